"""Snapshot comparison: fingerprints, change classes, patches and diff tours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from . import degrees


def change_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """A.6: path and NONE, COSMETIC, STRUCTURAL or DELETED.

    Both sides: path, content_hash, imports_hash, exports_hash, structure_hash, parse_error.
    One full outer join on path classifies everything, deletions included.
    """
    o = old.select("path", *[F.col(c).alias(f"o_{c}") for c in ("content_hash", "imports_hash", "exports_hash", "structure_hash", "parse_error")], F.lit(True).alias("o_in"))
    n = new.select("path", *[F.col(c).alias(f"n_{c}") for c in ("content_hash", "imports_hash", "exports_hash", "structure_hash", "parse_error")], F.lit(True).alias("n_in"))
    j = o.join(n, "path", "full_outer")
    hollow = (F.col("o_imports_hash") == "") & (F.col("o_structure_hash") == "")
    equal = (F.col("o_imports_hash") == F.col("n_imports_hash")) & (F.col("o_exports_hash") == F.col("n_exports_hash")) & (F.col("o_structure_hash") == F.col("n_structure_hash"))
    full = (F.col("n_imports_hash") != "") & (F.col("n_structure_hash") != "")
    change = (
        F.when(F.col("n_in").isNull(), "DELETED")
        .when(F.col("o_in").isNull(), "STRUCTURAL")
        .when(F.col("o_content_hash") == F.col("n_content_hash"), "NONE")
        .when(F.col("n_parse_error") & (F.col("o_parse_error") | hollow), "COSMETIC")
        .when(equal & full, "COSMETIC")
        .otherwise("STRUCTURAL")
    )
    return j.select("path", change.alias("change"))


def update_policy(changes: DataFrame) -> DataFrame:
    """One row: how much to analyse anew."""
    c = changes.where("change <> 'DELETED'").agg(F.count_if(F.col("change") == "STRUCTURAL").alias("structural"), F.count(F.lit(1)).alias("files"))
    policy = (
        F.when(F.col("structural") == 0, "SKIP")
        .when((F.col("structural") >= V.FULL_FROM) | (F.col("structural") > V.FULL_SHARE * F.col("files")), "FULL_UPDATE")
        .when(F.col("structural") >= V.ARCHITECTURE_FROM, "ARCHITECTURE_UPDATE")
        .otherwise("PARTIAL_UPDATE")
    )
    return c.select("structural", "files", policy.alias("policy"))


def patched_edges(old: DataFrame, partial: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Old edges without changed sources and deleted ends, and the fresh ones."""
    gone = changed.select("path").unionByName(deleted.select("path")).distinct()
    kept = old.join(gone.withColumnRenamed("path", "source"), "source", "left_anti").join(deleted.select(F.col("path").alias("target")).distinct(), "target", "left_anti")
    return kept.select(*old.columns).unionByName(partial.select(*old.columns))


def patch_graph(old: DataFrame, partial: DataFrame, changed: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patched edges and central files of the patched graph."""
    edges = patched_edges(old, partial, changed, deleted)
    return edges, degrees.central_files(edges)


def diff_tour(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changed files that the graph has, structural first, then importance, then path.

    The order runs per change class, so no window covers unchanged files.
    """
    rank = F.when(F.col("change") == "STRUCTURAL", 0).otherwise(1)
    met = changes.where("change in ('STRUCTURAL','COSMETIC')").join(files.select(F.col("id").alias("path"), "importance"), "path").withColumn("rank", rank)
    return met.withColumn("place", F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("importance"), "path"))).select("path", "change", "importance", "rank", "place")


def deleted_count(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changes without a file in the graph."""
    return changes.join(files.select(F.col("id").alias("path")), "path", "left_anti").agg(F.count(F.lit(1)).alias("deleted"))
