"""Guided tours over the assembled graph: learn, recall, questions and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import graph, ranking


def cycle_partners(cycles: DataFrame) -> DataFrame:
    """Smallest other member of any cycle of a node. ``cycles``: path (array of nodes)."""
    c = cycles.select(F.explode("path").alias("id"), "path")
    return c.select("id", F.array_min(F.filter("path", lambda x: x != F.col("id"))).alias("partner")).groupBy("id").agg(F.min("partner").alias("partner"))


def facts(role_label: Column, in_degree: Column, out_degree: Column) -> Column:
    """C27."""
    return F.array(role_label, F.concat(F.lit("imported by "), in_degree.cast("string")), F.concat(F.lit("imports "), out_degree.cast("string")))


def questions(files: DataFrame, cycles: DataFrame) -> DataFrame:
    """One text per flag, in flag order. ``files``: id, flags, size."""
    f = files.join(cycle_partners(cycles), "id", "left")
    return f.withColumn("questions", F.transform("flags", lambda x: S.question_text(x, F.col("size"), F.col("partner")))).drop("partner")


def learn(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Important files by layer tier, then Kahn rank, importance and id.

    ``files``: id, importance, flags, tier.
    """
    keep = ranking.important_ids(files)
    rank = graph.kahn_order(edges).select(F.col("node").alias("id"), "rank")
    f = files.join(keep, "id", "left_semi").join(rank, "id", "left")
    return f.orderBy("tier", F.col("rank").asc_nulls_last(), F.desc("importance"), "id").select("id", "tier", "rank")


def by_question(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Files of the hits by Kahn rank, then by retrieval rank. ``hits``: file_path, place."""
    best = hits.groupBy(F.col("file_path").alias("id")).agg(F.min("place").alias("place"))
    rank = graph.kahn_order(edges).select(F.col("node").alias("id"), "rank")
    return best.join(rank, "id", "left").orderBy(F.col("rank").asc_nulls_last(), "place").select("id", "rank", "place")
