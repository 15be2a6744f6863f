"""Thin adapters from the star-schema test tables to the engine's canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: id, path, name, folder, language, size, loc, functions; a row per node, never sent through the driver."""
    p = table(spark, sf_dir, "part")
    path = F.concat_ws("/", "p_type", "p_brand", F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")))
    return p.select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("p_name").alias("name"), F.col("p_type").alias("folder"), F.col("p_brand").alias("language"), F.round(F.col("p_retailprice") * 100).cast("long").alias("size"), F.col("p_size").alias("loc"), (F.col("p_size") % 7).alias("functions")).hint("merge")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive returned lines of an order as an import of the next part by the part."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return li.select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("type"), F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of another, known part. Part keys cover the lines' keys, checked by a semi-join."""
    i = imports(spark, sf_dir).where("target is not null and target <> source")
    return i.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target")).hint("merge"), "target", "left_semi").select("ord", "line", "type", "source", "target")


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a smaller to a larger key: acyclic."""
    return edges(spark, sf_dir).where("source < target")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as token usage: tokens = value * 100, provider = event type."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("provider"), F.round(F.col("value") * 100).cast("long").alias("tokens"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as two snapshots with added, deleted, changed and unchanged rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    new_text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n# changed"))).otherwise(F.col("text"))

    def prints(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"), F.md5("lang").alias("imports_hash"), F.md5("source").alias("exports_hash"), F.when(F.col("doc_id") % 21 == 0, F.md5(F.substring("text", -9, 9))).otherwise(F.md5("lang")).alias("structure_hash"), (F.col("doc_id") % 17 == 0).alias("parse_error"))

    return prints(d.where("doc_id % 13 <> 0")), prints(d.where("doc_id % 11 <> 0").withColumn("text", new_text))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with degrees: nulls are zero."""
    from ..operators.degrees import degrees

    return files(spark, sf_dir).join(degrees(edges(spark, sf_dir)).withColumnRenamed("file", "id"), "id", "left").na.fill(0, ["in_degree", "out_degree"])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks: layer by label."""
    e = table(spark, sf_dir, "embeddings")
    layer = F.when(F.col("label") % 3 == 0, "frontend").when(F.col("label") % 3 == 1, "services").otherwise("routes")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("file_path"), (F.col("vec_id") % 5).alias("start_line"), (F.col("vec_id") % 5).alias("end_line"), layer.alias("layer"), F.col("embedding").alias("vector"))
