"""A corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; its
decisions take effect.  All but the last return the columns of the documents, unchanged
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import mixing, quality, sharding, simhash, winnow
from graphloom.llm.common import delete_path, new_path, scratch


def _aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but the used ones renamed, so that none clashes with an operator's, and the way back."""
    names = {c: c if c in used else f"__own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below its threshold) go.

    Null and empty texts are scored on empty statistics, so they go or stay together; rows
    with null or repeated ids are judged by their own text, and equal texts alike.  A text
    of any length is judged whole.  Without labels every score is 0.5 and all stay.  An empty
    table stays empty; other columns, whatever their names, stay as they are.
    """
    docs, back = _aside(docs, "doc_id", "text")
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, forest).where("predicted = 1").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; a null id only where there is no other.

    Links are SimHash distances that a similarity of 0.8 in five-word shingles comes to (see
    ``simhash.keep_one``).  Null, empty and blank texts are one group.  Of rows equal in id
    and text one stays, whichever.  A text of any length is hashed whole.  An empty table
    stays empty; other columns stay as they are.
    """
    docs, back = _aside(docs, "doc_id", "text")
    return simhash.keep_one(docs).select(*back)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: a twentieth of their words or more lies in benchmark windows.

    Null and blank texts have no words and stay; equal texts, repeated rows and null ids are
    judged alike, by the text.  A text of any length is scanned whole.  Without items nothing
    goes.  An empty table stays empty; other columns stay as they are.
    """
    docs, back = _aside(docs, "doc_id", "text")
    return winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it, rounded to whole documents.

    A document without words (null, empty, blank) weighs nothing and stays once.  Rows equal
    in id, source and text share their copies evenly, ties in any order.  A null source is a
    source of its own.  A very long text is one document, taken or not as a whole.  An empty
    table stays empty; other columns stay as they are, on every copy.
    """
    docs, back = _aside(docs, "doc_id", "text", "source")
    taken = mixing.mix_taken(docs, source_col="source").withColumn("__copies", F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))))
    copies = taken.groupBy("__ra", "__rb").agg(F.sum("__copies").cast("int").alias("__all"), F.count(F.lit(1)).cast("int").alias("__same"))
    joined = docs.select("*", *mixing.row_keys("doc_id", "text", "source")).join(copies, ["__ra", "__rb"])
    turn = F.row_number().over(Window.partitionBy("__ra", "__rb").orderBy("doc_id"))
    own = F.floor(F.col("__all") / F.col("__same")) + F.when(turn <= F.col("__all") % F.col("__same"), 1).otherwise(0)
    return joined.withColumn("__own", own.cast("int")).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__own")))).select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; nothing goes.

    Null ids, null, empty and very long texts, ties and repeated rows are rows like any
    other.  An empty table gives no rows; other columns are left out.
    """
    return sharding.shard(docs)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources), ("shard", shard)]

#: the classifier, SimHash and the drawn matrix are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again.

    A stage's intermediate tables go when its result is written, and a stage's result goes
    when the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark, path):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
