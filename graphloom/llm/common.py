"""Shared plumbing of the training-data operators.

* ``work_dir`` / ``materialize``: tables written to the shared folder named by
  ``spark.checkpoint.dir``; they cut lineage and survive lost executors.
* ``spread_rank``: row numbers and running sums inside arbitrarily large
  groups, in two levels, so that no group is ever gathered into one task.
* ``materialize_bucketed``: a written table that later joins need not move.
* ``components``: connected components by the graph engine's star contraction.
* ``text_slices``: bounded numpy views of Arrow string columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph

SLICE_BYTES = 1 << 20


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs in one process.

    Executors on other machines cannot see a temporary folder, so without a shared one they
    get an error instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_graphloom_dir", None)
        if not base:
            base = tempfile.mkdtemp(prefix="graphloom-")
            spark._graphloom_dir = base
    return base.rstrip("/")


_scratch: ContextVar[list[str] | None] = ContextVar("graphloom_scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    if (made := _scratch.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession, keep: str) -> Iterator[None]:
    """Deletes the intermediate tables made inside, once what is to stay is written to ``keep``.

    Operators return lazy results over such tables, so write the result before leaving.
    """
    token = _scratch.set([])
    try:
        yield
    finally:
        for path in _scratch.get() or []:
            if path != keep:
                delete_path(spark, path)
        _scratch.reset(token)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a durable lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``materialize``, in ``buckets`` files by the hash of ``key``: joins on it then move only the other side.

    Spark reads buckets only through its catalog, so the table is registered, resolved and
    taken out of the catalog again; the returned plan holds its files.
    """
    spark = df.sparkSession
    table = f"graphloom_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", new_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread_bits(rows: int, most: int = 16) -> int:
    """log2 of a bucket count near sqrt(rows): buckets and their contents grow alike."""
    return min(most, max(2, (max(rows, 1).bit_length() + 1) // 2))


def spread_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], rank: str, **before: str) -> DataFrame:
    """Adds ``rank`` (0-based) and, for each ``new=column``, the sum of column over earlier rows, per group.

    Rows are ordered by ``bucket`` and then by ``order``.  Per-bucket totals are summed
    first (map-side combined); one window runs over those totals and another inside each
    (group, bucket), so the largest task holds one bucket instead of one group.
    Group columns must not hold nulls; without any, the whole table is one group.
    """
    keys = [*group, bucket]
    sums = {"__n0": F.lit(1), **{f"__s_{new}": F.col(c) for new, c in before.items()}}
    totals = df.groupBy(*keys).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, *(F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(totals, keys).withColumn(rank, F.col("__n0") + F.count(F.lit(1)).over(inside))
    for new, c in before.items():
        out = out.withColumn(new, F.col(f"__s_{new}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop(*sums)


def range_parts(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``__p``, the number of the row's range in the given order, for ``spread_rank`` without a hash to bucket by.

    Written to the shared folder, so that a lost executor cannot deal the ranges anew.
    """
    return materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), name)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component = smallest node reachable) of an undirected edge table of longs, for every node with an edge."""
    return graph.components(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), "a", "b")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into row ranges of at most ``limit`` text bytes (one row at least).

    Yields (rows, bytes as uint8, offsets from 0); a null text has no bytes.
    """
    arr = batch.column(batch.schema.get_field_index(column))
    if len(arr) == 0:
        return
    if not pa.types.is_string(arr.type) and not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    wide = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=wide)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    if arr.null_count:
        # null slots may cover bytes in principle; rebuild without them
        arr = arr.fill_null("")
        bufs = arr.buffers()
        off = np.frombuffer(bufs[1], dtype=wide)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(arr)
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
