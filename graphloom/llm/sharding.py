"""Operator 3: uniform shuffle into shards of exact sizes.

Method: a hypergeometric communication matrix.  Rows fall into hashed partitions; the
number of rows each partition sends to each shard is drawn from the multivariate
hypergeometric law that a uniformly random permutation induces; every partition permutes
its rows and cuts them by its drawn counts; rows are exchanged; every shard permutes again.
Only the partition counts (at most 65,536) and the drawn matrix pass the driver.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread_bits, spread_rank


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One exact draw by inversion outward from the mode; cost grows with the spread only."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    up, down, pu, pd = mode, mode, p, p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > lo:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Rows and columns sum to the given totals; distributed as under a uniform permutation."""
    rng, left, out = random.Random(seed), list(columns), []
    for n in rows:
        line, total = [], sum(left)
        for s, m in enumerate(left):
            k = n if s == len(left) - 1 else hypergeometric(rng, m, total - m, n)
            line.append(k)
            n -= k
            total -= m
        left = [m - k for m, k in zip(left, line, strict=True)]
        out.append(line)
    return out


def shard(docs: DataFrame, *, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals every row into ``shards`` shards whose row counts differ by at most one.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law = 'rows', shard, slot
    (0-based place in the shard, gapless) and grown_shard (null under this law).
    A null text has no bytes and crc32 0; an empty text likewise.  Null and repeated ids
    are kept, one output row per input row.  Rows are hashed with their place in the input,
    so any number of equal rows, or of null ids, spreads over all partitions; a rerun over
    the same files agrees.  A text of any length is only measured and summed.  An empty table
    gives an empty result.  Other columns are ignored, whatever their names.
    The first ``rows mod shards`` shards hold the extra row.  The draws are exact as far as
    ``lgamma`` is: beyond some 10**10 rows their probabilities carry errors of about 10**-5.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialize(rows.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", F.monotonically_increasing_id())), "shard-rows")
    total = rows.count()
    bits = spread_bits(total)
    rows = rows.withColumn("__p", F.shiftrightunsigned("__h", 64 - bits))
    counts = {r[0]: r[1] for r in rows.groupBy("__p").count().collect()}  # at most 2**16 rows
    parts = sorted(counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    ends = []
    for p, line in zip(parts, matrix, strict=True):
        cum, acc = [], 0
        for k in line:
            acc += k
            cum.append(acc)
        ends.append((p, cum))
    cuts = spark.createDataFrame(ends, "__p long, __cum array<long>")
    local = Window.partitionBy("__p").orderBy("__o", "doc_id", "text_crc32")
    dealt = (
        rows.withColumn("__o", F.xxhash64(F.lit(seed + 1), "__h"))
        .join(cuts, "__p")
        .withColumn("__r", F.row_number().over(local))
        .withColumn("shard", F.aggregate("__cum", F.lit(0), lambda acc, c: acc + F.when(c < F.col("__r"), 1).otherwise(0)))
        .select("doc_id", "size", "text_crc32", "shard", F.xxhash64(F.lit(seed + 2), "__h", "shard").alias("__o"))
    )
    dealt = materialize(dealt, "shard-dealt")
    dealt = dealt.withColumn("__b", F.shiftrightunsigned("__o", 64 - max(2, spread_bits(total // shards))))
    placed = spread_rank(dealt, ["shard"], "__b", [F.col("__o"), F.col("doc_id"), F.col("text_crc32")], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
