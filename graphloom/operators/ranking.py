"""Order, top-k, dedupe and window-shaped operators."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalars as S
from .graph import in_order, settle

#: layers of a model up to which its repeats are kept for equal models of a task
SHORT = 256


def first_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """First occurrence per (source, target); a map-side combined minimum, no sort of groups."""
    rest = [c for c in edges.columns if c not in ("source", "target", *order)]
    g = edges.groupBy("source", "target").agg(F.min(F.struct(*order, *rest)).alias("e"))
    return g.select("source", "target", *[F.col(f"e.{c}").alias(c) for c in [*order, *rest]])


def collapsed_graph(nodes: DataFrame, edges: DataFrame, limit: int = V.GRAPH_NODES) -> tuple[DataFrame, DataFrame]:
    """At most ``limit`` nodes; the rest become ``__collapsed__`` with summed degrees.

    ``nodes``: id, importance, in_degree, out_degree.  Edges are first-wins deduped, then
    rerouted, without sentinel self-loops, and deduped again.  Only ``limit`` kept ids are
    broadcast.
    """
    # at most one row more than the limit is ranked and broadcast
    best = nodes.orderBy(F.desc("importance"), "id").limit(limit + 1).select("id", F.row_number().over(Window.orderBy(F.desc("importance"), "id")).alias("n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("all"))
    kept = F.broadcast(best.where((F.col("n") < limit) | (F.col("all") <= limit)).select("id"))
    name = F.when(F.col("k.id").isNotNull(), F.col("n.id").cast("string")).otherwise("__collapsed__")
    out = nodes.alias("n").join(kept.alias("k"), F.col("n.id") == F.col("k.id"), "left").select(name.alias("id"), "n.in_degree", "n.out_degree")
    out = out.groupBy("id").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    pairs = edges.select("source", "target").distinct()
    a, b = kept.select(F.col("id").alias("a")), kept.select(F.col("id").alias("b"))
    re = pairs.join(a, F.col("source") == F.col("a"), "left").join(b, F.col("target") == F.col("b"), "left")
    end = lambda k, c: F.when(F.col(k).isNotNull(), F.col(c).cast("string")).otherwise("__collapsed__")
    re = re.select(end("a", "source").alias("source"), end("b", "target").alias("target")).distinct()
    return out, re.where(~((F.col("source") == "__collapsed__") & (F.col("target") == "__collapsed__")))


def percentile_floor(values: DataFrame, column: str, share: float) -> DataFrame:
    """Element ceil(n * share) of the positive values in descending order; 0 without any.

    One row.  The value is found on the histogram of distinct values, summed by ranges.
    """
    counts = values.where(F.col(column) > 0).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = in_order(counts, [F.desc("v")], upto="n")
    total = ranked.agg(F.sum("n").alias("__all"))
    return ranked.crossJoin(F.broadcast(total)).where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("__all") * share))).agg(F.coalesce(F.max("v"), F.lit(0)).alias("floor"))  # one row


def flags(files: DataFrame) -> DataFrame:
    """Adds flags in fixed order; ``files``: id, in_degree, size, is_entry, in_cycle."""
    hub = percentile_floor(files, "in_degree", V.HUB_SHARE).withColumnRenamed("floor", "__hub")
    god = percentile_floor(files, "size", V.GOD_SHARE).withColumnRenamed("floor", "__god")
    f = files.crossJoin(F.broadcast(hub)).crossJoin(F.broadcast(god))  # one row each
    hub_at = F.greatest(F.lit(1), F.least(F.lit(V.HUB_MOST), F.col("__hub")))
    god_at = F.greatest(F.lit(1), F.least(F.lit(V.GOD_MOST), F.col("__god")))
    tests = [("orphan", (F.col("in_degree") == 0) & ~F.col("is_entry")), ("in_cycle", F.col("in_cycle")), ("hub", F.col("in_degree") >= hub_at), ("entry_point", F.col("is_entry")), ("god_file", F.col("size") >= god_at)]
    return f.withColumn("flags", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests]), lambda x: x.isNotNull())).drop("__hub", "__god")


def flag_counts(flagged: DataFrame) -> DataFrame:
    """Count per flag, none without files."""
    order = F.array_position(F.array(*[F.lit(x) for x in V.FLAG_ORDER]), F.col("flag"))
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("files")).orderBy(order)


def important_ids(files: DataFrame, top: int = V.TOUR_TOP) -> DataFrame:
    """The ``top`` files by importance and every flagged file."""
    best = files.select("id", "importance").orderBy(F.desc("importance"), "id").limit(top).select("id")
    return best.unionByName(files.where(F.size("flags") > 0).select("id")).distinct()


def recall_order(files: DataFrame) -> DataFrame:
    """Importance, then flagged first, then id. Adds ``order`` over the important files."""
    marked = files.withColumn("__flagged", F.size("flags") > 0)
    return in_order(marked, [F.desc("importance"), F.desc("__flagged"), F.col("id")]).drop("__flagged").withColumnRenamed("place", "order")


def profile_order(files: DataFrame, scan: str) -> DataFrame:
    """Place by importance, equals in order of the scan."""
    return in_order(files, [F.desc("importance"), F.col(scan)])


def best_hits(hits: DataFrame, key: list[str], limit: int | None = None) -> DataFrame:
    """Highest score per key, then by score (top-k report if ``limit``)."""
    rest = [c for c in hits.columns if c not in ("score", *key)]
    g = hits.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), *rest)).alias("h"))
    out = g.select(*key, (-F.col("h.s")).alias("score"), *[F.col(f"h.{c}").alias(c) for c in rest]).orderBy(F.desc("score"), *key)
    return out if limit is None else out.limit(limit)


def with_island(rows: DataFrame, partition: list[str], order: list[str], signature: str) -> DataFrame:
    """Adds the number of the run of equal signatures that a row belongs to."""
    w = Window.partitionBy(*partition).orderBy(*order)
    starts = F.when(F.lag(signature).over(w).eqNullSafe(F.col(signature)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("__start", starts).withColumn("island", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def islands(rows: DataFrame, partition: list[str], order: list[str], signature: str) -> DataFrame:
    """Consecutive rows of equal signature folded to one with its length."""
    r = with_island(rows, partition, order, signature)
    return r.groupBy(*partition, "island").agg(F.first(signature).alias(signature), F.count(F.lit(1)).alias("repeat"))


def disambiguate(labels: DataFrame) -> DataFrame:
    """Shortest path suffix, grown a part per round only while labels clash.

    ``labels``: id (path).  A label's clash count is a window over equal labels; each round
    is written to the shared folder, and rounds end when nothing can grow.
    """
    parts = F.split("id", "/")
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(F.col("n") - k + 1, F.lit(1)), F.least(k, F.col("n"))), "/")
    now = labels.select("id", F.size(parts).alias("n"), F.lit(1).alias("k"))
    while True:
        w = Window.partitionBy("label")
        clash = (F.min("id").over(w) != F.max("id").over(w)) & (F.col("k") < F.col("n"))
        now = settle(now.withColumn("label", tail(F.col("k"))).withColumn("grow", clash).select("id", "n", (F.col("k") + F.col("grow").cast("int")).alias("k"), "grow"))
        if now.where("grow").isEmpty():
            break
        now = now.drop("grow")
    return now.select("id", tail(F.col("k")).alias("label"))


def folder_labels(folders: DataFrame) -> DataFrame:
    """Folders of equal last part get trailing parts from two up until distinct within the group."""
    parts = F.split("id", "/")
    base = folders.select("id", F.size(parts).alias("n"), S.basename(F.col("id")).alias("g"))
    alone = base.groupBy("g").agg(F.countDistinct("id").alias("members"))
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(F.col("n") - k + 1, F.lit(1)), F.least(k, F.col("n"))), "/")
    depth = base.groupBy("g").agg(F.max("n").alias("deepest"))
    # smallest k at which all labels of a group differ
    levels = base.join(alone, "g").join(depth, "g").withColumn("k", F.explode(F.sequence(F.when(F.col("members") > 1, 2).otherwise(1), F.greatest(F.col("deepest"), F.lit(2))))).withColumn("label", tail(F.col("k")))
    ok = levels.groupBy("g", "k").agg((F.countDistinct("label") == F.countDistinct("id")).alias("ok"), F.max("deepest").alias("deepest"))
    best = ok.groupBy("g").agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("k"))), F.max("deepest")).alias("best"))
    return levels.join(best, "g").where("k = best").select("id", "label")


def periodic_runs(signature: list, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, period, count) of the repeats that a sequence is told by, without overlap.

    A run of period p is a longest stretch where every item equals that p places before;
    it counts if it holds ``least`` whole periods and no smaller period covers its block.
    Of all runs the widest is taken first, then the smaller period, then the earlier one.
    """
    import numpy as np

    codes = np.unique(np.array(signature, dtype=object).astype(str), return_inverse=True)[1]
    n, runs = len(codes), []
    for period in range(1, n // least + 1):
        same = np.concatenate([[False], codes[period:] == codes[:-period], [False]])
        turn = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)  # equal stretches, end exclusive
        for start, end in turn.tolist():
            count = (end - start) // period + 1
            block = codes[start : start + period]
            smaller = any(period % d == 0 and (block == np.tile(block[:d], period // d)).all() for d in range(1, period))
            if count >= least and not smaller:
                runs.append((start, period, count))
    free, taken = np.ones(n, bool), []
    for start, period, count in sorted(runs, key=lambda r: (-r[1] * r[2], r[1], r[0])):
        if free[start : start + period * count].all():
            free[start : start + period * count] = False
            taken.append((start, period, count))
    return sorted(taken)


def label_repeats(models: DataFrame, least: int = 2) -> DataFrame:
    """W16 per model: ``models`` has model, pos, signature.

    The choice is sequential within a model, so each model is one row, its list of layers;
    a task looks once at short lists that are equal.  Small as the rows are, they are dealt
    over all tasks.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = functools.lru_cache(4096)(lambda signature: periodic_runs(list(signature), least))
        for b in batches:
            names, layers = b.column("model").to_pylist(), b.column("layers").to_pylist()
            runs = [short(tuple(x)) if len(x) <= SHORT else periodic_runs(x, least) for x in layers]
            rows = [(m, *r) for m, found in zip(names, runs, strict=True) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, [pa.string(), *[pa.int64()] * 3], strict=True)], ["model", "start", "length", "count"])

    tasks = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = models.repartition(tasks, "model").groupBy("model").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("signature").alias("s")).alias("l")))).alias("p"))
    return listed.select(F.col("model").cast("string").alias("model"), F.col("p.l.s").alias("layers")).mapInArrow(find, "model string, start long, length long, count long")
