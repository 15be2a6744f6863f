"""Iterative graph algorithms as bounded loops of joins over shared-folder tables.

Steps are written once to the folder named by ``spark.checkpoint.dir``, so lineage stays
short and lost executors cost one step.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V


#: rows of a step's table up to which all tasks may get it whole: some 2 MB as a hash table, in each join of each step
SENT_ROWS = 20_000


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_graphloom_tmp", None) or tempfile.mkdtemp(prefix="graphloom-")
        spark._graphloom_tmp = base
    return base.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{_shared(spark)}/graphloom-steps/{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _write(df: DataFrame, path: str, *metrics: Column) -> dict:
    """Writes a table and returns its row count ``n`` and other totals, observed in the same job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *metrics).write.parquet(path)
    return seen.get


def read_back(spark: SparkSession, schema: T.StructType, rows: int, *paths: str) -> DataFrame:
    """A step's table; told by its rows, not by its files, whether a join may send it through the driver.

    Files are small for their rows, so Spark would often broadcast a table of a row per node,
    once for each join of a loop.  Only short tables of plain columns are, others meet by sorted keys.
    """
    plain = not any(isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) for f in schema)
    return spark.read.schema(schema).parquet(*paths).hint("broadcast" if plain and rows <= SENT_ROWS else "merge")


def settle(df: DataFrame) -> DataFrame:
    """Writes a step's table and reads it back."""
    return settle_counted(df)[0]


def settle_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A step's table, written and read back, and its number of rows."""
    path = new_folder(df.sparkSession)
    n = _write(df, path)["n"]
    return read_back(df.sparkSession, df.schema, n, path), n


class Steps:
    """Rows that a loop finds step by step: each step is written once, all are read together."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.schema, self.paths, self.rows = spark, new_folder(spark), None, [], []

    def add(self, df: DataFrame) -> DataFrame:
        """Writes the next step; ``last`` is its number of rows."""
        self.schema = self.schema or df.schema
        self.paths.append(f"{self.base}/{len(self.paths)}")
        self.rows.append(_write(df, self.paths[-1])["n"])
        return self.step(len(self.paths) - 1)

    @property
    def last(self) -> int:
        return self.rows[-1] if self.rows else 0

    def step(self, n: int) -> DataFrame:
        return read_back(self.spark, self.schema, self.rows[n], self.paths[n])

    def all(self) -> DataFrame:
        return read_back(self.spark, self.schema, sum(self.rows), *self.paths)


def in_order(df: DataFrame, order: list[Column | str], **sums: str) -> DataFrame:
    """Adds ``place`` (from 1) in a global order and, for each ``new=column``, the sum of column up to the row.

    Rows go to ranges of the order; totals per range, a row each, are all that one task
    sees of the whole, and windows run inside ranges.
    """
    placed = settle(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    totals = {"__n": F.count(F.lit(1)), **{f"__{new}": F.sum(c) for new, c in sums.items()}}
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("__p").agg(*(c.alias(k) for k, c in totals.items())).select("__p", *(F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in totals))
    inside = Window.partitionBy("__p").orderBy(*order)
    out = placed.join(F.broadcast(base), "__p").withColumn("place", F.col("__n") + F.row_number().over(inside))  # a row per shuffle partition
    for new, c in sums.items():
        out = out.withColumn(new, F.col(f"__{new}") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("__p", *totals)


def components(edges: DataFrame, a: str = "source", b: str = "target", rounds: int = 60) -> DataFrame:
    """Undirected components, (node, component = smallest node), by alternating star contraction.

    For every node that has an edge.  Minima are map-side combined and come back by plain
    equi-joins, whose skewed partitions adaptive execution can split.  Raises beyond
    ``rounds`` rounds; a chain of n links takes about log2(n).
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()

    def step(df: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = new_folder(spark)
        seen = _write(df, path, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        return path, read_back(spark, pairs.schema, seen["n"], path), (seen["n"], seen["sum"])

    path, now, seen = step(pairs)
    for _ in range(rounds if seen[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined: a star's centre is then a skewed join, which is split
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = settle(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        was, old = seen, path
        path, now, seen = step(small)
        delete_folder(spark, old)
        if was == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """Nodes reachable from ``starts`` (column node) with their distance; starts have 0.

    Breadth first by frontier joins; a node enters once, and each level is written once.
    """
    s, t = ("target", "source") if reverse else ("source", "target")
    ways = settle(edges.select(F.col(s).alias("node"), F.col(t).alias("to")).distinct())
    steps = Steps(edges.sparkSession)
    front, d = steps.add(starts.select("node").distinct().withColumn("depth", F.lit(0))), 0
    while depth is None or d < depth:
        d += 1
        nxt = front.select("node").join(ways, "node").select(F.col("to").alias("node")).distinct().join(steps.all().select("node"), "node", "left_anti")
        front = steps.add(nxt.withColumn("depth", F.lit(d)))
        if not steps.last:
            break
    return steps.all()


def bfs_flow(edges: DataFrame, starts: list, depth: int = V.BFS_DEPTH, most: int = V.BFS_NODES) -> list[tuple]:
    """Capped breadth-first visit in queue order from the first starts; edges of every visited node.

    The cap of 50 nodes makes this a driver-side report: only nodes that are visited are looked up.
    """
    queue = [(s, 0) for s in starts[: V.BFS_STARTS]]
    seen, out = set(), []
    while queue and len(seen) < most:
        level = {}
        for n, d in queue:
            if n not in seen and len(seen) + len(level) < most:
                level.setdefault(n, d)
        queue = []
        near: dict = {}
        for r in edges.where(F.col("source").isin(list(level))).select("source", "target").distinct().collect():
            near.setdefault(r["source"], []).append(r["target"])
        for n, d in level.items():
            seen.add(n)
            for m in sorted(near.get(n, [])):
                out.append((n, m))
                if d < depth and m not in seen:
                    queue.append((m, d + 1))
    return out


def dag_tiers(edges: DataFrame) -> DataFrame:
    """G8 on acyclic graphs: (node, tier), tier = longest path from a node nothing points to.

    Peeling gives each node its longest path; nodes that it never frees prove a cycle, and raise.
    """
    nodes = settle(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct())
    tiers = kahn_levels(edges).withColumnRenamed("level", "tier")
    if not nodes.join(tiers, "node", "left_anti").isEmpty():
        raise RuntimeError("the graph has a cycle")
    return tiers


def kahn_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """G10 levels: peel nodes without remaining incoming edges; nodes on or behind cycles are left out.

    Only nodes behind the level just freed can come free, so each round looks at their
    edges alone, and writes nothing but them and the next level.
    """
    pairs = settle(edges.select("source", "target").distinct())
    known = nodes is not None
    all_nodes = settle((nodes if nodes is not None else pairs.select(F.explode(F.array("source", "target")).alias("node"))).select("node").distinct())
    steps, level = Steps(edges.sparkSession), 0
    free = steps.add(all_nodes.join(pairs.select(F.col("target").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)))
    while steps.last:
        level += 1
        next_to = free.select(F.col("node").alias("source")).join(pairs, "source").select(F.col("target").alias("node")).distinct()
        next_to = settle(next_to.join(all_nodes, "node", "left_semi") if known else next_to)
        waits = pairs.join(next_to.select(F.col("node").alias("target")), "target", "left_semi").join(steps.all().select(F.col("node").alias("source")), "source", "left_anti").select(F.col("target").alias("node"))
        free = steps.add(next_to.join(waits, "node", "left_anti").withColumn("level", F.lit(level)))
    return steps.all()


def kahn_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Exact rank of the sorted FIFO order: by level, then by the last predecessor's rank, then name.

    The last predecessor in order lies one level up, so a level needs the ranks of the one
    before only.
    """
    levels = kahn_levels(edges, nodes)
    counts = {r["level"]: r["n"] for r in levels.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per level
    pairs = settle(edges.select("source", "target").distinct())
    steps, base, last = Steps(edges.sparkSession), 0, None
    for k in sorted(counts):
        now = levels.where(F.col("level") == k).select("node")
        if last is None:
            now = now.withColumn("last", F.lit(0).cast("long"))
        else:
            now = last.select(F.col("node").alias("source"), "rank").join(pairs, "source").groupBy(F.col("target").alias("node")).agg(F.max("rank").alias("last")).join(now, "node", "left_semi")
        last = steps.add(in_order(now, ["last", "node"]).select("node", (F.lit(base) + F.col("place")).cast("long").alias("rank")))
        base += counts[k]
    return steps.all() if counts else levels.select("node", F.col("level").cast("long").alias("rank"))


def leftovers(edges: DataFrame) -> DataFrame:
    """O3: nodes that peeling never frees: those on cycles, and all behind them."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return nodes.join(kahn_levels(edges).select("node"), "node", "left_anti")


def has_cycle(edges: DataFrame) -> bool:
    """Some node is never freed by peeling."""
    return not leftovers(edges).isEmpty()


def canonical_cycle(path: Column) -> Column:
    """Rotates a cycle (without its closing node) to start at the smallest node."""
    at = F.array_position(path, F.array_min(path)).cast("int")
    return F.concat(F.slice(path, at, F.size(path)), F.slice(path, F.lit(1), at - 1))


def cycles_bounded(edges: DataFrame, most: int = 3) -> DataFrame:
    """All simple cycles of 2 to ``most`` nodes, canonical and distinct.

    Paths grow only over nodes larger than their first, so each cycle arises once.
    """
    pairs = settle(edges.select("source", "target").where("source <> target").distinct())
    paths = pairs.where("target > source").select(F.col("source").alias("first"), F.col("target").alias("last"), F.array("source", "target").alias("path"))
    found = None
    for n in range(2, most + 1):
        closed = paths.join(pairs, (F.col("last") == F.col("source")) & (F.col("first") == F.col("target"))).select("path")
        found = closed if found is None else found.unionByName(closed)
        if n < most:
            paths = settle(paths.join(pairs, F.col("last") == F.col("source")).where((F.col("target") > F.col("first")) & ~F.array_contains("path", F.col("target"))).select("first", F.col("target").alias("last"), F.concat("path", F.array("target")).alias("path")))
    return found.select(F.size("path").alias("length"), "path")


def cycles_sequential(edges: list[tuple]) -> list[list]:
    """The traversal-dependent subset of cycles that a depth-first walk in sorted order meets.

    For small graphs only (layers, fixtures): the walk is sequential by definition.
    """
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    order = {a: sorted(b) for a, b in near.items()}
    done: set = set()
    raw: list[list] = []
    for root in sorted(order):
        if root in done:
            continue
        path, inside, stack = [root], {root}, [iter(order.get(root, []))]
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                stack.pop()
                node = path.pop()
                inside.discard(node)
                done.add(node)
            elif nxt in inside:
                raw.append(path[path.index(nxt) :])
            elif nxt not in done:
                path.append(nxt)
                inside.add(nxt)
                stack.append(iter(order.get(nxt, [])))
    seen, out = set(), []
    for c in raw:
        k = c.index(min(c))
        c = c[k:] + c[:k]
        if tuple(c) not in seen:
            seen.add(tuple(c))
            out.append(c)
    return sorted(out, key=len)


def tiers_sequential(nodes: list, edges: list[tuple]) -> dict:
    """G8 with cycles: in-place sweeps in list order, at most n + 1 of them. For layer graphs."""
    tier = dict.fromkeys(nodes, 0)
    for _ in range(len(nodes) + 1):
        moved = False
        for a, b in edges:
            if a in tier and b in tier and tier[b] < tier[a] + 1:
                tier[b] = tier[a] + 1
                moved = True
        if not moved:
            break
    return tier


def label_propagation(files: DataFrame, edges: DataFrame, group: str = "layer", sweeps: int = V.LABEL_SWEEPS) -> DataFrame:
    """Communities per group by in-place sweeps over sorted nodes of the undirected induced graph.

    A node takes the commonest label around it, the smallest among equals, and sees what
    nodes before it took in the same sweep: sequential within a group by definition, so each
    group is one grouped call over index arrays (some 20 bytes an edge).  Returns group,
    node, community.
    """
    import numpy as np
    import pandas as pd

    inside = edges.select("source", "target").distinct()
    side = files.select(F.col(group).alias("g"), F.col("path").alias("p"))
    e = inside.join(side.select(F.col("p").alias("source"), "g"), "source").join(side.select(F.col("p").alias("target"), F.col("g").alias("g2")), "target").where("g = g2 and source <> target")
    rows = side.select("g", F.col("p").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(e.select("g", F.col("source").alias("a"), F.col("target").alias("b")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf["a"].to_numpy(dtype=object).astype(str))
        links = pdf.dropna(subset=["b"])
        ends = [np.searchsorted(names, links[c].to_numpy(dtype=object).astype(str)) for c in ("a", "b")]
        both = np.unique(np.stack([np.concatenate(ends), np.concatenate(ends[::-1])]), axis=1) if len(links) else np.zeros((2, 0), np.int64)
        borders = np.searchsorted(both[0], np.arange(len(names) + 1))
        linked = np.flatnonzero(np.diff(borders))
        label = np.arange(len(names))
        for _ in range(sweeps):
            before = label.copy()
            for n in linked.tolist():
                met, times = np.unique(label[both[1, borders[n] : borders[n + 1]]], return_counts=True)
                label[n] = met[times.argmax()]
            if (label == before).all():
                break
        return pd.DataFrame({"g": pdf["g"].iloc[0], "node": names, "community": names[label]})

    return rows.groupBy("g").applyInPandas(run, "g string, node string, community string").withColumnRenamed("g", group)


def shortest_path(edges: DataFrame, starts: list, exits: list) -> list | None:
    """Breadth-first path from the first start that reaches any exit; null if none does.

    Levels hold each new node with its parent and its place in the queue; a level is a join,
    and only the one path is read back.
    """
    spark, goals = edges.sparkSession, set(exits)
    kind = edges.schema["source"].dataType.simpleString()
    ways = settle(edges.select(F.col("source").alias("node"), F.col("target").alias("to")).distinct())
    goal = spark.createDataFrame([(x,) for x in goals], f"node {kind}")
    for s in starts:
        if s in goals:
            return [s]
        steps = Steps(spark)
        front = steps.add(spark.createDataFrame([(s, None, 1)], f"node {kind}, parent {kind}, place long"))
        while steps.last:
            nxt = front.select("node", "place").join(ways, "node").groupBy(F.col("to").alias("node")).agg(F.min(F.struct("place", "node")).alias("from")).join(steps.all().select("node"), "node", "left_anti")
            nxt = nxt.select("node", F.col("from.node").alias("parent"), F.col("from.place").alias("turn"))
            front = steps.add(in_order(nxt, ["turn", "node"]).select("node", "parent", "place"))
            met = front.join(goal, "node", "left_semi").orderBy("place").limit(1).collect()
            if met:
                path = [met[0]["node"], met[0]["parent"]]
                for k in range(len(steps.paths) - 2, 0, -1):
                    path.append(steps.step(k).where(F.col("node") == path[-1]).first()["parent"])
                return path[::-1]
    return None


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected neighbour pairs."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"))).distinct()


def universe(edges: DataFrame, files: DataFrame) -> DataFrame:
    """O1: every id that is an end of an edge or a file."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).unionByName(files.select("id")).distinct()


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among ``keep`` (column node)."""
    k = keep.select("node").distinct()
    return edges.join(k.select(F.col("node").alias("source")), "source", "left_semi").join(k.select(F.col("node").alias("target")), "target", "left_semi").select(*edges.columns)


def tour(edges: DataFrame, files: DataFrame, most: int = 25, tier: Callable[[], Column] | None = None) -> DataFrame:
    """Kahn-ordered files, then the rest by importance and name.

    ``files``: id, importance (and ``tier`` if a tier column is to lead the order).
    """
    rank = kahn_order(edges, files.select(F.col("id").alias("node")).unionByName(edges.select(F.explode(F.array("source", "target")).alias("node"))).distinct())
    f = files.join(rank.select(F.col("node").alias("id"), "rank"), "id", "left")
    lead = [F.col("tier")] if tier else []
    w = [*lead, F.col("rank").asc_nulls_last(), F.desc("importance"), F.col("id")]
    return f.orderBy(*w).limit(most).select("id", "rank")
