"""Operator 6: embedding near-duplicates by PCA-ordered tiled comparison.

Method: unit vectors are rotated onto their principal axes, so that leading dimensions
carry most of a product.  Within a label they are cut along the first axis into blocks of
bounded rows; two blocks meet only if their ranges on that axis come within the largest
distance that the threshold allows.  The task of a pair of blocks orders both by the first
axis and compares tiles of them by blocks of dimensions: after each block, products are
bounded by the partial product plus the product of suffix norms, and pairs that cannot
reach the threshold go.  What is left is judged on the original vectors in double
precision.  Equal vectors are one class with a count throughout.

Vectors travel in their own type and are rotated where they meet.  A block is sent once to
each partner, so what moves grows with the rows times the blocks of their label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, materialize, spread_bits

THRESHOLD = 0.98
#: rows of a block (a task holds two) and of a tile
BLOCK, TILE = 16_384, 1024
LEAD, STEP = 8, 24
#: vectors per dimension from which the axes are estimated; axes only steer the cost
AXES_SAMPLE = 4096
SLACK = 1e-9
#: pairs judged at a time
PAIRS = 32_768


def axes(sample: np.ndarray) -> np.ndarray:
    """Rotation onto principal axes (of unit vectors, not centred), largest first."""
    _, vec = np.linalg.eigh(sample.T @ sample)
    return vec[:, ::-1].copy()


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, which is exact, so that no product overflows or vanishes."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Side:
    """Vectors of one block in order of the first axis, with what the bounds need."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray | None) -> None:
        z = unit(x)
        z = z if rotation is None else z @ rotation
        self.order = np.argsort(z[:, 0], kind="stable")
        self.x, self.z = scaled(x[self.order]), z[self.order]
        self.norm = np.sqrt(np.einsum("nd,nd->n", self.x, self.x))
        tail = np.sqrt(np.maximum(np.cumsum((self.z * self.z)[:, ::-1], axis=1)[:, ::-1], 0))
        self.suffix = np.concatenate([tail, np.zeros((len(x), 1))], axis=1)


def compare(a: Side, b: Side, i0: int, i1: int, j0: int, j1: int, threshold: float):
    """Yields index pairs (i, j) of a[i0:i1] and b[j0:j1] with cosine of at least the threshold.

    Where both sides are one, pairs with i < j only.
    """
    width = a.z.shape[1]
    lead = min(LEAD, width)
    part = a.z[i0:i1, :lead] @ b.z[j0:j1, :lead].T
    may = part + a.suffix[i0:i1, lead][:, None] * b.suffix[j0:j1, lead][None, :] >= threshold - SLACK
    if a is b:
        may &= np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None, :]
    every_i, every_j = np.nonzero(may)
    for at in range(0, len(every_i), PAIRS):
        i, j = every_i[at : at + PAIRS], every_j[at : at + PAIRS]
        dot, done = part[i, j], lead
        i, j = i + i0, j + j0
        while done < width and len(i):
            upto = min(width, done + STEP)
            dot = dot + np.einsum("nd,nd->n", a.z[i, done:upto], b.z[j, done:upto])
            ok = dot + a.suffix[i, upto] * b.suffix[j, upto] >= threshold - SLACK
            i, j, dot, done = i[ok], j[ok], dot[ok], upto
        ok = np.einsum("nd,nd->n", a.x[i], b.x[j]) / (a.norm[i] * b.norm[j]) >= threshold
        if ok.any():
            yield i[ok], j[ok]


def merge_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, after more links."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not ((nxt := root[root]) == root).all():
            root = nxt


def link_blocks(x: np.ndarray, split: int, rotation: np.ndarray | None, n: np.ndarray, threshold: float, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(links counted with the partners' copies, root) of each row.

    Pairs between rows before and after ``split``, or all pairs where it is the end.  Only
    one tile's pairs are held at a time, so a crowd of near copies costs time, not memory.
    """
    a = Side(x[:split], rotation)
    b = a if split == len(x) else Side(x[split:], rotation)
    shift = 0 if b is a else split
    links, root = np.zeros(len(x)), np.arange(len(x))
    reach = np.sqrt(2 - 2 * threshold) + 1e-6
    for i0 in range(0, len(a.z), tile):
        i1 = min(i0 + tile, len(a.z))
        for j0 in range(i0 if b is a else 0, len(b.z), tile):
            j1 = min(j0 + tile, len(b.z))
            if b.z[j0, 0] - a.z[i1 - 1, 0] > reach:
                break
            if a.z[i0, 0] - b.z[j1 - 1, 0] > reach:
                continue
            for i, j in compare(a, b, i0, i1, j0, j1, threshold):
                i, j = a.order[i], b.order[j] + shift
                links += np.bincount(i, weights=n[j], minlength=len(x)) + np.bincount(j, weights=n[i], minlength=len(x))
                root = merge_roots(root, i, j)
    return links, root


NAME = ["label", "dim"]


def deal(classes: DataFrame, turn, block: int) -> tuple[DataFrame, DataFrame]:
    """``classes`` with the cell that each lies in, and the blocks that cells make up; both written.

    Cells have equal width on the first axis; one of more than a quarter of a block is dealt
    by hash into as many pieces as its own count asks for.  A block is a run of whole cells
    that begins within ``block`` rows, so it has about 1.25 times as many at most.
    """

    def project(batches):
        for b in batches:
            v = b.column("v")
            size = np.diff(np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1])
            flat, at = v.flatten().to_numpy().astype(np.float64), np.concatenate([[0], np.cumsum(size)])
            first = np.zeros(len(v))
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                z, r = unit(flat[at[rows][:, None] + np.arange(dim)]), turn.value.get(dim)
                first[rows] = z[:, 0] if r is None else z @ r[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.float64())], [*b.schema.names, "z0"])

    width = 2.0 / (1 << spread_bits(classes.count(), 12))
    kind = classes.schema["v"].dataType.simpleString()
    turned = classes.select("class", *NAME, "n", "v").mapInArrow(project, f"class bigint, label string, dim int, n bigint, v {kind}, z0 double").withColumn("base", F.floor((F.col("z0") + 1) / width))
    most = max(block // 4, 1)
    crowded = materialize(turned.groupBy(*NAME, "base").agg(F.ceil(F.count(F.lit(1)) / most).alias("pieces")).where("pieces > 1"), "vectors-crowded")
    turned = turned.join(crowded, [*NAME, "base"], "left").withColumn("piece", F.pmod(F.xxhash64("class"), F.coalesce("pieces", F.lit(1))).cast("long"))
    turned = materialize(turned.select("class", *NAME, "n", "v", "z0", "base", "piece"), "vectors-turned")
    cells = turned.groupBy(*NAME, "base", "piece").agg(F.count(F.lit(1)).alias("rows"), F.min("z0").alias("lo"), F.max("z0").alias("hi"))
    before = F.sum("rows").over(Window.partitionBy(*NAME).orderBy("base", "piece").rowsBetween(Window.unboundedPreceding, -1))
    return turned, materialize(cells.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / block)), "vectors-cells")


def meetings(cells: DataFrame, threshold: float) -> DataFrame:
    """Pairs of blocks of a label, the same or a later one, whose ranges on the first axis come within reach.

    Blocks meet by strips of that axis, a fraction of the reach wide: one is listed in every
    strip where a partner may begin, the other in that where it begins.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    strip = max(reach / 8, 1e-3)
    blocks = materialize(cells.groupBy(*NAME, "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "vectors-blocks")
    at = lambda c: F.floor(c / strip)
    # a later block may begin before this one only inside a cell that both have a piece of
    ahead = blocks.select(*NAME, F.col("block").alias("a"), "hi", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi") + reach))).alias("strip"))
    begin = cells.groupBy(*NAME, "block").agg(F.min("lo").alias("lo"))
    twins = cells.select(*NAME, "base", F.col("block").alias("a")).distinct().join(cells.select(*NAME, "base", F.col("block").alias("b")).distinct(), [*NAME, "base"]).where("a <= b").select(*NAME, "a", "b")
    met = ahead.join(begin.select(*NAME, F.col("block").alias("b"), "lo", at(F.col("lo")).alias("strip")), [*NAME, "strip"]).where((F.col("a") <= F.col("b")) & (F.col("lo") - F.col("hi") <= reach)).select(*NAME, "a", "b")
    return materialize(met.unionByName(twins).distinct(), "vectors-met")


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, block: int = BLOCK, tile: int = TILE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared within equal, non-null labels and equal dimension.  Null, empty
    and zero vectors and those with null or non-finite components link with nothing.  A cosine does not depend on a
    vector's length, however large or small its components are.  n_links counts other rows linked directly; component_id is the smallest id reachable;
    kept marks rows whose id that is (also a lone null id).  Repeated rows link with each
    other, and so do rows that share an id.  An empty table gives an empty result; other
    columns are ignored, whatever their names.  ``components`` raises beyond 60 rounds, some
    2**30 links in a row.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType
    small = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    plain = F.transform(F.col(vec_col), lambda e: (e.cast(small) + F.lit(0.0).cast(small)).cast(small))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), plain.alias("v"))
    good = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    # 128 bits tell classes apart; a long names them
    rows = rows.withColumn("k1", F.when(good, F.xxhash64("label", "v"))).withColumn("k2", F.when(good, F.xxhash64(F.lit(1), "v", "label")))
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors-classes")
    sample: dict[int, list] = {}
    for r in classes.select("dim", "v").orderBy("k1", "k2").limit(AXES_SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    turn = spark.sparkContext.broadcast({dim: axes(unit(np.array(x))) for dim, x in sample.items()})

    name = NAME
    turned, cells = deal(classes, turn, block)
    met = meetings(cells, threshold)
    roles = met.select(*name, "a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(met.where("a <> b").select(*name, "a", "b", F.col("b").alias("block"), F.lit(1).alias("side")))
    sent = turned.join(cells.select(*name, "base", "piece", "block"), [*name, "base", "piece"]).join(roles, [*name, "block"]).select(*name, "a", "b", "side", "class", "n", "v")

    def linked(group: pa.Table) -> pa.Table:
        group = group.sort_by("side")
        n, cls = group.column("n").to_numpy(), group.column("class").to_numpy()
        x = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(n), -1).astype(np.float64)
        split = int(np.searchsorted(group.column("side").to_numpy(), 1))
        links, root = link_blocks(x, split, turn.value.get(x.shape[1]), n, threshold, tile)
        some = np.flatnonzero(links > 0)
        return pa.table({"class": cls[some], "links": links[some].astype(np.int64), "root": cls[root[some]]})

    found = materialize(sent.groupBy(*name, "a", "b").applyInArrow(linked, "class bigint, links bigint, root bigint"), "vectors-links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    thin = classes.select("class", "k1", "k2", "n", "least")
    linked_of = materialize(joined.join(thin.select(F.col("class").alias("node"), "least"), "node"), "vectors-linked")
    least = materialize(linked_of.groupBy("component").agg(F.min("least").alias("component_id")), "vectors-least")
    named = linked_of.join(least, "component").select(F.col("node").alias("class"), "component_id", F.lit(True).alias("met"))
    of = thin.join(links, "class", "left").join(named, "class", "left")
    of = of.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    out = rows.select("vec_id", "k1", "k2").join(materialize(of, "vectors-of"), ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
