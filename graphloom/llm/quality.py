"""Operator 5: quality classifier.

Method: histogram gradient-boosted trees over document statistics.  Statistics come from
whole texts, vectorised over Arrow slices.  Training uses at most ``SAMPLE`` labelled
documents, those of the smallest id hashes outside the held-out fold.  The trees are perfect binary
trees flattened into arrays, and all of them are walked at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import text_slices

#: documented bound of the labelled sample, and the rest of the model's parameters
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LAMBDA, MIN_ROWS = 80, 4, 64, 0.15, 1.0, 20
THRESHOLD = 0.3

# byte classes: 0 rest of ASCII controls, 1 lower, 2 upper, 3 digit, 4 blank, 5 newline, 6 .,;: 7 !? 8 | 9 brackets and quotes, 10 other symbols, 11 UTF-8 lead, 12 UTF-8 continuation
KINDS = 13
_kind = np.zeros(256, np.uint8)
_kind[0x21:0x7F] = 10
_kind[ord("a") : ord("z") + 1] = 1
_kind[ord("A") : ord("Z") + 1] = 2
_kind[ord("0") : ord("9") + 1] = 3
_kind[[0x20, 0x09, 0x0D]] = 4
_kind[0x0A] = 5
_kind[[ord(c) for c in ".,;:"]] = 6
_kind[[ord(c) for c in "!?"]] = 7
_kind[ord("|")] = 8
_kind[[ord(c) for c in "()[]{}<>'\"-"]] = 9
_kind[0xC0:] = 11
_kind[0x80:0xC0] = 12
_WORD = textnp.byte_table(False, textnp.BLANKS)
_LINE = textnp.byte_table(False, b"\n")


def _repeats(ids: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: distinct items, count of the commonest, and items equal to the one before."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(n)
    if len(ids) > 1:
        eq = (ids[1:] == ids[:-1]) & (row[1:] == row[:-1])
        same = np.bincount(row[1:][eq], minlength=n).astype(float)
    mixed = np.sort((ids & np.uint64(0xFFFFFFFFFF)) | (row.astype(np.uint64) << np.uint64(40)))
    edge = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]])) if len(mixed) else np.zeros(0, np.int64)
    run = np.diff(np.append(edge, len(mixed)))
    owner = (mixed[edge] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n).astype(float)
    most = np.zeros(n)
    np.maximum.at(most, owner, run.astype(float))
    return distinct, most, same


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, features): shares of byte classes, word and line statistics."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = _kind[data]
    counts = np.bincount(row * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS).astype(float)
    chars = np.maximum(size - counts[:, 12], 1)
    mapped, s, e, first = textnp.words(data, offsets, _WORD)
    nw = np.diff(first).astype(float)
    w = np.maximum(nw, 1)
    wrow = np.repeat(np.arange(n), np.diff(first))
    long = (e - s).astype(float)

    def per(x: np.ndarray) -> np.ndarray:
        return np.bincount(wrow, weights=x, minlength=n)

    mean = per(long) / w
    spread = np.sqrt(np.maximum(per(long * long) / w - mean * mean, 0))
    h = textnp.span_hash(*textnp.prefix_hash(mapped), s, e) if len(s) else np.zeros(0, np.uint64)
    distinct, most, same = _repeats(h, first)
    head, tail = kinds[s] if len(s) else np.zeros(0), kinds[e - 1] if len(s) else np.zeros(0)
    up = np.cumsum(np.append(0, kinds == 2))
    shout = ((up[e] - up[s]) >= np.maximum(0.5 * long, 2)) if len(s) else np.zeros(0)
    odd = np.isin(tail, (7, 10)).astype(float)
    lone = (long == 1).astype(float)
    lmap, ls, le, lfirst = textnp.words(data, offsets, _LINE)
    lh = textnp.span_hash(*textnp.prefix_hash(lmap), ls, le) if len(ls) else np.zeros(0, np.uint64)
    ldistinct, lmost, lsame = _repeats(lh, lfirst)
    nl = np.maximum(np.diff(lfirst), 1).astype(float)
    share = counts / chars[:, None]
    cols = [np.log1p(size), np.log1p(nw), *(share[:, k] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)), mean, spread, distinct / w, most / w, same / w, per(shout.astype(float)) / w, per(odd) / w, per(lone) / w, per((head == 2).astype(float)) / w, nw / nl, ldistinct / nl, lmost / nl, lsame / nl]
    return np.stack(cols, axis=1)


@dataclass
class Forest:
    """Flattened perfect trees: feature and cut of inner nodes, value of leaves, per tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        raw = self.base + self.value[trees, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosts log-loss trees on feature histograms.

    A split needs ``MIN_ROWS`` rows on either side; without any that gains, a tree is one
    leaf, so one class, or fewer rows than two such sides, give a constant near the mean.
    No rows give 0.5.
    """
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    none = np.zeros((0, inner))
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if not len(y):
        return Forest(base, none.astype(np.int64), none, np.zeros((0, leaves)))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    bins = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)], axis=1)
    flat = bins + np.arange(m) * BINS
    raw = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feat, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for d in range(DEPTH):
            lo, width = 2**d - 1, 2**d
            local = at - lo
            key = (local[:, None] * (m * BINS) + flat).ravel()
            shape = (width, m, BINS)
            sums = [np.bincount(key, weights=np.repeat(v, m), minlength=width * m * BINS).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            gl, hl, nl = sums
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + LAMBDA) + (gt - gl) ** 2 / (ht - hl + LAMBDA) - gt**2 / (ht + LAMBDA)
            gain[(nl < MIN_ROWS) | (nt - nl < MIN_ROWS)] = -1
            gain[:, :, -1] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feat[lo + k], cut[lo + k] = f, cuts[f][b]
            go = x[np.arange(n), feat[at]] > cut[at]
            at = 2 * at + 1 + go
        leaf = at - inner
        value = -RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + LAMBDA)
        raw = raw + value[leaf]
        features.append(feat)
        thresholds.append(cut)
        values.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(values))


def held_out(c):
    """The fold never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fits on at most ``sample`` labelled documents, the one bound on what is learnt from.

    Rows with a null id or label, and those held out, teach nothing; repeated labels of an
    id are averaged; rows that repeat a labelled id are documents of their own, and the bound
    holds for them all.  Null and empty texts teach with empty statistics.  Ties in the hash
    go by id and statistics, so reruns agree.  Empty tables give the constant 0.5.  Columns
    that clash are not looked at.
    """
    picked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "t"):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    # at most ``sample`` ids and labels are broadcast
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked), F.col("id") == F.col("__id")).select("id", "t", "y")
    kind = docs.schema[id_col].dataType.simpleString()
    got = joined.mapInArrow(run, f"id {kind}, y double, x array<double>").orderBy(F.xxhash64("id"), "id", "x").limit(sample).collect()
    x = np.array([r["x"] for r in got]) if got else np.zeros((0, 1))
    return fit(x, np.array([r["y"] for r in got]))


def score(docs: DataFrame, forest: Forest, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus score and predicted; clashing columns are replaced.

    Null and empty texts are scored on empty statistics, a text of any length on the whole
    of it, with some 100 bytes of memory a byte.  Rows with null or repeated ids and repeated
    rows are kept; equal texts score alike.  An empty table stays empty.
    """
    docs = docs.drop("score", "predicted")
    columns = docs.columns
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, text_col):
                s = model.value.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*columns, "score", "predicted"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
