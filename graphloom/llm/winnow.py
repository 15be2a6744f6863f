"""Operator 1: benchmark decontamination by winnowing.

Method: in texts and items alike, keep the minimum k-gram hash of every sliding window of
w grams, so that any shared span of k + w - 1 words shares a kept hash; join the kept
hashes; extend every hit word by word and keep runs of at least the window's length.
Items shorter than the window get a (k, w) of their own with k + w - 1 = their length.

The items go to the tasks in blocks of bounded bytes.  One block is one pass over the texts,
nothing is shuffled and no key can be hot.  More blocks are as many passes, one at a time:
each writes only the texts with hits, under 128 bits of their hash, and gives its block up
before the next; a last pass joins what they found.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnp
from .common import materialize, text_slices

WINDOW = 13
#: bytes of item text held by a task at a time
BLOCK_BYTES = 16 << 20
MARKS = [T.StructField("__spans", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType()))]
DIGEST = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]


def kept(h: np.ndarray, row_of: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed grams of word hashes: (positions, hashes).  Windows stay inside a row."""
    g = textnp.grams(h, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = g[:n].copy()
    for j in range(1, w):
        np.minimum(m, g[j : j + n], out=m)
    whole = row_of[:n] == row_of[k + w - 2 : k + w - 2 + n]
    sel = np.zeros(len(g), bool)
    for j in range(w):
        sel[j : j + n] |= (g[j : j + n] == m) & whole
    at = np.flatnonzero(sel)
    return at, g[at]


class Index:
    """Winnowed fingerprints of one block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int) -> None:
        by_text: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
        for item, text in items:
            ws = tuple((text or "").encode().translate(textnp.ALNUM_TRANSLATE).split())
            if ws:
                names = by_text[ws]
                if item is not None:
                    names.append(str(item))
        self.texts = list(by_text)
        self.names = [sorted(set(by_text[t])) for t in self.texts]
        self.window = window
        #: per window length: k, w, sorted hashes, {hash: {text: positions}}
        self.classes: list[tuple[int, int, int, np.ndarray, dict[int, dict[int, list[int]]]]] = []
        by_length: dict[int, list[int]] = defaultdict(list)
        for t, ws in enumerate(self.texts):
            by_length[min(window, len(ws))].append(t)
        for length, members in sorted(by_length.items()):
            k = (length + 1) // 2
            w = length - k + 1
            table: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
            for t in members:
                h = self._hashes(self.texts[t])
                at, hs = kept(h, np.zeros(len(h), np.int64), k, w)
                for p, x in zip(at.tolist(), hs.tolist(), strict=True):
                    table[x][t].append(p)
            self.classes.append((length, k, w, np.array(sorted(table), np.uint64), {x: dict(v) for x, v in table.items()}))

    @staticmethod
    def _hashes(ws: tuple[bytes, ...]) -> np.ndarray:
        data = np.frombuffer(b" ".join(ws), np.uint8)
        mapped, s, e, _ = textnp.words(data, np.array([0, len(data)]), textnp.ALNUM)
        return textnp.span_hash(*textnp.prefix_hash(mapped), s, e)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[int]]]]:
        """(words per row, {row: (hit runs as word ranges, texts found)}).

        A match of text t through the gram at p reaches ``length`` words to either side at
        most; if all those are hit and t is found, p has nothing to add for t.  That keeps
        repetitive texts from trying every pair of places.
        """
        mapped, s, e, first = textnp.words(data, offsets, textnp.ALNUM)
        rows = np.diff(first)
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        if not len(s):
            return rows, found
        h = textnp.span_hash(*textnp.prefix_hash(mapped), s, e)
        row_of = np.repeat(np.arange(len(rows)), rows)
        low = mapped.tobytes()
        covered = bytearray(len(s))
        for length, k, w, hashes, table in self.classes:
            at, g = kept(h, row_of, k, w)
            if not len(g) or not len(hashes):
                continue
            near = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
            hit = np.flatnonzero(hashes[near] == g)
            done: dict[tuple[int, int], int] = {}  # diagonal -> end of its last run
            for p, x in zip(at[hit].tolist(), g[hit].tolist(), strict=True):
                row = int(row_of[p])
                lo, hi = int(first[row]), int(first[row + 1])
                near_lo, near_hi = max(lo, p + k - length), min(hi, p + length)
                for t, places in table[x].items():
                    ws = self.texts[t]
                    for q in places:
                        if done.get((t, p - q), -1) > p:
                            continue
                        if row in found and t in found[row][1] and covered.find(0, near_lo, near_hi) < 0:
                            break
                        a, b = p, p
                        while a > lo and q - (p - a) > 0 and low[s[a - 1] : e[a - 1]] == ws[q - (p - a) - 1]:
                            a -= 1
                        while b < hi and q + (b - p) < len(ws) and low[s[b] : e[b]] == ws[q + (b - p)]:
                            b += 1
                        done[(t, p - q)] = max(b, p + 1)
                        if b - a >= length:
                            runs, texts = found.setdefault(row, ([], set()))
                            runs.append((a - lo, b - lo))
                            texts.add(t)
                            covered[a:b] = b"\x01" * (b - a)
        return rows, found


def _union(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def _digest(counts: list[int], spans: list[list[int]], items: list[list[str]]) -> list[pa.Array]:
    """Columns of ``DIGEST``; spans hold starts and ends in turn."""
    hits = [_union(list(zip(x[::2], x[1::2], strict=True))) if x else 0 for x in spans]
    names = [sorted(set(x)) for x in items]
    return [
        pa.array(counts, pa.int64()),
        pa.array(hits, pa.int64()),
        pa.array([len(x) for x in names], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
        pa.array([h > 0 and 20 * h >= c for h, c in zip(hits, counts, strict=True)], pa.bool_()),
    ]


def _found(index: Index, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[list[int]], list[list[str]]]:
    counts, found = index.scan(data, offsets)
    spans: list[list[int]] = [[] for _ in range(rows.num_rows)]
    items: list[list[str]] = [[] for _ in range(rows.num_rows)]
    for r, (runs, texts) in found.items():
        spans[r] = [x for run in runs for x in run]
        items[r] = [name for t in texts for name in index.names[t]]
    return counts.tolist(), spans, items


def _one_pass(shared, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *_digest(*_found(shared.value, rows, data, offsets))], [*columns, *(f.name for f in DIGEST)])

    return run


def _marks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "t"):
                _, spans, items = _found(shared.value, rows, data, offsets)
                some = pa.array([i for i, x in enumerate(spans) if x], pa.int64())
                marked = pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["a", "b", "spans", "items"])
                yield marked.take(some)

    return run


def _last_pass(text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, text):
                counts = np.diff(textnp.words(data, offsets, textnp.ALNUM)[3]).tolist()
                spans, items = ([x or [] for x in rows.column(c).to_pylist()] for c in ("__spans", "__items"))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *_digest(counts, spans, items)], [*columns, *(f.name for f in DIGEST)])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, n_items, items_sha256 and contaminated.

    A null or blank text has no words, hence no hits, and is not contaminated; an empty
    item matches nothing.  Items equal in words count under each of their ids; a null id
    marks words as hit but is not listed.  Repeated rows are kept, and equal texts, ids or
    not, get equal digests.  With an empty items table nothing is hit; an empty docs table
    stays empty.  A text of any length is scanned whole, with some 100 bytes of memory a
    byte.  Columns of ``docs`` that clash with the result's are replaced.

    Items up to ``block_bytes`` are one pass over ``docs``; more take a pass for each half
    of that many bytes, and the texts are exchanged once unless the hits are few.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(f.name for f in [*MARKS, *DIGEST]))
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    picked = items.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t"))
    result = T.StructType([*docs.schema.fields, *DIGEST])
    if blocks == 1:
        index = Index([(r["i"], r["t"]) for r in picked.collect()], window)  # at most block_bytes
        return docs.mapInArrow(_one_pass(spark.sparkContext.broadcast(index), text_col, docs.columns), result)
    text = F.col(text_col)
    a, b = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    keyed, found = docs.select(a.alias("a"), b.alias("b"), text.alias("t")).where(text.isNotNull()), []
    for n in range(blocks):
        part = picked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n)
        shared = spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in part.collect()], window))  # about block_bytes / 2
        found.append(materialize(keyed.mapInArrow(_marks(shared), "a bigint, b bigint, spans array<bigint>, items array<string>"), "winnow-marks"))
        shared.destroy()
    # equal texts were marked alike, so one row of each block stands for them
    one = reduce(DataFrame.unionByName, [f.dropDuplicates(["a", "b"]) for f in found])
    marks = one.groupBy("a", "b").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))
    marks = materialize(marks.withColumnsRenamed({"a": "__a", "b": "__b"}), "winnow-found")
    met = docs.withColumn("__x", a).withColumn("__y", b).join(marks, (F.col("__x") == F.col("__a")) & (F.col("__y") == F.col("__b")), "left")
    return met.select(*docs.columns, "__spans", "__items").mapInArrow(_last_pass(text_col, docs.columns), result)
