"""Operator 13: prefix trie of conversations.

Method: a mergesort that knows common prefixes.  A conversation is the string of its turns'
digests, a fixed number of bytes each, then its id, so that those that end at a node come
first there, by id.  Tasks sort runs of bounded size and send them front-coded, cut at
splitters; a range's runs meet in a loser tree that never compares a turn known to be
shared (``suffixes.merge``).  The merged stream keeps the open path on a stack and emits a
node when it leaves the path.

Ranges hold like numbers of turns, so conversations that are alike, up to all of them, are
dealt over many.  Only the nodes on a range's first and last path may go on in another
range: each range has one row with those, and one fold over these rows joins them.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import folds
from .common import materialize
from .suffixes import _runs_of_key, common, merge, task_keys

#: bytes of a turn: a mark above that of an id, and the head of the digest
UNIT = 16
_END = b"\x00"
#: turns of a sorted run, of a range, and of the sample that splitters come from; ranges at most
RUN_TURNS, RANGE_TURNS, SAMPLE_TURNS, RANGES = 1 << 17, 1 << 18, 1 << 18, 4096
WORDS = r"[^\x20\x09-\x0D]+"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turn_unit(role: Column, text: Column) -> Column:
    """A turn's mark and digest in hex: equal for equal role and text."""
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.lit("01"), F.substring(F.sha2(both, 256), 1, 2 * UNIT - 2))


def sequences(talk: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digest and number of words.

    Turns go by number, null first; equal numbers by role and digest.  Null roles and texts
    are empty.  Rows with a null conv_id belong to no conversation and are left out.  Texts
    are reduced to digests before rows meet.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).cast("long")
    turn = F.struct(F.col("turn").isNotNull().alias("told"), "turn", role.alias("role"), turn_unit(role, text).alias("unit"), words.alias("words"))
    rows = talk.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("conv_id", F.transform("ts", lambda t: F.struct(t["unit"], t["words"])).alias("turns"))


def rebuild(own: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin with turns of their group's first one: h turns, h from the id's crc32.

    The own first h turns give way to the first h of conversation c - c % ``group``, as many
    as it has; a conversation may be left without turns.
    """
    head = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most - 1).alias("__head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = own.withColumn("__base", F.col("conv_id") - F.col("conv_id") % group).join(head, "__base", "left").withColumn("__h", h)
    none = F.array().cast(own.schema["turns"].dataType)
    turns = F.concat(F.slice(F.coalesce("__head", none), F.lit(1), F.col("__h")), F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(0))))
    return joined.select("conv_id", turns.alias("turns"))


def _end(conv: int) -> bytes:
    return _END + (conv + (1 << 63)).to_bytes(8, "big")


def _weight(key: bytes) -> int:
    return len(key) // UNIT + 1


def splitters(strings: list[bytes], ranges: int) -> list[bytes]:
    """Cuts that deal the sample's turns evenly, each as short as tells it from the string before."""
    strings = sorted(strings)
    total = sum(map(_weight, strings))
    cuts, seen, prev = [], 0, b""
    for s in strings:
        if seen * ranges >= total * (len(cuts) + 1) and prev:
            cut = s[: common(prev, s, 0) + 1]
            if not cuts or cut > cuts[-1]:
                cuts.append(cut)
        seen += _weight(s)
        prev = s
    return cuts


def _send_runs(cuts, lands: np.ndarray):
    """Sorts runs, front-codes them and sends a piece to every range that they touch."""

    def pieces(items: list[tuple[bytes, list[int]]]) -> Iterator[tuple[int, int, bytes]]:
        items.sort(key=lambda x: x[0])
        at = 0
        while at < len(items):
            r = bisect_right(cuts.value, items[at][0])
            same, rests, counts, prev = [], [], [], b""
            while at < len(items) and (r == len(cuts.value) or items[at][0] < cuts.value[r]):
                string, words = items[at]
                h = common(prev, string, 0)
                same.append(h)
                rests.append(string[h:])
                counts.append(words[h // UNIT :])
                prev = string
                at += 1
            yield int(lands[r]), r, pickle.dumps((same, rests, counts), protocol=5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            for conv, key, words in zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist(), batch.column("words").to_pylist(), strict=True):
                held.append((key + _end(conv), words))
                turns += len(words) + 1
                if turns >= RUN_TURNS:
                    yield _batch(pieces(held))
                    held, turns = [], 0
        yield _batch(pieces(held))

    def _batch(rows: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
        lands, ranges, data = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lands, pa.int64()), pa.array(ranges, pa.int32()), pa.array(data, pa.binary())], ["land", "range", "piece"])

    return run


class Node:
    """An open node: what is known of its subtree so far."""

    __slots__ = ("conv", "convs", "children", "leaves", "saved", "words", "ends", "below", "ref")

    def __init__(self, words: int, ref: int | None) -> None:
        self.conv, self.convs, self.children, self.leaves, self.saved, self.words = None, 0, 0, 0, 0, words
        self.ends: list[int] = []
        self.below: list[tuple] = []
        self.ref = ref

    def add(self, conv: int, convs: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += convs

    def close(self) -> tuple[int, int]:
        """(leaves, saved tokens) of the whole subtree, all of which has been added."""
        return (self.leaves if self.children else 1), self.saved + (self.convs - 1) * self.words

    def adopt(self, child: Node) -> None:
        leaves, saved = child.close()
        self.add(child.conv, child.convs)
        self.children += 1
        self.leaves += leaves
        self.saved += saved


def nodes_of(stream: Iterator[tuple[bytes, int, list[int]]]) -> tuple[list[tuple], list[tuple[int, str]], bytes]:
    """A range's nodes from its sorted strings, each with its common prefix with the one before and its turns' words.

    Returns the finished nodes, the ends of the nodes that may go on elsewhere, and the
    range's row for the fold: first and last string and those nodes.  A finished node names
    its parent's conversation, or the number of a parent that may go on.
    """
    out, marked, stack = [], [], []
    first = last = None

    def flush(node: Node, conv: int | None) -> None:
        for row in node.below:
            out.append((*row[:2], conv, *row[2:], None if conv is not None else node.ref))
        node.below = []

    def leave(keep: int) -> None:
        while len(stack) - 1 > keep:
            node, depth = stack.pop(), len(stack)
            if node.ref is not None:
                mark(node, depth)
                continue
            leaves, saved = node.close()
            flush(node, node.conv)
            digest = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
            stack[-1].adopt(node)
            stack[-1].below.append((node.conv, depth, node.convs, node.children, leaves, saved, digest))
            if stack[-1].ref is not None:
                flush(stack[-1], None)

    def mark(node: Node, depth: int) -> None:
        flush(node, None)
        marked.append((node.ref, depth, node))

    for string, shared, words in stream:
        depth = (len(string) - 9) // UNIT
        begin = first is None
        if begin:
            stack.append(Node(0, 0))
            first = string
        else:
            leave(shared // UNIT)
        for d in range(len(stack), depth + 1):
            stack.append(Node(words[d - 1], d if begin else None))
        conv = int.from_bytes(string[-8:], "big") - (1 << 63)
        stack[-1].add(conv, 1)
        stack[-1].ends.append(conv)
        last = string
    ref = (len(first) - 9) // UNIT + 1
    for node in stack:
        if node.ref is None:
            node.ref, ref = ref, ref + 1
    while stack:
        mark(stack.pop(), len(stack))
    ends = [(ref, ",".join(map(str, node.ends))) for ref, _, node in marked if node.ends]
    rows = [(ref, depth, n.conv, n.convs, n.children, n.leaves, n.saved, n.words) for ref, depth, n in marked]
    return out, ends, pickle.dumps((first, last, rows), protocol=5)


_PARTS = f"kind int, range int, ref int, {_NODE}, ends_sha256 string, ends string, row binary"


def _merge_ranges(schema: pa.Schema):
    def strings(same: list[int], rests: list[bytes]) -> Iterator[tuple[bytes, int]]:
        prev = b""
        for h, rest in zip(same, rests, strict=True):
            prev = prev[:h] + rest
            yield prev, h

    def words(same: list[int], counts: list[list[int]]) -> Iterator[list[int]]:
        prev: list[int] = []
        for h, rest in zip(same, counts, strict=True):
            prev = prev[: h // UNIT] + rest
            yield prev

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, held in _runs_of_key(batches, "range"):
            runs = [pickle.loads(p) for b in held for p in b.column("piece").to_pylist()]
            sides = [words(same, counts) for same, _, counts in runs]
            merged = ((string, shared, next(sides[i])) for i, string, shared in merge([strings(same, rests) for same, rests, _ in runs]))
            nodes, ends, row = nodes_of(merged)
            rows = [(0, r, ref, *node, digest, None, None) for *node, digest, ref in nodes]
            rows += [(1, r, ref, *[None] * 8, text, None) for ref, text in ends]
            rows.append((2, r, None, *[None] * 9, row))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


_SPINE = f"range int, ref int, node int, {_NODE}"


def _spine(schema: pa.Schema):
    """Joins the nodes that ranges share, in order of ranges; one row per range comes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[Node] = []
        before, number = b"", 0

        def push(depth: int, words: int) -> None:
            nonlocal number
            assert depth == len(stack)
            node = Node(words, number)
            number += 1
            stack.append(node)

        def leave(keep: int) -> None:
            while len(stack) - 1 > keep:
                node, depth = stack.pop(), len(stack)
                leaves, saved = node.close()
                for row in node.below:
                    # references of ranges, and children that are joined themselves
                    out.append((*row[:3], node.conv, *[None] * 6) if len(row) == 3 else (None, None, row[0], *row[1:3], node.conv, *row[3:]))
                done = (node.ref, node.conv, depth, node.convs, node.children, leaves, saved)
                if stack:
                    stack[-1].adopt(node)
                    stack[-1].below.append(done)
                else:
                    out.append((None, None, done[0], *done[1:3], None, *done[3:]))

        for batch in batches:
            for r, row in zip(batch.column("range").to_pylist(), batch.column("row").to_pylist(), strict=True):
                first, last, rows = pickle.loads(row)
                leave(common(before, first, 0) // UNIT if before else -1)
                n = (len(first) - 9) // UNIT + 1
                ways = sorted(x for x in rows if x[0] < n), sorted(x for x in rows if x[0] >= n)
                for way in ways:
                    if way is ways[1]:
                        leave(common(first, last, 0) // UNIT)
                    for ref, depth, conv, convs, children, leaves, saved, words in way:
                        if depth == len(stack):
                            push(depth, words)
                        node = stack[depth]
                        if conv is not None:
                            node.add(conv, convs)
                        node.children += children
                        node.leaves += leaves
                        node.saved += saved
                        node.below.append((r, ref, node.ref))
                before = last
        leave(-1)
        for i in range(0, len(out), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 65_536], strict=True), schema, strict=True)], schema=schema)

    return run


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def prefix_trie(seqs: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """A row per node of the trie over (conv_id, turns as unit and words): distinct prefixes, from the textless root.

    conv_id is a node's smallest member, n_convs its members, n_leaves and saved_tokens cover
    its subtree, ends_sha256 the members that end at it.  Turns with equal digests (120 bits
    of SHA-256 over role and text) are one.  A conversation without turns ends at the root; no
    conversation at all gives no node, not even a root.  Any number of conversations may be
    alike; one conversation is one item, with some 40 bytes a turn, whatever its texts' length.
    """
    spark = seqs.sparkSession
    key = F.unhex(F.array_join("turns.unit", ""))
    items = materialize(seqs.select("conv_id", key.alias("key"), F.col("turns.words").alias("words")), "trie-items")
    turns = items.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    if ranges is None:
        ranges = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // RANGE_TURNS)))
    # a sample by the ids' hash, of some SAMPLE_TURNS turns whatever the table holds: it steers balance, not results
    share = min(1.0, SAMPLE_TURNS / max(turns, 1))
    sample = items.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("conv_id", "key").collect()
    cuts = splitters([bytes(r["key"]) + _end(r["conv_id"]) for r in sample], ranges)
    ranges = len(cuts) + 1
    sent = items.mapInArrow(_send_runs(spark.sparkContext.broadcast(cuts), task_keys(ranges)), "land long, range int, piece binary")
    parts = sent.repartition(ranges, "land").sortWithinPartitions("range").mapInArrow(_merge_ranges(_arrow(spark, _PARTS)), _PARTS)
    parts = materialize(parts, "trie-parts")
    rows = parts.where("kind = 2").select("range", "row").repartition(1).sortWithinPartitions("range")  # a row per range
    spine = materialize(rows.mapInArrow(_spine(_arrow(spark, _SPINE)), _SPINE), "trie-spine")

    own = [x.split()[0] for x in _NODE.split(", ")]
    known = spine.where("ref is not null").select("range", "ref", "node", F.col("conv_id").alias("__conv"))
    inner = parts.where("kind = 0").drop("kind", "ends", "row").join(known, ["range", "ref"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__conv"))
    ends = parts.where("kind = 1").select("range", "ref", F.col("ends").alias("text")).join(known, ["range", "ref"]).select("node", "range", "text")
    # one node's ends are one digest, and so one stream over its ranges
    digests = folds.fold(ends, "node", ["range"], ["text"], _start, _step, _finish, "ends_sha256 string")
    outer = spine.where("ref is null").join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return inner.select(*own, "ends_sha256").unionByName(outer.select(*own, "ends_sha256"))


def _start() -> list:
    return [hashlib.sha256(), False]


def _step(state: list, row: tuple) -> None:
    if state[1]:
        state[0].update(b",")
    state[0].update(row[0].encode())
    state[1] = True


def _finish(state: list) -> list[tuple]:
    return [(state[0].hexdigest(),)]
