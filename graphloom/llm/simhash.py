"""Operator 7: SimHash near-duplicates by multi-index hashing.

Method: 64-bit fingerprints are cut into segments, each with a radius; radii plus one add up
to more than the distance, so two fingerprints within the distance come within the radius in
some segment.  For distance 4 and three segments the radii are 1, 1 and 0 (were all three
exceeded, the distance would be 2 + 2 + 1 = 5).  Each distinct fingerprint enters one table
per segment and probes it with the segment's small Hamming ball (a radius over 1 is met
half-way by both); fetched matches are verified on their complete distance.

A segment value that very many fingerprints share is indexed again by pieces of the other
bits, one piece more than the distance, of which some must agree; what is still crowded is
dealt over a grid of entries by probes, so no task holds more than a bounded part.  A task
reduces its links to a spanning forest before it emits them, so that a large group of near
copies gives a line per member, not per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnp
from .common import components, materialize, text_slices

_LOWER = textnp.byte_table(True, textnp.BLANKS)
SHINGLE = 4
SEED = 42
DISTANCE = 4
#: segments of a fingerprint.  Three suit up to some 10**9 distinct fingerprints; beyond, two
#: longer ones meet fewer by chance, for 130 keys each instead of 48
SEGMENTS = 3
#: table entries of one value beyond which it is indexed again, and then dealt over a grid
HOT = 4096
CANDIDATES = 500_000
#: table entries and probes of a task, which holds them all
PART_ROWS = 500_000


def segments(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) of each segment; one that needs no look has radius -1."""
    borders = [64 * i // count for i in range(count + 1)]
    share, extra = divmod(distance + 1, count)
    return [(a, b - a, share - (i >= extra)) for i, (a, b) in enumerate(zip(borders, borders[1:], strict=False))]


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of the lowest ``bits`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _vote(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit integer."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the XXH64 hashes of a text's shingles; 0 without words."""
    ws = text.lower().split()
    n = len(ws)
    if n == 0:
        return 0
    h = xxhash.xxh64_intdigest
    joined = b" ".join(ws)
    if n <= shingle:
        return _vote(np.array([h(joined, SEED)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    return _vote(np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n - shingle + 1))


def rolled(data: np.ndarray, offsets: np.ndarray, shingles: tuple[tuple[int, int], ...]) -> np.ndarray:
    """SimHash of rolling hashes of the rows' shingles, a line for each (shingle length, seed); 0 without words.

    Vectorised over the words of a slice, for links that need no given hash.
    """
    mapped, s, e, first = textnp.words(data, offsets, _LOWER)
    out = np.zeros((len(shingles), len(offsets) - 1), np.int64)
    h = textnp.span_hash(*textnp.prefix_hash(mapped), s, e) if len(s) else np.zeros(0, np.uint64)
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            made = {k: textnp.grams(h[a:b], min(k, b - a)) for k, _ in shingles}
            out[:, r] = [_vote(textnp.mix(made[k] + np.uint64(seed * textnp.BASE & textnp.MASK)) if seed else made[k]) for k, seed in shingles]
    return out


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, rolling: dict[str, tuple[int, int]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, key) per row; key is a hash of id and text for joining back.

    With ``rolling``, a name for each (shingle length, seed), rows have those fingerprints
    instead, of rolling hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if rolling is None:
                fps = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in b.column("t").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64()), b.column("key")], ["doc_id", "fp", "key"])
                continue
            for rows, data, offsets in text_slices(b, "t"):
                made = rolled(data, offsets, tuple(rolling.values()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, made), rows.column("key")], ["doc_id", *rolling, "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = ", ".join(f"{c} bigint" for c in rolling or ["fp"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("key")).mapInArrow(run, f"doc_id {kind}, {made}, key bigint")


def _forest(batches: Iterator[pa.RecordBatch], distance: int, check: int | None) -> Iterator[pa.RecordBatch]:
    """Verified links among one partition's table entries and probes, as a spanning forest.

    Rows have fp, and key with the mark of a probe as its lowest bit; with ``check`` also a
    node's number and second fingerprint.
    """
    columns = ["key", "fp", *(["node", "check"] if check is not None else [])]
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in columns] for b in batches]
    if not parts:
        return
    rows = dict(zip(columns, (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True))
    del parts
    probe = (rows["key"] & 1).astype(bool)
    rows["key"] >>= 1
    table, probes = ({c: x[m] for c, x in rows.items()} for m in (~probe, probe))
    order = np.argsort(table["key"], kind="stable")
    table = {c: x[order] for c, x in table.items()}
    del rows
    lo, hi = np.searchsorted(table["key"], probes["key"], "left"), np.searchsorted(table["key"], probes["key"], "right")
    met = hi > lo
    lo, count = lo[met], (hi - lo)[met]
    probes = {c: x[met] for c, x in probes.items()}
    name = "fp" if check is None else "node"
    near = lambda a, b, most: np.bitwise_count((a ^ b).view(np.uint64)) <= most
    # a probe need not be a table entry of this partition
    nodes = np.unique(np.concatenate([table[name], probes[name]]))
    label = np.arange(len(nodes))
    i, total = 0, np.cumsum(count)
    while i < len(count):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + CANDIDATES, "right")))
        c = count[i:j]
        left = np.repeat(np.arange(i, j), c)
        right = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[i:j], c)
        i = j
        ok = (probes[name][left] < table[name][right]) & near(probes["fp"][left], table["fp"][right], distance)
        left, right = left[ok], right[ok]
        if check is not None:
            ok = near(probes["check"][left], table["check"][right], check)
            left, right = left[ok], right[ok]
        u, at = np.searchsorted(nodes, probes[name][left]), np.searchsorted(nodes, table[name][right])
        while True:
            a, b = label[u], label[at]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not ((nxt := label[label]) == label).all():
                label = nxt
    out = np.flatnonzero(label != np.arange(len(nodes)))
    if len(out):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[label[out]])], ["a", "b"])


def link_forest(distinct: DataFrame, distance: int = DISTANCE, count: int = SEGMENTS, check: int | None = None) -> DataFrame:
    """(a, b) edges connecting exactly what links connect: fingerprints within the distance.

    ``distinct`` has one row per distinct fingerprint in column fp, its own name.  With
    ``check`` it has node (a long) and a second fingerprint ``check``, which must lie within
    that distance, too; edges are then between nodes.
    """
    spark = distinct.sparkSession
    held = [c for c in ("fp", "node", "check") if check is not None or c == "fp"]
    tables, balls, rest = [], [], F.lit(None).cast("long")
    for s, (low, bits, radius) in enumerate(segments(distance, count)):
        if radius < 0:
            continue
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(s << 32))
        tables += [value.bitwiseXOR(F.lit(m)) for m in ball(bits, radius // 2)]
        balls += [value.bitwiseXOR(F.lit(m)) for m in ball(bits, radius - radius // 2)]
        # the other bits, turned to the lowest places
        turned = F.shiftrightunsigned("fp", low + bits).bitwiseOR(F.shiftleft("fp", 64 - low - bits)) if low + bits < 64 else F.col("fp")
        rest = F.when(F.shiftright("key", 32) == s, turned.bitwiseAND(F.lit((1 << (64 - bits)) - 1))).otherwise(rest)
    table = distinct.select(*held, F.explode(F.array(*tables)).alias("key"), F.lit(False).alias("probe"))
    probes = distinct.select(*held, F.explode(F.array(*balls)).alias("key"), F.lit(True).alias("probe"))
    both = table.unionByName(probes)

    def crowded(entries: DataFrame, name: str) -> DataFrame:
        return materialize(entries.groupBy("key").count().where(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("parts")), name)

    hot = crowded(table, "simhash-hot")
    if not hot.isEmpty():
        known = both.join(hot, "key", "left")
        piece = -(-(64 - 64 // count) // (distance + 1))  # all of them cover the rest of any segment
        again = [F.xxhash64("key", F.lit(i), F.shiftrightunsigned("rest", i * piece).bitwiseAND(F.lit((1 << piece) - 1))) for i in range(distance + 1)]
        fine = known.where("parts is not null").withColumn("rest", rest).select(*held, F.explode(F.array(*again)).alias("key"), "probe")
        fine = materialize(fine, "simhash-fine")
        dense = crowded(fine.where("not probe"), "simhash-dense")
        grid = fine.join(dense, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own, other = F.pmod(F.xxhash64("fp"), F.col("parts")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        grid = grid.withColumn("own", own.cast("int")).withColumn("other", other)
        cell = F.xxhash64("key", F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")), F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")))
        both = known.where("parts is null").select(*held, "key", "probe").unionByName(grid.select(*held, cell.alias("key"), "probe"))
    rows = (len(tables) + len(balls)) * distinct.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    both = both.select(*held, F.shiftleft("key", 1).bitwiseOR(F.col("probe").cast("long")).alias("key"))
    return both.repartition(parts, F.shiftright("key", 1)).mapInArrow(lambda batches: _forest(batches, distance, check), "a bigint, b bigint")


def name_groups(prints: DataFrame, code: list[str], links) -> DataFrame:
    """``prints`` (doc_id, code, key) with component_id and first_key: smallest id, and its row's key, of all that links reach.

    Rows of equal code are one class; ``links`` makes (a, b) edges of classes, which have a
    number ``node`` (the fingerprint itself where that is the whole code).
    """
    classes = prints.groupBy(*code).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    classes = materialize(classes.withColumn("node", F.col("fp") if code == ["fp"] else F.monotonically_increasing_id()), "simhash-classes")
    joined = components(links(classes))
    # only linked fingerprints meet their component, and both sides are written before they
    # do: a group of any size is then a skewed join, which is split
    linked = materialize(joined.join(classes, "node").select("node", "component", "first"), "simhash-linked")
    least = materialize(linked.groupBy("component").agg(F.min("first").alias("least")), "simhash-least")
    named = linked.join(least, "component").select("node", "least")
    of = classes.join(named, "node", "left").withColumn("least", F.coalesce("least", "first"))
    of = materialize(of.select(*code, F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("first_key")), "simhash-components")
    return prints.join(of, code)


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, key, fingerprint, component_id, first_key.

    component_id is the smallest id reachable over links (a null id only where a group has
    no other); first_key is the key of that document's row.  Null, empty and blank texts have
    fingerprint 0 and link like any other.  A text of any length is hashed whole, in one task
    with some 100 bytes a word.  Repeated rows are kept, and ties in the id go to the smaller
    key.  An empty table gives an empty result; other columns are ignored, whatever their
    names.  ``components`` raises beyond 60 rounds, some 2**30 links in a row.
    """
    prints = materialize(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "simhash-prints")
    named = name_groups(prints, ["fp"], lambda classes: link_forest(classes, distance, segments))
    return named.select("doc_id", "fp", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "first_key")


#: fingerprints of near_dedup: two of two-word shingles, of which either finds candidates, and one of five-word shingles
SIMILAR = {"one": (2, 0), "two": (2, 1), "check": (5, 0)}


def similar_groups(docs: DataFrame, *, distance: int = 7, segments: int = 4, check: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, component_id, first_key of each row, by links of a similarity of about 0.8 in five-word shingles.

    Two documents link if either of their two-word fingerprints lies within ``distance`` bits
    and their five-word ones within ``check``.  Shingle sets of Jaccard 0.8 have a cosine of
    0.89, at which 9.7 of 64 bits differ on average, with a deviation of 2.9; the same edits
    leave two-word shingles 6 bits apart.  Nine in ten such pairs are within both limits,
    nearly all that are more alike, and half of those at 0.7.
    """
    prints = materialize(fingerprints(docs, rolling=SIMILAR, id_col=id_col, text_col=text_col), "simhash-prints")

    def links(classes: DataFrame) -> DataFrame:
        found = [materialize(link_forest(classes.select(F.col(c).alias("fp"), "node", "check"), distance, segments, check), "simhash-links") for c in ("one", "two")]
        return found[0].unionByName(found[1])

    return name_groups(prints, list(SIMILAR), links).select("doc_id", "key", "component_id", "first_key")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document, that of the smallest id, of each of ``similar_groups``.

    A null id stays only where a group has no other; of rows equal in id and text one stays,
    whichever.  Null, empty and blank texts are one group.  All columns are returned; names
    with two leading underscores are the operator's.  An empty table stays empty.
    """
    groups = similar_groups(docs, id_col=id_col, text_col=text_col)
    stay = groups.select(F.col("first_key").alias("__key"), F.xxhash64(F.lit("id"), "component_id").alias("__id")).distinct()
    # join and window share their keys, so whole texts are exchanged once
    keyed = docs.withColumn("__key", F.xxhash64(id_col, text_col)).withColumn("__id", F.xxhash64(F.lit("id"), id_col))
    once = Window.partitionBy("__key", "__id").orderBy("__key")
    met = keyed.join(stay, ["__key", "__id"])
    return met.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*docs.columns)
