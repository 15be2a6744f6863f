"""Operator 4: exact substring dedup by a distributed merge sort of suffixes.

Method: a byte goes if a ``length``-byte string covering it also starts earlier.  Two equal
strings have equal minimizers (the least-hashed gram among those they hold, leftmost on
ties), so suffixes need sorting only from minimizers on, about one byte in thirty:

1. texts are packed into blocks, a table in the shared folder bucketed by block, so that
   they never move again; every block sends the distinct hashes of its minimizer grams and
   gets back which of them occur again anywhere;
2. starts whose minimizer occurs once drop out; the others of one minimizer form one suffix
   (from the minimizer on) with the bytes left of it.  A block sorts its suffixes by
   partition and bytes, front-codes them (common prefix with the one before, then the rest)
   and sends one run per partition of the gram hash;
3. a partition merges its runs with a loser tree that carries common-prefix lengths and
   compares bytes only beyond them; neighbours in the merged order share long prefixes, and
   strings equal on both sides of the minimizer are told apart by order of place.  More than
   ``fan`` blocks are merged in two levels: batches of blocks by groups of partitions first;
4. blocks get back the starts to cover and cut the bytes.

Equal suffixes of a block are sent once.  A gram that occurs very often is dealt over the
partitions by the bytes around it that all strings of a range of distances share, so a
partition gets only what is equal far beyond the gram, once per block.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnp
from .common import materialize_bucketed, text_slices

LENGTH = 100
GRAM = 40
#: text of a block and, of all blocks, for a partition: a task holds some thirty times as much of either
BLOCK_BYTES, PART_BYTES = 6 << 20, 8 << 20
SLICE = 512 << 10
#: occurrences of a gram from which its starts are dealt by their context, and distances per deal
HOT, STEP = 4096, 8
#: runs merged at a time, and Spark partitions at most (each takes its parts one after another)
FAN, PARTITIONS = 4096, 20_000
#: lengths are stored in 16 bits, and a run's strings begin with their partition's number
LONGEST, NUMBER = 30_000, 4


def _pack(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _binary(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Byte strings of the given lengths, one after another in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of a binary column."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), np.diff(offsets).astype(np.int64)


def _runs_of_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive rows of equal key, of rows sorted by it: only one key's rows are held."""
    now, held = None, []
    for b in batches:
        k = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and k[i] != now:
                yield int(now), held
                held = []
            now = k[i]
            held.append(b.slice(i, j - i))
    if held:
        yield int(now), held


def minimizers(text: np.ndarray, lens: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Minimizers of all strings inside rows: (place, gram hash, first start, last start).

    Runs over slices of starts, long rows included; a minimizer whose starts lie in two
    slices comes twice, with a part of them each.
    """
    ends = np.cumsum(lens)
    parts, total = [], int(ends[-1]) if len(ends) else 0
    width, mask = length - gram + 1, np.uint64((1 << 30) - 1)
    for base in range(0, total - length + 1, SLICE):
        n = min(SLICE, total - length + 1 - base)
        data = text[base : base + n + length - 1]
        s, q = textnp.prefix_hash(data)
        m = len(data) - gram + 1
        g = textnp.mix((s[gram:] - s[:m]) * q[:m])
        low = (g & ~mask) | np.arange(m, dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:n], low[width - span : width - span + n])
        place = (low[:n] & mask).astype(np.int64)
        # starts whose string ends in their own row
        i, j = np.searchsorted(ends, [base, base + n - 1], "right")
        borders = np.minimum(ends[i : j + 1], base + n)
        row_end = np.repeat(ends[i : j + 1], np.diff(np.concatenate([[base], borders])))
        starts = np.flatnonzero(row_end - np.arange(base, base + n) >= length)
        if not len(starts):
            continue
        place = place[starts]
        edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.append(edge[1:], len(starts)) - 1
        at = place[edge]
        parts.append((at + base, g[at], starts[edge] + base, starts[last] + base))
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none


class Block:
    def __init__(self, raw: bytes, lens: list[int], length: int, gram: int) -> None:
        self.bytes = zstandard.ZstdDecompressor().decompress(raw)
        self.lens = np.array(lens, np.int64)
        self.at, self.hash, self.first, self.last = minimizers(np.frombuffer(self.bytes, np.uint8), self.lens, length, gram)
        #: distinct grams by 48 bits of their hash (more are compared in vain, at worst)
        self.grams, self.gram_of, self.counts = np.unique(self.hash >> np.uint64(16), return_inverse=True, return_counts=True)

    def deal(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(order of the distinct grams by partition, their partitions)."""
        p = (self.grams % np.uint64(parts)).astype(np.int64)
        return np.argsort(p, kind="stable"), p


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """Spark's bucket of longs: Murmur3 (32 bits, seed 42) of their two halves, modulo."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = np.full(len(values), 42, np.uint32)
    for half in (values & 0xFFFFFFFF, values >> 32):
        h ^= turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % buckets


def block_names(part: int, buckets: int) -> Iterator[int]:
    """Ascending names for a task's blocks that fall into one bucket, so that the task writes one file."""
    for base in range(0, 1 << 31, 65_536):
        names = (part << 32) | np.arange(base, base + 65_536, dtype=np.int64)
        yield from names[bucket_of(names, buckets) == part % buckets].tolist()


def task_keys(tasks: int) -> np.ndarray:
    """A long for each of ``tasks`` shuffle partitions that lands there: numbers dealt by it spread evenly."""
    keys, base = np.full(tasks, -1, np.int64), 0
    while (keys < 0).any():
        names = np.arange(base, base + 4 * tasks + 1024, dtype=np.int64)
        found, first = np.unique(bucket_of(names, tasks), return_index=True)
        keys[found] = np.where(keys[found] < 0, names[first], keys[found])
        base += len(names)
    return keys


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, buckets: int) -> DataFrame:
    """(block, ids, lens, raw, size): whole texts in input order, about ``block_bytes`` together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = block_names(TaskContext.get().partitionId(), buckets)
        ids: list = []
        lens: list[int] = []
        held: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal ids, lens, held, size
            raw = zstandard.ZstdCompressor(level=3).compress(b"".join(held))
            out = _table([(next(names), ids, lens, raw, size)], ["block", "ids", "lens", "raw", "size"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()])
            ids, lens, held, size = [], [], [], 0
            return out

        for batch in batches:
            for rows, data, offsets in text_slices(batch, "t", block_bytes):
                if ids and size + len(data) > block_bytes:
                    yield block()
                ids += rows.column("id").to_pylist()
                lens += np.diff(offsets).tolist()
                held.append(data.tobytes())
                size += len(data)
                if size >= block_bytes:
                    yield block()
        if ids:
            yield block()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "block bigint, ids array<bigint>, lens array<bigint>, raw binary, size bigint")


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Sorted byte strings of 16-bit length as (common prefixes, rest lengths, rests)."""
    same, rest, out, prev = array("H"), array("H"), [], b""
    for s in strings:
        h = common(prev, s, 0)
        same.append(h)
        rest.append(len(s) - h)
        out.append(s[h:])
        prev = s
    return same.tobytes(), rest.tobytes(), b"".join(out)


def decode(same: bytes, rest: bytes, data: bytes) -> Iterator[tuple[bytes, int]]:
    prev, at = b"", 0
    for h, r in zip(array("H", same), array("H", rest), strict=True):
        prev = prev[:h] + data[at : at + r]
        at += r
        yield prev, h


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - (x.bit_length() + 7) // 8


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Merges sorted runs of (string, common prefix with the run's string before).

    Yields (run, string, common prefix with the string yielded before).  The tree holds, for
    each loser, its common prefix with the winner that beat it; a candidate whose prefix
    with the last output is longer wins without a look at any byte.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head: list[bytes] = [b""] * k
    prefix = [-1] * k  # -1: run is over
    for i, r in enumerate(runs):
        got = next(r, None)
        if got is not None:
            head[i], prefix[i] = got[0], 0
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); updates the loser's prefix to that with the winner."""
        ha, hb = prefix[a], prefix[b]
        if ha > hb:
            return a, b
        if hb > ha:
            return b, a
        if ha < 0:
            return a, b
        x, y = head[a], head[b]
        h = common(x, y, ha)
        if len(y) == h and len(x) > h or (len(x) > h and len(y) > h and y[h] < x[h]):
            prefix[a] = h
            return b, a
        prefix[b] = h
        return a, b

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, loser[node] = play(build(2 * node), build(2 * node + 1))
        return w

    winner = build(1) if k > 1 else 0
    while prefix[winner] >= 0:
        yield winner, head[winner], prefix[winner]
        got = next(runs[winner], None)
        if got is None:
            prefix[winner] = -1
        else:
            head[winner], prefix[winner] = got
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def _send_grams(parts: int, lands: np.ndarray, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block and partition: 48 bits of each distinct gram's hash, and 16 of its count."""
        for b in batches:
            for name, lens, raw in zip(b.column("block").to_pylist(), b.column("lens").to_pylist(), b.column("raw"), strict=True):
                block = Block(raw.as_py(), lens, length, gram)
                order, p = block.deal(parts)
                if not len(order):
                    continue
                sent = ((block.grams << np.uint64(16)) | np.minimum(block.counts, 0xFFFF).astype(np.uint64))[order]
                to, many = np.unique(p, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lands[to % len(lands)]), pa.array(to, pa.int32()), pa.array(np.full(len(to), name), pa.int64()), _binary(sent, many * 8)], ["task", "part", "block", "hashes"])

    return run


def _count_grams(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block and partition, a byte for each gram: 0 once, 1 again, 2 very often."""
        for _, rows in _runs_of_key(batches, "part"):
            sent = [_bytes_of(b.column("hashes")) for b in rows]
            whole = np.concatenate([x.view(np.uint64) for x, _ in sent])
            k, n = whole >> np.uint64(16), (whole & np.uint64(0xFFFF)).astype(np.int64)
            grams, of = np.unique(k, return_inverse=True)
            total = np.bincount(of, weights=n)
            flags = np.where(total >= hot, 2, np.where(total > 1, 1, 0)).astype(np.uint8)[of]
            at = 0
            for b, (x, lens) in zip(rows, sent, strict=True):
                yield pa.RecordBatch.from_arrays([b.column("part"), b.column("block"), _binary(flags[at : at + len(x) // 8], lens // 8)], ["part", "block", "flags"])
                at += len(x) // 8

    return run


def _run(keys: list[bytes], lefts: list[bytes], ids: list[int], blocks: list[int], places: list[int], gone: list[tuple[int, int, int]]) -> bytes:
    """Sorted strings with what is left of them and where they are; gone: (block, start, starts to cover)."""
    return _pack(front_code(keys), array("H", map(len, lefts)).tobytes(), b"".join(lefts), np.array(ids, np.int64), np.array(blocks if blocks.count(blocks[0]) < len(blocks) else blocks[:1], np.int64), np.array(places, np.int32), np.array(gone, np.int64).reshape(-1, 3))


class Runs:
    """Runs opened for a merge: what they say is gone, and (string, prefix) and side streams."""

    def __init__(self, packed: Iterable[bytes]) -> None:
        #: of each block, starts and numbers of starts by turns, in 32 bits
        self.gone: dict[int, array] = defaultdict(lambda: array("i"))
        self.strings, self.sides = [], []
        for data in packed:
            coded, lens, lefts, ids, blocks, places, gone = _unpack(data)
            for block, start, n in gone.tolist():
                self.gone[block].extend((start, n))
            self.strings.append(decode(*coded))
            self.sides.append(self._side(array("H", lens), lefts, ids, blocks, places))

    @staticmethod
    def _side(lens: array, lefts: bytes, ids: np.ndarray, blocks: np.ndarray, places: np.ndarray) -> Iterator[tuple[bytes, int, int, int]]:
        at, one = 0, len(blocks) == 1
        for n, (size, i, place) in enumerate(zip(lens, ids, places, strict=True)):
            yield lefts[at : at + size], int(i), int(blocks[0 if one else n]), int(place)
            at += size

    def merged(self) -> Iterator[tuple[bytes, int, bytes, int, int, int]]:
        """(string, prefix with the one before, left, id, block, place) in order of strings."""
        for r, string, same in merge(self.strings):
            yield string, same, *next(self.sides[r])


def _send_runs(parts: int, group: int, many: int, lands: np.ndarray, length: int, gram: int):
    def runs_of(name: int, ids: list, lens: list[int], raw: bytes, replies: pa.Scalar) -> list[tuple]:
        b = Block(raw, lens, length, gram)
        if not len(b.at):
            return []
        got = replies.values
        order, _ = b.deal(parts)
        flags = np.zeros(len(b.grams), np.uint8)
        flags[order] = _bytes_of(got.field("flags").take(pa.array(np.argsort(got.field("part").to_numpy(), kind="stable"))))[0]
        flags = flags[b.gram_of]
        some = np.flatnonzero(flags)
        row = np.searchsorted(np.cumsum(b.lens), b.at[some], "right")
        low = -(1 << 63)
        names = [low if i is None else i for i in ids]
        text = b.bytes
        # (partition's number and suffix, left) -> earliest (id, place); the others of a block are sure to go
        seen: dict[tuple[bytes, bytes], tuple[int, int]] = {}
        gone: list[tuple[int, int, int]] = []
        part = (b.grams[b.gram_of[some]] % np.uint64(parts)).astype(np.int64)
        for a, p, s0, s1, f, r in zip(b.at[some].tolist(), part.tolist(), b.first[some].tolist(), b.last[some].tolist(), flags[some].tolist(), row.tolist(), strict=True):
            pieces = [(s0, s1, p)]
            if f == 2:
                pieces = []
                for step in range((a - s1) // STEP, (a - s0) // STEP + 1):
                    near, far = step * STEP, min(step * STEP + STEP - 1, length - gram)
                    shared = xxhash.xxh64_intdigest(text[a - near : a - far + length], step)
                    pieces.append((max(s0, a - far), min(s1, a - near), shared % parts))
            for u, v, p in pieces:
                key = (p.to_bytes(NUMBER, "big") + text[a : v + length], text[u:a])
                mine, kept = (names[r], a), seen.get(key)
                if kept is None:
                    seen[key] = mine
                    continue
                if mine < kept:
                    seen[key], mine = mine, kept
                gone.append((name, mine[1] - len(key[1]), v - u + 1))
        del b
        out, keys, i = [], sorted(seen), 0
        to = [int.from_bytes(k[0][:NUMBER], "big") // group for k in keys]
        while i < len(keys):
            j = i
            while j < len(keys) and to[j] == to[i]:
                j += 1
            places = [seen[k] for k in keys[i:j]]
            key = to[i] * many + zlib.crc32(name.to_bytes(8, "big")) % many
            out.append((int(lands[key % len(lands)]), key, _run([k[0] for k in keys[i:j]], [k[1] for k in keys[i:j]], [x[0] for x in places], [name], [x[1] for x in places], gone)))
            gone, i = [], j
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, ids, lens, raw, replies in zip(b.column("block").to_pylist(), b.column("ids").to_pylist(), b.column("lens").to_pylist(), b.column("raw"), b.column("replies"), strict=True):
                if replies.is_valid:
                    rows = runs_of(name, ids, lens, raw.as_py(), replies)
                    for i in range(0, len(rows), 256):
                        yield _table(rows[i : i + 256], ["task", "key", "run"], [pa.int64(), pa.int64(), pa.binary()])

    return run


def _merge_batches(lands: np.ndarray, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First level: the runs of a batch of blocks for a group of partitions become one for each partition."""
        for _, rows in _runs_of_key(batches, "key"):
            runs = Runs(r.as_py() for b in rows for r in b.column("run"))
            gone = [(block, *x) for block, v in runs.gone.items() for x in zip(v[::2], v[1::2], strict=True)]
            keys, lefts, ids, blocks, places = [], [], [], [], []

            def close() -> pa.RecordBatch:
                nonlocal keys, lefts, ids, blocks, places, gone
                part = int.from_bytes(keys[0][:NUMBER], "big")
                row = (int(lands[part % len(lands)]), part, _run(keys, lefts, ids, blocks, places, gone))
                keys, lefts, ids, blocks, places, gone = [], [], [], [], [], []
                return _table([row], ["task", "key", "run"], [pa.int64(), pa.int64(), pa.binary()])

            equal: dict[bytes, int] = {}  # left of the strings equal to the last one -> entry
            for string, same, left, i, block, place in runs.merged():
                if keys and keys[-1][:NUMBER] != string[:NUMBER]:
                    yield close()
                if not keys or same < len(string) or len(keys[-1]) > len(string):
                    equal = {}
                n = equal.get(left)
                if n is None:
                    equal[left] = len(keys)
                    for held, x in zip((keys, lefts, ids, blocks, places), (string, left, i, block, place), strict=True):
                        held.append(x)
                    continue
                if (i, block, place) < (ids[n], blocks[n], places[n]):
                    block, place, ids[n], blocks[n], places[n] = blocks[n], places[n], i, block, place
                gone.append((block, place - len(left), len(string) - NUMBER + len(left) - length + 1))
            if keys:
                yield close()

    return run


def _merge_runs(length: int, gram: int):
    def settle(bucket: list[tuple], gone: dict[int, array]) -> None:
        """bucket: (string, prefix with the one before, left, id, block, place), one gram, sorted."""
        # equal on both sides: the earliest stays for comparison, the others go
        best: dict[tuple[bytes, bytes], int] = {}
        for n, (string, _, left, *order) in enumerate(bucket):
            kept = best.setdefault((string, left), n)
            if kept != n:
                lose = n
                if order < list(bucket[kept][3:]):
                    best[(string, left)], lose = n, kept
                e = bucket[lose]
                gone[e[4]].extend((e[5] - len(left), len(string) - NUMBER + len(left) - length + 1))
        if len(best) < 2:
            return
        # prefixes between the remaining neighbours: minima over what lies between
        chosen = sorted(best.values())
        prefixes, h, k = [], 1 << 30, 0
        for n, e in enumerate(bucket):
            h = min(h, e[1])
            if k < len(chosen) and n == chosen[k]:
                prefixes.append(h)
                h, k = 1 << 30, k + 1
        rows = [bucket[n] for n in chosen]
        lost = [0] * len(rows)
        for o in range(min(length + NUMBER - len(e[0]) for e in rows), max(len(e[2]) for e in rows) + 1):
            need, cls, held = length - o + NUMBER, 0, {}
            for n, e in enumerate(rows):
                if prefixes[n] < need:
                    cls += 1
                if len(e[2]) < o or len(e[0]) < need:
                    continue
                key = (cls, e[2][len(e[2]) - o :])
                kept = held.setdefault(key, n)
                if kept != n:
                    if e[3:] < rows[kept][3:]:
                        held[key] = n
                        lost[kept] |= 1 << o
                    else:
                        lost[n] |= 1 << o
        for e, bits in zip(rows, lost, strict=True):
            while bits:
                top = bits.bit_length()
                run = (~bits & ((1 << top) - 1)).bit_length()  # bits run..top-1 are set
                gone[e[4]].extend((e[5] - top + 1, top - run))
                bits &= (1 << run) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs_of_key(batches, "key"):
            runs = Runs(r.as_py() for b in rows for r in b.column("run"))
            bucket: list[tuple] = []
            for e in runs.merged():
                if bucket and e[1] < gram + NUMBER:
                    if len(bucket) > 1:
                        settle(bucket, runs.gone)
                    bucket = []
                bucket.append(e if bucket else (e[0], 0, *e[2:]))
            if len(bucket) > 1:
                settle(bucket, runs.gone)
            found = [(block, x.tobytes()) for block, x in runs.gone.items() if x]
            if found:
                yield _table(found, ["block", "gone"], [pa.int64(), pa.binary()])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, lens, raw, replies in zip(b.column("ids").to_pylist(), b.column("lens").to_pylist(), b.column("raw"), b.column("replies").to_pylist(), strict=True):
                text = zstandard.ZstdDecompressor().decompress(raw.as_py())
                gone = np.frombuffer(b"".join(replies or []), np.int32).reshape(-1, 2).astype(np.int64)
                gone = gone[np.argsort(gone[:, 0], kind="stable")]
                ends = np.cumsum(np.array(lens, np.int64))
                start, end = gone[:, 0], gone[:, 0] + gone[:, 1] + length - 1
                row = np.searchsorted(ends, start, "right")
                far = np.maximum.accumulate(end) if len(end) else end
                fresh = np.flatnonzero(np.concatenate([[True], (start[1:] > far[:-1]) | (row[1:] != row[:-1])])) if len(start) else np.zeros(0, np.int64)
                starts, stops = start[fresh], far[np.append(fresh[1:], len(start)) - 1] if len(start) else far
                first = np.searchsorted(row[fresh], np.arange(len(ids) + 1)).tolist()
                rows, at = [], 0
                for n, (i, size) in enumerate(zip(ids, lens, strict=True)):
                    spans = list(zip(starts[first[n] : first[n + 1]].tolist(), stops[first[n] : first[n + 1]].tolist(), strict=True))
                    borders = [at, *(x for s in spans for x in s), at + size]
                    kept = b"".join(text[u:v] for u, v in zip(borders[::2], borders[1::2], strict=True))
                    rows.append((i, size, size - len(kept), len(spans), kept))
                    at += size
                yield _table(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    return run


def dedup_substrings(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes).

    Earlier means a smaller doc_id (a null id comes first), rows repeating an id in order of
    input, and an earlier start inside a document.  Ids must be integers, ``length`` from
    ``gram`` to 30,000; anything else raises.  Null and empty texts have no bytes; texts
    shorter than ``length`` stay whole; one over ``block_bytes`` is a block of its own, which
    a task holds whole.  Other columns are ignored, whatever their names; an empty table
    gives an empty result.  Kept bytes may split a character.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    if not 1 <= gram <= length <= LONGEST or length - gram >= 1 << 16:
        raise ValueError(f"length must lie between gram and {LONGEST}")
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize_bucketed(pack_blocks(docs, id_col, text_col, block_bytes, shuffle), "suffix-blocks", "block", shuffle)
    count, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(shuffle, -(-total // part_bytes))
    tasks = max(shuffle, min(parts, PARTITIONS))

    lands = task_keys(tasks)

    def dealt(rows: DataFrame, key: str) -> DataFrame:
        return rows.repartition(tasks, "task").sortWithinPartitions(key)

    def with_replies(reply: str, replies: DataFrame) -> DataFrame:
        return blocks.drop("size").join(replies.groupBy("block").agg(F.collect_list(reply if reply == "gone" else F.struct("part", reply)).alias("replies")), "block", "left")

    sent = blocks.select("block", "lens", "raw").mapInArrow(_send_grams(parts, lands, length, gram), "task bigint, part int, block bigint, hashes binary")
    flags = dealt(sent, "part").mapInArrow(_count_grams(hot), "part int, block bigint, flags binary")
    deep = count > fan
    group, many = (-(-parts // fan), -(-count // fan)) if deep else (1, 1)
    run = "task bigint, key bigint, run binary"
    runs = with_replies("flags", flags).mapInArrow(_send_runs(parts, group, many, lands, length, gram), run)
    if deep:
        runs = dealt(runs, "key").mapInArrow(_merge_batches(lands, length), run)
    gone = dealt(runs, "key").mapInArrow(_merge_runs(length, gram), "block bigint, gone binary")
    return with_replies("gone", gone).mapInArrow(_cut(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
