"""Prefix tries against one built conversation by conversation."""

import hashlib
import random
import re
import zlib

import pytest
from graphloom.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, key string, words string"


def expected(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", prefix_digest(role or "", text or ""), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())
    )


def prefix_digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def talk(seed, convs, vocabulary):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 3 // 2), convs):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, None]) if rng.random() < 0.1 else turn, rng.choice(["user", "assistant", None]), rng.choice(vocabulary)))
    return rows


@pytest.mark.parametrize(("seed", "convs", "ranges"), [(1, 60, 1), (2, 60, 7), (3, 400, 40), (4, 400, 400)])
def test_nodes_equal_a_trie_by_hand(spark, seed, convs, ranges):
    rows = talk(seed, convs, ["a b c", "a  b\tc", "", None, "é x", "hello " * 50])
    rows += [(None, 0, "user", "no conversation"), (-40, 0, "user", "a"), (-41, 0, "user", "a"), (-41, 1, "user", "b")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(6)
    got = prefixtrie.prefix_trie(prefixtrie.rebuild(prefixtrie.sequences(docs)), ranges=ranges)
    assert found(got) == expected(rows)


@pytest.mark.parametrize("ranges", [3, 50])
def test_one_conversation_many_times(spark, ranges):
    """Copies of one conversation, and of its beginning, are dealt over ranges."""
    rows = [(c * 20, t, "user", f"turn {t}") for c in range(700) for t in range(4 + (c % 3 == 0))]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert found(prefixtrie.prefix_trie(prefixtrie.rebuild(prefixtrie.sequences(docs)), ranges=ranges)) == expected(rows)


def test_a_long_conversation_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "RUN_TURNS", 50)
    rows = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}" if t != 1500 else "x") for t in range(3000)] + [(3, 0, "user", "same")] * 9 + [(4, 0, "user", "w " * 300_000)]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert found(prefixtrie.prefix_trie(prefixtrie.rebuild(prefixtrie.sequences(docs)), ranges=9)) == expected(rows)


def test_turnless_and_none(spark):
    own = spark.createDataFrame([(5, [])], "conv_id long, turns array<struct<unit:string,words:long>>")
    assert found(prefixtrie.prefix_trie(own)) == [(5, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())]
    assert prefixtrie.prefix_trie(own.limit(0)).count() == 0
    assert prefixtrie.prefix_trie(prefixtrie.rebuild(prefixtrie.sequences(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_splitters_are_short_and_even():
    strings = [bytes([1, k]) * 8 + prefixtrie._end(k) for k in range(200)]
    cuts = prefixtrie.splitters(strings, 10)
    assert len(cuts) == 9 and all(len(c) <= 3 for c in cuts)
    assert prefixtrie.splitters([], 5) == []
