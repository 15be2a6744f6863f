"""Substring dedup against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest
from graphloom.llm import queries as Q
from graphloom.llm import suffixes


def brute(docs, length):
    """docs in order of earliness: {row: (n_bytes, n_removed, n_spans, kept)}."""
    seen, out = set(), []
    for _, text in docs:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def digest(rows):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows]


def mixture(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(40) for _ in range(4)] + ["ab" * 150, "z" * 260, text(18)]
    docs = []
    for i in range(n):
        parts = [text(rng.randrange(30)) for _ in range(3)]
        for s in rng.sample(shared, rng.randrange(3)):
            a = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(4), s[a : a + rng.randrange(60, 300)])
        docs.append((i, " ".join(parts)))
    docs += [(n + 1 + i, docs[rng.randrange(n)][1]) for i in range(20)]
    return [(None, shared[0]), (-5, None), (-4, ""), *docs]


def test_equals_brute_force(spark):
    for seed, hot, block, fan in ((1, 4096, 4 << 20, 4096), (2, 3, 4 << 20, 4096), (3, 5, 3000, 4096), (4, 4, 2000, 3)):
        docs = mixture(seed)
        shuffled = docs[:]
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)
        got = sorted(digest(suffixes.dedup_substrings(df, hot=hot, block_bytes=block, fan=fan).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert got == [(i, *x) for (i, _), x in zip(docs, brute(docs, 100), strict=True)]


def test_long_strings_and_texts_over_several_slices(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 777)
    docs = mixture(5, 40)
    long = " ".join(t or "" for _, t in docs)
    docs += [(900, long[:9000]), (901, "x" + long[100:4000] + "y" * 700), (902, "y" * 1500)]
    for length, gram in ((300, 40), (61, 60), (100, 100)):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = sorted(digest(suffixes.dedup_substrings(df, length=length, gram=gram, block_bytes=5000).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert got == [(i, *x) for (i, _), x in zip(docs, brute(docs, length), strict=True)]


def test_what_cannot_be_right_raises(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(TypeError):
        suffixes.dedup_substrings(docs)
    for length in (39, 30_001):
        with pytest.raises(ValueError, match="length"):
            suffixes.dedup_substrings(spark.range(1).selectExpr("id doc_id", "'x' text"), length=length)


def test_buckets_are_those_of_spark(spark):
    rng = random.Random(1)
    names = [0, 1, -1, 1 << 40] + [rng.getrandbits(62) for _ in range(200)]
    want = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n long").selectExpr("pmod(hash(n), 37)").collect()]
    assert suffixes.bucket_of(np.array(names), 37).tolist() == want
    keys = suffixes.task_keys(211)
    assert suffixes.bucket_of(keys, 211).tolist() == list(range(211))
    got = [x for x, _ in zip(suffixes.block_names(5, 37), range(20), strict=False)]
    assert got == sorted(got) and set(suffixes.bucket_of(np.array(got), 37).tolist()) == {5}


def test_blocks_do_not_move(spark):
    docs = spark.createDataFrame(mixture(6), "doc_id long, text string").repartition(5)
    plan = suffixes.dedup_substrings(docs, block_bytes=4000)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Bucketed: true" in plan and plan.count("\n") and not [x for x in plan.split("Exchange")[1:] if "raw" in x.split("\n\n")[0]]


def test_repeated_rows_and_empty_tables(spark):
    same = "q" * 30 + "".join(chr(97 + i % 23) + str(i) for i in range(100))
    rows = suffixes.dedup_substrings(spark.createDataFrame([(1, same), (1, same)], "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, len(same)]
    assert suffixes.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in Q.op4_suffix_runs(spark, sf).collect())
    assert got == [(i, *x) for (i, _), x in zip(docs, brute(docs, 100), strict=True)]


def test_a_partition_has_little_text_and_gone_starts_take_eight_bytes():
    # 6 GB by 200 partitions was 32 MB each: a task of four then held over a gigabyte
    assert suffixes.PART_BYTES <= 8 << 20
    gone = [(7, i, 1) for i in range(1000)]
    runs = suffixes.Runs(iter([suffixes._run([b"a"], [b""], [1], [7], [0], gone)]))
    assert len(runs.gone[7].tobytes()) == 8 * len(gone)


def test_merge_orders_and_tells_prefixes():
    rng = random.Random(7)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30))) for _ in range(11)]
    got, prev = [], b""
    for _, s, h in suffixes.merge([suffixes.decode(*suffixes.front_code(r)) for r in runs]):
        assert not got or s[:h] == prev[:h] and (len(s) == h or len(prev) == h or s[h] != prev[h])
        got.append(s)
        prev = s
    assert got == sorted(x for r in runs for x in r)
