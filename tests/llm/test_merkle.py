"""Merkle manifests against a tree built node by node."""

import hashlib
import random
import zlib

import pytest
from graphloom.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, kids string, leaf string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hashed(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fan):
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // fan * fan :][:fan]
            proofs[i].append((run[: p % fan], run[p % fan + 1 :]))
        level, at = [h("".join(level[i : i + fan])) for i in range(0, len(level), fan)], [p // fan for p in at]
    return level[0], proofs


def expected(rows, fan):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, hashed(r)))
    built = [tree([hashed(r) for r in by[s]], fan) for s in names]
    root, above = tree([b[0] for b in built], fan)
    out = []
    for s, (subroot, proofs), up in zip(names, built, above, strict=True):
        for r, own in zip(by[s], proofs, strict=True):
            proof = own + up
            now = hashed(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = hashed((*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)})))
            for left, right in proof:
                now = h("".join(left) + now + "".join(right))
            out.append((r[0], hashed(r), subroot, root, h("".join("".join(a) + "".join(b) for a, b in proof)), now, now == root))
    return out


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(i, "hot" if i % 3 else rng.choice([None, "", "a", "é", "\U0001f600"]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "Ab c", "É x" * (i % 7)])) for i in range(n)]
    return rows + [(3, "hot", "en", 1, "Same"), (3, "hot", "en", 1, "Same"), (None, "hot", None, None, None), (7, "one", "en", 2, "X" * 200_000), (None, None, None, None, None)]


def order(r):
    return tuple((v is not None, str(v)) for v in r)


@pytest.mark.parametrize(("n", "fan"), [(700, 16), (90, 2), (0, 16)])
def test_audit_equals_a_tree_by_hand(spark, n, fan):
    rows = rows_of(n, n)
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in merkle.audit(docs, fan=fan).collect()]
    # rows equal in id differ only in place
    assert sorted(got, key=order) == sorted(expected(rows, fan), key=order)


def test_many_sources_and_one_document(spark):
    rows = [(i, f"s{i:04d}", "en", 1, f"T{i}") for i in range(300)]
    assert sorted((tuple(r) for r in merkle.audit(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()), key=order) == sorted(expected(rows, 16), key=order)
    (one,) = merkle.audit(spark.createDataFrame([(5, "a", "en", 1, "low", "", "")], SCHEMA)).collect()
    assert one["root"] == one["leaf"] == one["subroot"] == hashed((5, "a", "en", 1, "low"))
    assert one["proof_sha256"] == h("") and one["verified"]


def test_no_rows(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_changed_row_is_found_by_its_proof(spark):
    docs = spark.createDataFrame([(i, "s", f"t{i}") for i in range(40)], "id long, source string, text string").withColumn("leaf", merkle.leaf(F.col("id"), F.col("text")))
    proved = merkle.prove(merkle.build(docs, "leaf", ["id"], carry=["id"]), ["id"])
    now = docs.select("id", merkle.leaf(F.col("id"), F.when(F.col("id") == 7, "other").otherwise(F.col("text"))).alias("now"))
    bad = proved.join(now, "id").where(merkle.fold(F.col("now"), F.col("proof")) != F.col("root"))
    assert [r["id"] for r in bad.collect()] == [7]
