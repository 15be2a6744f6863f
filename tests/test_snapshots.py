"""Stored tables: versions, changes by bucket, compaction, concurrent writers."""

import json

import pytest
from graphloom.sources.snapshots import Conflict, Snapshots

SCHEMA = "k long, v string, `odd name` int"


def rows(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], buckets=8)


def test_versions_show_all_or_nothing(spark, table):
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert rows(table.read()) == [] and table.compact() == 0
    table.write(df((1, "a", 1), (2, "b", 2), (None, "n", 0)))
    was = table.read()
    table.upsert(df((2, "c", 3), (3, "d", None), (3, "e", None)), gone=df((1, "", 0)).select("k"))
    assert rows(table.read()) == rows(df((2, "c", 3), (3, "e", None), (None, "n", 0)))
    # a reader that began before, and one that asks for the version
    assert rows(was) == rows(table.read(1)) == rows(df((1, "a", 1), (2, "b", 2), (None, "n", 0)))
    table.upsert(df((None, "m", 9), (1, "again", 5)))
    want = rows(df((1, "again", 5), (2, "c", 3), (3, "e", None), (None, "m", 9)))
    assert rows(table.read()) == want
    assert table.compact() == 4 and rows(table.read()) == want
    assert all(not e["log"] for e in table._manifest()["entries"].values())
    table.write(df((7, "new", 7)))
    assert rows(table.read()) == [(7, "new", 7)] and table.versions() == [1, 2, 3, 4, 5]


def test_an_upsert_touches_its_buckets_only(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=32)
    table.write(spark.range(20_000).selectExpr("id AS k", "'old' AS v"))
    before = table._manifest()["entries"]
    table.upsert(spark.createDataFrame([(5, "new"), (70_000, "new")], "k long, v string"))
    after = table._manifest()["entries"]
    moved = [b for b in after if after[b] != before.get(b)]
    assert len(before) == 32 and 1 <= len(moved) <= 2 and all(after[b]["base"] == before[b]["base"] for b in after)
    got = table.read()
    assert got.count() == 20_001 and rows(got.where("v = 'new'")) == [(5, "new"), (70_000, "new")]
    table.compact()
    folded = table._manifest()["entries"]
    assert [b for b in folded if folded[b]["base"] != before[b]["base"]] == moved
    kept = {f.name for f in (tmp_path / "t").iterdir()}
    lost = table.vacuum(keep=1)
    assert len(lost) == 1 and lost[0].startswith("log-") and set(lost) < kept and table.read().count() == 20_001


def test_two_writers_and_other_formats(spark, table, tmp_path):
    df = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    table.write(df)
    with pytest.raises(Conflict):
        table._commit(1, {}, 8)
    assert rows(table.read()) == [(1, "a", 1)]
    at = tmp_path / "t/manifest/0000000001.json"
    at.write_text(json.dumps(json.loads(at.read_text()) | {"format": 99}))
    (tmp_path / "t/manifest/.0000000001.json.crc").unlink(missing_ok=True)
    assert rows(table.read()) == []


def test_the_bucket_count_of_a_table_stays(spark, tmp_path):
    Snapshots(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=4).write(spark.range(50).selectExpr("id AS k", "'a' AS v"))
    other = Snapshots(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=16)
    other.upsert(spark.range(50).selectExpr("id AS k", "'b' AS v"))
    assert {r["v"] for r in other.read().collect()} == {"b"} and other.read().count() == 50
