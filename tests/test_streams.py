"""Streams by event-time timers against their batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from graphloom.operators import metrics
from graphloom.streaming import ordered
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, key string, message string"


@pytest.fixture
def streams(spark):
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    ordered.use_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def feed(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, name, make, batches):
    """All rows of a stream over files that come one by one."""
    src = str(tmp_path / f"in-{name}")
    feed(spark, src, batches)
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    rows = spark.table(name).collect()
    state = [o["numRowsTotal"] for o in (q.lastProgress or {"stateOperators": []})["stateOperators"]]
    return rows, state


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for key in ("a", "b", None):
        at = 0
        for n in range(60):
            at += rng.choice([1, 2, 5, 15, 16, 40])
            rows.append((T0 + timedelta(seconds=at), key, f"{key}{n}"))
    return rows


def test_silences_equal_the_batch_gaps(streams, tmp_path):
    rows = sample(3)
    early, late = [r for r in rows if r[0] < T0 + timedelta(seconds=300)], [r for r in rows if r[0] >= T0 + timedelta(seconds=300)]
    random.Random(1).shuffle(early)
    random.Random(2).shuffle(late)
    end = [(T0 + timedelta(days=1), "end", "x")]
    got, state = run(streams, tmp_path, "silences", lambda s: ordered.keepalives(s, 15), [early, late, end])
    df = streams.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", event_id long")
    gaps = {(r["key"], r["ts"]) for r in metrics.keepalive_gaps(df.where("key is not null"), "key").join(df, ["key", "event_id"]).collect()}
    # the batch form names the event after a gap, the stream the silence before it; the last silence has no event after it
    following = {}
    for key in ("a", "b"):
        times = sorted(t for t, k, _ in rows if k == key)
        following |= {(key, a): b for a, b in zip(times, [*times[1:], None], strict=True)}
    found = {(r["key"], following[(r["key"], r["since"])]) for r in got if r["key"] in ("a", "b")}
    assert {x for x in found if x[1]} == gaps, (sorted(map(str, got))[:12], len(got), len(gaps))
    assert {x[0] for x in found if not x[1]} == {"a", "b"}
    assert all(r["due"] - r["since"] == timedelta(seconds=15) for r in got)
    assert sum(r["events"] for r in got if r["key"] == "a") == 60


def test_numbers_follow_time_and_quiet_keys_are_forgotten(streams, tmp_path):
    first = [(T0 + timedelta(seconds=s), "k", f"m{s}") for s in range(40)]
    random.Random(4).shuffle(first)
    second = [(T0 + timedelta(seconds=s), "k", f"m{s}") for s in range(40, 60)]
    again = [(T0 + timedelta(days=3), "k", "again"), (T0 + timedelta(days=3, seconds=1), "k", "more")]
    end = [(T0 + timedelta(days=9), "end", "x")]
    got, _ = run(streams, tmp_path, "numbers", lambda s: ordered.numbered(s, quiet=3600), [first, second, again, end])
    rows = sorted((r["seq"], r["message"]) for r in got if r["key"] == "k")
    assert rows == sorted([*((s + 1, f"m{s}") for s in range(60)), (1, "again"), (2, "more")])
