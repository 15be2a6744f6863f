"""Streams whose keys are followed in event time by ``transformWithState``: silences and numbering.

Rows wait in map state, by millisecond, until the watermark has passed them; a timer at each
such millisecond then takes them in order, whatever batch or order they came in.  A key that
has been quiet for long enough has no state left.  Sessions need the RocksDB state store
(``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from .. import fixed_values as V


def use_state_store(spark: SparkSession) -> None:
    """``transformWithState`` keeps its state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Takes a key's rows in order of time; ``quiet`` milliseconds after the last one the key is over.

    Rows have ``at`` (milliseconds) and what ``wanted`` names, one value or none.  Of equal
    milliseconds, rows keep the order in which they came.
    """

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "texts array<string>")
        self.last = handle.getValueState("last", StructType([StructField("at", LongType()), StructField("n", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        fresh: dict[int, list] = {}
        for r in rows:
            fresh.setdefault(r["at"], []).append(r["text"])
        for at, texts in fresh.items():
            had = list(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (had + texts,))
            if not had:
                # both before the watermark can pass them: timers made while timers run wait for another batch
                self.handle.registerTimer(at)
                self.handle.registerTimer(at + self.quiet + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        out: list[Row] = []
        at, n = self.last.get() if self.last.exists() else (None, 0)
        if at is not None and now > at + self.quiet:
            out += self.silent(key, at, n)
            at, n = None, 0
            self.last.clear()
        if self.waiting.containsKey((now,)):
            texts = self.waiting.getValue((now,))[0]
            self.waiting.removeKey((now,))
            out += self.taken(key, now, n, texts)
            self.last.update((now, n + len(texts)))
        return iter(out)

    def taken(self, key: tuple, at: int, n: int, texts: list) -> list[Row]:
        return []

    def silent(self, key: tuple, at: int, n: int) -> list[Row]:
        return []

    def close(self) -> None:
        pass


class _Silences(InOrder):
    def silent(self, key: tuple, at: int, n: int) -> list[Row]:
        return [Row(key=key[0], since=at, due=at + self.quiet, events=n)]


class _Numbers(InOrder):
    def taken(self, key: tuple, at: int, n: int, texts: list) -> list[Row]:
        return [Row(key=key[0], seq=n + i + 1, message=t) for i, t in enumerate(texts)]


def _keyed(events: DataFrame, text: str | None, late: str):
    rows = events.withWatermark("ts", late)
    return rows.select(F.col("key").cast("string").alias("key"), "ts", F.unix_millis("ts").alias("at"), (F.col(text).cast("string") if text else F.lit("").cast("string")).alias("text")).groupBy("key")


def keepalives(events: DataFrame, seconds: int = V.KEEPALIVE_SECONDS, late: str = "10 seconds") -> DataFrame:
    """A row for each silence of a key longer than ``seconds``, when it happens: key, since, due, events before it.

    A timer makes the row as soon as the watermark has passed the time at which a sign of
    life was due; no later event is needed.  ``events``: key, ts.
    """
    out = _keyed(events, None, late).transformWithState(_Silences(seconds * 1000), "key string, since long, due long, events long", "append", "EventTime")
    return out.select("key", F.timestamp_millis("since").alias("since"), F.timestamp_millis("due").alias("due"), "events")


def numbered(events: DataFrame, quiet: int = V.SESSION_SECONDS, late: str = "10 seconds") -> DataFrame:
    """Messages with their number from 1 per key, in order of time over all batches.

    After ``quiet`` seconds without events a key is over, and its next event is 1.
    ``events``: key, ts, message.
    """
    return _keyed(events, "message", late).transformWithState(_Numbers(quiet * 1000), "key string, seq long, message string", "append", "EventTime")
