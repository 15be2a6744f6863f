"""Structured Streaming forms of quota, limiter and breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as V


def quota_stream(usage: DataFrame, late: str = "1 day") -> DataFrame:
    """Tokens per day and user over a stream, with a watermark."""
    return usage.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "user_id").agg(F.sum("tokens").alias("tokens")).select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "user_id", "tokens")


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All of a key's rows of a micro-batch by time: they may come in several frames."""
    return pd.concat(list(frames), ignore_index=True).sort_values("ts", kind="stable")


def _micros(t: pd.Timestamp) -> int:
    return int(t.value // 1000)


def _forget_after(state: GroupState, last_us: int, seconds: int) -> None:
    """Sets the time, by the watermark, from which the key's state matters no more."""
    at = last_us // 1000 + seconds * 1000 + 1
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def limiter_stream(requests: DataFrame, limit: int, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """T5: per request whether it is accepted; the state holds the accepted times in the window.

    ``requests``: ts, key (string).  Within a micro-batch requests are taken by time.  A key
    is forgotten once the watermark has passed its last window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        out, last = [], 0
        for t in _in_order(frames)["ts"]:
            last = _micros(t)
            held = [x for x in held if x > last - seconds * 1_000_000]
            ok = len(held) < limit
            if ok:
                held.append(last)
            out.append((key[0], t, ok))
        state.update((held,))
        _forget_after(state, last, seconds)
        yield pd.DataFrame(out, columns=["key", "ts", "accepted"])

    return requests.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, accepted boolean", "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def breaker_stream(events: DataFrame, failures: int = V.BREAKER_FAILURES, seconds: int = V.BREAKER_SECONDS, late: str = "1 minute", quiet: int = V.BREAKER_QUIET_SECONDS) -> DataFrame:
    """Breaker state after each event. ``events``: ts, provider, ok.

    Within a micro-batch events are taken by time.  A provider without events for ``quiet``
    seconds of the watermark starts anew.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name, row, since = state.get if state.exists else ("closed", 0, 0)
        out, last = [], 0
        for t, ok in _in_order(frames)[["ts", "ok"]].itertuples(index=False):
            last = _micros(t)
            if name == "open" and last - since >= seconds * 1_000_000:
                name = "half_open"
            if name != "open":
                if ok:
                    name, row = "closed", 0
                else:
                    row += 1
                    if name == "half_open" or row >= failures:
                        name, since = "open", last
            out.append((key[0], t, name))
        state.update((name, row, since))
        _forget_after(state, last, quiet)
        yield pd.DataFrame(out, columns=["provider", "ts", "state"])

    return events.withWatermark("ts", late).groupBy("provider").applyInPandasWithState(step, "provider string, ts timestamp, state string", "name string, row int, since bigint", "append", GroupStateTimeout.EventTimeTimeout)


def numbered_stream(events: DataFrame, late: str = "1 minute", quiet: int = V.SESSION_SECONDS) -> DataFrame:
    """Adds a sequence number from 1 per key. ``events``: key, ts, message.

    A key without events for ``quiet`` seconds of the watermark is over; its next event is 1.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        pdf = _in_order(frames)
        state.update((n + len(pdf),))
        _forget_after(state, _micros(pdf["ts"].iloc[-1]), quiet)
        yield pd.DataFrame({"key": key[0], "seq": range(n + 1, n + len(pdf) + 1), "message": pdf["message"].tolist()})

    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key string, seq long, message string", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def alive(events: DataFrame, silence: str = f"{V.KEEPALIVE_SECONDS} seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of a key's events with no silence longer than ``silence`` inside: key, start, end, events."""
    s = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", silence).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return s.select("key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
