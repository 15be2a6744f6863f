"""Operational analytics: quota, spend, rate limits, breaker states, stage histograms."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from .folds import fold


def quota_daily(usage: DataFrame) -> DataFrame:
    """Tokens per day and user. ``usage``: ts, user_id, provider, tokens."""
    return usage.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def spend(usage: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Tokens and USD per day and provider (tokens / 1000 * rate)."""
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    g = usage.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "provider").agg(F.sum("tokens").alias("tokens"))
    return g.withColumn("usd", F.round(F.col("tokens") / 1000 * F.coalesce(F.try_element_at(rate, F.col("provider")), F.lit(0.0)), 4))


def quota_breach(usage: DataFrame, quota: int = V.USER_QUOTA_TOKENS) -> DataFrame:
    """User-days over quota, with remaining floored at 0."""
    d = quota_daily(usage)
    return d.select("day", "user_id", "tokens", F.greatest(F.lit(0), F.lit(quota) - F.col("tokens")).alias("remaining"), (F.col("tokens") > quota).alias("blocked"))


def bucket_label(value: Column, bounds: list[float]) -> Column:
    """Smallest bound that holds the value, +Inf beyond."""
    c = F.when(value <= bounds[0], F.lit(str(bounds[0])))
    for b in bounds[1:]:
        c = c.when(value <= b, F.lit(str(b)))
    return c.otherwise("+Inf")


def stage_histogram(stages: DataFrame, bounds: list[float] = V.STAGE_BUCKETS) -> DataFrame:
    """Count and seconds per (stage, outcome, bucket). ``stages``: stage, outcome, seconds."""
    return stages.groupBy("stage", "outcome", bucket_label(F.col("seconds"), bounds).alias("le")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 2).alias("seconds"))


def keepalive_gaps(events: DataFrame, key: str, seconds: int = V.KEEPALIVE_SECONDS) -> DataFrame:
    """Silences longer than ``seconds`` between a key's consecutive events."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.select(key, "event_id", "ts", F.lag("ts").over(w).alias("before")).withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))).where(F.col("gap") > seconds * 1_000_000).select(key, "event_id", F.col("gap").alias("gap_us"))


def numbered(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds seq from 1 within a key, as a sender stores it."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def sequence_complete(events: DataFrame, key: str, seq: str) -> DataFrame:
    """T2 of stored numbers: complete if they are 1 to the largest, each once; also what is missing and repeated."""
    g = events.groupBy(key).agg(F.max(seq).alias("total_events"), F.count(seq).alias("received"), F.countDistinct(seq).alias("kinds"), F.min(seq).alias("least"))
    complete = (F.col("least") == 1) & (F.col("received") == F.col("total_events")) & (F.col("kinds") == F.col("received"))
    return g.select(key, F.col("total_events").cast("long").alias("total_events"), F.coalesce(complete, F.lit(False)).alias("complete"), (F.col("total_events") - F.col("kinds")).cast("long").alias("missing"), (F.col("received") - F.col("kinds")).alias("repeated"))


def offered_load(events: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """T5, window form: requests of a key within the ``seconds`` up to each request."""
    w = Window.partitionBy(key).orderBy("__us").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("load", F.count(F.lit(1)).over(w)).drop("__us")


def rate_limiter(events: DataFrame, key: str, limit: int, seconds: int = 60) -> DataFrame:
    """T5: accept a request if fewer than ``limit`` accepted ones lie in the window; only those count.

    A fold over a key's time-ordered requests whose state is the accepted times inside the
    window.  Returns key, accepted, rejected.
    """

    def step(state: list, row: tuple) -> None:
        held, now = state[0], row[0]
        while held and held[0] <= now - seconds * 1_000_000:
            held.popleft()
        fits = len(held) < limit
        if fits:
            held.append(now)
        state[1 if fits else 2] += 1

    timed = events.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    return fold(timed, key, ["__us"], ["__us"], lambda: [deque(), 0, 0], step, lambda s: [(s[1], s[2])], "accepted long, rejected long")


def breaker_states(events: DataFrame, failures: int = V.BREAKER_FAILURES, seconds: int = V.BREAKER_SECONDS) -> DataFrame:
    """Final state and number of openings per provider. ``events``: ts, provider, ok.

    closed opens at ``failures`` in a row; open turns half-open ``seconds`` later, where a
    success closes and a failure opens again.  What comes while open changes nothing; of
    events at one time failures come first.
    """

    def step(b: dict, row: tuple) -> None:
        now, ok = row
        if b["state"] == "open":
            if now - b["since"] < seconds * 1_000_000:
                return
            b["state"] = "half_open"
        if ok:
            b["state"], b["row"] = "closed", 0
            return
        b["row"] += 1
        if b["state"] == "half_open" or b["row"] >= failures:
            b |= {"state": "open", "since": now, "opened": b["opened"] + 1}

    timed = events.select("provider", F.unix_micros(F.col("ts").cast("timestamp")).alias("__us"), "ok")
    return fold(timed, "provider", ["__us", "ok"], ["__us", "ok"], lambda: {"state": "closed", "row": 0, "since": 0, "opened": 0}, step, lambda b: [(b["state"], b["opened"])], "state string, opened long")


def label_counters(calls: DataFrame, labels: list[str], sums: list[str]) -> DataFrame:
    """Calls and sums of measures per set of labels."""
    return calls.groupBy(*labels).agg(F.count(F.lit(1)).alias("calls"), *(F.sum(c).alias(c) for c in sums))


def latency_histogram(calls: DataFrame, labels: list[str], seconds: str = "seconds", bounds: list[float] = V.LATENCY_BUCKETS) -> DataFrame:
    """Cumulative buckets as scrapers read them: calls up to each bound, and +Inf, per label set.

    Every call adds to its own bucket first (map-side combined); the running sums are over a
    label set's ten rows.
    """
    own = calls.groupBy(*labels, bucket_label(F.col(seconds), bounds).alias("le")).agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(x).alias("le")) for i, x in enumerate([*map(str, bounds), "+Inf"])])).alias("b")
    grid = own.select(*labels).distinct().select(*labels, every).select(*labels, "b.*")
    w = Window.partitionBy(*labels).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(own, [*labels, "le"], "left").select(*labels, "le", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n"))


def gate(usage: DataFrame, spent: DataFrame, user_quota: int = V.USER_QUOTA_TOKENS, cap: float = V.GLOBAL_QUOTA_USD) -> DataFrame:
    """Per day and user whether the next call is let through: user tokens and the day's USD, both strict.

    ``spent``: day, usd, as ``spend`` gives them per provider.
    """
    day = spent.groupBy("day").agg(F.sum("usd").alias("usd"))
    return quota_breach(usage, user_quota).join(day, "day", "left").select("day", "user_id", "tokens", "remaining", F.when(F.col("blocked"), "user_quota").when(F.col("usd") > cap, "global_cap").otherwise("ok").alias("gate"))


def backoff(attempt: Column, first: float, factor: float = 2.0) -> Column:
    """Seconds to wait before the next try; attempts count from 1."""
    return F.lit(first) * F.pow(F.lit(factor), attempt - 1)


def fixed_backoff(attempt: Column, waits: list[int] = V.RETRY_WAITS) -> Column:
    """The listed waits in turn, null when they are used up."""
    return F.try_element_at(F.array(*[F.lit(w) for w in waits]), attempt.cast("int"))


def retried(tries: DataFrame, key: str, waits: list[int] = V.RETRY_WAITS) -> DataFrame:
    """T7 over logged tries (key, attempt, ok, retryable): outcome, tries made and seconds waited per call.

    A call ends with its first success, its first failure that is not worth a retry, or the
    last wait; later tries in the log do not count.
    """
    stop = F.col("ok") | ~F.col("retryable") | (F.col("attempt") > len(waits))
    first = tries.groupBy(key).agg(F.min(F.when(stop, F.struct("attempt", "ok"))).alias("end"), F.max("attempt").alias("seen"))
    made = F.coalesce(F.col("end.attempt"), F.col("seen"))
    total = F.aggregate(F.slice(F.array(*[F.lit(w) for w in waits]), 1, F.greatest(made - 1, F.lit(0)).cast("int")), F.lit(0), lambda a, x: a + x)
    outcome = F.when(F.col("end.ok"), "ok").when(F.col("end").isNull(), "pending").otherwise("failed")
    return first.select(key, outcome.alias("outcome"), made.cast("long").alias("tries"), total.cast("long").alias("waited"))
