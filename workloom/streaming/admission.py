"""Admission control: order-stateful limiters, batch and streaming.

Only admitted events count against the limits, so no window function gives the same answer.
Each key is decided in time order with a bounded state (the admitted events of the last
hour). The batch form cuts every key where it was idle for as long as the state looks back:
the pieces do not depend on each other and run in different tasks. A task streams sorted
Arrow batches and carries the state from batch to batch, so it holds no group in memory.
Only a key that is never idle stays one piece; its order is part of the definition.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from workloom.operators.ranking import join_same

# The limiters run in Python workers. They travel by value, so that a worker needs no copy of
# this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MINUTE_US = 60_000_000
HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class Limits:
    per_minute: int = 60
    cost_per_hour: float = 10.0
    cost_per_request: float = 0.01


class SlidingLimiter:
    """Times and costs (in millionths) of the admitted events of the last hour."""

    def __init__(self, limits: Limits, memory: list[int] | None = None) -> None:
        self.limits, self.hourly = limits, round(limits.cost_per_hour * 1e6)
        memory = memory or []
        self.admitted = deque(zip(memory[::2], memory[1::2]))
        self.spent = sum(memory[1::2])

    def forget(self, at: int) -> None:
        while self.admitted and self.admitted[0][0] <= at - HOUR_US:
            self.spent -= self.admitted.popleft()[1]

    def decide(self, at: int, cost: int) -> str:
        self.forget(at)
        recent = 0
        for t, _ in reversed(self.admitted):
            if t <= at - MINUTE_US or recent >= self.limits.per_minute:
                break
            recent += 1
        if recent >= self.limits.per_minute:
            return "requests"
        if self.spent + cost > self.hourly:
            return "cost"
        self.admitted.append((at, cost))
        self.spent += cost
        return "admitted"

    def memory(self) -> list[int]:
        return [x for pair in self.admitted for x in pair]

    def until(self) -> int | None:
        return self.admitted[-1][0] + HOUR_US if self.admitted else None


class AnchoredLimiter:
    """A window that starts again at the first event 60 s or more after its start."""

    def __init__(self, cap: int, memory: list[int] | None = None) -> None:
        self.cap = cap
        self.start, self.count = memory or (None, 0)

    def forget(self, at: int) -> None:
        if self.start is not None and at - self.start >= MINUTE_US:
            self.start, self.count = None, 0

    def decide(self, at: int, cost: int = 0) -> str:
        self.forget(at)
        if self.start is None:
            self.start = at
        if self.count >= self.cap:
            return "dropped"
        self.count += 1
        return "admitted"

    def memory(self) -> list[int]:
        return [] if self.start is None else [self.start, self.count]

    def until(self) -> int | None:
        return None if self.start is None else self.start + MINUTE_US


def _cost(cost: str | None, limits: Limits) -> Column:
    """Cost of each event in millionths; events without one cost what the limits say."""
    each = F.lit(round(limits.cost_per_request * 1e6))
    if cost is None:
        return each.cast("bigint").alias("cost")
    return F.coalesce(F.floor(F.expr(cost) * 1e6 + 0.5).cast("bigint"), each).alias("cost")


def _ordered(events: DataFrame, key: str, horizon_us: int, cost: Column) -> DataFrame:
    """Events by (key, piece) in time order; a piece begins after ``horizon_us`` of idleness.

    Idleness is found on one row per key and horizon-wide bucket: no gap that long fits
    inside a bucket.
    """
    timed = events.select(
        F.col(key).alias("key"), "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), cost,
    ).withColumn("bucket", F.floor(F.col("at") / horizon_us))
    by_key = W.partitionBy("key").orderBy("bucket")
    idle = F.col("first") - F.lag("last").over(by_key) >= horizon_us
    pieces = (
        timed.groupBy("key", "bucket").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .withColumn("starts", F.when(F.coalesce(idle, F.lit(True)), 1).otherwise(0))
        .withColumn("piece", F.sum("starts").over(by_key)).select("key", "bucket", "piece")
    )
    return join_same(timed, pieces, ["key", "bucket"]).select("key", "piece", "event_id", "at", "cost").repartition(
        "key", "piece").sortWithinPartitions("key", "piece", "at", "event_id")


def _scan(make: Callable[[], object]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limiter = None, None
        for pdf in batches:
            out = []
            columns = (pdf[c].to_numpy() for c in ("key", "piece", "at", "cost"))
            for key, piece, at, cost in zip(*columns):
                if limiter is None or (key, piece) != current:
                    current, limiter = (key, piece), make()
                out.append(limiter.decide(int(at), int(cost)))
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "decision": out})

    return run


def admit(events: DataFrame, key: str, limits: Limits = Limits(), cost: str | None = None) -> DataFrame:
    """Decision per event: admitted, or denied for requests or cost. ``cost`` is an expression."""
    kind = events.schema[key].dataType.simpleString()
    return _ordered(events, key, HOUR_US, _cost(cost, limits)).mapInPandas(
        _scan(lambda: SlidingLimiter(limits)), f"key {kind}, event_id bigint, decision string")


def cap_per_minute(events: DataFrame, key: str, cap: int = 100) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    return _ordered(events, key, MINUTE_US, _cost(None, Limits())).mapInPandas(
        _scan(lambda: AnchoredLimiter(cap)), f"key {kind}, event_id bigint, decision string")


def _by_watermark(make: Callable[[list[int]], object]):
    """Events wait in the state until the watermark passes them, and are then decided in order.

    So a late event is decided in its place, as in the batch form, if it comes within the allowed
    lateness. The state leaves when nothing waits and the limiter's memory has run out.
    """

    def run(k, frames, state: GroupState):
        times, ids, costs, memory = state.get if state.exists else ([], [], [], [])
        rows = list(zip(times, ids, costs))
        if not state.hasTimedOut:
            for pdf in frames:
                rows += zip(pdf["at"].tolist(), pdf["event_id"].tolist(), pdf["cost"].tolist())
        rows.sort()
        watermark = state.getCurrentWatermarkMs()
        n = sum(at <= watermark * 1000 for at, _, _ in rows)
        limiter = make(list(memory))
        decisions = [limiter.decide(at, cost) for at, _, cost in rows[:n]]
        limiter.forget(watermark * 1000)
        wake = rows[n][0] if n < len(rows) else limiter.until()
        if wake is None:
            state.remove()
        else:
            waiting = [list(x) for x in zip(*rows[n:])] or [[], [], []]
            state.update((*waiting, limiter.memory()))
            state.setTimeoutTimestamp(max(wake // 1000, watermark + 1, 1))
        if n:
            yield pd.DataFrame({"key": [k[0]] * n, "event_id": [i for _, i, _ in rows[:n]], "decision": decisions})

    return run


STATE = "times array<bigint>, ids array<bigint>, costs array<bigint>, memory array<bigint>"


def admit_stream(events: DataFrame, key: str, limits: Limits = Limits(), lateness: str = "10 minutes",
                 cost: str | None = None) -> DataFrame:
    """Streaming form of ``admit``; events later than ``lateness`` are dropped."""
    kind = events.schema[key].dataType.simpleString()
    return _keyed(events, key, lateness, _cost(cost, limits)).applyInPandasWithState(
        _by_watermark(lambda memory: SlidingLimiter(limits, memory)),
        f"key {kind}, event_id bigint, decision string", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def cap_stream(events: DataFrame, key: str, cap: int = 100, lateness: str = "10 minutes") -> DataFrame:
    """Streaming form of ``cap_per_minute``."""
    kind = events.schema[key].dataType.simpleString()
    return _keyed(events, key, lateness, _cost(None, Limits())).applyInPandasWithState(
        _by_watermark(lambda memory: AnchoredLimiter(cap, memory)),
        f"key {kind}, event_id bigint, decision string", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _keyed(events: DataFrame, key: str, lateness: str, cost: Column):
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.select(
        F.col(key).alias("key"), "event_id", "ts", F.unix_micros("ts").alias("at"), cost).groupBy("key")


def offered_load(events: DataFrame, key: str, cost: str) -> DataFrame:
    """Requests of the last 60 s and cost of the last hour at each event, both strictly newer
    than the bound.

    Time is cut into hours. Each event also enters the next hour as a halo row, so every
    (key, hour) group holds all that its windows look back on and a hot key is split.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = events.withColumn("_at", at).withColumn("_hour", F.floor(F.col("_at") / HOUR_US))
    rows = timed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_halo")).withColumn(
        "_hour", F.col("_hour") + F.col("_halo"))
    base = W.partitionBy(key, "_hour").orderBy("_at")
    minute, hour = base.rangeBetween(-(MINUTE_US - 1), 0), base.rangeBetween(-(HOUR_US - 1), 0)
    return rows.withColumns({
        "requests_last_minute": F.count("*").over(minute),
        "cost_last_hour": F.sum(cost).over(hour),
    }).filter(F.col("_halo") == 0).drop("_at", "_hour", "_halo")
