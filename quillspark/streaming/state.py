"""Time-driven state, as streams and as their batch twins."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.shared import sequential

#: A key admits so many events in a sliding window of so many seconds; idle keys are dropped after twice that.
LIMIT, WINDOW_SECONDS = 5, 60
#: A session ends after so many idle seconds, or at this age.
IDLE_SECONDS, AGE_SECONDS = 3600, 14_400


def micros(c: str):
    """Microseconds of a timestamp with or without a zone (taken as the session's)."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def admit(times: list[float], limit: int = LIMIT, window: float = WINDOW_SECONDS, open_: deque | None = None) -> tuple[list[bool], deque]:
    """Which events are admitted: fewer than ``limit`` admitted ones in the ``window`` before. Blocked events are not
    recorded; an event exactly ``window`` old no longer counts."""
    kept = deque() if open_ is None else open_
    out = []
    for t in times:
        while kept and t - kept[0] >= window:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


def rate_limit(events: DataFrame, key: str, time: str, order: str, limit: int = LIMIT, window: int = WINDOW_SECONDS) -> DataFrame:
    """``(key, order, admitted)`` of a batch: each key is one sequential run, ties in time by ``order``. Keys are
    streamed over with the times of one window as state, so a hot key costs memory for its window only."""
    own = events.where(F.col(time).isNotNull()).select(key, order, (micros(time) / 1e6).alias("_t"))
    return sequential(own, [key], ["_t", order], deque, lambda kept, row: admit([row["_t"]], limit, window, kept)[0][0], "admitted", "boolean").drop("_t")


def rate_limit_stream(events: DataFrame, key: str, time: str, order: str, limit: int = LIMIT, window: int = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: the admitted times of a key are its state, dropped when by event time the key has been
    idle for two windows."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(key, order, time, (micros(time) / 1e6).alias("_t"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(batches)).sort_values(["_t", order], kind="stable")
        ok, kept = admit(pdf["_t"].tolist(), limit, window, kept)
        state.update((list(kept),))
        state.setTimeoutTimestamp(max(int((pdf["_t"].max() + 2 * window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "admitted": ok})

    return own.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, admitted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, key: str, time: str, idle: int = IDLE_SECONDS, age: int = AGE_SECONDS) -> DataFrame:
    """``(key, session, started, ended, events, expired_by)``: runs of events less than ``idle`` seconds apart. A run
    that lasts ``age`` seconds or longer is said to expire by age. Windows per key and one combining aggregation."""
    w = W.partitionBy(key).orderBy(time)
    new = F.coalesce((micros(time) - F.lag(micros(time)).over(w) >= idle * 1_000_000).cast("int"), F.lit(1))
    runs = events.where(F.col(time).isNotNull()).select(key, time, new.alias("_n")).withColumn("session", F.sum("_n").over(w.rangeBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy(key, "session").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("events"))
    old = micros("ended") - micros("started") >= age * 1_000_000
    return out.withColumn("expired_by", F.when(old, "age").otherwise("idle"))


def session_stream(events: DataFrame, key: str, time: str, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream by Spark's session windows, with a watermark for late events."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, idle), key).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ends"), "events")


def event_windows(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and kind; works on a stream (with a watermark) and on a batch."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("started"), kind, "n")


def limited_sessions(events: DataFrame, key: str, time: str, order: str, idle: int = IDLE_SECONDS, age: int = AGE_SECONDS) -> DataFrame:
    """``(key, session, started, ended, events)``: a session ends when the next event comes ``idle`` seconds or more after
    the last, or ``age`` seconds or more after its first; that event begins the next session. Ties in time by ``order``.
    Each key streams through one task with three numbers as state."""
    own = events.where(F.col(time).isNotNull()).select(key, order, time, micros(time).alias("_t"))

    def step(state: list, row: dict) -> int:
        t = row["_t"]
        if not state:
            state[:] = [1, t, t]
        elif t - state[2] >= idle * 1_000_000 or t - state[1] >= age * 1_000_000:
            state[:] = [state[0] + 1, t, t]
        state[2] = t
        return state[0]

    placed = sequential(own, [key], ["_t", order], list, step, "session", "int")
    return placed.groupBy(key, "session").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("events"))


def joined_events(left: DataFrame, right: DataFrame, key: str, time: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Each event of ``left`` with those of ``right`` of the same key that came at most ``within`` before it; columns of
    ``right`` get the prefix ``before_``. On streams both sides have a watermark, so that what is kept of either is
    bounded by ``within``; on a batch it is a range join within the key."""
    if left.isStreaming or right.isStreaming:
        left, right = left.withWatermark(time, late), right.withWatermark(time, late)
    b = right.select(*(F.col(c).alias(f"before_{c}") for c in right.columns))
    on = (F.col(key) == F.col(f"before_{key}")) & (F.col(f"before_{time}") <= F.col(time)) & (F.col(f"before_{time}") >= F.col(time) - F.expr(f"INTERVAL {within}"))
    return left.join(b, on)
