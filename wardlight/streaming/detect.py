"""Rules on streams.  Event time and watermarks decide, so a stream gives what a batch over the same events gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECOND = 1_000_000


def fold_stream(hits: DataFrame, keys: list[str], cooldown_s: int = 300, delay: str = "5 minutes") -> DataFrame:
    """Hits of single-event rules, folded while they are at most the cooldown apart; a fold is emitted once the watermark has passed it.

    ``hits`` has ts (timestamp) and the keys.  A session window ends after the gap, and a hit just at its end still
    belongs to it, as in a batch.
    """
    session = F.session_window("ts", f"{cooldown_s} seconds")
    return hits.withWatermark("ts", delay).groupBy(*keys, session.alias("s")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n")).drop("s")


STATE = "pending array<bigint>, recent array<bigint>, first bigint, last bigint, n bigint"
OUT = "key string, first_us bigint, last_us bigint, n bigint"


def step(times: list[int], recent: list[int], burst: tuple[int, int, int] | None, need: int, window_us: int):
    """Runs sorted times through a threshold rule: the times still in the window, the open burst, and closed ones.

    No more than ``need`` times are kept: with so many in the window a burst is open, and it ends only when the window is empty.
    """
    closed, seen, left = [], recent + times, 0
    for at in range(len(recent), len(seen)):
        t = seen[at]
        while t - seen[left] > window_us:
            left += 1
        if burst and t - burst[1] <= window_us:
            burst = (burst[0], t, burst[2] + 1)
            continue
        if burst:
            closed.append(burst)
            burst = None
        if at - left + 1 >= need:
            burst = (seen[left], t, at - left + 1)
    return seen[max(left, len(seen) - need) :], burst, closed


def threshold_stream(events: DataFrame, need: int, window_s: int, delay: str = "5 minutes") -> DataFrame:
    """Bursts of a threshold rule, each emitted once the watermark is a window past its last event.

    ``events`` has ts (timestamp) and key (string).  State by key: events that the watermark hasn't passed, ``need`` of those in
    the window at most, and the open burst; so it is bounded by the delay.  Events behind the watermark are dropped by Spark.
    """
    window_us = window_s * SECOND

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, recent, first, last, n = state.get if state.exists else ([], [], 0, 0, 0)
        pending, recent = list(pending), list(recent)
        for f in frames:
            pending += [int(t) for t in f["us"]]
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted(t for t in pending if t <= mark)
        pending = [t for t in pending if t > mark]
        recent, burst, closed = step(ready, recent, (first, last, n) if n else None, need, window_us)
        if burst and mark - burst[1] > window_us and not any(t - burst[1] <= window_us for t in pending):
            closed.append(burst)
            burst = None
        recent = [t for t in recent if mark - t <= window_us]
        if pending or recent or burst:
            first, last, n = burst or (0, 0, 0)
            state.update((pending, recent, first, last, n))
            due = min([*pending, *([burst[1] + window_us] if burst else []), *([recent[-1] + window_us] if recent else [])])
            state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)
        else:
            state.remove()
        if closed:
            yield pd.DataFrame([(key[0], *b) for b in closed], columns=["key", "first_us", "last_us", "n"])

    keyed = events.withWatermark("ts", delay).where("key is not null").select("key", "ts", F.unix_micros("ts").alias("us")).groupBy("key")
    return keyed.applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
