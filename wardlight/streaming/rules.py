"""All forms of stateful rules on streams, with state by rule and key in RocksDB.

Rows wait until the watermark has passed them, so a key's rows are taken in order of time however they arrive, and a stream finds what a batch finds.
A timer in event time wakes a key when its next row is due or its open burst ends; between, a key costs nothing.  Rows behind the watermark are
dropped by Spark, which counts them (``late_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.bursts import SECOND
from ..operators.fused import Watch

OUT = "rule int, g string, first_us long, trigger_us long, trigger_seq long, last_us long, n long, mean_s double, cv double"
_ROW = "us long, seq long, v long, x string, p boolean"
_OPEN = "first long, at long, seq long, last long, n long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Row = tuple[int, int, int | None, str | None, bool]
Open = tuple[int, int, int, int, int]  # first, trigger, its seq, last, rows


class Machine:
    """One rule on one key, row by row in order of (us, seq): what stands in its window, and the open burst or the time until which it is quiet."""

    def __init__(self, watch: Watch, window: list[Row], open_: Open | None):
        self.watch, self.window, self.open, self.out = watch, window, open_, []

    def _metric(self) -> int:
        if self.watch.form == "sum":
            return sum(r[2] or 0 for r in self.window)
        if self.watch.form == "distinct":
            return len({r[3] for r in self.window if r[3] is not None})
        return len(self.window)

    def _alert(self, o: Open, mean: float | None = None, cv: float | None = None) -> None:
        self.out.append((*o, mean, cv))

    def take(self, row: Row) -> None:
        getattr(self, f"_{self.watch.form}" if self.watch.form in ("sequence", "beacon") else "_burst")(row)

    def _burst(self, row: Row) -> None:
        w, us = self.watch, row[0]
        self.window = [r for r in self.window if us - r[0] <= w.window_us] + [row]
        if self.open and us - self.open[3] <= w.window_us:
            self.open = (*self.open[:3], us, self.open[4] + 1)
            return
        self.close()
        if self._metric() >= w.need:
            inside = self.window
            if w.form == "sum":  # from the last row from which the sum is still reached
                total = np.cumsum([r[2] or 0 for r in reversed(inside)])
                inside = inside[len(inside) - 1 - int(np.argmax(total >= w.need)) :]
            self.open = (inside[0][0], us, row[1], us, len(inside))
        elif w.form == "count":
            self.window = self.window[-w.need :]

    def _sequence(self, row: Row) -> None:
        w, us = self.watch, row[0]
        self.window = [r for r in self.window if us - r[0] <= w.window_us]
        if row[4]:
            self.window.append(row)
        elif len(self.window) >= w.need and not (self.open and us - self.open[1] <= w.window_us):
            self.open = (self.window[0][0], us, row[1], us, len(self.window) + 1)
            self._alert(self.open)

    def _beacon(self, row: Row) -> None:
        """One alert a key, at its first even run; later rows of the key change nothing."""
        w = self.watch
        if self.open and self.open[2] >= 0:
            return
        first, n = (self.open[0], self.open[4] + 1) if self.open else (row[0], 1)
        self.open = (first, row[0], -1, row[0], n)
        self.window = [*self.window, row][-w.need :]
        times = np.array([r[0] for r in self.window])
        if len(times) < w.need or times[-1] - times[0] > w.window_us:
            return
        gaps = np.diff(times) / SECOND
        mean = float(gaps.mean())
        cv = float(gaps.std() / mean) if mean else 1.0
        if w.least_s <= mean <= w.most_s and cv <= w.jitter:
            self.open, self.window = (first, row[0], max(row[1], 0), row[0], n), []
            self._alert((first, row[0], row[1], row[0], n), mean, cv)

    def close(self) -> None:
        if self.open and self.watch.form not in ("sequence", "beacon"):
            self._alert(self.open)
            self.open = None

    def passed(self, mark: int, waiting: int | None) -> None:
        """All rows up to ``mark`` are here, the next one that is known comes at ``waiting``."""
        w = self.watch.window_us
        if self.open and self.watch.form != "beacon" and mark - self.open[3] > w and (waiting is None or waiting - self.open[3] > w):
            if self.watch.form == "sequence":
                self.open = None
            self.close()
        if self.watch.form != "beacon":
            self.window = [r for r in self.window if mark - r[0] <= w]

    def due(self) -> int | None:
        """When there is something to close or forget."""
        ends = [t + self.watch.window_us + 1 for t in ([self.open[3]] if self.open else []) + ([self.window[-1][0]] if self.window else [])]
        return max(ends) if ends and self.watch.form != "beacon" else None


class Processor(StatefulProcessor):
    """State by (rule, g): rows that wait for the watermark, rows of the window, the open burst, and when the key is to be woken."""

    def __init__(self, watches: Sequence[Watch], ttl_ms: int | None = None):
        self.watches, self.ttl_ms = list(watches), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW, self.ttl_ms)
        self.window = handle.getListState("window", _ROW, self.ttl_ms)
        self.open = handle.getValueState("open", _OPEN, self.ttl_ms)
        self.wake = handle.getValueState("wake", "ms long", self.ttl_ms)

    def _wake(self, us: int) -> None:
        """One timer a key: the earliest."""
        ms = -(-us // 1000)
        now = self.wake.get()[0] if self.wake.exists() else None
        if now is not None and now <= ms:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            new = [_row(r) for r in frame[["us", "seq", "v", "x", "p"]].itertuples(index=False)]
            self.waiting.appendList(new)
            earliest = min([r[0] for r in new] + ([earliest] if earliest is not None else []))
        if earliest is not None:
            self._wake(earliest)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.wake.clear()
        rows = sorted(map(_row, self.waiting.get())) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        machine = Machine(self.watches[key[0]], [_row(r) for r in self.window.get()] if self.window.exists() else [], tuple(map(int, self.open.get())) if self.open.exists() else None)
        for r in ready:
            machine.take(r)
        machine.passed(mark, later[0][0] if later else None)
        for state, values in ((self.waiting, later), (self.window, machine.window)):
            state.put(values) if values else state.clear()
        self.open.update(machine.open) if machine.open else self.open.clear()
        if later:
            self._wake(later[0][0])
        if (due := machine.due()) is not None:
            self._wake(max(due, mark + 1000))
        if machine.out:
            made = [(key[0], key[1], o[0], o[1], o[2], o[3], o[4], *o[5:]) for o in machine.out]
            frame = pd.DataFrame(made, columns=[f.split()[0] for f in OUT.split(", ")])
            yield frame.astype({"rule": "int32", "mean_s": "float64", "cv": "float64"})

    def close(self) -> None:
        pass


def _row(r: Any) -> Row:
    us, seq, v, x, p = r
    return int(us), int(seq), None if v is None or v != v else int(v), None if x is None or x != x else str(x), bool(p)


def watch_stream(rows: DataFrame, watches: Sequence[Watch], delay: str = "5 minutes", ttl_ms: int | None = None) -> DataFrame:
    """Alerts (OUT) of ``rows``: rule, g, ts, us, seq, v, x, p as ``operators.fused.frames`` has them, and ts as timestamp.

    A burst is emitted once the watermark is a window past its last row, a sequence when its trigger is passed, a beacon when its first even run is.
    ``delay`` bounds what waits, the rules' windows what is kept of them; ``ttl_ms`` lets state of keys go that no row has touched for so long by
    the clock, which a replay of old logs must not ask for.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # lists, timers and expiry need it
    known = rows.withWatermark("ts", delay).where("g is not null").select("rule", "g", "ts", "us", "seq", F.col("v").cast("long").alias("v"), F.col("x").cast("string").alias("x"), F.coalesce("p", F.lit(False)).alias("p"))
    return known.groupBy("rule", "g").transformWithStateInPandas(Processor(watches, ttl_ms), OUT, "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the progress that the query still knows."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])
