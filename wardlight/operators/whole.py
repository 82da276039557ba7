"""Stateful rules over keys whose rows fit one task: one shuffle and one sort, no copies of rows.

Rows come in the order of key, rule and time, many keys at once.  All gaps of more than a window are one step longer than the window, so the keys of a batch
stand on one line of time, on which a search tells each row the first one in its window, and differences of running sums are its metric.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that are gone through at once, or those of one key.
ROWS = 1 << 17
FOUND = "rule int, g string, first_us long, first_seq long, trigger_us long, trigger_seq long, last_us long, n long, mean_s double, cv double"


def whole(rows: DataFrame, watches: Sequence) -> DataFrame:
    """Alerts of keys without nulls in g, us and seq, and each row at which a sequence is complete.  ``rows`` and ``watches`` as for ``fused.frames``."""
    dealt = rows.select("rule", "g", "us", "seq", "v", "x", "p").repartition("g", "rule").sortWithinPartitions("g", "rule", "us", "seq")
    return dealt.mapInArrow(_in_groups(watches), FOUND)


def _in_groups(watches: Sequence) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    most = min(ROWS, (1 << 62) // (max(w.window_us for w in watches) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, goal = [], 0, most
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= goal:
                table = pa.Table.from_batches(held).combine_chunks()
                last = int(np.flatnonzero(_opens(table))[-1])
                for part in _parts(table.slice(0, last), most):
                    yield from _alerts(part, watches).to_batches()
                table = table.slice(last).combine_chunks()
                held, n = table.to_batches(), table.num_rows
                goal = max(most, 2 * n)  # else a key of many batches would be put together again with each
        if n:
            for part in _parts(pa.Table.from_batches(held).combine_chunks(), most):
                yield from _alerts(part, watches).to_batches()

    return run


def _parts(table: pa.Table, most: int) -> Iterator[pa.Table]:
    """Whole keys of at most so many rows together, or one key."""
    edges = np.append(np.flatnonzero(_opens(table)), table.num_rows)
    at = 0
    while at < table.num_rows:
        end = int(max(edges[np.searchsorted(edges, at + most, "right") - 1], edges[np.searchsorted(edges, at, "right")]))
        yield table.slice(at, end - at)
        at = end


def _opens(table: pa.Table) -> np.ndarray:
    """Whether each row is the first of its key and rule."""
    new = np.ones(table.num_rows, bool)
    if len(new) < 2:
        return new
    differs = lambda c: pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()
    new[1:] = differs(table["g"]) | differs(table["rule"])
    return new


def _before(amounts: np.ndarray) -> np.ndarray:
    """Running sums before each row, and of all."""
    return np.concatenate((np.zeros(1, amounts.dtype), np.cumsum(amounts)))


def _turns(table: pa.Table, counted: np.ndarray, group: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at which a value comes that no row in the window has, and rows after which it goes with the row itself."""
    comes, goes = np.zeros((2, len(counted)), np.int64)
    x = table["x"]
    rows = np.flatnonzero(counted & pc.is_valid(x).to_numpy())
    if len(rows):
        code = pc.fill_null(x.combine_chunks().dictionary_encode().indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        code = (group * (int(code.max()) + 1) + code)[rows]
        order = np.argsort(code, kind="stable")
        rows, code = rows[order], code[order]
        apart = (code[1:] != code[:-1]) | (rows[:-1] < start[rows[1:]])
        comes[rows], goes[rows] = np.append(True, apart), np.append(apart, True)
    return comes, goes


def _even(us: np.ndarray, rows: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and coefficient of variation of the gaps between each row and the ``need`` - 1 before it, summed in the order of time."""
    total, mean, m2 = np.zeros((3, len(rows)))
    for k in range(1, need):
        at = rows - need + 1 + k
        gap = (us[at] - us[at - 1]) / 1e6
        off = gap - mean
        total, mean = total + gap, mean + off / k
        m2 = m2 + off * (off - off / k)
    mean = total / (need - 1)
    return mean, np.where(mean == 0, 1.0, np.sqrt(m2 / (need - 1)) / np.where(mean == 0, 1.0, mean))


def _alerts(table: pa.Table, watches: Sequence) -> pa.Table:
    rule, us, seq = (table[c].to_numpy() for c in ("rule", "us", "seq"))
    v, p = pc.fill_null(table["v"], 0).to_numpy(), pc.fill_null(table["p"], False).to_numpy()
    if np.abs(v.astype(float)).sum() >= 1 << 62:
        v = v.astype(object)
    form = {f: np.array([w.form == f for w in watches])[rule] for f in ("count", "sum", "distinct", "sequence", "beacon")}
    window, need = (np.array([getattr(w, c) for w in watches], np.int64)[rule] for c in ("window_us", "need"))
    new, here = _opens(table), np.arange(len(us))
    gap = np.diff(us, prepend=us[:1])
    pause = new | (gap > window)
    line = np.cumsum(np.where(pause, window + 1, gap))
    start = np.searchsorted(line, line - window)
    prior = form["sequence"] & p
    sums = _before(np.where(form["sum"], v, form["count"] | prior))
    comes, goes = _turns(table, form["distinct"], np.cumsum(new), start)
    metric = sums[1:] - sums[start] + _before(comes)[1:] - _before(goes)[start]
    fires = (metric >= need) & ~form["beacon"] & ~prior

    mean, cv = np.zeros((2, len(us)))
    place = here - np.maximum.accumulate(np.where(new, here, 0))
    for i, w in enumerate(watches):
        if w.form == "beacon":
            rows = np.flatnonzero((rule == i) & (place >= w.need - 1))
            rows = rows[us[rows] - us[rows - w.need + 1] <= w.window_us]
            mean[rows], cv[rows] = _even(us, rows, w.need)
            fires[rows] = (w.least_s <= mean[rows]) & (mean[rows] <= w.most_s) & (cv[rows] <= w.jitter)

    # sessions, of which a beacon has one; the first row that fires in each
    opens = np.where(form["beacon"], new, pause)
    heads = np.flatnonzero(opens)
    of, last = np.cumsum(opens) - 1, np.append(heads[1:], len(us)) - 1
    shot = np.flatnonzero(fires & ~form["sequence"])
    shot = shot[np.diff(of[shot], prepend=-1) > 0]
    first, last = np.where(form["beacon"][shot], heads[of[shot]], start[shot]), last[of[shot]]
    summed = np.flatnonzero(form["sum"][shot])
    if len(summed):  # the last row from which the sum is still enough; windows of two sessions have no row in common
        till, size = shot[summed], shot[summed] - first[summed] + 1
        ahead = np.cumsum(size) - size
        row = np.repeat(first[summed] - ahead, size) + np.arange(size.sum())
        enough = np.repeat(sums[till + 1], size) - sums[row] >= np.repeat(need[till], size)
        first[summed] = np.maximum.reduceat(np.where(enough, row, -1), ahead)

    complete = np.flatnonzero(fires & form["sequence"])
    oldest = np.flatnonzero(prior)[_before(prior.astype(np.int64))[start[complete]]]
    at, start, end = np.append(shot, complete), np.append(first, oldest), np.append(last, complete)
    n = np.append(last - first + 1, metric[complete].astype(np.int64) + 1)
    beats, ordered = form["beacon"][at], form["sequence"][at]
    columns = {
        "rule": pa.array(rule[at]), "g": table["g"].take(pa.array(at)), "first_us": pa.array(us[start]), "first_seq": pa.array(seq[start], mask=ordered), "trigger_us": pa.array(us[at]), "trigger_seq": pa.array(seq[at]),
        "last_us": pa.array(us[end]), "n": pa.array(n), "mean_s": pa.array(mean[at], mask=~beats), "cv": pa.array(cv[at], mask=~beats),
    }
    return pa.table(columns)
