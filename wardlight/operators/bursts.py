"""Threshold, distinct-count and sum rules over trailing windows, folded into bursts.

A key's events fire when a metric over the trailing window (both ends in) reaches ``need``; later events of the key
at most a window apart belong to the same burst.  As windows never cross a gap longer than themselves, a burst starts
with the first firing event of a session and lasts to its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sessions import sessions_of_points
from .trailing import ordered, ranged, with_past

SECOND = 1_000_000


def metric_rows(df: DataFrame, keys: list[str], window_us: int, metric: str = "count", value: str | None = None) -> DataFrame:
    """Adds ``metric`` and ``first``, the (us, seq, place) of the first row in the window, to each row of ``sessions_of_points``."""
    k, r = ordered(keys), ranged(keys, window_us)
    rows = with_past(df, window_us)
    here = F.struct("us", "seq", "place")
    first = F.min(here).over(r)
    if metric == "count":
        amount = F.col("place") - F.min("place").over(r) + 1
    elif metric == "sum":
        v = F.coalesce(F.col(value), F.lit(0))
        running = F.sum(v).over(k.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_cs", running).withColumn("_cb", running - v)
        amount = F.col("_cs") - F.min("_cb").over(r)
    elif metric == "distinct":
        return _distinct_rows(rows, keys, window_us, value)
    else:
        raise ValueError(f"unknown metric {metric}")
    return rows.withColumn("metric", amount).withColumn("first", first).where("not _past").drop("_b", "_past", "_cs", "_cb")


def _distinct_rows(rows: DataFrame, keys: list[str], window_us: int, value: str) -> DataFrame:
    """A value is there from a row that has it until a window after the last one before a pause of more than a window: its first row adds one
    to the count, and a row of its own a window after its last takes one away."""
    here = F.struct("us", "seq", "place")
    rows = rows.withColumn("first", F.min(here).over(ranged(keys, window_us)))
    of = Window.partitionBy(*keys, "_b", value).orderBy("us", "seq")
    known = F.col(value).isNotNull()
    comes = known & F.coalesce(F.col("us") - F.lag("us").over(of) > window_us, F.lit(True))
    goes = known & F.coalesce(F.lead("us").over(of) - F.col("us") > window_us, F.lit(True))
    change = lambda us, place, by: F.struct(us.alias("us"), F.lit(place).alias("place"), by.alias("by"))
    changes = F.array(change(F.col("us"), 1, F.col("_comes").cast("int")), F.when(F.col("_goes"), change(F.col("us") + window_us + 1, 0, F.lit(-1))))
    rows = rows.withColumns({"_comes": comes, "_goes": goes}).withColumn("_c", F.explode(F.array_compact(changes)))
    count = F.sum("_c.by").over(Window.partitionBy(*keys, "_b").orderBy("_c.us", "_c.place", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("metric", count).where("_c.place = 1 and not _past").drop("_b", "_past", "_c", "_comes", "_goes")


def bursts(df: DataFrame, keys: list[str], need, window_s: float, metric: str = "count", value: str | None = None) -> DataFrame:
    """One row a burst: keys, sid, first_us, first_seq, trigger_us, trigger_seq, last_us, n.

    df has us (microseconds), seq (breaks ties) and the keys, or is the rows of ``sessions_of_points`` for a gap of the window; rows with a null key
    don't count.  A sum starts at the latest row from which it still reaches ``need``; its values must not be negative.
    """
    gap = int(window_s * SECOND)
    rows = df if "place" in df.columns else sessions_of_points(df, keys, gap)
    group = [*keys, "sid"]
    found = metric_rows(rows, keys, gap, metric, value)
    # a session's rows stand in one row of places, so its burst ends with its last place and its events need no counting
    fired = F.min(F.when(F.col("metric") >= need, F.struct("us", "seq", "place", "first")))
    got = found.groupBy(*group).agg(fired.alias("t"), F.max("us").alias("last_us"), F.max("place").alias("last")).where("t is not null")
    got = got.select(*group, F.col("t.first").alias("first"), F.struct("t.us", "t.seq", "t.place").alias("trigger"), "last_us", "last")
    if metric == "sum":
        here = F.struct("us", "seq", "place")
        inside = rows.join(got, group).where(F.col("place").between(F.col("first.place"), F.col("trigger.place")))
        suffix = F.sum(F.coalesce(F.col(value), F.lit(0))).over(Window.partitionBy(*group).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
        shrunk = inside.select(*group, here.alias("h"), suffix.alias("_s")).where(F.col("_s") >= need).groupBy(*group).agg(F.max("h").alias("first"))
        got = got.drop("first").join(shrunk, group)
    return got.select(
        *group, F.col("first.us").alias("first_us"), F.col("first.seq").alias("first_seq"), F.col("trigger.us").alias("trigger_us"), F.col("trigger.seq").alias("trigger_seq"), "last_us", (F.col("last") - F.col("first.place") + 1).alias("n")
    )


def dominant(members: DataFrame, group: list[str], value: str, order: str = "seq") -> DataFrame:
    """group and ``value``: the most frequent non-empty value, among equals the one met first."""
    counted = members.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("s"))
    return counted.groupBy(*group).agg(F.max_by(value, F.struct("n", -F.col("s"))).alias(value))
