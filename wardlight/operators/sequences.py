"""Sequence and beacon rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bursts import SECOND
from .graph import chains
from .lineage import cut
from .sessions import sessions
from .trailing import ordered, ranged, with_past


def sequences(df: DataFrame, keys: list[str], need: int, window_s: float) -> DataFrame:
    """Triggers preceded by at least ``need`` priors of the key in the trailing window; after an alert the key is quiet for a window.

    df has us, seq, keys and the booleans is_prior and is_trigger; a row that is both counts as prior.
    One row an alert: keys, us, seq, first_us (the oldest prior in the window), n (priors and the trigger).
    """
    if need < 1:
        raise ValueError("a sequence needs at least one prior event")
    gap = int(window_s * SECOND)
    prior = F.coalesce("is_prior", F.lit(False))
    rows = df.where(prior | F.col("is_trigger")).where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("_p", prior.cast("int"))
    rows = with_past(rows, gap).withColumn("_cp", F.sum("_p").over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0)))
    r = ranged(keys, gap)
    rows = rows.withColumn("_n", F.col("_cp") - F.min(F.col("_cp") - F.col("_p")).over(r)).withColumn("first_us", F.min(F.when(F.col("_p") == 1, F.col("us"))).over(r))
    hits = rows.where((F.col("_p") == 0) & ~F.col("_past") & (F.col("_n") >= need)).select(*keys, "us", "seq", "first_us", (F.col("_n") + 1).alias("n"))
    return apart(hits, keys, gap)


def apart(hits: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Of each key's rows the first, and then always the first more than ``gap`` after the last one chosen.

    The first of a session of rows is always chosen.  Only in sessions longer than the gap others may be: there each row points to the first more than
    a gap behind it, which is less than two gaps away, and the chains from the sessions' first rows are followed.
    """
    rows = cut(sessions(hits, keys, gap))
    here = F.struct("us", "seq")
    head = here == F.col("sid")
    long = rows.groupBy(*keys, "sid").agg(F.max("us").alias("_last")).where(F.col("_last") - F.col("sid.us") > gap).drop("_last")
    inside = cut(rows.join(long, [*keys, "sid"], "left_semi"))
    if not inside.limit(1).count():
        return rows.where(head).drop("sid")
    node = F.struct(*keys, "us", "seq")
    # rows are sent to their own bucket and, as what follows, to the one before
    later = with_past(inside.withColumn("_us", -F.col("us")), 2 * gap + 1, "_us")
    behind = Window.partitionBy(*keys, "sid", "_b").orderBy("us").rangeBetween(gap + 1, Window.unboundedFollowing)
    following = later.withColumn("next", F.min(node).over(behind)).where("not _past").select(node.alias("node"), "next")
    chosen = chains(inside.where(head).select(node.alias("node")), following)
    return rows.where(head).drop("sid").union(rows.where(~head).withColumn("node", node).join(chosen, "node", "left_semi").drop("node", "sid").select(*[c for c in rows.columns if c != "sid"]))


def beacons(df: DataFrame, keys: list[str], need: int, window_s: float, jitter: float = 0.25, least_s: float = 5, most_s: float = 900) -> DataFrame:
    """Keys with ``need`` consecutive events in a window whose gaps are even: mean in [least_s, most_s], deviation at most ``jitter`` of it.

    One row a key, over all its events: first_us, last_us, n; and of the first such run mean_s, cv and its last row at_us, at_seq.
    """
    if need < 2:
        raise ValueError("a beacon needs at least two events")
    window = int(window_s * SECOND)
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    k = ordered(keys)
    run = k.rowsBetween(-(need - 2), 0)
    x = with_past(rows, window).withColumn("_g", (F.col("us") - F.lag("us").over(k)) / SECOND)
    x = x.withColumns({"_span": F.col("us") - F.lag("us", need - 1).over(k), "_m": F.avg("_g").over(run), "_sd": F.stddev_pop("_g").over(run), "_c": F.count("_g").over(run)})
    cv = F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_sd") / F.col("_m"))
    even = x.where(~F.col("_past") & (F.col("_c") == need - 1) & (F.col("_span") <= window) & F.col("_m").between(least_s, most_s) & (cv <= jitter))
    first = even.groupBy(*keys).agg(F.min(F.struct("us", "seq", F.col("_m").alias("mean_s"), cv.alias("cv"))).alias("f"))
    whole = rows.groupBy(*keys).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"))
    return whole.join(first, keys).select(*keys, "first_us", "last_us", "n", F.col("f.mean_s").alias("mean_s"), F.col("f.cv").alias("cv"), F.col("f.us").alias("at_us"), F.col("f.seq").alias("at_seq"))
