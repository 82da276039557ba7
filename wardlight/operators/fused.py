"""Many stateful rules over one table of rows: one row-level shuffle for all of them.

A key whose rows fit one task is one group, without buckets (``whole``).  What follows is for crowded keys, whose rows are many tasks, in one pass of frames.

Rows are tagged with their rule and key and dealt out by (rule, key, bucket), a bucket being as wide as the rule's window; each row also goes, as past, to
the bucket behind.  Windows of different widths can't share a range frame.  But in a bucket only past rows leave the window, each at
a time of its own, so a running sum over what comes and goes is the metric of every rule at once, and what left last tells which row is now
the first.  A bucket's rows are less than a window apart, so it is one piece of a session: one row of facts a bucket tells
where sessions begin and end, what fired first in them and how many rows they have.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bursts import SECOND
from .lineage import cut
from .needles import within_bound
from .sequences import apart
from .whole import whole

#: A key with more rows than this, over all rules, is dealt out by time.
CROWD = 1 << 19
FOUND = ("rule", "g", "first_us", "first_seq", "trigger_us", "trigger_seq", "last_us", "n", "mean_s", "cv")


@dataclass(frozen=True)
class Watch:
    """What a rule asks of its key's rows: ``form`` is count, sum, distinct, sequence or beacon."""

    form: str
    need: int
    window_us: int
    jitter: float = 0.25
    least_s: float = 5
    most_s: float = 900


def _of(watches: Sequence[Watch], value) -> Column:
    """A rule's own value, by its number."""
    return F.element_at(F.array(*[F.lit(value(w)) for w in watches]), F.col("rule") + 1)


def _is(watches: Sequence[Watch], *forms: str) -> Column:
    return _of(watches, lambda w: w.form in forms)


def _bucket(watches: Sequence[Watch], us: str = "us") -> Column:
    return F.floor(F.col(us) / _of(watches, lambda w: max(w.window_us, 1))).cast("long")


def _even(watches: Sequence[Watch], k) -> dict[str, Column]:
    """Mean and deviation of the last gaps of a beacon's rule, and whether they are even; one frame for each number of gaps that a rule asks for."""
    out: dict[str, Column] = {}
    gap = F.col("gap") / SECOND
    m = sd = c = span = F.lit(None)
    for need in sorted({w.need for w in watches if w.form == "beacon"}):
        run, mine = k.rowsBetween(-(need - 2), 0), _of(watches, lambda w, n=need: w.form == "beacon" and w.need == n)
        m, sd = F.when(mine, F.avg(gap).over(run)).otherwise(m), F.when(mine, F.stddev_pop(gap).over(run)).otherwise(sd)
        c, span = F.when(mine, F.count(gap).over(run)).otherwise(c), F.when(mine, F.col("us") - F.lag("us", need - 1).over(k)).otherwise(span)
    out["mean_s"] = m.cast("double")
    out["cv"] = F.when(m == 0, 1.0).otherwise(sd / m).cast("double")
    out["_full"] = F.coalesce((c == _of(watches, lambda w: w.need - 1)) & (span <= _of(watches, lambda w: w.window_us)), F.lit(False))
    return out


def frames(rows: DataFrame, watches: Sequence[Watch]) -> DataFrame:
    """Of each (rule, g, bucket) its last row, with the bucket's facts, and each row at which a sequence is complete.

    rows: rule (place in ``watches``), g (key, not null), us, seq, v (long, what a sum adds up), x (string, what is counted once) and p (boolean, a
    sequence's prior row).
    """
    window, need = _of(watches, lambda w: w.window_us), _of(watches, lambda w: w.need)
    at = _bucket(watches)
    copies = F.explode(F.array(F.struct(at.alias("b"), F.lit(False).alias("past")), F.struct((at + 1).alias("b"), F.lit(True).alias("past")))).alias("c")
    x = rows.select("rule", "g", "us", "seq", "v", "x", "p", copies).select("rule", "g", F.col("c.b").alias("b"), "us", "seq", "v", "x", "p", F.col("c.past").alias("past"))
    comes = goes = F.lit(None).cast("boolean")
    if any(w.form == "distinct" for w in watches):
        same = Window.partitionBy("rule", "g", "b", "x").orderBy("us", "seq")
        comes = F.coalesce(F.col("us") - F.lag("us").over(same) > window, F.lit(True))
        goes = F.coalesce(F.lead("us").over(same) - F.col("us") > window, F.lit(True))
    x = x.withColumns({"comes": comes, "goes": goes})
    k = Window.partitionBy("rule", "g", "b").orderBy("us", "seq")
    prior = F.coalesce("p", F.lit(False))
    # what counts towards the metric, and of a sequence only prior rows stand in its window
    x = x.withColumns({"stands": ~_is(watches, "sequence") | prior, "gap": F.col("us") - F.lag("us").over(k)})
    x = x.withColumn("h", F.when(F.col("stands"), F.struct("us", "seq"))).withColumn("next", F.expr("lead(h, 1) ignore nulls over (partition by rule, g, b order by us, seq)"))
    if any(w.form == "beacon" for w in watches):
        x = x.withColumns(_even(watches, k))
    else:
        x = x.withColumns({"mean_s": F.lit(None).cast("double"), "cv": F.lit(None).cast("double"), "_full": F.lit(False)})
    known = F.col("x").isNotNull()
    amount = lambda changed: F.when(_is(watches, "distinct"), (known & F.col(changed)).cast("long")).when(_is(watches, "sum"), F.coalesce("v", F.lit(0).cast("long"))).otherwise(F.col("stands").cast("long"))
    change = lambda t, kind, d, c: F.struct(t.alias("t"), F.lit(kind).alias("kind"), d.alias("d"), c.alias("c"))
    arrival = change(F.col("us"), 1, amount("comes"), F.col("stands").cast("long"))
    departure = F.when(F.col("past") & F.col("stands") & ~_is(watches, "beacon"), change(F.col("us") + window + 1, 0, -amount("goes"), F.lit(-1).cast("long")))
    x = x.withColumn("e", F.explode(F.array_compact(F.array(arrival, departure)))).select("*", "e.*")
    j = Window.partitionBy("rule", "g", "b").orderBy("t", "kind", "seq")
    sofar = j.rowsBetween(Window.unboundedPreceding, 0)
    left = F.last(F.when(F.col("kind") == 0, F.col("next")), ignorenulls=True).over(sofar)
    x = x.withColumns({"metric": F.sum("d").over(sofar), "inside": F.sum("c").over(sofar), "first": F.coalesce(left, F.first("h", ignorenulls=True).over(sofar))})
    x = x.where("kind = 1 and not past")
    even = F.col("_full") & F.col("mean_s").between(_of(watches, lambda w: float(w.least_s)), _of(watches, lambda w: float(w.most_s))) & (F.col("cv") <= _of(watches, lambda w: float(w.jitter)))
    x = x.withColumn("fires", F.when(_is(watches, "beacon"), F.coalesce(even, F.lit(False))).when(_is(watches, "sequence"), ~prior & (F.col("metric") >= need)).otherwise(F.col("metric") >= need))
    x = x.withColumn("place", F.row_number().over(j).cast("long"))
    shot = F.when(F.col("fires"), F.struct("us", "seq", "first", "inside", "place", "mean_s", "cv"))
    x = x.withColumns({"shot": F.min(shot).over(sofar), "start": F.first(F.struct("us", "seq", "gap")).over(sofar), "end": F.lead("us").over(j).isNull()})
    hit = _is(watches, "sequence") & F.col("fires")
    return x.where(F.col("end") | hit).select("rule", "g", "b", "us", "seq", "start", "place", "shot", "end", hit.alias("hit"), F.col("first.us").alias("from_us"), "metric")


def watched(rows: DataFrame, watches: Sequence[Watch], crowd: int = CROWD) -> DataFrame:
    """One row an alert (FOUND).  ``rows`` as for ``frames``, kept by the caller: they are read once to find the keys with more than ``crowd`` rows, and once more.

    A burst's first row is the first in the window of the row that fired; of a sum it is the last from which the sum still reaches ``need`` (amounts
    are not negative).  A beacon is one row a key, over all its rows.  After a sequence its key is quiet for a window."""
    lacking = F.col("g").isNull() | F.col("us").isNull() | F.col("seq").isNull()
    crowded = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.bool_or(lacking).alias("lacking")).where(F.col("lacking") | (F.col("n") > crowd)).select(F.col("g").alias("_g")))
    if crowded.limit(1).count():
        crowded = within_bound(crowded, "_g")
        same = F.col("g").eqNullSafe(F.col("_g"))
        found = cut(whole(rows.join(crowded, same, "left_anti"), watches)).unionByName(_dealt(rows.join(crowded, same, "left_semi"), watches))
    else:
        found = cut(whole(rows, watches))
    sequence = _is(watches, "sequence")
    parts = [found.where(~sequence)]
    for w_us in sorted({w.window_us for w in watches if w.form == "sequence"}):
        hits = found.where(_of(watches, lambda w, u=w_us: w.form == "sequence" and w.window_us == u))
        chosen = apart(hits.withColumnsRenamed({"trigger_us": "us", "trigger_seq": "seq"}), ["rule", "g"], w_us)
        parts.append(chosen.withColumnsRenamed({"us": "trigger_us", "seq": "trigger_seq"}).select(*FOUND))
    return reduce(DataFrame.unionByName, parts)


def _dealt(rows: DataFrame, watches: Sequence[Watch]) -> DataFrame:
    """Alerts, and each row at which a sequence is complete, by ``frames``; sums read rows once more, for those of their alerts' windows."""
    marks = cut(frames(rows, watches))
    window = _of(watches, lambda w: w.window_us)
    by_key = Window.partitionBy("rule", "g").orderBy("b")
    opens = (F.coalesce(F.col("start.gap") > window, F.lit(True)) & ~_is(watches, "beacon")).cast("int")
    facts = marks.where(F.col("end") & ~_is(watches, "sequence")).withColumns(
        {"sid": F.sum(opens).over(by_key.rowsBetween(Window.unboundedPreceding, 0)), "before": F.coalesce(F.sum("place").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    at = F.when(F.col("shot").isNotNull(), F.struct("shot", (F.col("before") + F.col("shot.place")).alias("place")))
    got = facts.groupBy("rule", "g", "sid").agg(F.min(at).alias("at"), F.min("start").alias("start"), F.max("us").alias("last_us"), F.max(F.col("before") + F.col("place")).alias("till"), F.sum("place").alias("all")).where("at is not null")
    beacon = _is(watches, "beacon")
    t = "at.shot"
    found = got.select(
        "rule", "g", F.when(beacon, F.col("start.us")).otherwise(F.col(f"{t}.first.us")).alias("first_us"), F.when(beacon, F.col("start.seq")).otherwise(F.col(f"{t}.first.seq")).alias("first_seq"), F.col(f"{t}.us").alias("trigger_us"),
        F.col(f"{t}.seq").alias("trigger_seq"), "last_us", F.when(beacon, F.col("all")).otherwise(F.col("till") - F.col("at.place") + F.col(f"{t}.inside")).alias("n"), F.col(f"{t}.mean_s").alias("mean_s"), F.col(f"{t}.cv").alias("cv"),
    )
    parts = [found]
    if any(w.form == "sum" for w in watches):
        found = cut(found)
        parts = [found.where(~_is(watches, "sum")), _shrunk(rows.where(_is(watches, "sum")), found.where(_is(watches, "sum")), watches)]
    none = F.lit(None).cast("double")
    hits = marks.where("hit").select("rule", "g", F.col("from_us").alias("first_us"), F.lit(None).cast("long").alias("first_seq"), F.col("us").alias("trigger_us"), F.col("seq").alias("trigger_seq"), F.col("us").alias("last_us"), (F.col("metric") + 1).alias("n"), none.alias("mean_s"), none.alias("cv"))
    return cut(reduce(DataFrame.unionByName, [*parts, hits]))


def _in_buckets(rows: DataFrame, spans: DataFrame, watches: Sequence[Watch], until: str) -> DataFrame:
    """Rows of the buckets from ``first_us`` to ``until`` of each span, of the same rule and key."""
    reach = spans.withColumn("_b", F.explode(F.sequence(_bucket(watches, "first_us"), _bucket(watches, until))))
    return rows.withColumn("_b", _bucket(watches)).join(reach, ["rule", "g", "_b"]).drop("_b")


def _shrunk(rows: DataFrame, sums: DataFrame, watches: Sequence[Watch]) -> DataFrame:
    here, group = F.struct("us", "seq"), ["rule", "g", "trigger_seq"]
    spans = sums.select(*group, "first_us", "first_seq", "trigger_us")
    inside = _in_buckets(rows.select("rule", "g", "us", "seq", "v"), spans, watches, "trigger_us")
    inside = inside.where((here >= F.struct(F.col("first_us").alias("us"), F.col("first_seq").alias("seq"))) & (here <= F.struct(F.col("trigger_us").alias("us"), F.col("trigger_seq").alias("seq"))))
    back = Window.partitionBy(*group).orderBy(F.desc("us"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    reaches = F.sum(F.coalesce("v", F.lit(0))).over(back) >= _of(watches, lambda w: w.need)
    # rows from which the sum is still enough, the last of which is the first of the alert
    kept = inside.withColumn("_r", reaches).groupBy(*group).agg(F.max(F.when(F.col("_r"), here)).alias("_f"), F.count_if("_r").alias("_more"))
    return sums.join(kept, group).withColumns({"first_us": F.col("_f.us"), "first_seq": F.col("_f.seq"), "n": F.col("n") - F.col("_more") + 1}).select(*FOUND)


def members(rows: DataFrame, alerts: DataFrame, watches: Sequence[Watch]) -> DataFrame:
    """The rows of each alert, with its rule, g and trigger_seq, and ``shown``: whether the row stood in the window when the rule fired."""
    spans = alerts.select("rule", "g", "first_us", "first_seq", "trigger_us", "trigger_seq", "last_us")
    near = _in_buckets(rows, spans, watches, "last_us")
    here, trigger = F.struct("us", "seq"), F.struct(F.col("trigger_us").alias("us"), F.col("trigger_seq").alias("seq"))
    after = here >= F.struct(F.col("first_us").alias("us"), F.coalesce("first_seq", F.lit(-(1 << 63))).alias("seq"))
    sequence = (F.coalesce("p", F.lit(False)) & (F.col("us") >= F.col("first_us")) & (here < trigger)) | (here == trigger)
    inside = F.when(_is(watches, "sequence"), sequence).otherwise(after & (F.col("us") <= F.col("last_us")))
    return near.where(inside).withColumn("shown", _is(watches, "beacon", "sequence") | (here <= trigger)).drop("first_us", "first_seq", "last_us")
