"""Sessions of intervals: maximal runs in which each starts at most ``gap`` after the latest end so far.

The primitive behind burst folding, cooldowns and correlation.  A key's rows are split by time into buckets, so that a
key with a third of all rows is many tasks; only one row a bucket (its latest end, its last session start) is carried from
bucket to bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets are this many gaps wide.
SPREAD = 64


def bucket(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(width)).cast("long")


def sessions(df: DataFrame, keys: list[str], gap_us: int, start: str = "us", end: str = "us", seq: str = "seq") -> DataFrame:
    """Adds ``sid``, a struct (us, seq) of the session's first row.  Rows are ordered by (start, seq); rows with a null key have no session and go."""
    if start == end:
        return sessions_of_points(df, keys, gap_us, start, seq).drop("place")
    width = max(SPREAD * gap_us, 1)
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("_b", bucket(F.col(start), width))
    own = Window.partitionBy(*keys, "_b").orderBy(start, seq)
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    def carried(x: DataFrame, value: Column, name: str) -> DataFrame:
        last = x.groupBy(*keys, "_b").agg(F.max(value).alias("_v")).withColumn(name, F.max("_v").over(across)).drop("_v")
        return x.join(last, [*keys, "_b"])

    rows = rows.withColumn("_near", F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    rows = carried(rows, F.col(end), "_far")
    before = F.greatest("_near", "_far")
    here = F.struct(F.col(start).alias("us"), F.col(seq).alias("seq"))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) - before > gap_us), here))
    rows = carried(rows, F.col("_new"), "_earlier")
    local = F.max("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("sid", F.coalesce(local, "_earlier")).drop("_b", "_near", "_far", "_new", "_earlier")


def sessions_of_points(df: DataFrame, keys: list[str], gap_us: int, at: str = "us", seq: str = "seq") -> DataFrame:
    """``sessions`` of rows without length, and ``place``, each row's number in its key.

    What a bucket must know of those before it is the end of the last one, the latest start of a session, and the number of rows; one row a bucket tells all.
    """
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("_b", bucket(F.col(at), max(SPREAD * gap_us, 1)))
    own = Window.partitionBy(*keys, "_b").orderBy(at, seq)
    here = F.struct(F.col(at).alias("us"), F.col(seq).alias("seq"))
    rows = rows.withColumns({"_new": F.when(F.col(at) - F.lag(at).over(own) > gap_us, here), "place": F.row_number().over(own).cast("long")})
    rows = rows.withColumn("_start", F.max("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    facts = rows.groupBy(*keys, "_b").agg(F.min(here).alias("first"), F.max(at).alias("last"), F.max("_new").alias("new"), F.count(F.lit(1)).alias("n"))
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("opens", F.when(F.coalesce(F.col("first.us") - F.lag("last").over(by_bucket) > gap_us, F.lit(True)), F.col("first")))
    facts = facts.select(*keys, "_b", F.coalesce("opens", F.max(F.coalesce("new", "opens")).over(earlier)).alias("_open"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    out = rows.join(facts, [*keys, "_b"])
    return out.withColumns({"sid": F.coalesce("_start", "_open"), "place": F.col("place") + F.col("_before")}).drop("_b", "_new", "_start", "_open", "_before")
