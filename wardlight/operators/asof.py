"""As-of join: to each row the latest row of another table at or before it, of the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sessions import bucket


def as_of(left: DataFrame, right: DataFrame, keys: list[str], width_us: int, at: str = "us", seq: str = "seq", name: str = "last") -> DataFrame:
    """``left`` with a struct ``name`` of the latest row of ``right`` with the same keys and ``at`` at most the row's (of equal times the greatest ``seq``), or null.

    Both have ``at`` (microseconds) and the keys; ``right`` has ``seq``.  Keys are split into buckets of ``width_us``, so that one with most rows is many tasks:
    in a bucket rows of both tables are put in order, and only one row a bucket, its last of ``right``, is carried on to those behind.  Rows of
    ``left`` with a null key or time are kept and have none.
    """
    b = bucket(F.col(at), width_us)
    value = F.struct(F.col(at), F.col(seq), *[F.col(c) for c in right.columns if c not in (at, seq, *keys)])
    own = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(seq).alias("_seq"), value.alias("_v"), b.alias("_b")).where("_at is not null").where(" and ".join(f"`{k}` is not null" for k in keys))
    rows = left.select(*keys, F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(own.schema["_seq"].dataType).alias("_seq"), b.alias("_b"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_at", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    both = own.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows.withColumn("_v", F.lit(None).cast(own.schema["_v"].dataType)))
    near = both.withColumn("_near", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    # one row a bucket of either table
    lasts = own.groupBy(*keys, "_b").agg(F.max(F.struct("_at", "_seq", "_v")).alias("_l")).withColumn("_l", F.col("_l._v"))
    buckets = lasts.unionByName(rows.where("_b is not null").select(*keys, "_b").distinct().withColumn("_l", F.lit(None).cast(own.schema["_v"].dataType)))
    one = buckets.groupBy(*keys, "_b").agg(F.first("_l", ignorenulls=True).alias("_l"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    far = one.withColumn("_far", F.last("_l", ignorenulls=True).over(before)).where("_far is not null").drop("_l")
    out = near.join(far, [*keys, "_b"], "left")
    return out.select("_row.*", F.coalesce("_near", "_far").alias(name))
