"""Trailing time windows by key, split by time so that a hot key is many tasks.

A window of W reaches back at most one bucket of width W, so each row is sent to its own bucket and, as past, to the next one;
frames within a bucket are then the same as frames over the whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .sessions import bucket


def with_past(df: DataFrame, window_us: int, us: str = "us") -> DataFrame:
    """Adds ``_b`` and ``_past``; rows with ``_past`` are copies that serve as history only."""
    b = bucket(F.col(us), max(window_us, 1))
    copies = F.explode(F.array(F.struct(b.alias("b"), F.lit(False).alias("past")), F.struct((b + 1).alias("b"), F.lit(True).alias("past"))))
    return df.withColumn("_c", copies).withColumn("_b", F.col("_c.b")).withColumn("_past", F.col("_c.past")).drop("_c")


def ordered(keys: list[str], us: str = "us", seq: str = "seq") -> WindowSpec:
    return Window.partitionBy(*keys, "_b").orderBy(us, seq)


def ranged(keys: list[str], window_us: int, us: str = "us") -> WindowSpec:
    """By time alone: the frame [-W, 0] has later rows of the same time, too."""
    return Window.partitionBy(*keys, "_b").orderBy(us).rangeBetween(-window_us, 0)
