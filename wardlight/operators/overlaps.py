"""Interval join: pairs of intervals of one key that overlap, by bins as wide as the intervals are long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each level's bins are so many times as wide as those of the one below.
STEP = 16


def _level(start: Column, end: Column, width_us: int, top: int) -> Column:
    """The first level whose bins are as wide as the interval is long."""
    out = F.lit(top)
    for i in range(top - 1, -1, -1):
        out = F.when(end - start < width_us * STEP**i, i).otherwise(out)
    return out


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width_us: int = 60_000_000, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """``keys``, and structs ``l`` and ``r`` of the rows whose intervals, ends included, have a moment in common; each pair once.  Rows with a null key or bound, or
    that end before they start, overlap with nothing.

    An interval lies in at most two bins of its own level, and as many of each level above.  A pair is looked for on the level of the longer one and
    taken in the first bin that both lie in; on a level rows that are natives of it meet natives and rows from below, but those from below don't meet
    each other.  So a long interval is not laid out in many short bins, and a key with most rows is as many tasks as it has bins.
    """
    good = lambda df: df.where(" and ".join(f"`{k}` is not null" for k in keys)).where(F.col(start) <= F.col(end))
    left, right = good(left), good(right)
    longest = max([x for df in (left, right) if (x := df.agg(F.max(F.col(end) - F.col(start))).first()[0]) is not None], default=0)
    top = 0
    while width_us * STEP**top <= longest:
        top += 1

    def laid(df: DataFrame, name: str) -> DataFrame:
        row = df.select(*keys, F.struct(*[F.col(c) for c in df.columns if c not in keys]).alias(name), F.col(start).alias(f"{name}s"), F.col(end).alias(f"{name}e"))
        row = row.withColumn(f"{name}o", _level(F.col(f"{name}s"), F.col(f"{name}e"), width_us, top))
        row = row.withColumn("level", F.explode(F.sequence(F.col(f"{name}o"), F.lit(top))))
        wide = F.element_at(F.array(*[F.lit(width_us * STEP**i) for i in range(top + 1)]), F.col("level") + 1)
        return row.withColumn("wide", wide).withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{name}s") / F.col("wide")), F.floor(F.col(f"{name}e") / F.col("wide")))))

    a, b = laid(left, "l"), laid(right, "r").drop("wide")
    on = [*keys, "level", "bin"]
    meet = lambda x, y: x.join(y, on).where((F.col("ls") <= F.col("re")) & (F.col("rs") <= F.col("le")) & (F.col("bin") == F.greatest(F.floor(F.col("ls") / F.col("wide")), F.floor(F.col("rs") / F.col("wide")))))
    longer = meet(a.where("lo = level"), b)
    shorter = meet(a.where("lo < level"), b.where("ro = level"))
    return longer.select(*keys, "l", "r").union(shorter.select(*keys, "l", "r"))
