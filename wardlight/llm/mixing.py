"""Mixing sources to target weights by systematic sampling.

Targets: sources share ``SHARE`` of all sizes by weight; a target stops at ``MOST`` times its source's
size and the excess goes to the others by weight, until none is above (the level is found in closed
form, by the order in which sources fill up).  A source's documents then each expect
target / source size copies.  In the order of size the expected copies are summed up, one offset
for each source (from a hash of its name and a seed) is added, and a document is emitted
once for each integer boundary that its sum crosses; the order by size keeps the words taken near the target.

Running sums need no task that holds a source: rows are dealt by ranges of (source, size, id), ranked
within their range, and the ranges' counts are summed up.

Defined cases: a null source is a source of its own, the last; a null text has size 0; sources of size 0 have
target 0 and take nothing; repeated rows each give a row, and rows equal in size and id are ordered
by text; a very long text is one document, counted whole; an empty table gives an empty table; other columns are ignored, or kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target`` for rows of source and size; works on one row a source after the first sum."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    s = s.withColumn("weight", F.when(F.col("source_size") > 0, F.get(weights, (F.row_number().over(order) - 1) % len(WEIGHTS))).otherwise(0))
    # a source is full when the level reaches fill = most / weight; those that fill earlier keep most, the rest share what is left
    s = s.withColumn("fill", F.when(F.col("weight") > 0, MOST * F.col("source_size") / F.col("weight")))
    by_fill = Window.orderBy(F.col("fill").asc_nulls_first(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = s.withColumns(
        {
            "all": F.sum("source_size").over(whole),
            "before": F.coalesce(F.sum(F.when(F.col("weight") > 0, MOST * F.col("source_size"))).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    s = s.withColumn("level", F.when(F.col("weight") > 0, (SHARE * F.col("all") - F.col("before")) / F.col("open")))
    # the first source, in order of filling, that the level of its turn doesn't fill: its level holds from there on
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source", "level"))).over(whole)["level"])
    got = F.least(F.col("level") * F.col("weight"), (MOST * F.col("source_size")).cast("double"))
    return s.select("source", "source_size", F.when(F.col("weight") > 0, F.coalesce(got, (MOST * F.col("source_size")).cast("double"))).otherwise(F.lit(0.0)).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """In [0, 1), from a hash of the seed and the source (null: as the source named by one U+0000)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\x00")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, tie, size, source_size, target and ``copies``, one row a document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.col("text").cast("string")).alias("tie"),
        size(F.col("text").cast("string")).alias("size"),
    )
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    # kept before they are dealt by ranges, which reads its input twice: texts are looked at once
    dealt = T.cut(rows).repartitionByRange(T.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt = T.cut(dealt.withColumn("at", F.monotonically_increasing_id()))  # partition above bit 33, place in it below
    part = F.shiftright("at", 33)
    # one row for each range and source in it: the ranks before it, and the source's target
    spans = dealt.groupBy("source", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goal = targets(dealt).withColumnRenamed("source", "goal_of")
    spans = spans.withColumn("before", before).join(goal, F.col("source").eqNullSafe(F.col("goal_of"))).withColumnsRenamed({"source": "s", "part": "p"})
    each = F.col("target") / F.col("source_size")
    upto = lambda rank: F.floor(rank * each + offset(F.col("source")))
    rank = F.col("before") + F.col("at") - F.col("first") + 1
    placed = dealt.join(spans, F.col("source").eqNullSafe(F.col("s")) & (part == F.col("p"))).withColumn("rank", rank)
    copies = F.when(F.col("source_size") > 0, upto(F.col("rank")) - upto(F.col("rank") - 1)).otherwise(0)
    return placed.select("doc_id", "source", "tie", "size", "source_size", "target", copies.cast("long").alias("copies"))


def shares(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix: each document, with all its columns, as often as the plan takes it.

    Rows equal in id, source and text are one group: its copies are dealt out over its rows, in the order of a hash of the whole row.
    """
    key = {"k_id": F.col("doc_id").cast("long"), "k_source": F.col("source").cast("string"), "k_tie": F.xxhash64(F.col("text").cast("string"))}
    p = plan(docs).groupBy("doc_id", "source", "tie").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    p = p.where("copies > 0").select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("tie").alias("p_tie"), "copies", "n")
    packed = docs.select(F.struct("*").alias("row"), T.row_hash().alias("k_whole"), *[c.alias(k) for k, c in key.items()])
    on = F.col("k_id").eqNullSafe(F.col("p_id")) & F.col("k_source").eqNullSafe(F.col("p_source")) & (F.col("k_tie") == F.col("p_tie"))
    turn = F.when(F.col("n") == 1, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("p_id", "p_source", "p_tie").orderBy("k_whole")))
    own = F.floor(F.col("copies") * F.col("turn") / F.col("n")) - F.floor(F.col("copies") * (F.col("turn") - 1) / F.col("n"))
    return packed.join(p, on).withColumn("turn", turn).select("row", F.explode(F.array_repeat(F.lit(1), own.cast("int")))).select("row.*")
