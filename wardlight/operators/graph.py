"""Connected components and chains by rounds of joins; nodes are of any type that has an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that it reaches, for the nodes of ``edges`` (a, b).

    Each round takes the smallest label among neighbours, then the label of that label, so paths shorten
    by half and a chain of n nodes ends after about log n rounds.  Labels only fall; a round without a fall ends it.
    Edges are joined by their own nodes and never grouped into lists.  State is checkpointed each round.
    An empty table gives an empty table.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = cut(labels.join(heard, "node", "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("next"), F.col("label").alias("last")))
        jump = near.select(F.col("node").alias("next"), F.col("next").alias("further"))
        after = cut(near.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("label"), "last"))
        fell = after.where("label < last").limit(1).count()
        labels = after.select("node", "label")
        if not fell:
            return labels


def chains(heads: DataFrame, following: DataFrame) -> DataFrame:
    """``node`` of the heads and of all that follow them, for ``following`` of ``node`` and ``next`` (one next at most).

    Each round adds what lies one jump on and doubles the jump, so a chain of n nodes ends after about log n rounds.
    """
    reached, jump = cut(heads.select("node")), cut(following.where("next is not null").select("node", "next"))
    while True:
        ahead = cut(reached.join(jump, "node").select(F.col("next").alias("node")).distinct().join(reached, "node", "left_anti"))
        if not ahead.limit(1).count():
            return reached
        reached = cut(reached.union(ahead))
        onward = jump.select(F.col("node").alias("next"), F.col("next").alias("further"))
        jump = cut(jump.join(onward, "next").select("node", F.col("further").alias("next")))
