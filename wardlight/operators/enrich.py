"""What is known about hosts and indicators, joined to rows by name without case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .needles import within_bound


def with_assets(rows: DataFrame, host: Column, assets: DataFrame, name: str = "asset") -> DataFrame:
    """``rows`` with a struct ``name`` of the asset of that host, or null.  ``assets`` has host_key (lower case), of which the greatest row of each holds."""
    known = assets.groupBy("host_key").agg(F.max(F.struct(*[F.col(c) for c in assets.columns if c != "host_key"])).alias(name)).withColumnRenamed("host_key", "_host")
    return rows.withColumn("_host", F.lower(host)).join(within_bound(known, "_host"), "_host", "left").drop("_host")


def known_indicators(rows: DataFrame, indicator: Column, feed: DataFrame) -> DataFrame:
    """The rows whose indicator stands in ``feed`` (key in lower case, each once), with the feed's columns but the key."""
    return rows.withColumn("key", F.lower(indicator)).join(within_bound(feed, "key"), "key").drop("key")
