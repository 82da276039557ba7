"""Incidents kept up as alerts come in, batch by batch: what a new alert ties together becomes one, and falls to the smaller label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.correlation import GAP_S, entities
from ..operators.graph import components
from ..operators.sessions import sessions
from ..sources.logs import exists

_RUNS = "entity string, first_us long, last_us long, node long"
_MEMBERS = "ord long, incident long"
_MOVES = "old long, new long"


class Incidents:
    """State in ``folder``, one version a batch: runs (an entity's stretches of alerts within the gap, with their incident), members (each alert with the incident that
    it got then) and moves (incidents that became part of an earlier one).  A batch that is run again writes its version again, so a retry changes nothing.

    Only entities that the new alerts have are looked at; their alerts of before are not read, but their runs, of which there are few.  ``keep_us`` lets runs go
    that ended so long before the newest alert that no alert will be tied to them any more (the gap and the alerts' greatest delay)."""

    def __init__(self, spark: SparkSession, folder: str, assets: DataFrame, gap_s: float = GAP_S, keep_us: int | None = None):
        self.spark, self.folder, self.assets, self.gap_us, self.keep_us = spark, folder, assets, int(gap_s * 1_000_000), keep_us

    def _path(self, what: str, version: int) -> str:
        return f"{self.folder}/{what}/v={version}"

    def _read(self, what: str, schema: str, version: int) -> DataFrame:
        path = self._path(what, version)
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _upto(self, what: str, schema: str, version: int | None) -> DataFrame:
        """All batches' rows."""
        path = f"{self.folder}/{what}"
        rows = self.spark.read.schema(f"{schema}, v int").parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], f"{schema}, v int")
        return rows if version is None else rows.where(F.col("v") <= version)

    def add(self, alerts: DataFrame, version: int) -> None:
        """``alerts`` (ord, first_us, last_us and the entities' columns) of batch ``version``: 0, 1, ..., as ``foreachBatch`` numbers them."""
        new = entities(alerts, self.assets).select("entity", "first_us", "last_us", F.col("ord").alias("node"), F.lit(True).alias("fresh"))
        runs = self._read("runs", _RUNS, version - 1).withColumn("fresh", F.lit(False))
        touched = new.select("entity").distinct()
        near = runs.join(touched, "entity", "left_semi").unionByName(new)
        tied = sessions(near.withColumn("seq", F.col("node")), ["entity"], self.gap_us, "first_us", "last_us")
        first = F.min("node").over(_run())
        tied = tied.withColumn("head", first)
        label = components(tied.select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b").distinct())
        named = label.select("node", F.col("label").alias("to"))
        members = alerts.select("ord").join(named.withColumnRenamed("node", "ord"), "ord", "left").select("ord", F.coalesce("to", "ord").alias("incident"))
        members.write.mode("overwrite").parquet(self._path("members", version))
        moves = named.where("to < node").join(alerts.select(F.col("ord").alias("node")), "node", "left_anti").select(F.col("node").alias("old"), F.col("to").alias("new"))
        moves.write.mode("overwrite").parquet(self._path("moves", version))
        moved = self.spark.read.schema(_MOVES).parquet(self._path("moves", version))
        merged = tied.groupBy("entity", "sid").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.min("node").alias("node")).drop("sid").join(named, "node", "left").withColumn("node", F.coalesce("to", "node")).drop("to")
        rest = runs.drop("fresh").join(touched, "entity", "left_anti").join(moved.withColumnRenamed("old", "node"), "node", "left").withColumn("node", F.coalesce("new", "node")).drop("new")
        after = merged.unionByName(rest)
        if self.keep_us is not None:
            newest = alerts.agg(F.max("last_us")).first()[0]
            after = after.where(F.col("last_us") >= newest - self.keep_us) if newest is not None else after
        after.select("entity", "first_us", "last_us", "node").write.mode("overwrite").parquet(self._path("runs", version))

    def members(self, version: int | None = None) -> DataFrame:
        """ord and incident of all alerts so far (up to a batch): the incident that each got then, or what that became since."""
        moves = self._upto("moves", _MOVES, version).select(F.col("old").alias("a"), F.col("new").alias("b")).distinct()
        final = components(moves).withColumnRenamed("node", "incident")
        return self._upto("members", _MEMBERS, version).select("ord", "incident").join(final, "incident", "left").select("ord", F.coalesce("label", "incident").alias("incident"))


def _run():
    from pyspark.sql import Window

    return Window.partitionBy("entity", "sid")


def incident_stream(alerts: DataFrame, state: Incidents, checkpoint: str):
    """Starts a query over a stream of alerts that keeps ``state`` up."""
    return alerts.writeStream.foreachBatch(lambda rows, version: state.add(rows, version)).option("checkpointLocation", checkpoint).start()
