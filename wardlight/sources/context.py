"""Allow-lists, assets, threat intelligence, rules and scenarios: small tables and mappings."""

from __future__ import annotations

import json
from importlib import resources
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRITICALITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def bundled(name: str) -> str:
    return resources.files("wardlight.plans").joinpath(name).read_text(encoding="utf-8")


def load_yaml(path: str | None, default: str) -> Any:
    if path is None:
        return yaml.safe_load(bundled(default))
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


class Environment:
    """Lists by name (lower-cased values, or a file of one value a line: ``{file: path}``) and the assets."""

    def __init__(self, doc: dict[str, Any]):
        named = doc.get("lists") or {}
        self.lists = {k: [str(v).lower() for v in vs] for k, vs in named.items() if not isinstance(vs, dict)}
        self.files = {k: str(vs["file"]) for k, vs in named.items() if isinstance(vs, dict)}
        self.asset_rows = [(str(a["host"]), a.get("ip") and str(a["ip"]), str(a.get("criticality", "low")), str(a.get("role", ""))) for a in doc.get("assets") or []]
        bad = {c for _, _, c, _ in self.asset_rows} - set(CRITICALITY)
        if bad:
            raise ValueError(f"unknown criticality {sorted(bad)}")

    @classmethod
    def load(cls, path: str | None = None) -> Environment:
        return cls(load_yaml(path, "environment.yml") or {})

    def known(self, spark: SparkSession) -> dict[str, list[str] | DataFrame]:
        """All lists; those in files are tables, read by Spark from any store."""
        return self.lists | {k: spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''") for k, path in self.files.items()}

    def assets(self, spark: SparkSession) -> DataFrame:
        """host_key (lower-cased), host, ip, criticality, role; of a host that comes twice the last row."""
        rows = {h.lower(): (h.lower(), h, ip, c, r) for h, ip, c, r in self.asset_rows}
        return spark.createDataFrame(list(rows.values()), "host_key string, host string, ip string, criticality string, role string")


def load_intel(spark: SparkSession, path: str) -> DataFrame:
    """key (lower-cased indicator), type, threat, confidence, source; of an indicator that comes twice the last row."""
    rows = spark.read.csv(path, header=True, schema="indicator string, type string, threat string, confidence int, source string")
    n = F.monotonically_increasing_id()
    row = F.struct(F.col("n"), "type", "threat", F.coalesce("confidence", F.lit(0)).alias("confidence"), "source")
    last = rows.withColumn("n", n).groupBy(F.lower("indicator").alias("key")).agg(F.max(row).alias("r"))
    return last.select("key", "r.type", "r.threat", "r.confidence", "r.source")


def no_intel(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, type string, threat string, confidence int, source string")


def load_truth(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
