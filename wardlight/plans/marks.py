"""Leaves of rules with large lists, networks (ADDRESS/BITS) in lists, or many needles become columns of marks, joined to the events before conditions are compiled."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import resolve
from ..functions.predicates import leaf_key
from ..operators.needles import counted, existence
from ..operators.networks import longest_match

#: A list of more values, or a leaf with more needles, is joined; up to so many are part of the condition.
MANY = 200
_EDGES = ("contains", "startswith", "endswith")


def _leaves(sel: Any) -> Iterator[tuple[str, Any]]:
    for s in sel if isinstance(sel, list) else [sel]:
        yield from s.items() if isinstance(s, dict) else ()


def _values(lists: dict, names: Any) -> list:
    """What the named lists are: tables, or Python lists."""
    return [lists[w] for w in (names if isinstance(names, list) else [names]) if w in lists]


def large(selections: list[Any], lists: dict, many: int = MANY) -> dict[str, tuple[str, Any]]:
    """The leaves to be joined, by their key."""
    out = {}
    for name, want in (x for s in selections for x in _leaves(s)):
        mods = name.split("|")[1:]
        if "in_list" in mods:
            known = _values(lists, want)
            if any(isinstance(v, DataFrame) for v in known) or sum(len(v) for v in known) > many or any("/" in str(x) for v in known for x in v):
                out[leaf_key(name, want)] = (name, want)
        elif any(m in _EDGES for m in mods) and isinstance(want, list) and len(want) > many:
            out[leaf_key(name, want)] = (name, want)
    return out


def _table(spark, column: str, values: list) -> DataFrame:
    return spark.createDataFrame(pa.table({column: pa.array([str(v) for v in values], pa.string())}))


def marked(rows: DataFrame, selections: list[Any], lists: dict, key: str = "seq", many: int = MANY) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with a column of marks for each large leaf, and the columns' names by the leaf's key.  ``key`` tells rows apart."""
    columns, marks, plain = rows.columns, {}, rows
    spark = rows.sparkSession
    for i, (at, (name, want)) in enumerate(large(selections, lists, many).items()):
        field, *mods = name.split("|")
        mark, value = f"_mark{i}", resolve(field, columns)
        if "in_list" in mods:
            parts = [v.select(F.col(v.columns[0]).cast("string").alias("value")) if isinstance(v, DataFrame) else _table(spark, "value", v) for v in _values(lists, want)]
            known = parts[0]
            for p in parts[1:]:
                known = known.union(p)
            rows = existence(rows, value, known, mark)
            if known.where("value like '%/%'").limit(1).count():  # networks stand in the list, too
                rows = longest_match(rows.withColumn("_ip", value.cast("string")), "_ip", known.where("value like '%/%'"), "value", "_net").withColumn(mark, F.col(mark) | F.col("_net").isNotNull()).drop("_net")
        else:
            needles = _table(spark, "needle", want)
            where = next(m for m in mods if m in _EDGES)
            hits = counted(plain.select(F.col(key), value.cast("string").alias("_field")), key, "_field", needles, where)
            if "all" in mods:
                total = len({str(w).lower() for w in want})
                hits = hits.where(F.col("n") == total)
            rows = rows.join(hits.select(key).withColumn(mark, F.lit(True)), key, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
        marks[at] = mark
    return rows, marks
