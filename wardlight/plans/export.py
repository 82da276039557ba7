"""Rules on single events as texts: a Splunk search, and a Spark SQL condition."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.fields import EVENT
from ..functions.predicates import Logic, RuleError, condition
from .rules import EventRule

_SYSMON = 'sourcetype="XmlWinEventLog:Microsoft-Windows-Sysmon/Operational" EventCode='
#: Where a search finds each kind of event.
SOURCES = {"process_create": _SYSMON + "1", "network_connect": _SYSMON + "3", "process_access": _SYSMON + "10", "file_create": _SYSMON + "11", "dns_query": _SYSMON + "22", "http_request": "sourcetype=access_combined", "sudo": "sourcetype=linux_secure sudo"}
#: What a value must meet, by modifier; f is the field, v the value.
FORMS = {
    "": 'lower({f})="{v}"', "wild": 'like(lower({f}), "{v}")', "contains": 'like(lower({f}), "%{v}%")', "startswith": 'like(lower({f}), "{v}%")', "endswith": 'like(lower({f}), "%{v}")', "re": 'match({f}, "(?i){v}")',
    "gt": "tonumber({f})>{v}", "gte": "tonumber({f})>={v}", "lt": "tonumber({f})<{v}", "lte": "tonumber({f})<={v}",
}


def _brackets(word: str):
    return lambda parts: parts[0] if len(parts) == 1 else "(" + f" {word} ".join(parts) + ")"


SPL = Logic(_brackets("OR"), _brackets("AND"), lambda part: f"NOT {part}")


def _leaf(name: str, want: Any) -> str:
    field, *mods = name.split("|")
    form = next((m for m in mods if m != "all"), "")
    if form not in FORMS:
        raise RuleError(f"{name}: a search has nothing for it")

    def one(value: Any) -> str:
        if value is None:
            return f'(isnull({field}) OR {field}="")'
        text = str(value) if form == "re" else str(value).lower()
        kind = "wild" if form == "" and ("*" in text or "?" in text) else form
        text = text.replace("\\", "\\\\").replace('"', '\\"')
        return FORMS[kind].format(f=field, v=text.replace("*", "%").replace("?", "_") if kind == "wild" else text)

    return (SPL.all if "all" in mods else SPL.any)([one(v) for v in (want if isinstance(want, list) else [want])])


def _selection(sel: Any) -> str:
    return SPL.any([_selection(s) for s in sel]) if isinstance(sel, list) else SPL.all([_leaf(k, v) for k, v in sel.items()])


def _fields(sel: Any) -> list[str]:
    return [f for s in sel for f in _fields(s)] if isinstance(sel, list) else [k.split("|")[0] for k in sel]


def to_spl(rule: EventRule, index: str = "main") -> str:
    """A search for what the rule finds, for people to read and try; patterns are as near as the language has them."""
    detection = dict(rule.doc["detection"])
    text = detection.pop("condition")
    where = condition(text, {n: _selection(s) for n, s in detection.items()}, SPL)
    shown = dict.fromkeys(["_time", "host", "user", *(f for s in detection.values() for f in _fields(s))])
    return f"index={index} {SOURCES[rule.kind]}\n| where {where}\n| table {', '.join(shown)}"


def to_spark_sql(rule: EventRule, spark: SparkSession) -> str:
    """The rule's condition over a table of events, as Spark writes it.  What Spark writes but can't read again (addresses judged by is_public) is an error."""
    rows = spark.createDataFrame([], EVENT)
    plan = rows.where(F.coalesce(rule.column({}, rows.columns), F.lit(False)))._jdf.queryExecution().analyzed()
    text = plan.condition().sql()
    try:
        rows.where(text).schema  # noqa: B018  analysed, not run
    except AnalysisException as e:
        raise RuleError(f"{rule.id}: Spark SQL has no text for it ({e.getCondition()})") from None
    return text
