"""Registered queries by name, with SQL for each: every operator on the given tables.

The tables hold no security logs, so operators run by role: users are keys, event types kinds, values amounts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import event_json, resolve
from ..functions.net import is_public
from ..functions.predicates import condition, selection
from ..operators import bursts as B
from ..operators import correlation as C
from ..operators import sequences as S
from ..operators.asof import as_of
from ..operators.enrich import known_indicators, with_assets
from ..operators.fused import Watch, watched
from ..operators.lineage import cut
from ..operators.needles import counted
from ..operators.networks import longest_match
from ..operators.overlaps import overlapping
from ..operators.sessions import sessions
from ..operators.trailing import ordered, ranged, with_past
from ..sources import logs as L
from ..sources import sinks
from .detector import Detector
from .marks import marked
from .rules import EventRule, StateRule

HOUR = 3600
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``us``, microseconds whatever the session's time zone, and ``seq``."""
    e = table(spark, sf_dir, "events")
    return e.withColumns({"us": F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"), "seq": F.col("event_id")})


# ---------------------------------------------------------------- stateful rules

_BURST_SQL = """
WITH RECURSIVE e AS (SELECT user_id AS k, epoch_us(ts) AS us, event_id AS seq, event_type AS x, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE {where}),
g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, seq) AS rn, CASE WHEN us - lag(us) OVER (PARTITION BY k ORDER BY us, seq) <= {w} THEN 0 ELSE 1 END AS nb,
  CAST(sum(v) OVER (PARTITION BY k ORDER BY us, seq) AS BIGINT) AS cs FROM e),
s AS (SELECT *, sum(nb) OVER (PARTITION BY k ORDER BY us, seq) AS sid, min(rn) OVER r AS st, {metric} AS metric FROM g
  WINDOW r AS (PARTITION BY k ORDER BY us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)),
t AS (SELECT k, sid, min(rn) AS trn FROM s WHERE metric >= {need} GROUP BY k, sid),
f AS (SELECT t.k, t.sid, t.trn, {start} AS st FROM t JOIN s ON s.k = t.k AND s.rn = t.trn),
z AS (SELECT k, sid, max(rn) AS ern, max(us) AS last_us FROM s GROUP BY k, sid)
SELECT f.k AS user_id, a.us AS first_us, b.us AS trigger_us, z.last_us, z.ern - f.st + 1 AS n
FROM f JOIN z ON z.k = f.k AND z.sid = f.sid JOIN s a ON a.k = f.k AND a.rn = f.st JOIN s b ON b.k = f.k AND b.rn = f.trn
"""


def _burst_sql(where: str, hours: int, need: int, metric: str = "count") -> str:
    amount = {"count": "rn - min(rn) OVER r + 1", "sum": "cs - min(cs - v) OVER r", "distinct": "count(DISTINCT x) OVER r"}[metric]
    start = f"(SELECT max(q.rn) FROM s q WHERE q.k = t.k AND q.rn BETWEEN s.st AND t.trn AND s.cs - (q.cs - q.v) >= {need})" if metric == "sum" else "s.st"
    return _BURST_SQL.format(where=where, w=f"{hours * HOUR}::BIGINT * 1000000", need=need, metric=amount, start=start)


def _burst(where: str, hours: int, need: int, metric: str = "count") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = events(spark, sf_dir).where(where).select("user_id", "us", "seq", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
        found = B.bursts(rows, ["user_id"], need, hours * HOUR, metric, {"count": None, "sum": "v", "distinct": "event_type"}[metric])
        return found.select("user_id", "first_us", "trigger_us", "last_us", "n")

    return run


for _name, _args in {
    "threshold_burst": ("event_type = 'error'", 24, 3),
    "threshold_burst_wide": ("event_type = 'error'", 48, 4),
    "distinct_burst": ("true", 12, 4, "distinct"),
    "sum_burst": ("true", 12, 20000, "sum"),
}.items():
    register(_burst_sql(*_args), _name)(_burst(*_args))


@register("""
WITH RECURSIVE e AS (SELECT user_id AS k, epoch_us(ts) AS us, event_id AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS p FROM events WHERE event_type IN ('error', 'purchase')),
c AS (SELECT *, sum(p) OVER (PARTITION BY k ORDER BY us, seq) AS cp FROM e),
n AS (SELECT *, cp - min(cp - p) OVER r AS n, min(CASE WHEN p = 1 THEN us END) OVER r AS first_us FROM c WINDOW r AS (PARTITION BY k ORDER BY us RANGE BETWEEN 86400::BIGINT * 1000000 PRECEDING AND CURRENT ROW)),
h AS (SELECT k, us, seq, first_us, n, row_number() OVER (PARTITION BY k ORDER BY us, seq) AS r FROM n WHERE p = 0 AND n >= 2),
a AS (
  SELECT k, us, seq, first_us, n, us AS quiet, true AS fires, r FROM h WHERE r = 1
  UNION ALL
  SELECT h.k, h.us, h.seq, h.first_us, h.n, CASE WHEN h.us - a.quiet > 86400::BIGINT * 1000000 THEN h.us ELSE a.quiet END, h.us - a.quiet > 86400::BIGINT * 1000000, h.r FROM a JOIN h ON h.k = a.k AND h.r = a.r + 1
)
SELECT k AS user_id, us, first_us, CAST(n + 1 AS BIGINT) AS n FROM a WHERE fires
""")
def sequence_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"is_prior": F.col("event_type") == "error", "is_trigger": F.col("event_type") == "purchase"})
    return S.sequences(e.select("user_id", "us", "seq", "is_prior", "is_trigger"), ["user_id"], 2, 24 * HOUR).select("user_id", "us", "first_us", "n")


@register("""
WITH e AS (SELECT user_id AS k, epoch_us(ts) AS us, event_id AS seq FROM events),
g AS (SELECT *, (us - lag(us) OVER w) / 1000000.0::DOUBLE AS g, us - lag(us, 4) OVER w AS span FROM e WINDOW w AS (PARTITION BY k ORDER BY us, seq)),
m AS (SELECT *, avg(g) OVER r AS m, stddev_pop(g) OVER r AS sd, count(g) OVER r AS c FROM g WINDOW r AS (PARTITION BY k ORDER BY us, seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
f AS (SELECT k, min(us) AS at_us FROM m WHERE c = 4 AND span <= 604800::BIGINT * 1000000 AND m BETWEEN 5 AND 900000 AND sd / m <= 0.35 GROUP BY k)
SELECT e.k AS user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n, f.at_us FROM e JOIN f ON e.k = f.k GROUP BY e.k, f.at_us
""")
def beacon(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.beacons(events(spark, sf_dir).select("user_id", "us", "seq"), ["user_id"], 5, 7 * 24 * HOUR, 0.35, 5, 900_000)
    return found.select("user_id", "first_us", "last_us", "n", "at_us")


@register("""
WITH g AS (SELECT event_type, user_id, epoch_us(ts) AS us, event_id AS seq, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600::BIGINT * 1000000 THEN 0 ELSE 1 END AS nb FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(nb) OVER (PARTITION BY event_type, user_id ORDER BY us, seq) AS sid FROM g)
SELECT event_type, user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY event_type, user_id, sid
""")
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_type", "user_id", "us", "seq")
    s = sessions(e, ["event_type", "user_id"], 6 * HOUR * B.SECOND)
    return s.groupBy("event_type", "user_id", "sid").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n")).drop("sid")


@register("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS s FROM events GROUP BY ALL)
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS r FROM c) WHERE r = 1
""")
def dominant_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.dominant(events(spark, sf_dir), ["user_id"], "event_type")


@register("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400::BIGINT * 1000000 PRECEDING AND CURRENT ROW) AS n FROM events
""")
def trailing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 24 * HOUR * B.SECOND
    rows = with_past(events(spark, sf_dir).select("event_id", "user_id", "us", "seq"), day)
    return rows.withColumn("n", F.count(F.lit(1)).over(ranged(["user_id"], day))).where("not _past").select("event_id", "n")


@register("""
WITH g AS (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events)
SELECT event_id, CASE WHEN gap_us <= 172800::BIGINT * 1000000 THEN gap_us ELSE -1 END AS gap_us FROM g
""")
def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    two_days = 48 * HOUR * B.SECOND
    rows = with_past(events(spark, sf_dir).select("event_id", "user_id", "us", "seq"), two_days)
    gap = F.col("us") - F.lag("us").over(ordered(["user_id"]))
    return rows.withColumn("gap_us", gap).where("not _past").select("event_id", F.when(F.col("gap_us") <= two_days, F.col("gap_us")).otherwise(-1).alias("gap_us"))


@register("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 60000000 AS until FROM events),
m AS (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
s AS (SELECT *, sum(CASE WHEN us - before <= 3600::BIGINT * 1000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS sid FROM m)
SELECT user_id, min(us) AS first_us, max(until) AS last_us, count(*) AS n FROM s GROUP BY user_id, sid
""")
def running_max_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of intervals: an event lasts a minute for each hundredth of its value."""
    e = events(spark, sf_dir).select("user_id", "us", "seq", (F.col("us") + F.round(F.col("value") * 100).cast("long") * 60_000_000).alias("until"))
    s = sessions(e, ["user_id"], HOUR * B.SECOND, "us", "until")
    return s.groupBy("user_id", "sid").agg(F.min("us").alias("first_us"), F.max("until").alias("last_us"), F.count(F.lit(1)).alias("n")).drop("sid")


#: Eight rules that run in one plan: form, condition, hours, need; what each counts stands in the queries above.
_FUSED = [("count", "error", 24, 3), ("count", "error", 48, 4), ("distinct", None, 12, 4), ("sum", None, 12, 20000), ("sum", "purchase", 36, 15000), ("count", "view", 6, 2), ("sequence", None, 24, 2), ("beacon", None, 7 * 24, 5)]


def _fused_sql() -> str:
    parts = []
    for i, (form, kind, hours, need) in enumerate(_FUSED):
        if form == "sequence":
            inner = f"SELECT user_id, first_us, us AS trigger_us, us AS last_us, n FROM ({_SQL['sequence_alert']})"
        elif form == "beacon":
            inner = f"SELECT user_id, first_us, at_us AS trigger_us, last_us, n FROM ({_SQL['beacon']})"
        else:
            inner = f"SELECT user_id, first_us, trigger_us, last_us, n FROM ({_burst_sql(f'event_type = {kind!r}' if kind else 'true', hours, need, form)})"
        parts.append(f"SELECT {i} AS rule, q.* FROM ({inner}) q")
    return " UNION ALL ".join(parts)


@register(_fused_sql())
def fused_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight stateful rules over one scan of the events."""
    e = events(spark, sf_dir)
    tags = []
    for i, (form, kind, _, _) in enumerate(_FUSED):
        concerned = F.col("event_type") == kind if kind else F.col("event_type").isin("error", "purchase") if form == "sequence" else F.lit(True)
        v = F.round(F.col("value") * 100).cast("long") if form == "sum" else F.lit(None).cast("long")
        x = F.col("event_type") if form == "distinct" else F.lit(None).cast("string")
        p = F.col("event_type") == "error" if form == "sequence" else F.lit(False)
        tags.append(F.when(concerned, F.struct(F.lit(i).alias("rule"), v.alias("v"), x.alias("x"), p.alias("p"))))
    rows = cut(e.select(F.col("user_id").cast("string").alias("g"), "us", "seq", F.explode(F.array(*tags)).alias("t")).where("t is not null").select("g", "us", "seq", "t.*"))
    watches = [Watch(form, need, hours * HOUR * B.SECOND, 0.35, 5, 900_000) for form, _, hours, need in _FUSED]
    return watched(rows, watches).select("rule", F.col("g").cast("long").alias("user_id"), "first_us", "trigger_us", "last_us", "n")


# ---------------------------------------------------------------- correlation, scores, reports

# Alerts made of bursts of errors: a user's machine is the one of their nation, which stands in the inventory.
_ALERTS_SQL = _burst_sql("event_type = 'error'", 24, 3)
_MADE_SQL = """
WITH RECURSIVE bursts AS ({alerts}),
a AS (SELECT row_number() OVER (ORDER BY b.first_us, b.user_id) AS ord, b.user_id, b.first_us, b.last_us, b.n, lower(trim(n.n_name)) AS host, n.n_regionkey,
  CASE WHEN b.n >= 5 THEN 'critical' WHEN b.n >= 4 THEN 'high' ELSE 'medium' END AS severity, ['Discovery', 'Execution', 'Exfiltration', ''][b.user_id % 4 + 1] AS tactic, 'T10' || (10 + b.user_id % 7) AS technique
  FROM bursts b JOIN nation n ON n.n_nationkey = b.user_id % 25),
"""
_INCIDENTS_SQL = (
    _MADE_SQL
    + """
n AS (SELECT ord, first_us, last_us, 'user:u' || user_id AS e FROM a UNION ALL SELECT ord, first_us, last_us, 'host:' || host FROM a UNION ALL SELECT ord, first_us, last_us, 'ip:10.9.' || (user_id % 25) || '.1' FROM a WHERE n_regionkey < 4),
l AS (SELECT DISTINCT x.ord AS i, y.ord AS j FROM n x JOIN n y ON x.e = y.e AND x.ord <> y.ord AND CASE WHEN x.ord > y.ord THEN x.first_us - y.last_us ELSE y.first_us - x.last_us END <= {gap}::BIGINT * 1000000),
c AS (SELECT ord AS i, ord AS o FROM a UNION SELECT l.j, c.o FROM c JOIN l ON l.i = c.i),
m AS (SELECT a.*, m.incident FROM a JOIN (SELECT i, min(o) AS incident FROM c GROUP BY i) m ON m.i = a.ord)
"""
)


def _made_sql(template: str, **args) -> str:
    return template.format(alerts=_ALERTS_SQL, **args).replace("bursts AS (\nWITH RECURSIVE", "bursts AS (\nWITH")


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as machines, those of the last region unknown; regions tell their worth."""
    level = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), F.col("n_regionkey").cast("int") + 1)
    known = table(spark, sf_dir, "nation").where("n_regionkey < 4")
    host = F.trim("n_name")
    return known.select(F.lower(host).alias("host_key"), host.alias("host"), F.concat(F.lit("10.9."), F.col("n_nationkey").cast("string"), F.lit(".1")).alias("ip"), level.alias("criticality"), F.lit("").alias("role"))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the detector gives them."""
    found = _burst("event_type = 'error'", 24, 3)(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.trim("n_name").alias("host"))
    empty = F.lit("")
    made = found.join(F.broadcast(nation), F.col("user_id") % 25 == F.col("n_nationkey")).select(
        "user_id", "first_us", "last_us", F.col("n").alias("count"), "host", F.concat(F.lit("CORP\\u"), F.col("user_id").cast("string")).alias("user"), empty.alias("src_ip"), empty.alias("dst_ip"),
        F.when(F.col("n") >= 5, "critical").when(F.col("n") >= 4, "high").otherwise("medium").alias("severity"), F.element_at(F.array(*map(F.lit, ("Discovery", "Execution", "Exfiltration", ""))), (F.col("user_id") % 4 + 1).cast("int")).alias("tactic"),
        F.concat(F.lit("T10"), (10 + F.col("user_id") % 7).cast("string")).alias("technique"), F.lit("errors").alias("rule_id"), F.lit("Many errors").alias("rule_title"), F.array().cast("array<string>").alias("evidence"),
        F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example"))).alias("indicators"),
    )
    return cut(C.ranked(made, "ord", F.col("first_us"), F.col("user_id")).withColumn("id", F.format_string("ALR-%04d", "ord")))


def _incident_members(spark: SparkSession, sf_dir: str, gap_s: int) -> DataFrame:
    return C.correlate(_alerts(spark, sf_dir), _assets(spark, sf_dir), gap_s)


for _gap in (1800, 7200, 21600):

    def _correlate(spark: SparkSession, sf_dir: str, gap: int = _gap) -> DataFrame:
        return _incident_members(spark, sf_dir, gap).select("ord", "user_id", "incident")

    register(_made_sql(_INCIDENTS_SQL, gap=_gap) + "SELECT ord, user_id, incident FROM m", f"correlate_incidents_{_gap}")(_correlate)


_GAP = 21600
_SCORE_SQL = (
    _made_sql(_INCIDENTS_SQL, gap=_GAP)
    + """, k AS (SELECT incident, CASE n_regionkey WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 0 END AS worth, CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 30 ELSE 15 END AS grave, m.* EXCLUDE (incident),
  CASE WHEN user_id % 10 = 0 THEN 15 WHEN user_id % 10 = 1 THEN 8 ELSE 0 END AS known FROM m),
i AS (SELECT incident, min(first_us) AS first_us, max(last_us) AS last_us, CAST(sum(n) AS BIGINT) AS volume, count(*) AS n_alerts, max(grave) AS grave, max(worth) AS worth, max(known) AS known, count(DISTINCT tactic) AS stages,
  CASE max(grave) WHEN 40 THEN 'critical' WHEN 30 THEN 'high' ELSE 'medium' END AS severity, count(DISTINCT host) AS n_hosts, count(DISTINCT user_id) AS n_users, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques FROM k GROUP BY incident),
q AS (SELECT *, least(100, grave + CASE WHEN stages > 1 THEN least(6 * (stages - 1), 24) ELSE 0 END + worth + known + CASE WHEN volume >= 50 THEN 5 ELSE 0 END)::INTEGER AS score FROM i)
"""
)


def _scores(spark: SparkSession, sf_dir: str, members: DataFrame | None = None) -> DataFrame:
    """Incidents of the library; every tenth user's indicator is well known, the next one's less so."""
    key = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit(".example")).alias("key")
    feed = table(spark, sf_dir, "customer").where("c_custkey % 10 < 2").select(key, F.lit("domain").alias("type"), F.lit("trick").alias("threat"), F.when(F.col("c_custkey") % 10 == 0, 90).otherwise(60).alias("confidence"), F.lit("own").alias("source"))
    ids = table(spark, sf_dir, "events").where("user_id % 10 < 2").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example")).alias("key"), F.lit("domain").alias("type"), F.lit("trick").alias("threat"), F.when(F.col("user_id") % 10 == 0, 90).otherwise(60).alias("confidence"), F.lit("own").alias("source"))
    members = members if members is not None else _incident_members(spark, sf_dir, _GAP)
    return C.incidents(members, _assets(spark, sf_dir), feed.union(ids).distinct())


@register(_SCORE_SQL + "SELECT incident, first_us, volume, n_alerts, score FROM q")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("incident", "first_us", "volume", "n_alerts", "score")


@register(_SCORE_SQL + "SELECT incident, last_us, severity, n_hosts, n_users, techniques, grave, worth, known FROM q")
def incident_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in an incident, and the points of its single reasons."""
    points = lambda about: F.coalesce(F.get(F.transform(F.filter("score_breakdown", lambda p: p["reason"].contains(about)), lambda p: p["points"]), 0), F.lit(0))
    out = _scores(spark, sf_dir).select("incident", "last_us", "severity", F.size("hosts").cast("long").alias("n_hosts"), F.size("users").cast("long").alias("n_users"), F.array_join("techniques", ",").alias("techniques"), "score_breakdown")
    return out.withColumns({"grave": points("an alert is"), "worth": points(" worth"), "known": points("is known for")}).drop("score_breakdown")


@register(_SCORE_SQL + "SELECT p.priority, count(q.score) AS n FROM (VALUES ('P1', 80, 101), ('P2', 60, 80), ('P3', 35, 60), ('P4', 0, 35)) p(priority, lo, hi) LEFT JOIN q ON q.score >= p.lo AND q.score < p.hi GROUP BY p.priority")
def priority_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = spark.createDataFrame([(p,) for p, _ in C.PRIORITIES], "priority string")
    counted = _scores(spark, sf_dir).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, "priority", "left").select("priority", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@register(_SCORE_SQL + "SELECT incident, score, row_number() OVER (ORDER BY score DESC, first_us, incident) AS place FROM q")
def rank_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked(_scores(spark, sf_dir).select("incident", "score", "first_us"), "place", -F.col("score"), F.col("first_us"), F.col("incident")).drop("first_us")


def _result(spark: SparkSession, sf_dir: str, truth: dict | None = None):
    """A run's result from the tables: firewall lines, alerts and incidents."""
    from .triage import Result

    members = cut(_incident_members(spark, sf_dir, _GAP))
    rows = L.parse(_firewall_lines(spark, sf_dir), "firewall")
    return Result(rows.where("ok"), L.parse_stats(rows), members, _scores(spark, sf_dir, members), _assets(spark, sf_dir), truth)


_SEVERITIES = ("low", "medium", "high", "critical")


@register(
    _SCORE_SQL
    + """SELECT (SELECT count(*) FROM events WHERE event_id % 11 <> 0) AS events, (SELECT count(*) FROM a) AS alerts, (SELECT count(*) FROM q) AS incidents,
round(100 * (1 - (SELECT count(*) FROM q) / (SELECT count(*) FROM events WHERE event_id % 11 <> 0)::DOUBLE), 2) AS reduction_pct,
(SELECT count(*) FROM a WHERE severity = 'critical') AS critical, (SELECT count(*) FROM a WHERE tactic = 'Execution') AS execution, (SELECT count(*) FROM q WHERE score >= 35 AND score < 60) AS p3, (SELECT count(*) FROM events WHERE event_id % 11 = 0) AS skipped"""
)
def summary_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .triage import summary

    x = summary(_result(spark, sf_dir))
    row = (x["events"], x["alerts"], x["incidents"], float(x["reduction_events_to_incidents_pct"]), x["alerts_by_severity"].get("critical", 0), x["alerts_by_tactic"].get("Execution", 0), x["priorities"]["P3"], x["parse"]["firewall"]["skipped"])
    return spark.createDataFrame([row], "events long, alerts long, incidents long, reduction_pct double, critical long, execution long, p3 long, skipped long")


@register(_made_sql(_MADE_SQL) + "s AS (SELECT severity FROM a) SELECT v.severity, count(s.severity) AS n FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) v(severity) LEFT JOIN s ON s.severity = v.severity GROUP BY v.severity")
def alerts_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = spark.createDataFrame([(s,) for s in _SEVERITIES], "severity string")
    counted = _alerts(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@register(_made_sql(_MADE_SQL) + "t AS (SELECT technique, count(*) AS score FROM a GROUP BY technique) SELECT technique, score, max(score) OVER () AS highest FROM t")
def navigator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = sinks.navigator(_alerts(spark, sf_dir))
    rows = [(t["techniqueID"], t["score"], layer["gradient"]["maxValue"]) for t in layer["techniques"]]
    return spark.createDataFrame(rows, "technique string, score long, highest long")


@register(
    _made_sql(_INCIDENTS_SQL, gap=_GAP)
    + """, s(id, malicious, expected, wanted) AS (VALUES ('A', true, ['errors'], ['host:france', 'user:u7']), ('B', true, ['errors', 'other'], ['host:china']), ('C', false, []::VARCHAR[], ['user:nobody']), ('D', false, []::VARCHAR[], ['ip:10.9.3.1'])),
x AS (SELECT DISTINCT s.id, n.ord FROM s JOIN n ON list_contains(s.wanted, n.e)), r AS (SELECT x.id, count(*) AS related, count(DISTINCT incident) AS incidents FROM x JOIN m ON m.ord = x.ord GROUP BY x.id)
SELECT s.id, coalesce(related, 0) AS related, CASE WHEN related > 0 AND len(expected) > 0 THEN 1::BIGINT ELSE 0 END AS detected, len(expected) - CASE WHEN related > 0 AND len(expected) > 0 THEN 1 ELSE 0 END AS missing,
  CASE WHEN malicious THEN len(expected) = 1 AND coalesce(related, 0) > 0 AND incidents = 1 ELSE coalesce(related, 0) = 0 END AS pass, (SELECT count(*) FROM a WHERE ord NOT IN (SELECT ord FROM x)) AS unattributed
FROM s LEFT JOIN r ON r.id = s.id"""
)
def evaluate_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .triage import evaluate

    of = lambda i, bad, rules, names: {"id": i, "name": i, "malicious": bad, "expected_rules": rules, "entities": names}
    truth = {"scenarios": [of("A", True, ["errors"], ["host:france", "user:u7"]), of("B", True, ["errors", "other"], ["host:china"]), of("C", False, [], ["user:nobody"]), of("D", False, [], ["ip:10.9.3.1"])]}
    found = evaluate(spark, _result(spark, sf_dir, truth))
    rows = [(r["scenario"], r["related"], len(r["detected"]), len(r["missing"]), r["pass"], found["unattributed_alerts"]) for r in found["scenarios"]]
    return spark.createDataFrame(rows, "id string, related long, detected long, missing long, pass boolean, unattributed long")


@register(_made_sql(_INCIDENTS_SQL, gap=_GAP) + "SELECT DISTINCT ord, e AS entity FROM n")
def entity_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.entities(_alerts(spark, sf_dir), _assets(spark, sf_dir)).select("ord", "entity")


# ---------------------------------------------------------------- selections and conditions

def _chosen(tab: str, key: str, sel, where: str) -> None:
    def add(name: str) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = table(spark, sf_dir, tab)
            return t.where(selection(sel, {}, t.columns)).select(key)

        register(f"SELECT {key} FROM {tab} WHERE {where}", name)(run)

    return add


_chosen("part", "p_partkey", {"p_brand": ["BRAND#11", "brand#23"]}, "lower(p_brand) IN ('brand#11', 'brand#23')")("sel_eq_ci")
_chosen("part", "p_partkey", {"p_type": "s?an*"}, "lower(p_type) LIKE 's_an%'")("sel_wildcard")
_chosen("pages", "page_id", {"url|contains": ["page=", "utm_source="]}, "contains(lower(url), 'page=') OR contains(lower(url), 'utm_source=')")("sel_contains_any")
_chosen("pages", "page_id", {"html|contains|all": ["<p", "</div>"]}, "contains(lower(html), '<p') AND contains(lower(html), '</div>')")("sel_contains_all")
_chosen("pages", "page_id", {"url|startswith": "https://"}, "starts_with(lower(url), 'https://')")("sel_startswith")
_chosen("pages", "page_id", {"url|endswith": [".html", "/"]}, "suffix(lower(url), '.html') OR suffix(lower(url), '/')")("sel_endswith")
_chosen("documents", "doc_id", {"text|re": r"released under the (mit|apache) license"}, "regexp_matches(text, '(?i)released under the (mit|apache) license')")("sel_regex")
_chosen("orders", "o_orderkey", {"o_totalprice|gte": 100000, "o_totalprice|lt": 300000, "o_orderstatus": "f"}, "o_totalprice >= 100000 AND o_totalprice < 300000 AND lower(o_orderstatus) = 'f'")("sel_numeric")
_chosen("documents", "doc_id", {"absent": None, "lang": "fr"}, "lower(lang) = 'fr'")("sel_null")
_chosen("part", "p_partkey", [{"p_size|gt": 45}, {"p_type|contains": "steel", "p_size|lte": 5}], "p_size > 45 OR (contains(lower(p_type), 'steel') AND p_size <= 5)")("sel_or_maps")


def _conditioned(name: str, text: str, where: str) -> None:
    found = {"selection_https": {"url|startswith": "https"}, "selection_page": {"url|contains": "page="}, "filter_utm": {"url|contains": "utm_"}, "filter_missing": {"nothing|contains": "x"}}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, "pages")
        return t.where(condition(text, {n: selection(s, {}, t.columns) for n, s in found.items()})).select("page_id")

    register(f"WITH p AS (SELECT page_id, starts_with(lower(url), 'https') AS a, contains(lower(url), 'page=') AS b, contains(lower(url), 'utm_') AS c FROM pages) SELECT page_id FROM p WHERE {where}", name)(run)


_conditioned("cond_and_not", "selection_https and not (filter_utm or filter_missing)", "coalesce(a, false) AND NOT coalesce(c, false)")
_conditioned("cond_1_of", "1 of selection_* and not filter_utm", "(coalesce(a, false) OR coalesce(b, false)) AND NOT coalesce(c, false)")
_conditioned("cond_all_of", "all of selection_* or filter_utm", "(coalesce(a, false) AND coalesce(b, false)) OR coalesce(c, false)")

# ---------------------------------------------------------------- fields, joins, parsing

_IP = r"(?<![0-9A-Za-z.:])(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![0-9A-Za-z.:])"


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses of documents, and one of each event in IPv6 writing, which documents don't show."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_IP), F.lit(0))).alias("ip"))
    group = lambda c: F.lower(F.hex(c))
    parts = F.array(*map(F.lit, ("2606", "2001", "fd00", "fe80", "2a00", "100", "2002", "64")))
    made = F.concat(F.element_at(parts, (F.col("event_id") % 8 + 1).cast("int")), F.lit(":"), group(F.col("user_id") % 65536), F.lit("::"), group(F.col("event_id") % 65536))
    return found.union(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), made.alias("ip")))


@register(r"""
WITH d AS (SELECT doc_id, (' ' || coalesce(text, '') || ' ') AS t FROM documents),
x AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(t, '[^0-9A-Za-z.:]+', '  ', 'g'), ' (\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}) ', 1)) AS ip FROM d),
e AS (SELECT event_id AS doc_id, ['2606', '2001', 'fd00', 'fe80', '2a00', '100', '2002', '64'][event_id % 8 + 1] || ':' || lower(to_hex(user_id % 65536)) || '::' || lower(to_hex(event_id % 65536)) AS ip, event_id % 8 IN (0, 4) OR (event_id % 8 = 1 AND (user_id % 65536 > 511 AND user_id % 65536 <> 3512 OR user_id % 65536 = 3 OR user_id % 65536 BETWEEN 32 AND 63 OR user_id % 65536 = 1 AND event_id % 65536 IN (1, 2))) AS public FROM events),
n AS (SELECT doc_id, ip, regexp_matches(ip, '^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$') AS ok,
  try_cast(split_part(ip, '.', 1) AS BIGINT) * 16777216 + try_cast(split_part(ip, '.', 2) AS BIGINT) * 65536 + try_cast(split_part(ip, '.', 3) AS BIGINT) * 256 + try_cast(split_part(ip, '.', 4) AS BIGINT) AS a FROM x)
SELECT doc_id, ip, ok AND (NOT (a BETWEEN 0 AND 16777215 OR a BETWEEN 167772160 AND 184549375 OR a BETWEEN 2130706432 AND 2147483647 OR a BETWEEN 2851995648 AND 2852061183 OR a BETWEEN 2886729728 AND 2887778303
  OR a BETWEEN 3221225472 AND 3221225727 OR a BETWEEN 3232235520 AND 3232301055 OR a BETWEEN 3323068416 AND 3323199487 OR a >= 4026531840) OR a IN (3221225481, 3221225482)) AS public FROM n WHERE NOT contains(ip, ':')
UNION ALL SELECT doc_id, ip, public FROM e
""")
def is_public_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("doc_id", "ip", is_public(F.col("ip")).alias("public"))


_LIST_SQL = "SELECT s_suppkey, s_name FROM supplier s {kind} JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) n ON s.s_nationkey = n.n_nationkey"


def _listed(spark: SparkSession, sf_dir: str, chosen: Callable[[Column], Column]) -> DataFrame:
    """Suppliers by a rule's leaf: whether their nation stands in a list that is a table."""
    sel, lists = {"s_nationkey|in_list": "allowed"}, {"allowed": table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")}
    rows, marks = marked(table(spark, sf_dir, "supplier"), [sel], lists, "s_suppkey")
    return rows.where(chosen(selection(sel, lists, rows.columns, marks=marks))).select("s_suppkey", "s_name")


@register(_LIST_SQL.format(kind="SEMI"))
def allowlist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, lambda c: c)


@register(_LIST_SQL.format(kind="ANTI"))
def allowlist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, lambda c: ~c)


_PIECES = "(SELECT DISTINCT lower(substr({field}, CAST({at} AS BIGINT), CAST({n} AS BIGINT))) AS needle FROM pages, unnest(range(10)) r(i))"
_IN_HTML = _PIECES.format(field="html", at="1 + (page_id * 7 + i * 53) % 400", n="2 + (page_id + i) % 14")
_OF_URL = _PIECES.format(field="url", at="1 + i * 3", n="3 + (page_id + i) % 40")


def _pieces(p: DataFrame, field: str, at: str, n: str) -> DataFrame:
    """Ten pieces of each page as needles."""
    return p.select("page_id", field, F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select(F.lower(F.substr(F.col(field), F.expr(at).cast("int"), F.expr(n).cast("int"))).alias("needle"))


@register(f"WITH n AS {_IN_HTML} SELECT p.page_id, count(*) AS hits FROM pages p JOIN n ON contains(lower(p.html), n.needle) GROUP BY p.page_id")
def needles_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of thousands of needles each page contains."""
    p = table(spark, sf_dir, "pages")
    return counted(p, "page_id", "html", _pieces(p, "html", "1 + (page_id * 7 + i * 53) % 400", "2 + (page_id + i) % 14")).withColumnRenamed("n", "hits")


@register(
    f"WITH n AS {_OF_URL}, x AS (SELECT p.page_id, n.needle, starts_with(lower(p.url), n.needle) AS s, suffix(lower(p.url), n.needle) AS e FROM pages p JOIN n ON contains(lower(p.url), n.needle)) "
    "SELECT page_id, count(*) AS contained, count(*) FILTER (s) AS starts, count(*) FILTER (e) AS ends FROM x GROUP BY page_id"
)
def needles_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for addresses: contained, at the start, at the end."""
    p = table(spark, sf_dir, "pages")
    needles = _pieces(p, "url", "1 + i * 3", "3 + (page_id + i) % 40")
    counts = [counted(p, "page_id", "url", needles, where).withColumnRenamed("n", name) for where, name in (("contains", "contained"), ("startswith", "starts"), ("endswith", "ends"))]
    both = counts[0].join(counts[1], "page_id", "left").join(counts[2], "page_id", "left")
    return both.select("page_id", "contained", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("starts", "ends")])


# ---------------------------------------------------------------- log lines made of the tables, read by the parsers


def _lines(rows: DataFrame, value: Column, n: str) -> DataFrame:
    """Lines as ``read_lines`` gives them, in the order of ``n``."""
    return rows.select(value.alias("value"), F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.col(n).cast("long").alias("n")).alias("at"))


def _stamp(form: str) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(F.col("us") / 1_000_000)), form)


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _firewall_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh line is broken, every third has no size."""
    e = events(spark, sf_dir)
    id_, user = F.col("event_id"), F.col("user_id")
    action = F.element_at(F.array(*map(F.lit, L_ACTIONS)), (id_ % 5 + 1).cast("int"))
    more = F.when(id_ % 3 == 0, " RULE=7").otherwise(_text(" RULE=7 BYTES=", F.floor(F.col("value") * 100).cast("long")))
    line = _text(_stamp("yyyy-MM-dd HH:mm:ss"), "  ", action, " ", F.when(id_ % 2 == 0, "TCP").otherwise("udp"), " 10.0.", user % 200, ".", id_ % 250, ":", id_ % 60000, " -> 203.0.113.", user % 250, ":", id_ % 1000, more, " ")
    return _lines(e, F.when(id_ % 11 == 0, _text("broken ", id_, F.repeat(F.lit(" x"), 80))).otherwise(line), "event_id")


L_ACTIONS = ("ACCEPT", "ALLOW", "DROP", "DENY", "REJECT")


@register("""
SELECT event_id, CAST(epoch_us(ts) - epoch_us(ts) % 1000000 AS BIGINT) AS us, CASE WHEN event_id % 5 < 2 THEN 'fw_allow' ELSE 'fw_deny' END AS kind, '10.0.' || (user_id % 200) || '.' || (event_id % 250) AS src_ip, '203.0.113.' || (user_id % 250) AS dst_ip,
  CAST(event_id % 1000 AS INTEGER) AS dst_port, CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS bytes, ['accept', 'allow', 'drop', 'deny', 'reject'][event_id % 5 + 1] AS action
FROM events WHERE event_id % 11 <> 0
""")
def parse_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse(_firewall_lines(spark, sf_dir), "firewall").where("ok").select(F.col("at.n").alias("event_id"), "us", "kind", "src_ip", "dst_ip", "dst_port", "protocol", "bytes", "action")


@register("""
WITH b AS (SELECT event_id, left('broken ' || event_id || repeat(' x', 80), 120) AS line FROM events WHERE event_id % 11 = 0 ORDER BY event_id LIMIT 3)
SELECT 'firewall' AS source, count(*) AS total, count(*) FILTER (event_id % 11 <> 0) AS parsed, count(*) FILTER (event_id % 11 = 0) AS skipped, (SELECT string_agg(line, '|' ORDER BY event_id) FROM b) AS samples FROM events
""")
def parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_stats(L.parse(_firewall_lines(spark, sf_dir), "firewall")).withColumn("samples", F.array_join("samples", "|"))


@register(r"""
SELECT event_id, CAST(epoch_us(ts) - epoch_us(ts) % 1000000 AS BIGINT) AS us, ['auth_failure', 'auth_failure', 'auth_success', 'sudo'][event_id % 4 + 1] AS kind, 'h' || (user_id % 9) AS host, 'u' || user_id AS "user",
  CASE WHEN event_id % 4 = 3 THEN '' ELSE '192.168.' || (user_id % 250) || '.' || (event_id % 250) END AS src_ip, CASE WHEN event_id % 4 = 2 THEN 'publickey' END AS method, event_id % 4 = 1 AS invalid_user,
  CASE WHEN event_id % 4 = 3 THEN '/bin/run ' || event_type || '; x' END AS command, CASE WHEN event_id % 4 = 3 THEN '/home/u' || user_id END AS pwd
FROM events
""")
def parse_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ins and sudo of a year that the lines don't name."""
    e = events(spark, sf_dir)
    id_, user = F.col("event_id"), F.col("user_id")
    ip = _text("192.168.", user % 250, ".", id_ % 250)
    failed = F.when(id_ % 8 == 0, _text("Failed password for invalid user u", user, " from ", ip, " port 22 ssh2")).otherwise(_text("Failed publickey for u", user, " from ", ip, " port 22 ssh2"))
    said = F.when(id_ % 4 == 0, _text("sshd[12]: ", failed)).when(id_ % 4 == 1, _text("sshd-session: Invalid user u", user, " from ", ip)).when(id_ % 4 == 2, _text("sshd[7]: Accepted publickey for u", user, " from ", ip, " port 22 ssh2: RSA"))
    said = said.otherwise(_text("sudo:   u", user, " : TTY=pts/0 ; PWD=/home/u", user, " ; USER=root ; COMMAND=/bin/run ", F.col("event_type"), "; x"))
    line = _text(_stamp("MMM d HH:mm:ss"), " h", user % 9, " ", said)
    years = e.agg(F.min("us"), F.max("us")).first()
    first, last = (datetime.fromtimestamp((y or 0) / 1e6, timezone.utc).year for y in years)
    rows = [L.parse(_lines(e.where(F.year(F.timestamp_micros("us")) == y), line, "event_id"), "auth", year=y) for y in range(first, last + 1)]  # one a year
    return reduce(DataFrame.unionByName, rows).where("ok").select(F.col("at.n").alias("event_id"), "us", "kind", "host", "user", "src_ip", "method", F.coalesce("invalid_user", F.lit(False)).alias("invalid_user"), "command", "pwd")


@register(r"""
SELECT event_id, epoch_us(ts) - epoch_us(ts) % 1000 AS us, ['process_create', 'network_connect', 'process_access', 'file_create', 'dns_query'][event_id % 5 + 1] AS kind, 'WS-' || user_id AS host, 'CORP\u' || user_id AS "user", 'C:\' || event_type || '.exe' AS image,
  CASE WHEN event_id % 5 = 0 THEN 'run --k=' || props || ';w' END AS command_line, CASE WHEN event_id % 5 = 1 THEN '198.51.100.' || (user_id % 250) ELSE '' END AS dst_ip, CASE WHEN event_id % 5 = 1 THEN CAST(event_id % 60000 AS INTEGER) ELSE 0 END AS dst_port,
  CASE WHEN event_id % 5 = 4 THEN event_type || '.example' END AS query
FROM events
""")
def kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint logs of ``key=value`` pairs, the first of which comes twice."""
    e = events(spark, sf_dir)
    id_, user = F.col("event_id"), F.col("user_id")
    number = F.element_at(F.array(*map(F.lit, (1, 3, 10, 11, 22))), (id_ % 5 + 1).cast("int"))
    image = F.when(id_ % 5 == 2, "SourceImage").otherwise("Image")
    more = F.when(id_ % 5 == 0, _text(";CommandLine=run --k=", F.col("props"), ";w")).when(id_ % 5 == 1, _text(";DestinationIp=198.51.100.", user % 250, ";DestinationPort=", id_ % 60000)).when(id_ % 5 == 4, _text(";QueryName=", F.col("event_type"), ".example")).otherwise(F.lit(";TargetFilename="))
    stamp = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSS")
    line = _text(stamp, " UTC;EventID ", number, ";Kind;Computer=old;Computer=WS-", user, ";User=CORP\\u", user, ";", image, "=C:\\", F.col("event_type"), ".exe", more)
    return L.parse(_lines(e, line, "event_id"), "sysmon").where("ok").select(F.col("at.n").alias("event_id"), "us", "kind", "host", "user", "image", "command_line", "dst_ip", "dst_port", "query")


@register("""
WITH p AS (SELECT * REPLACE (CASE WHEN page_id % 5 = 0 THEN url || '?q="a"%20or%201="' ELSE url END AS url) FROM pages)
SELECT page_id, split_part(url, '?', 1) AS uri_path, CASE WHEN contains(url, '?') THEN substr(url, strpos(url, '?') + 1) ELSE '' END AS uri_query, 'web01' AS host, '10.1.' || (page_id % 200) || '.9' AS src_ip, CASE WHEN page_id % 3 = 0 THEN 'amy' ELSE '' END AS "user",
  CAST(200 + page_id % 300 AS INTEGER) AS status, CASE WHEN page_id % 4 = 0 THEN 0 ELSE length(html) END AS bytes, CASE WHEN page_id % 2 = 0 THEN 'agent ' || page_id END AS user_agent
FROM p WHERE regexp_full_match(url, '\\S+')
""")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lines of a web server's log; every fifth asks with quotes in its address."""
    p = table(spark, sf_dir, "pages")
    id_ = F.col("page_id")
    size = F.when(id_ % 4 == 0, "-").otherwise(F.length("html").cast("string"))
    line = _text("10.1.", id_ % 200, ".9 - ", F.when(id_ % 3 == 0, "amy").otherwise("-"), ' [10/Mar/2026:10:00:00 +0200] "GET ', F.col("url"), F.when(id_ % 5 == 0, '?q="a"%20or%201="').otherwise(""), ' HTTP/1.1" ', 200 + id_ % 300, " ", size, F.when(id_ % 2 == 0, _text(' "-" "agent ', id_, '"')).otherwise(""))
    got = L.parse(_lines(p, line, "page_id"), "apache").where("ok")
    return got.select(F.col("at.n").alias("page_id"), "uri_path", "uri_query", "host", "src_ip", "user", "status", "bytes", "user_agent")


# ---------------------------------------------------------------- the detector on events made of the table


def _as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as failed sign-ins, purchases as successful ones, all else as connections."""
    e = events(spark, sf_dir)
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "error", "auth_failure").when(F.col("event_type") == "purchase", "auth_success").otherwise("network_connect")
    made = {
        "kind": kind, "source": F.lit("auth"), "host": F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string")), "user": user, "src_ip": F.concat(F.lit("8.8."), (F.col("user_id") % 250).cast("string"), F.lit(".1")), "dst_ip": F.lit(""), "dst_port": F.lit(0),
        "query": F.concat("event_type", "props"), "bytes": F.round(F.col("value") * 100).cast("long"), "raw": F.concat(F.lit(" line "), F.col("event_id").cast("string"), F.lit(" ")),
    }
    return e.select("us", "seq", *[c.alias(k) for k, c in made.items()])


@register(
    "WITH RECURSIVE bursts AS (" + _burst_sql("event_type = 'error'", 24, 3).replace("WITH RECURSIVE", "WITH", 1)
    + """), m AS (SELECT b.user_id, b.first_us, b.trigger_us, e.event_id, epoch_us(e.ts) AS us, 'h' || (e.event_id % 3) AS host, e.event_type || e.props AS query FROM bursts b JOIN events e ON e.user_id = b.user_id AND e.event_type = 'error' AND epoch_us(e.ts) BETWEEN b.first_us AND b.last_us),
h AS (SELECT user_id, first_us, host FROM (SELECT *, row_number() OVER (PARTITION BY user_id, first_us ORDER BY n DESC, s) AS r FROM (SELECT user_id, first_us, host, count(*) AS n, min(event_id) AS s FROM m GROUP BY ALL)) WHERE r = 1),
p AS (SELECT user_id, first_us, string_agg('line ' || event_id, '|' ORDER BY us, event_id) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, first_us ORDER BY us, event_id) AS r FROM m WHERE us <= trigger_us) WHERE r <= 3 GROUP BY ALL),
i AS (SELECT user_id, first_us, string_agg(v, '|' ORDER BY us, event_id, k) AS indicators FROM (SELECT *, row_number() OVER (PARTITION BY user_id, first_us ORDER BY us, event_id, k) AS r FROM (
  SELECT user_id, first_us, v, us, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, first_us, v ORDER BY us, event_id, k) AS q FROM (SELECT *, query AS v, 2 AS k FROM m UNION ALL SELECT *, '8.8.' || (user_id % 250) || '.1', 0 FROM m)) WHERE q = 1)) WHERE r <= 10 GROUP BY ALL)
SELECT b.first_us, b.last_us, b.n AS count, 'u' || b.user_id AS "user", h.host, p.evidence, i.indicators, 'high' AS severity FROM bursts b JOIN h USING (user_id, first_us) JOIN p USING (user_id, first_us) JOIN i USING (user_id, first_us)"""
)
def indicators_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold rule through the detector: hosts, evidence and indicators of its alerts."""
    rule = StateRule({"id": "X", "severity": "high", "type": "threshold", "match": {"kind": "auth_failure"}, "group_by": "user", "count": 3, "window": 24 * HOUR})
    found = Detector([], [rule]).run(_as_events(spark, sf_dir))
    return found.select("first_us", "last_us", "count", "user", "host", F.array_join("evidence", "|").alias("evidence"), F.array_join("indicators", "|").alias("indicators"), "severity")


@register("""
WITH g AS (SELECT user_id, event_id % 3 AS h, epoch_us(ts) AS us, event_id AS seq FROM events WHERE event_type = 'purchase' AND value > 100),
s AS (SELECT *, sum(nb) OVER (PARTITION BY user_id, h ORDER BY us, seq) AS sid FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id, h ORDER BY us, seq) <= 86400::BIGINT * 1000000 THEN 0 ELSE 1 END AS nb FROM g)),
a AS (SELECT user_id, h, sid, min(us) AS first_us, max(us) AS last_us, count(*) AS n, arg_min(seq, (us, seq)) AS trigger FROM s GROUP BY ALL)
SELECT row_number() OVER (ORDER BY first_us, trigger) AS ord, first_us, last_us, n AS count, 'u' || user_id AS "user", 'h' || h AS host, 'line ' || trigger AS evidence, 'medium' AS severity, 'Execution' AS tactic, 'T1059.004' AS technique FROM a
""")
def event_rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on single events through the detector: hits folded by rule, host, user and address, and numbered."""
    doc = {"name": "Y", "title": "y", "level": "medium", "tags": ["attack.execution", "attack.t1059.004"], "logsource": {"service": "sudo"}, "detection": {"much": {"bytes|gt": 10000}, "condition": "much"}}
    sudo = _as_events(spark, sf_dir).where("kind = 'auth_success'").withColumn("kind", F.lit("sudo"))
    found = Detector([EventRule(doc)], [], cooldown_s=24 * HOUR).run(sudo)
    return found.select("ord", "first_us", "last_us", "count", "user", "host", F.array_join("evidence", "|").alias("evidence"), "severity", "tactic", "technique")


# ---------------------------------------------------------------- joins

#: Nine of ten orders are those of one user, at times within those of the events.
_ASKED = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 9 THEN 7 ELSE o_custkey % 150 END AS user_id, 1704067200000000 + CAST(o_orderkey * 7919 % 2592000 AS BIGINT) * 1000000 AS us FROM orders"


@register(f"""
WITH o AS ({_ASKED}), e AS (SELECT user_id, epoch_us(ts) AS us, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT o.o_orderkey, coalesce(e.event_id, -1) AS event_id, coalesce(e.us, -1) AS event_us FROM o ASOF LEFT JOIN e ON o.user_id = e.user_id AND o.us >= e.us
""")
def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's user did last before it; -1 for nothing."""
    o = table(spark, sf_dir, "orders")
    asked = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 < 9, 7).otherwise(F.col("o_custkey") % 150).cast("long").alias("user_id"), (F.lit(1704067200000000) + F.col("o_orderkey") * 7919 % 2592000 * 1000000).alias("us"))
    got = as_of(asked, events(spark, sf_dir).select("user_id", "us", "seq"), ["user_id"], 6 * HOUR * B.SECOND)
    nothing = F.lit(-1).cast("long")
    return got.select("o_orderkey", F.coalesce("last.seq", nothing).alias("event_id"), F.coalesce("last.us", nothing).alias("event_us"))


@register(
    "WITH b AS (" + _burst_sql("event_type = 'error'", 24, 3) + """), e AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 3000000 AS t FROM events)
SELECT b.user_id, b.first_us, e.event_id FROM b JOIN e ON e.user_id = b.user_id AND e.s <= b.last_us AND e.t >= b.first_us"""
)
def incident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts with all events of their user that last into their time."""
    b = _burst("event_type = 'error'", 24, 3)(spark, sf_dir).select("user_id", F.col("first_us").alias("start_us"), F.col("last_us").alias("end_us"))
    e = events(spark, sf_dir).select("user_id", F.col("us").alias("start_us"), (F.col("us") + F.round(F.col("value") * 100).cast("long") * 3_000_000).alias("end_us"), "event_id")
    return overlapping(b, e, ["user_id"], HOUR * B.SECOND).select("user_id", F.col("l.start_us").alias("first_us"), "r.event_id")


@register("""
WITH n AS (SELECT '10.0.0.0/8' AS net, 10::BIGINT * 16777216 AS lo, 11::BIGINT * 16777216 - 1 AS hi
  UNION ALL SELECT '10.' || r_regionkey || '.0.0/16', 10::BIGINT * 16777216 + r_regionkey * 65536, 10::BIGINT * 16777216 + r_regionkey * 65536 + 65535 FROM region
  UNION ALL SELECT '10.' || n_regionkey || '.' || n_nationkey || '.0/25', 10::BIGINT * 16777216 + n_regionkey * 65536 + n_nationkey * 256, 10::BIGINT * 16777216 + n_regionkey * 65536 + n_nationkey * 256 + 127 FROM nation
  UNION ALL SELECT '2001:db8:' || n_regionkey || '::/48', n_regionkey - 100, n_regionkey - 100 FROM nation WHERE n_nationkey < 5),
a AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '2001:DB8:' || (user_id % 4) || '::' || (event_id % 97) ELSE (10 + event_id % 2) || '.' || (user_id % 6) || '.' || (event_id % 27) || '.' || (event_id % 250) END AS ip,
  CASE WHEN event_id % 7 = 0 THEN user_id % 4 - 100 ELSE (10 + event_id % 2) * 16777216::BIGINT + user_id % 6 * 65536 + event_id % 27 * 256 + event_id % 250 END AS x FROM events)
SELECT event_id, ip, arg_min(net, hi - lo) AS net FROM a LEFT JOIN n ON x BETWEEN lo AND hi GROUP BY event_id, ip
""")
def network_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both kinds in nested networks: the smallest that holds each."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    nets = spark.range(1).select(F.lit("10.0.0.0/8").alias("net")).union(r.select(_text("10.", F.col("r_regionkey"), ".0.0/16"))).union(n.select(_text("10.", F.col("n_regionkey"), ".", F.col("n_nationkey"), ".0/25")))
    nets = nets.union(n.where("n_nationkey < 5").select(_text("2001:db8:", F.col("n_regionkey"), "::/48")))
    id_, user = F.col("event_id"), F.col("user_id")
    ip = F.when(id_ % 7 == 0, _text("2001:DB8:", user % 4, "::", id_ % 97)).otherwise(_text(10 + id_ % 2, ".", user % 6, ".", id_ % 27, ".", id_ % 250))
    found = longest_match(table(spark, sf_dir, "events").select("event_id", ip.alias("ip")), "ip", nets, "net")
    return found.select("event_id", "ip", F.col("network.net").alias("net"))


@register("""
SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS us, CASE event_type WHEN 'error' THEN 'auth_failure' WHEN 'purchase' THEN 'auth_success' ELSE 'network_connect' END AS kind, 'u' || user_id AS "user", CAST(round(value * 100) AS BIGINT) AS bytes, event_type || props AS query,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k, 11::BIGINT AS fields FROM events
""")
def events_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON objects, with their open fields beside the known ones, read again."""
    e = _as_events(spark, sf_dir).join(events(spark, sf_dir).select("seq", F.parse_json("props").alias("more")), "seq")
    told = e.select("seq", event_json(e.columns).alias("j"))
    of = lambda name: F.get_json_object("j", f"$.{name}")
    at = F.unix_micros(of("ts").cast("timestamp"))
    return told.select(F.col("seq").alias("event_id"), at.alias("us"), of("kind").alias("kind"), of("user").alias("user"), of("bytes").cast("long").alias("bytes"), of("query").alias("query"), of("k").cast("long").alias("k"), F.size(F.json_object_keys("j")).cast("long").alias("fields"))


@register("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 40 AND (event_type = 'error' OR CAST(json_extract(props, '$.k') AS BIGINT) = 77)
""")
def open_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on a field that is no column but stands in the events' own objects."""
    e = events(spark, sf_dir).withColumn("more", F.parse_json("props"))
    found = {"high": {"k|gte": 40}, "error": {"event_type": "error"}, "seven": {"K": 77}}
    hit = condition("high and (error or seven)", {n: selection(s, {}, e.columns) for n, s in found.items()})
    return e.where(hit).select("event_id", resolve("k", e.columns).cast("long").alias("k"))



def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    level = F.when(F.col("r_regionkey") == 0, "critical").when(F.col("r_regionkey") == 1, "high").when(F.col("r_regionkey") == 2, "medium")
    return n.join(r, n.n_regionkey == r.r_regionkey).where("r_regionkey < 4").select("n_nationkey", "n_name", level.alias("criticality"))


@register("""
SELECT c_custkey, n.n_name AS asset, coalesce(CASE r_regionkey WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' END, 'low') AS criticality
FROM customer c LEFT JOIN (SELECT n_nationkey, n_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 4) n ON c.c_nationkey = n.n_nationkey
""")
def asset_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    assets = _inventory(spark, sf_dir).select(F.col("n_nationkey").cast("string").alias("host_key"), "n_name", "criticality")
    found = with_assets(c, F.col("c_nationkey").cast("string"), assets)
    return found.select("c_custkey", F.col("asset.n_name").alias("asset"), F.coalesce("asset.criticality", F.lit("low")).alias("criticality"))


@register(r"""
WITH f AS (SELECT DISTINCT lower(w) AS key FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> ''),
d AS (SELECT DISTINCT doc_id, lower(w) AS key FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '')
SELECT doc_id, count(*) AS hits FROM d JOIN f USING (key) GROUP BY doc_id
""")
def intel_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as a feed of indicators."""
    words = lambda t, *keep: t.select(*keep, F.explode(F.split("text", " ")).alias("w")).where("w <> ''").select(*keep, F.lower("w").alias("key")).distinct()
    feed = words(table(spark, sf_dir, "benchmark"))
    return known_indicators(words(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("key", "word"), F.col("word"), feed).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
