"""All stateful rules in one plan against each rule by itself."""

import random
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators.bursts import SECOND, bursts
from wardlight.operators.fused import Watch, frames, watched
from wardlight.operators import whole as whole_keys
from wardlight.operators.sequences import beacons, sequences
from wardlight.plans.detector import ALERT, Detector, fused_alerts, state_alerts, tagged
from wardlight.plans.rules import StateRule

WATCHES = [
    Watch("count", 4, 30 * SECOND), Watch("count", 2, 12 * SECOND), Watch("sum", 60, 30 * SECOND), Watch("sum", 25, 7 * SECOND), Watch("distinct", 3, 30 * SECOND), Watch("distinct", 2, 9 * SECOND),
    Watch("sequence", 2, 25 * SECOND), Watch("sequence", 1, 60 * SECOND), Watch("beacon", 4, 200 * SECOND, 0.5, 2, 100), Watch("beacon", 3, 60 * SECOND, 0.3, 2, 100),
]


def rows_of(spark, seed):
    r = random.Random(seed)
    out = [(f"k{k}", r.randrange(0, 500, 4) * SECOND + r.choice((0, 0, 1)), f"v{r.randrange(4)}" if r.random() < 0.9 else None, r.randrange(30), r.random() < 0.6) for k in range(40) for _ in range(r.randrange(1, 30))]
    out.sort(key=lambda e: (e[1], r.random()))
    return spark.createDataFrame([(*e, i) for i, e in enumerate(out)], "g string, us long, x string, v long, p boolean, seq long").repartition(3)


def alone(df, i, w):
    window = w.window_us / SECOND
    if w.form == "beacon":
        got = beacons(df, ["g"], w.need, window, w.jitter, w.least_s, w.most_s).select("g", "first_us", F.col("at_seq").alias("trigger_seq"), "last_us", "n", "mean_s", "cv")
    elif w.form == "sequence":
        got = sequences(df.withColumns({"is_prior": F.col("p"), "is_trigger": ~F.col("p")}), ["g"], w.need, window).select("g", "first_us", F.col("seq").alias("trigger_seq"), F.col("us").alias("last_us"), "n", F.lit(None).cast("double"), F.lit(None).cast("double"))
    else:
        got = bursts(df, ["g"], w.need, window, w.form, {"sum": "v", "distinct": "x", "count": None}[w.form]).select("g", "first_us", "trigger_seq", "last_us", "n", F.lit(None).cast("double"), F.lit(None).cast("double"))
    return [(i, *map(round_off, r)) for r in got.collect()]


def round_off(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("seed", [1])
def test_every_form(spark, seed):
    df = rows_of(spark, seed)
    all_rows = df.withColumn("rule", F.explode(F.array(*map(F.lit, range(len(WATCHES))))))
    got = watched(all_rows, WATCHES).select("rule", "g", "first_us", "trigger_seq", "last_us", "n", "mean_s", "cv")
    kept = [(*r[:6], *map(round_off, r[6:])) if WATCHES[r[0]].form == "beacon" else (*r[:6], None, None) for r in map(tuple, got.collect())]
    want = [x for i, w in enumerate(WATCHES) for x in alone(df, i, w)]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
    assert {r[0] for r in want} == set(range(len(WATCHES)))


def test_crowded_keys_and_others(spark):
    """Keys are crowded or not, or lack a time: alerts are the same, and rows of keys that are not crowded are dealt out once, without copies."""
    df = rows_of(spark, 2)
    all_rows = df.withColumn("rule", F.explode(F.array(*map(F.lit, range(len(WATCHES))))))
    show = lambda found: sorted((tuple(map(round_off, r)) for r in found.select("rule", "g", "first_us", "trigger_seq", "last_us", "n", F.when(F.col("rule") >= 8, F.col("cv"))).collect()), key=repr)
    want = show(watched(all_rows, WATCHES))
    assert {r[0] for r in want} == set(range(len(WATCHES)))
    assert show(watched(all_rows, WATCHES, 150)) == want
    odd = all_rows.withColumn("us", F.when((F.col("g") != "k3") | (F.col("seq") % 5 != 0), F.col("us")))
    keep = lambda rows: [r for r in rows if r[1] != "k3"]
    assert keep(show(watched(odd, WATCHES))) == keep(want)
    plan = whole_keys.whole(spark.createDataFrame(all_rows.rdd, all_rows.schema), WATCHES)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(g[^,]*, rule", plan)) == 1 and plan.count("Exchange") == 1 and "explode" not in plan


def keys_of(seed, n=40):
    r = random.Random(seed)
    rows = [(i, f"k{k:02}", r.randrange(0, 300, 3) * SECOND, r.randrange(-5, 30), r.choice(("a", "b", "c", None)), r.random() < 0.6) for k in range(n) for i in range(len(WATCHES)) for _ in range(r.randrange(1, 12))]
    rows = sorted((g, rule, us, seq, v, x, p) for seq, (rule, g, us, v, x, p) in enumerate(rows))
    schema = pa.schema([("g", pa.string()), ("rule", pa.int32()), ("us", pa.int64()), ("seq", pa.int64()), ("v", pa.int64()), ("x", pa.string()), ("p", pa.bool_())])
    return pa.table([list(c) for c in zip(*rows)], schema=schema)


@pytest.mark.parametrize("rows", [2, 50])
def test_keys_over_several_batches(monkeypatch, rows):
    """Also keys with more rows than are gone through at once."""
    table = keys_of(3)
    want = whole_keys._alerts(table, WATCHES).to_pylist()
    monkeypatch.setattr(whole_keys, "ROWS", rows)
    got = pa.Table.from_batches(whole_keys._in_groups(WATCHES)(iter(table.to_batches(7)))).to_pylist()
    order = lambda r: (r["rule"], r["g"], r["trigger_seq"])
    assert want and sorted(got, key=order) == sorted(want, key=order)
    assert list(whole_keys._in_groups(WATCHES)(iter([]))) == []


@pytest.mark.parametrize("power", [0, 53])
def test_sums_by_brute_force(power):
    """Also negative amounts, and running sums over all keys that no long holds."""
    table = keys_of(5)
    v = table["v"].to_numpy() << power
    table = table.set_column(4, "v", pa.array(v))
    watches = [Watch(w.form, w.need << power, w.window_us) if w.form == "sum" else w for w in WATCHES]
    got = {(r["rule"], r["g"], r["trigger_seq"]): (r["first_seq"], r["last_us"], r["n"]) for r in whole_keys._alerts(table, watches).to_pylist() if watches[r["rule"]].form == "sum"}
    keys, want = {}, {}
    for r in table.to_pylist():
        keys.setdefault((r["rule"], r["g"]), []).append(r)
    for (rule, g), rows in keys.items():
        w, session = watches[rule], []
        for i, r in enumerate(rows if w.form == "sum" else []):
            session = [*session, r] if i and r["us"] - rows[i - 1]["us"] <= w.window_us else [r]
            if i + 1 < len(rows) and rows[i + 1]["us"] - r["us"] <= w.window_us:
                continue
            for j, t in enumerate(session):
                inside = [k for k in range(j + 1) if session[k]["us"] >= t["us"] - w.window_us]
                if sum(session[k]["v"] for k in inside) >= w.need:
                    start = max(k for k in inside if sum(q["v"] for q in session[k : j + 1]) >= w.need)
                    want[rule, g, t["seq"]] = (session[start]["seq"], r["us"], len(session) - start)
                    break
    assert want and got == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], "rule int, g string, us long, seq long, v long, x string, p boolean")
    assert watched(empty, WATCHES).collect() == []
    assert watched(empty, WATCHES[:1]).collect() == []


DOCS = [
    ({"id": i, "title": i, "severity": "high", "tactic": "Discovery", "technique": "T1046", **d})
    for i, d in {
        "A": {"type": "threshold", "match": {"kind": "auth_failure"}, "group_by": "src_ip", "count": 4, "window": 40},
        "B": {"type": "threshold", "match": {"kind": "fw_deny"}, "group_by": "host", "count": 3, "window": 15, "exclude": {"user": "u1"}},
        "C": {"type": "distinct", "match": {"kind": "auth_failure"}, "group_by": "src_ip", "distinct": "user", "count": 3, "window": 60},
        "D": {"type": "distinct", "match": {"kind": "network_connect"}, "group_by": "host", "distinct": "dst_ip", "count": 2, "window": 20},
        "E": {"type": "threshold", "match": {"kind": "network_connect"}, "group_by": "user", "sum": "bytes", "count": 500, "window": 50},
        "F": {"type": "sequence", "match": {"kind": "auth_success"}, "preceded_by": {"match": {"kind": "auth_failure"}, "count": 2}, "group_by": "src_ip", "window": 90},
        "G": {"type": "sequence", "match": {"kind": "fw_deny"}, "preceded_by": {"match": {"kind": "network_connect"}, "count": 1}, "group_by": "user", "window": 30},
        "H": {"type": "beacon", "match": {"kind": "network_connect"}, "count": 4, "window": 400, "max_jitter": 0.6, "min_interval": 1, "max_interval": 200},
    }.items()
]


def rules():
    return [StateRule(d) for d in DOCS]


def events_of(spark, seed, n=900):
    r = random.Random(seed)
    kinds = ("auth_failure", "auth_failure", "auth_success", "network_connect", "network_connect", "fw_deny")
    rows = [(r.randrange(0, 1500) * SECOND, r.choice(kinds), r.choice(("h1", "h2", "h3", "")), r.choice(("u1", "u2", "u3", "u4", "")), f"8.8.4.{r.randrange(5)}", r.choice(("9.9.9.1", "10.0.0.2", "9.9.9.3", "")), r.randrange(3), r.choice(("a.example", "", None)), r.randrange(300)) for _ in range(n)]
    rows = [(i, *e, f" line {i} " if i % 7 else "  ") for i, e in enumerate(rows)]
    return spark.createDataFrame(rows, "seq long, us long, kind string, host string, user string, src_ip string, dst_ip string, dst_port int, query string, bytes long, raw string").repartition(3)


@pytest.mark.parametrize("seed", [4])
def test_alerts_equal_those_of_single_plans(spark, seed):
    events = events_of(spark, seed)
    got = fused_alerts(events, rules(), {}).collect()
    want = reduce(DataFrame.unionByName, [state_alerts(events, r, i, {}) for i, r in enumerate(rules())]).collect()
    assert got and {r["rule_id"] for r in got} == {d["id"] for d in DOCS}
    show = lambda rows: sorted((tuple(r[c] for c in ALERT) for r in rows), key=repr)
    assert show(got) == show(want)


def test_one_scan_and_one_shuffle_of_rows(spark, tmp_path):
    """Eight rules: one scan to tag rows, one exchange of tagged rows for all frames."""
    events_of(spark, 6).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    plan = tagged(events, rules(), {})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    rows = spark.createDataFrame([], "rule int, g string, us long, seq long, v long, x string, p boolean")
    plan = frames(rows, [w for w in WATCHES])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(rule[^,]*, g[^,]*, b", plan)) == 1 and plan.count("Exchange") == 1


def test_one_key_with_most_rows(spark):
    """A key with nearly all rows is as many tasks as it has buckets."""
    n = 4000
    rows = [(0, "hot", i * SECOND, i, None, None, False) for i in range(n)] + [(0, f"k{i}", i * SECOND, n + i, None, None, False) for i in range(50)]
    df = spark.createDataFrame(rows, "rule int, g string, us long, seq long, v long, x string, p boolean")
    watch = [Watch("count", 5, 10 * SECOND)]
    got = watched(df, watch).collect()
    assert [(r["g"], r["first_us"], r["trigger_us"], r["last_us"], r["n"]) for r in got] == [("hot", 0, 4 * SECOND, (n - 1) * SECOND, n)]
    sizes = frames(df, watch).groupBy("b").count().count()
    assert sizes >= n // 10


def test_detector_uses_it(spark):
    events = events_of(spark, 7, 300)
    got = Detector([], rules()).run(events)
    assert got.count() == fused_alerts(events.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("host", "user", "src_ip", "dst_ip")}), rules(), {}).count()
