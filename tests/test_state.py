"""Stateful operators against plain state machines, with many equal times."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from wardlight.operators.bursts import SECOND, bursts
from wardlight.operators.graph import components
from wardlight.operators.sequences import beacons, sequences
from wardlight.operators.sessions import sessions


def events(seed, keys=60, most=25, span=400, step=5):
    r = random.Random(seed)
    out = []
    for k in range(keys):
        for _ in range(r.randrange(1, most)):
            out.append((f"k{k}", r.randrange(0, span, step) * SECOND, r.randrange(4), r.randrange(0, 30)))
    out.sort(key=lambda e: (e[1], r.random()))
    return [(k, us, i, f"v{x}", v) for i, (k, us, x, v) in enumerate(out)]


def machine(rows, need, window, metric):
    """One pass with a queue a key: fires when the metric reaches need, then takes in events while they keep coming."""
    out, state = [], {}
    for k, us, seq, x, v in rows:
        q, burst = state.setdefault(k, (deque(), None))
        q.append((us, seq, x, v))
        while us - q[0][0] > window:
            q.popleft()
        if burst and us - burst[3] <= window:
            burst[3], burst[4] = us, burst[4] + 1
            continue
        amount = {"count": len(q), "distinct": len({e[2] for e in q}), "sum": sum(e[3] for e in q)}[metric]
        burst = None
        if amount >= need:
            members = list(q)
            while metric == "sum" and sum(e[3] for e in members[1:]) >= need:
                members.pop(0)
            burst = [k, members[0][0], seq, us, len(members)]
            out.append(burst)
        state[k] = (q, burst)
    return sorted(map(tuple, out))


@pytest.mark.parametrize(("metric", "need", "value"), [("count", 4, None), ("distinct", 3, "x"), ("sum", 60, "v")])
@pytest.mark.parametrize("seed", [1, 2])
def test_bursts(spark, metric, need, value, seed):
    rows = events(seed)
    df = spark.createDataFrame(rows, "k string, us long, seq long, x string, v long")
    got = bursts(df, ["k"], need, 30, metric, value).select("k", "first_us", "trigger_seq", "last_us", "n").collect()
    assert sorted(map(tuple, got)) == machine(rows, need, 30 * SECOND, metric)


def test_bursts_edges(spark):
    at = lambda *s: spark.createDataFrame([("a", int(t * SECOND), i) for i, t in enumerate(s)] + [(None, 0, 99)], "k string, us long, seq long")
    n = lambda df, need, w: [r["n"] for r in bursts(df, ["k"], need, w).orderBy("first_us").collect()]
    assert n(at(*range(0, 80, 2)), 5, 60) == [40]
    assert n(at(*range(0, 150, 30)), 5, 60) == []
    assert n(at(*range(6), *range(3600, 3606)), 5, 60) == [6, 6]
    assert n(at(0, 60), 2, 60) == [2] and n(at(0, 60.000001), 2, 60) == []
    sums = spark.createDataFrame([("a", i * SECOND, i, v) for i, v in enumerate([5, 5, 5, 60, 60, 60])], "k string, us long, seq long, v long")
    assert [(r["first_us"], r["n"]) for r in bursts(sums, ["k"], 100, 600, "sum", "v").collect()] == [(3 * SECOND, 3)]


@pytest.mark.parametrize("seed", [3, 4])
def test_sessions_of_intervals(spark, seed):
    r = random.Random(seed)
    rows = [(f"k{r.randrange(8)}", s := r.randrange(0, 90_000, 7), s + r.randrange(0, 400), i) for i in range(1500)]
    got = sessions(spark.createDataFrame(rows, "k string, us long, end long, seq long"), ["k"], 20, "us", "end").collect()
    want, last = {}, {}
    for k, us, end, seq in sorted(rows, key=lambda e: (e[1], e[3])):
        if k not in last or us - last[k][0] > 20:
            last[k] = [end, (us, seq)]
        last[k][0] = max(last[k][0], end)
        want[seq] = last[k][1]
    assert {x["seq"]: tuple(x["sid"]) for x in got} == want


@pytest.mark.parametrize("seed", [5, 6])
def test_sequences(spark, seed):
    rows = events(seed)
    df = spark.createDataFrame(rows, "k string, us long, seq long, x string, v long").withColumns({"is_prior": F.col("x").isin("v0", "v1"), "is_trigger": F.col("v") % 2 == 0})
    got = sorted((r["k"], r["us"], r["seq"], r["first_us"], r["n"]) for r in sequences(df, ["k"], 2, 40).collect())
    want, prior, quiet = [], {}, {}
    for k, us, seq, x, v in rows:
        q = prior.setdefault(k, deque())
        while q and us - q[0] > 40 * SECOND:
            q.popleft()
        if x in ("v0", "v1"):
            q.append(us)
        elif v % 2 == 0 and len(q) >= 2 and not (k in quiet and us - quiet[k] <= 40 * SECOND):
            want.append((k, us, seq, q[0], len(q) + 1))
            quiet[k] = us
    assert got == sorted(want)


def test_beacons(spark):
    r = random.Random(8)
    data = {"even": [60 * i + r.uniform(-2, 2) for i in range(10)], "odd": sorted(r.uniform(0, 600) for _ in range(10)), "few": [60.0 * i for i in range(4)], "fast": [1.0 * i for i in range(12)], "late": [0.0, 1000.0] + [2000 + 30.0 * i for i in range(8)]}
    rows = [(k, int(t * SECOND), i) for k, ts in data.items() for i, t in enumerate(ts)]
    got = {x["k"]: (x["n"], x["first_us"]) for x in beacons(spark.createDataFrame(rows, "k string, us long, seq long"), ["k"], 8, 1800, 0.25, 5, 900).collect()}
    assert got == {"even": (10, rows[0][1]), "late": (10, 0)}


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(200, 260)] + [(r.randrange(150), r.randrange(150)) for _ in range(110)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(n, n) == x for n, x in label.items())


@pytest.mark.parametrize("gap_s", [3, 40])
def test_alerts_apart_in_long_sessions(spark, gap_s):
    """One busy key whose hits never pause, and keys with few."""
    from wardlight.operators.sequences import apart

    r = random.Random(gap_s)
    hits = [("busy", t * 1_000_000 + r.choice([0, 0, 500_000]), i, i, 1) for i, t in enumerate(sorted(r.randrange(600) for _ in range(900)))]
    hits += [(f"k{i % 30}", r.randrange(600) * 1_000_000, 1000 + i, i, 1) for i in range(90)]
    df = spark.createDataFrame(hits, "k string, us long, seq long, first_us long, n long").repartition(3)
    got = sorted((x["k"], x["us"], x["seq"]) for x in apart(df, ["k"], gap_s * 1_000_000).collect())
    want, last = [], {}
    for k, us, seq, *_ in sorted(hits):
        if us - last.get(k, -(10**12)) > gap_s * 1_000_000:
            last[k] = us
            want.append((k, us, seq))
    assert got == sorted(want) and sum(k == "busy" for k, *_ in got) > 10


def test_detector_with_one_busy_key(spark):
    """A key with nine tenths of the rows: each alert has the rows of its own burst or window, and missing fields count as empty."""
    from pyspark.sql import functions as F

    from wardlight.plans.detector import Detector
    from wardlight.plans.rules import EventRule, StateRule

    rows = [("auth_failure" if i % 3 else "auth_success", 1_000_000 * (i + 100 * (i // 50)), i, None, f"u{i % 7}", "8.8.8.8" if i % 10 else f"9.9.9.{i % 50}", None, 0, None, f"line {i}", None, None, None) for i in range(1500)]
    events = spark.createDataFrame(rows, "kind string, us long, seq long, host string, user string, src_ip string, dst_ip string, dst_port int, query string, raw string, source string, command string, bytes long").repartition(5)
    rules = [
        StateRule({"id": "A", "type": "threshold", "match": {"kind": "auth_failure"}, "count": 20, "window": 60}), StateRule({"id": "B", "type": "distinct", "distinct": "user", "match": {"kind": "auth_failure"}, "count": 5, "window": 20}),
        StateRule({"id": "C", "type": "sequence", "match": {"kind": "auth_success"}, "preceded_by": {"match": {"kind": "auth_failure"}, "count": 5}, "window": 30}),
    ]
    single = [EventRule({"name": "D", "logsource": {"service": "sudo"}, "detection": {"x": {"command": None}, "condition": "x"}})]
    both = events.union(events.where("seq = 7").withColumns({"kind": F.lit("sudo"), "seq": F.lit(9999).cast("long"), "src_ip": F.lit(None).cast("string")}))
    got = Detector(single, rules).run(both).collect()
    assert sum(x["rule_id"] == "D" for x in got) == 1
    busy = [(x[1], x[2], x[0], x[4]) for x in sorted(rows, key=lambda x: (x[1], x[2])) if x[5] == "8.8.8.8"]
    for x in got:
        if x["src_ip"] == "8.8.8.8" and x["rule_id"] != "D":
            inside = [b for b in busy if x["first_us"] <= b[0] <= x["last_us"]]
            fails = sum(k == "auth_failure" for *_, k, _ in inside)
            assert x["count"] == (fails + 1 if x["rule_id"] == "C" else fails) and len(x["evidence"]) == 3, x
    assert {x["rule_id"] for x in got if x["src_ip"] == "8.8.8.8"} == {"A", "B", "C"}
    assert sum(x["rule_id"] == "A" and x["src_ip"] == "8.8.8.8" for x in got) == 30
