"""Needles by an index of grams and lists by a join, against plain comparison."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardlight.functions.predicates import RuleError, condition, leaf, selection
from wardlight.operators.lineage import cut
from wardlight.operators import needles as N
from wardlight.operators.needles import counted, existence, found, within_bound
from wardlight.plans.detector import Detector
from wardlight.plans.marks import large, marked
from wardlight.plans.rules import EventRule, StateRule
from wardlight.sources.context import Environment

TEXTS = ["The quick brown fox", "the QUICK brown dog\nand a (cat).*", "", None, "aaaaaaaaaa", "ÄÖÜ straße 中文字", "x", "ab", "quick", "🙂🙂smile🙂 face"]
NEEDLES = ["quick", "QUICK brown", "the", "t", "", "aaaa", "aaaaa", ".*", "(cat).*", "dog\nand", "äöü", "中文", "zzzz", "quickest", "🙂smile", "ab", "fox", None, "quick"]


@pytest.mark.parametrize("where", ["contains", "startswith", "endswith"])
@pytest.mark.parametrize("most", [0, 1 << 20])
def test_needles(spark, where, most):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("gram", F.lit(1))
    needles = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    got = found(rows, "id", "text", needles, where, most=most).collect()
    test = {"contains": lambda t, n: n in t, "startswith": str.startswith, "endswith": str.endswith}[where]
    want = {(i, n.lower()) for i, t in enumerate(TEXTS) for n in NEEDLES if t is not None and n is not None and test(t.lower(), n.lower())}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_random_needles(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abc ") for _ in range(r.randrange(120))) for _ in range(150)]
    needles = ["".join(r.choice("abc ") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = found(rows, "id", "text", table)
    assert set(map(tuple, got.collect())) == {(i, n) for i, t in enumerate(texts) for n in needles if n in t}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbers_of_needles(spark, monkeypatch):
    """Many slices and needles longer than their keys; keys that come twice."""
    monkeypatch.setattr(N, "KEY", 3)
    monkeypatch.setattr(N, "LEAST_BYTES", 50)
    r = random.Random(7)
    texts = ["".join(r.choice("ab\0é🙂") for _ in range(r.randrange(40))) for _ in range(60)]
    needles = ["".join(r.choice("ab\0é🙂") for _ in range(r.randrange(8))) for _ in range(300)] + [texts[5], texts[5] + "a"]
    rows = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id long, text string")
    for where, test in (("contains", lambda t, n: n in t), ("startswith", str.startswith), ("endswith", str.endswith)):
        want = {}
        for i, t in enumerate(texts):
            want[i // 2] = want.get(i // 2, 0) + sum(test(t, n) for n in set(needles))
        got = counted(rows, "id", "text", spark.createDataFrame([(n,) for n in needles], "needle string"), where)
        assert sorted(map(tuple, got.collect())) == sorted((k, n) for k, n in want.items() if n)


def test_a_slice_meets_no_needles_of_others(spark, monkeypatch):
    """A thousand needles that share all grams of their first characters: slices get those alone that begin with one of their pieces."""
    monkeypatch.setattr(N, "LEAST_BYTES", 1000)
    near = []
    walk = N._walk
    monkeypatch.setattr(N, "_walk", lambda edge, pairs: (lambda t, n: pa.table({"key": pa.array([n.num_rows]), "n": pa.array([t.num_rows])}) if near else walk(edge, pairs)(t, n)))
    texts = [f'<a href="/page/{i:04d}">' for i in range(1000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    needles = spark.createDataFrame([(t[:-2],) for t in texts], "needle string")
    for where in ("contains", "startswith"):
        near.clear()
        assert {r["n"] for r in N._searched(rows, "id", "text", needles, where, N.BROADCAST_BYTES, False).collect()} == {1}
        near.append(where)
        met = N._searched(rows, "id", "text", needles, where, N.BROADCAST_BYTES, False).collect()
        assert len(met) > 10 and all(r["key"] == r["n"] for r in met)


def test_one_beginning_or_end_of_all(spark):
    """Addresses that all begin and end alike are dealt to many tasks, none of which gets all."""
    rows = spark.range(6000).select("id", F.format_string("https://host%05d.example/same", "id").alias("url"))
    needles = rows.select(F.expr("case id % 3 when 0 then substr(url, 1, 13) when 1 then substr(url, -20) else 'https://' end").alias("needle"))
    for where in ("startswith", "endswith"):
        got = counted(rows, "id", "url", needles, where)
        firsts = {f"https://host{i:05d}"[:13] for i in range(0, 6000, 3)} | {"https://"}
        lasts = {f"https://host{i:05d}.example/same"[-20:] for i in range(1, 6000, 3)}
        want = {i: sum((u[:13] in firsts, u[:8] in firsts)) if where == "startswith" else int(u[-20:] in lasts) for i in range(6000) for u in [f"https://host{i:05d}.example/same"]}
        assert dict(map(tuple, got.collect())) == {k: n for k, n in want.items() if n}
    met = N._searched(rows, "id", "url", needles, "startswith", N.BROADCAST_BYTES, False).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(met) > 1 and max(r["count"] for r in met) < 6000


def test_side_is_broadcast_only_within_its_bound(spark):
    t = spark.createDataFrame([("x" * 100,)] * 50, "v string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(within_bound(t, "v", 10_000)) and not hinted(within_bound(t, "v", 5_000))
    rows = spark.range(10).select(F.col("id").cast("string").alias("a"))
    got = existence(rows, F.col("a"), spark.createDataFrame([("3",), ("3",), (None,)], "value string"), "m", most=0)
    assert [r["a"] for r in got.where("m").collect()] == ["3"] and got.count() == 10


EVENT = "seq long, us long, kind string, host string, user string, src_ip string, dst_ip string, dst_port int, query string, bytes long, command string, raw string"


#: So many values are large in these tests.
MANY = 5


def events(spark, n=400):
    rows = [(i, i * 1_000_000, "sudo" if i % 2 else "auth_failure", "h", "u", "hot" if i % 3 else f"10.0.{i % 7}.{i % 5}", "", 0, "", i, f"run tool{i % 40:03d} --fast", f"line {i}") for i in range(n)]
    return spark.createDataFrame(rows, EVENT)


def test_marks_are_what_leaves_are(spark):
    """Every kind of large leaf, alone and in conditions, against the same leaf as a condition."""
    e = events(spark)
    wants = [f"TOOL{i:03d}" for i in range(0, 40, 3)] + [f"none{i}" for i in range(MANY)]
    addresses = {"few": ["10.0.1.1"], "many": [f"10.0.{i % 3}.{i}" for i in range(MANY + 5)] + ["HOT"]}
    sels = {
        "a": {"command|contains": wants}, "b": {"command|startswith": [f"run {w}" for w in wants]}, "c": {"command|endswith": [f"{w} --fast" for w in wants]}, "d": {"src_ip|in_list": "many", "kind": "sudo"},
        "e": {"src_ip|in_list": ["few", "many"]}, "f": [{"command|contains|all": ["run", *["tool"] * (MANY + 1)]}, {"query|contains": wants}],
    }
    rows, marks = marked(e, list(sels.values()), addresses, many=MANY)
    assert len(marks) == 7 and len(large(list(sels.values()), addresses, MANY)) == 7
    assert "tool" not in rows._jdf.queryExecution().optimizedPlan().toString()  # no needle stands in the plan
    rows = cut(rows)
    for text in (*sels, "a and not d", "1 of a* or e", "not b"):
        with_marks = rows.where(condition(text, {n: selection(s, addresses, rows.columns, marks=marks) for n, s in sels.items()}))
        plain = e.where(condition(text, {n: selection(s, addresses, e.columns) for n, s in sels.items()}))
        assert {r["seq"] for r in with_marks.collect()} == {r["seq"] for r in plain.collect()}, text


def test_a_list_of_a_million_rows(spark, tmp_path):
    spark.range(1_000_000).select(F.concat(F.lit("10.0."), (F.col("id") % 7).cast("string"), F.lit("."), F.col("id").cast("string"))).write.text(str(tmp_path / "list"))
    env = Environment({"lists": {"big": {"file": str(tmp_path / "list")}, "small": ["HOT"]}})
    lists = env.known(spark)
    with pytest.raises(RuleError, match="needs marks"):
        leaf("src_ip|in_list", "big", lists)
    single = EventRule({"name": "S", "level": "high", "logsource": {"service": "sudo"}, "detection": {"s": {"src_ip|in_list": "big"}, "condition": "s"}})
    state = StateRule({"id": "T", "severity": "high", "type": "threshold", "match": {"kind": "auth_failure"}, "exclude": {"src_ip|in_list": "big"}, "group_by": "src_ip", "count": 3, "window": 60})
    got = Detector([single], [state], lists, cooldown_s=1).run(events(spark)).collect()
    listed = {f"10.0.{i % 7}.{i % 5}" for i in range(400) if i % 3 == 0 and i % 7 == i % 5}
    singles = [r for r in got if r["rule_id"] == "S"]
    assert {r["src_ip"] for r in singles} <= {a for a in (f"10.0.{i % 7}.{i}" for i in range(5)) if a in listed} and singles
    assert {r["src_ip"] for r in got if r["rule_id"] == "T"} >= {"hot"} and not {r["src_ip"] for r in got if r["rule_id"] == "T"} & {r["src_ip"] for r in singles}
