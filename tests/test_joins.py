"""Joins by time, by interval and by network, and open fields, against loops over all pairs."""

import ipaddress
import json
import random

from pyspark.sql import functions as F

from wardlight.functions.fields import event_json, resolve
from wardlight.functions.predicates import selection
from wardlight.operators.asof import as_of
from wardlight.operators.networks import bits_of, longest_match
from wardlight.operators.overlaps import overlapping
from wardlight.plans.detector import Detector
from wardlight.plans.rules import EventRule
from wardlight.sources import logs


def keys(r):
    return "hot" if r.random() < 0.9 else r.choice(["a", "b", None])


def test_as_of(spark):
    """Nine of ten rows have one key; times are often equal."""
    r = random.Random(1)
    left = [(keys(r), r.randrange(0, 3000) if r.random() < 0.98 else None, f"l{i}") for i in range(400)]
    right = [(keys(r), r.randrange(0, 3000, 3), i, f"r{i}") for i in range(300)]
    got = as_of(spark.createDataFrame(left, "k string, us long, seq string").repartition(3), spark.createDataFrame(right, "k string, us long, seq long, v string").repartition(3), ["k"], 100)
    want = []
    for k, us, name in left:
        before = [(t, s, v) for q, t, s, v in right if k is not None and us is not None and q == k and t <= us]
        want.append((name, max(before) if before else None))
    assert sorted(((x["seq"], x["last"] and tuple(x["last"])) for x in got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w is not None for _, w in want) > 300
    empty = spark.createDataFrame([], "k string, us long, seq long, v string")
    assert all(x["last"] is None for x in as_of(spark.createDataFrame(left, "k string, us long, seq string"), empty, ["k"], 100).collect())
    wide = got.groupBy("k").count().where("k = 'hot'").first()["count"]
    assert wide == sum(k == "hot" for k, *_ in left)


def test_overlaps(spark):
    """Short and very long intervals, points, ends that touch, and one key with most rows."""
    r = random.Random(2)

    def some(n, name):
        out = []
        for i in range(n):
            s = r.randrange(0, 100_000)
            out.append((keys(r), s, s + r.choice((0, 0, 5, 50, 3000, 60_000, -1)), f"{name}{i}"))
        return out

    left, right = some(150, "l"), [*some(150, "r"), ("a", None, 5, "n"), ("a", 5, None, "m")]
    schema = "k string, start_us long, end_us long, name string"
    got = overlapping(spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(3), ["k"], 10).select("k", "l.name", F.col("r.name").alias("o")).collect()
    want = {(k, a, b) for k, s, e, a in left for q, t, u, b in right if k is not None and k == q and None not in (t, u) and s <= e and t <= u and s <= u and t <= e}
    assert len(got) == len(want) and set(map(tuple, got)) == want and len(want) > 1000
    assert overlapping(spark.createDataFrame([], schema), spark.createDataFrame(right, schema), ["k"]).count() == 0


NETS = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3", "10.1.2.3/32", "0.0.0.0/0", "2001:db8::/32", "2001:db8:1::/48", "2001:db8:1::9", "::/0", "none", "1.2.3.4/33", "10.9.9.9/x", None, "10.1.0.0/16"]


def test_longest_prefix(spark):
    r = random.Random(3)
    ips = ["10.1.2.3", "10.1.2.4", "10.1.9.9", "10.200.0.1", "8.8.8.8", "2001:DB8:1::9", "2001:db8:1:5::1", "2001:db8:ffff::1", "fe80::1", "x", "", None, "::ffff:10.1.2.3"] + [f"10.{r.randrange(3)}.{r.randrange(4)}.{r.randrange(5)}" for _ in range(100)]
    rows = spark.createDataFrame(list(enumerate(ips)), "n long, ip string")
    nets = spark.createDataFrame([(n, f"about {n}") for n in NETS], "net string, about string")
    known = [n for n in NETS if n and n not in ("none", "1.2.3.4/33", "10.9.9.9/x")]

    def best(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None
        held = [n for n in known if a.version == ipaddress.ip_network(n).version and a in ipaddress.ip_network(n)]
        return min(held, key=lambda n: (-ipaddress.ip_network(n).prefixlen, f"{n}"), default=None)

    for most in (0, 1 << 20):
        got = {x["n"]: x["network"] for x in longest_match(rows, "ip", nets, "net", most=most).collect()}
        assert len(got) == len(ips)
        for n, ip in enumerate(ips):
            want = best(ip) if ip else None
            assert (got[n] and got[n]["net"]) == want, ip
    assert spark.range(1).select(bits_of(F.lit("10.0.0.1")).alias("b")).first()["b"] == "4" + f"{int(ipaddress.ip_address('10.0.0.1')):032b}"


def test_networks_in_lists(spark):
    rows = spark.createDataFrame([(i, i, "sudo", "h", "u", ip, "", 0, "", "") for i, ip in enumerate(["10.1.2.3", "10.2.0.1", "9.9.9.9", "", "2001:db8::5"])], "seq long, us long, kind string, host string, user string, src_ip string, dst_ip string, dst_port int, query string, raw string")
    rule = EventRule({"name": "S", "logsource": {"service": "sudo"}, "detection": {"s": {"src_ip|in_list": "nets"}, "condition": "not s"}})
    got = Detector([rule], [], {"nets": ["10.1.0.0/16", "9.9.9.9", "2001:DB8::/32"]}, 1).run(rows).collect()
    assert sorted(x["src_ip"] for x in got) == ["", "10.2.0.1"]


def test_a_source_with_fields_of_its_own(spark, tmp_path, monkeypatch):
    """A parser of one's own gives a field that no event has: rules see it, files keep it, and JSON shows it."""

    def parse_door(lines, **_):
        x = F.split("value", " ")
        more = F.to_variant_object(F.struct(F.get(x, 2).alias("door"), F.try_to_number(F.get(x, 3), F.lit("999")).cast("int").alias("tries")))
        return logs._event(lines.withColumn("more", more), ts=F.try_to_timestamp(F.get(x, 0)), source=F.lit("door"), kind=F.lit("sudo"), user=F.get(x, 1))

    monkeypatch.setitem(logs.PARSERS, "door", parse_door)
    monkeypatch.setitem(logs.FILES, "door", "door.log")
    (tmp_path / "door.log").write_text("2026-03-10T08:00:00 amy North 3\n2026-03-10T08:00:01 bob south 12\nbad\n")
    (tmp_path / "firewall.log").write_text("2026-03-10 08:00:00 DENY UDP 1.1.1.1:5 -> 1.2.3.4:53\n")
    rows = logs.read_rows(spark, str(tmp_path))
    rows.write.partitionBy("ok", "kind").parquet(str(tmp_path / "kept"))
    events = logs.events_of(spark.read.schema(rows.schema).parquet(str(tmp_path / "kept")))
    for sel, users in (({"Door": "NORTH"}, {"amy"}), ({"tries|gt": 5}, {"bob"}), ({"door|contains": ["orth", "south"]}, {"amy", "bob"}), ({"nothing": None}, {"amy", "bob", ""}), ({"door": None}, {""})):
        assert {x["user"] for x in events.where(selection(sel, {}, events.columns)).collect()} == users, sel
    rule = EventRule({"name": "D", "level": "high", "logsource": {"service": "sudo"}, "detection": {"s": {"door": "south", "tries": 12}, "condition": "s"}})
    assert [x["user"] for x in Detector([rule], []).run(events).collect()] == ["bob"]
    shown = [json.loads(x[0]) for x in events.orderBy("source").select(event_json(events.columns)).collect()]
    bob = next(x for x in shown if x["user"] == "bob")
    assert (bob["door"], bob["tries"], bob["source"], bob["kind"], bob["ts"]) == ("south", 12, "door", "sudo", "2026-03-10T08:00:01.000000Z")
    wall = next(x for x in shown if x["source"] == "firewall")
    assert wall["bytes"] == 0 and wall["dst_ip"] == "1.2.3.4" and "door" not in wall and "image" not in wall
    stats = {x["source"]: (x["total"], x["skipped"]) for x in logs.parse_stats(rows).collect()}
    assert stats == {"door": (3, 1), "firewall": (1, 0)}
    assert resolve("door", [c for c in events.columns if c != "more"])._jc.toString().startswith("CAST(NULL")
