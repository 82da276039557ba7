"""Selections, conditions and the bundled rules."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wardlight.__main__ import main
from wardlight.functions.net import PRIVATE, PRIVATE_6, PUBLIC_WITHIN, PUBLIC_WITHIN_6, RESERVED_6, is_public
from wardlight.functions.predicates import RuleError, condition, leaf, selection
from wardlight.plans.detector import Detector, indicators_of
from wardlight.plans.export import to_spark_sql, to_spl
from wardlight.plans.rules import EventRule, StateRule, load_rules, load_sigma, tactic_of, technique_of

SCHEMA = "host string, user string, dst_ip string, dst_port int, image string, command_line string, uri_query string, status int, bytes long, invalid_user boolean, zero string"


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([("WS-1", "", "10.0.0.5", 0, r"C:\Tools\Cmd.exe", "whoami /priv\nnext", "", 404, 0, True, "0")], SCHEMA)


LISTS = {"known": ["10.0.0.5"], "people": ["bob"]}


@pytest.mark.parametrize(
    ("name", "want", "hit"),
    [
        ("host", "ws-1", True), ("host", ["x", "WS-1"], True), ("Computer", "WS-1", True), ("host", "ws*", True), ("host", "w?-[0-9]", True), ("host", "w?-[0-9]*", True), ("host", "*1*", True), ("host", "s-*", False),
        ("user", None, True), ("host", None, False), ("nothing", None, True), ("nothing", "x", False), ("nothing|contains", "", False), ("dst_port", 0, False), ("dst_port", None, True), ("bytes", 0, True),
        ("status", 404, True), ("status", "404", True), ("status|gte", 400, True), ("status|gt", 404, False), ("status|lt", "500", True), ("status|lte", [500], False), ("host|gt", 3, False),
        ("image|endswith", r"\cmd.exe", True), ("image|startswith", "c:\\", True), ("command_line|contains", ["zzz", "WHOAMI"], True), ("command_line|contains|all", ["zzz", "whoami"], False), ("command_line|contains|all", ["/priv", "whoami"], True),
        ("command_line|re", "^WHO.mi", True), ("command_line|re", "priv.next", False), ("invalid_user", True, True), ("invalid_user", False, False), ("status", True, True), ("bytes", True, False), ("bytes", False, True), ("host", True, True), ("user", True, False), ("zero", True, True), ("nothing", False, False), ("dst_ip|is_public", False, True), ("dst_ip|is_public", True, False), ("nothing|is_public", False, True),
        ("dst_ip|in_list", "known", True), ("dst_ip|in_list", ["people", "known"], True), ("dst_ip|in_list", "unknown", False), ("uri_query", "", True), ("uri_query|contains", "", True), ("CommandLine|contains", "%", False),
    ],
)
def test_leaves(row, name, want, hit):
    c = leaf(name, want, LISTS, row.columns)
    assert row.select(c.alias("yes"), (~c).alias("no")).first() == (hit, not hit)


def test_selections(row):
    pick = lambda s: row.select(selection(s, LISTS, row.columns)).first()[0]
    assert pick({}) and not pick([]) and pick({"host": "ws-1", "status": 404}) and not pick({"host": "ws-1", "status": 1}) and pick([{"host": "x"}, {"status": 404}])
    for bad in ({"host|near": "x"}, "host"):
        with pytest.raises(RuleError):
            selection(bad)


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("yes", True), ("no", False), ("not no and yes", True), ("yes and not (no or yes)", False), ("no or yes and no", False), ("(no or yes) and yes", True), ("1 of sel_*", True), ("all of sel_*", False),
        ("all of them", False), ("1 of them", True), ("NOT no AND yes", True), ("not 1 of sel_n*", True), ("yes and null_one", False), ("yes and not null_one", True),
    ],
)
def test_conditions(row, text, hit):
    found = {"yes": F.lit(True), "no": F.lit(False), "sel_y": F.lit(True), "sel_n": F.lit(False), "null_one": selection({"nothing|contains": "x"})}
    assert row.select(condition(text, found)).first()[0] is hit


@pytest.mark.parametrize("text", ["yes and", "(yes", "yes no", "other", "1 of x*", "1 of", "", None, ["yes"], "yes)"])
def test_bad_conditions(spark, text):
    with pytest.raises(RuleError):
        condition(text, {"yes": F.lit(True), "no": F.lit(False)})


def test_addresses(spark):
    r = random.Random(4)
    edge = [a for n in map(ipaddress.ip_network, PRIVATE) for x in (n.network_address, n.broadcast_address) for a in (int(x) - 1, int(x), int(x) + 1) if 0 <= a < 1 << 32]
    ips = [str(ipaddress.ip_address(a)) for a in edge + [r.getrandbits(32) for _ in range(2000)]]
    inside = lambda a, nets: any(ipaddress.ip_address(a) in ipaddress.ip_network(n) for n in nets)
    got = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", is_public(F.col("ip"))).collect()
    assert all(p == (not inside(i, PRIVATE) or inside(i, PUBLIC_WITHIN)) for i, p in got)
    for i, want in {"203.0.113.9": True, "192.168.1.1": False, "256.1.1.1": False, "01.2.3.4": False, "x": False, "": False}.items():
        assert spark.createDataFrame([(i,)], "ip string").select(is_public(F.col("ip"))).first()[0] is want, i


def public_6(text):
    try:
        a = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return not (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved)


def test_ipv6_addresses(spark):
    r = random.Random(6)
    nets = [ipaddress.ip_network(n) for n in (*PRIVATE_6, *RESERVED_6, *PUBLIC_WITHIN_6, "::ffff:0:0/96")]
    edge = [a for n in nets for x in (n.network_address, n.broadcast_address) for a in (int(x) - 1, int(x), int(x) + 1) if 0 <= a < 1 << 128]
    numbers = edge + [r.getrandbits(128) for _ in range(300)] + [0xFFFF << 32 | r.getrandbits(32) for _ in range(200)]
    texts = [f(ipaddress.IPv6Address(n)) for n in numbers for f in (str, lambda a: a.exploded.upper())]
    texts += ["::", "::1", "1::", ":1", "1:", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7", "2606:4700:4700::1111", "2606:4700::12345", "fe80::1%eth0", "2606::1%a", "2606::1%", "2606::%1%2"]
    texts += ["::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:192.0.2.1", "::ffff:256.1.1.1", "64:ff9b::8.8.8.8", "1.2.3.4::", "::1.2.3.4:5", "2606:4700::g", "2606:4700:: ", "a:b"]
    got = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", is_public(F.col("ip"))).collect()
    assert {t: p for t, p in got} == {t: public_6(t) for t in texts}
    yes = leaf("dst_ip|is_public", True)
    assert spark.createDataFrame([("2606:4700:4700::1111",)], "dst_ip string").select(yes).first()[0] is True
    assert spark.createDataFrame([("2606:4700:4700::1111", "10.0.0.1", "8.8.8.8", "a.top")], "a string, b string, c string, d string").select(indicators_of(*map(F.col, "abcd"))).first()[0] == ["2606:4700:4700::1111", "8.8.8.8", "a.top"]


def test_tags():
    assert tactic_of("attack.command_and_control") == tactic_of("attack.Command-and-Control") == "Command and Control" and tactic_of("attack.t1059.001") is None and tactic_of("execution") is None
    assert technique_of("attack.t1059.001") == "T1059.001" and technique_of("attack.T1046") == "T1046" and technique_of("car.x") is None and technique_of("attack.impact") is None


RULE = """
title: Own rule {n}
id: 00000000-0000-0000-0000-00000000000{n}
level: {level}
logsource: {{category: process_creation, product: windows}}
detection:
  chosen: {{Image|endswith: '\\tool{n}.exe'}}
  condition: chosen
tags: [attack.execution, attack.t1204.002]
"""


def test_sigma_files_and_folders(row, tmp_path, capsys):
    (tmp_path / "b.yml").write_text(RULE.format(n=1, level="informational"))
    (tmp_path / "a.yaml").write_text(RULE.format(n=2, level="critical") + "---" + RULE.format(n=3, level="odd"))
    (tmp_path / "c.txt").write_text("no rule")
    rules = load_sigma(str(tmp_path))
    assert [(r.title, r.severity, r.tactic, r.technique, r.kind) for r in rules] == [(f"Own rule {n}", s, "Execution", "T1204.002", "process_create") for n, s in ((2, "critical"), (3, "medium"), (1, "low"))]
    assert load_sigma(str(tmp_path / "b.yml"))[0].id.endswith("01")
    e = row.withColumns({"kind": F.lit("process_create"), "image": F.lit(r"C:\x\TOOL1.exe")})
    assert e.select(*[r.column({}, e.columns) for r in rules]).first() == (False, False, True)
    single, stateful = load_rules(sigma=str(tmp_path))
    assert len(single) == 3 and len(stateful) == 8
    assert main(["rules", "--sigma", str(tmp_path)]) == 0 and "Own rule 3" in capsys.readouterr().out
    (tmp_path / "d.yml").write_text("title: x\nlogsource: {category: unheard_of}\n")
    with pytest.raises(RuleError, match="d.yml"):
        load_sigma(str(tmp_path))
    assert main(["rules", "--sigma", str(tmp_path)]) == 2


def test_bundled_rules(spark):
    event_rules, state_rules = load_rules()
    assert len(event_rules) == 12 and len(state_rules) == 8 and len(Detector(event_rules, state_rules).catalog()) == 20
    for bad in ({"logsource": {"category": "x"}}, {"logsource": {"service": "sudo"}, "detection": {"condition": "a"}}):
        with pytest.raises(RuleError):
            EventRule(bad)
    for bad in ({"id": "x", "type": "other"}, {"id": "x", "type": "beacon", "count": 1}, {"id": "x", "type": "sequence", "preceded_by": {"count": 0}}, {"id": "x", "type": "threshold", "severity": "odd"}):
        with pytest.raises(RuleError):
            StateRule(bad)


def test_searches(tmp_path, capsys):
    rules = {r.id: r for r in load_rules()[0]}
    text = to_spl(rules["IDT-SG-001"], "winlogs")
    assert text.startswith("index=winlogs ") and "EventCode=1\n| where " in text and text.endswith("| table _time, host, user, Image, CommandLine")
    assert r'(like(lower(Image), "%\\powershell.exe") OR like(lower(Image), "%\\pwsh.exe")) AND (like(lower(CommandLine), "% -enc %")' in text
    assert " AND NOT (" in to_spl(rules["IDT-SG-004"]) and "EventCode=10" in to_spl(rules["IDT-SG-004"])
    assert all(to_spl(r) for r in rules.values())
    odd = EventRule({"logsource": {"category": "webserver"}, "detection": {"a": [{"url": "x*y?"}, {"status|gte": 500, "user": None}], "b": {"url|re|all": ["A.c", 'q"']}, "condition": "1 of a or not all of them"}})
    assert to_spl(odd).split("where ")[1].split("\n")[0] == '((like(lower(url), "x%y_") OR (tonumber(status)>=500 AND (isnull(user) OR user=""))) OR NOT ((like(lower(url), "x%y_") OR (tonumber(status)>=500 AND (isnull(user) OR user=""))) AND (match(url, "(?i)A.c") AND match(url, "(?i)q\\""))))'
    with pytest.raises(RuleError):
        to_spl(EventRule({"logsource": {"category": "dns_query"}, "detection": {"a": {"dst_ip|is_public": True}, "condition": "a"}}))
    (tmp_path / "r.yml").write_text(RULE.format(n=1, level="low"))
    assert main(["sigma-to-spl", "--rule", str(tmp_path / "r.yml"), "--index", "i"]) == 0 and capsys.readouterr().out.startswith("index=i ")


def test_conditions_as_spark_sql(spark):
    """The text finds the rows that the column finds."""
    from wardlight.functions.fields import EVENT

    rows = spark.createDataFrame([], EVENT)
    made = [{"kind": "process_create", "image": r"C:\w\pwsh.exe", "command_line": "x -w hidden"}, {"kind": "process_create", "image": r"C:\w\pwsh.exe"}, {"kind": "process_access", "target_image": r"C:\lsass.exe", "granted_access": "0x1010"}, {"kind": "http_request", "url": "/a?q=' OR 1=1"}, {"kind": "dns_query", "query": "a.TOP"}]
    events = spark.createDataFrame([tuple(m.get(c) for c in rows.columns) for m in made], rows.schema)
    hits = 0
    for rule in load_rules()[0]:
        want = [bool(x[0]) for x in events.select(F.coalesce(rule.column({}, rows.columns), F.lit(False))).collect()]
        assert [x[0] for x in events.select(F.expr(to_spark_sql(rule, spark))).collect()] == want
        hits += sum(want)
    assert hits == 4


def test_sql_of_every_modifier(spark):
    """Texts that Spark reads again and that find the same rows; what has no text is an error."""
    from wardlight.functions.fields import EVENT

    rows = spark.createDataFrame([], EVENT)
    made = [{"kind": "process_create", "image": "C:\\A'b%_\"x.exe", "bytes": n, "src_ip": ip} for n, ip in ((5, "8.8.8.8"), (50, "10.0.0.1"), (None, ""))]
    events = spark.createDataFrame([tuple(m.get(c, "" if c in ("host", "user", "src_ip", "dst_ip") else None) for c in rows.columns) for m in made], rows.schema)
    wants = {"Image": "c:\\a'b%_\"x.exe", "Image|contains": ["'B%_", "none"], "Image|contains|all": ["b", "x"], "Image|startswith": "c:", "Image|endswith": ['"X.exe'], "Image|re": r"b%_.x\.exe$", "bytes|gt": 5, "bytes|gte": 5, "bytes|lt": 50, "bytes|lte": 50, "query": None, "image": "*b?_*", "src_ip|in_list": "l"}
    for name, want in wants.items():
        rule = EventRule({"name": "R", "logsource": {"category": "process_creation"}, "detection": {"s": {name: want}, "condition": "s"}})
        found = [bool(x[0]) for x in events.select(F.coalesce(rule.column({}, rows.columns), F.lit(False))).collect()]
        assert [x[0] for x in events.select(F.expr(to_spark_sql(rule, spark))).collect()] == found, name
    rule = EventRule({"name": "R", "logsource": {"category": "process_creation"}, "detection": {"s": {"src_ip|is_public": True}, "condition": "s"}})
    with pytest.raises(RuleError, match="no text"):
        to_spark_sql(rule, spark)
