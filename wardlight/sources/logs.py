"""Log files as one table of events, parsed by Spark functions alone."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.fields import EVENT, OPEN
from ..functions.net import let

#: Sources in the order that breaks ties of time, with their files; kinds by event number; names of the two senders.
FILES = {"auth": "auth.log", "sysmon": "sysmon.log", "firewall": "firewall.log", "apache": "apache_access.log"}
RANK = {s: i for i, s in enumerate(FILES)}
SYSMON_KINDS = {1: "process_create", 3: "network_connect", 10: "process_access", 11: "file_create", 22: "dns_query"}
WEB_HOST, FIREWALL_SENSOR = "web01", "fw01"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _parts(text: Column, by: str, use: Callable[[Callable[[int], Column]], Column], most: int = -1) -> Column:
    """``use`` of the parts of a text between separators, which are split once; a part beyond the last is null."""
    return let(F.split(text, by, most), lambda found: use(lambda i: F.get(found, F.lit(i))))


def _digits(c: Column) -> Column:
    return c.rlike(r"^\d+$")


def _after(text: Column, mark: str) -> Column:
    """What follows a mark, null without it."""
    return F.when(text.contains(mark), F.substring_index(text, mark, -1))


def _event(lines: DataFrame, **columns: Column) -> DataFrame:
    """The full event row; ``ok`` tells whether the line is one."""
    schema: StructType = _parse_datatype_string(EVENT)
    made = {f.name: columns.get(f.name, F.lit(None)).cast(f.dataType) for f in schema if f.name not in ("us", "raw", "seq")}
    for c in ("host", "user", "src_ip", "dst_ip"):
        made[c] = F.coalesce(made[c], F.lit(""))
    made["dst_port"] = F.coalesce(made["dst_port"], F.lit(0))
    return lines.select(*[made[f.name].alias(f.name) if f.name in made else F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != "raw"], F.col("value").alias("raw"), "at", *[c for c in ("block", OPEN) if c in lines.columns])


def _told(lines: DataFrame, event: Column, source: str) -> DataFrame:
    """Event rows from one struct of fields, null for a line that is none.  As a generator's row it is made once, also where rows are then kept by its fields."""
    lines = lines.select("*", F.explode(F.array(event)).alias("e"))
    return _event(lines, source=F.lit(source), **{f.name: F.col(f"e.{f.name}") for f in lines.schema["e"].dataType})


def parse_auth(lines: DataFrame, year: int | None = None, now: datetime | None = None, **_) -> DataFrame:
    """Sign-ins and sudo.  Lines have no year: it is ``year`` or the year of ``now``, and the one before if the date would lie two days ahead of ``now``."""
    moment = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp") if now else F.current_timestamp()
    this = F.year(moment)
    stated = F.lit(year).cast("int") if year else this
    who = lambda user, ip, method=None: F.struct(user.alias("user"), ip.alias("ip"), (method if method is not None else F.lit(None).cast("string")).alias("method"))

    def time(date: Column) -> Column:
        at = lambda y: F.try_to_timestamp(F.concat_ws(" ", y.cast("string"), date), F.lit("yyyy MMM d HH:mm:ss"))
        return let(at(stated), lambda t: F.when((stated == this) & (t > moment + F.expr("interval 2 days")), at(stated - 1)).otherwise(t))

    def signed_in(m: Column) -> list[Column]:
        """"Failed password for [invalid user] NAME from ADDRESS port N", "Invalid user NAME from ADDRESS", "Accepted METHOD for NAME from ADDRESS port N".
        Without a name a line tells of no sign-in."""
        tail = F.regexp_replace(F.coalesce(_after(m, "Failed password for "), _after(m, "Failed publickey for ")), "^invalid user ", "")
        failed = _parts(tail, " ", lambda w: F.when((w(0) != "") & (w(1) == "from") & (w(3) == "port") & _digits(w(4)), who(w(0), w(2))))
        invalid = _parts(_after(m, "Invalid user "), " ", lambda w: F.when((w(0) != "") & (w(1) == "from"), who(w(0), w(2))))
        known = lambda w: w(0).isin("password", "publickey", "keyboard-interactive/pam") & (w(1) == "for") & (w(2) != "") & (w(3) == "from") & (w(5) == "port") & _digits(w(6))
        return [failed, invalid, _parts(_after(m, "Accepted "), " ", lambda w: F.when(known(w), who(w(2), w(4), w(0))))]

    def ran(m: Column) -> Column:
        """"NAME : TTY=... ; PWD=... ; USER=... ; COMMAND=..."."""
        facts = F.substring_index(m, "COMMAND=", 1)
        fact = lambda k: F.nullif(F.regexp_extract(facts, rf"[\s;:]{k}=(\S+)", 1), F.lit(""))
        got = F.struct(_strip(F.substring_index(m, ":", 1)).alias("user"), fact("PWD").alias("pwd"), fact("USER").alias("target"), _strip(F.substring(m, F.instr(m, "COMMAND=") + 8, F.length(m))).alias("command"))
        return let(got, lambda x: F.when(m.contains("COMMAND=") & x["user"].rlike(r"^\S+$") & x["pwd"].isNotNull() & x["target"].isNotNull(), x))

    def event(p: Callable[[int], Column]) -> Column:
        headed = p(0).isin(*MONTHS) & p(1).rlike(r"^\d{1,2}$") & p(2).rlike(r"^\d\d:\d\d:\d\d$") & p(4).endswith(":")
        proc = F.regexp_replace(p(4), r"(\[\d+\])?:$", "")
        ssh = F.when(proc.startswith("sshd"), F.struct(*[c.alias(k) for k, c in zip("fia", signed_in(p(5)), strict=True)]))
        got = F.struct(time(F.concat_ws(" ", p(0), p(1), p(2))).alias("ts"), p(3).alias("host"), ssh.alias("ssh"), F.when(proc == "sudo", ran(p(5))).alias("sudo"))
        return F.when(headed, let(got, told))

    def told(x: Column) -> Column:
        first = F.coalesce(x["ssh"]["f"], x["ssh"]["i"], x["ssh"]["a"])
        wrong = F.coalesce(x["ssh"]["f"], x["ssh"]["i"]).isNotNull()
        kind = F.when(wrong, "auth_failure").when(first.isNotNull(), "auth_success").when(x["sudo"].isNotNull(), "sudo")
        unknown = F.when(x["ssh"]["f"].isNull() & x["ssh"]["i"].isNotNull(), F.lit(True))
        columns = {"ts": x["ts"], "kind": kind, "host": x["host"], "user": F.coalesce(first["user"], x["sudo"]["user"]), "src_ip": first["ip"], "service": F.when(x["ssh"].isNotNull(), "ssh"), "method": F.when(~wrong, first["method"])}
        columns |= {"invalid_user": unknown, "target_user": x["sudo"]["target"], "command": x["sudo"]["command"], "pwd": x["sudo"]["pwd"]}
        return F.struct(*[c.alias(k) for k, c in columns.items()])

    return _told(lines, _parts(_strip(F.col("value")), r"\s+", event, 6), "auth")


def parse_sysmon(lines: DataFrame, **_) -> DataFrame:
    """``time;event id;type;key=value;...``; of a key that comes twice the later value holds."""
    # from the last to the first, so that the first of a name holds
    pairs = lambda rest: F.reverse(F.filter(F.split(F.coalesce(rest, F.lit("")), r";(?=[A-Za-z]\w*=)"), lambda p: p.contains("=")))
    names = lambda found: F.transform(found, lambda p: _strip(F.substring_index(p, "=", 1)))

    def time(first: Column) -> Column:
        exact = lambda stamp: stamp.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$")
        micros = lambda stamp: F.rpad(F.substring_index(stamp, ".", -1), 6, "0").try_cast("long")
        at = lambda stamp: F.timestamp_micros(F.unix_micros(F.try_to_timestamp(F.substring_index(stamp, ".", 1), F.lit("yyyy-M-d H:m:s"))) + micros(stamp))
        return let(F.regexp_replace(_strip(first), " UTC", ""), lambda stamp: F.when(exact(stamp), at(stamp)))

    def told(parts: Column, found: Column, known: Column) -> Column:
        value = lambda k: let(F.get(found, (F.array_position(known, k) - 1).cast("int")), lambda p: _strip(F.substring(p, F.instr(p, "=") + 1, F.length(p))))
        full = lambda k: F.nullif(value(k), F.lit(""))
        number = F.element_at(F.split(_strip(F.get(parts, 1)), r"\s+"), -1).try_cast("int")
        kinds = F.create_map(*[F.lit(x) for kv in SYSMON_KINDS.items() for x in kv])
        columns = {"ts": F.when(F.size(parts) >= 3, time(F.get(parts, 0))), "kind": F.element_at(kinds, number), "event_id": number, "host": value("Computer"), "user": value("User"), "src_ip": value("SourceIp"), "dst_ip": value("DestinationIp")}
        columns |= {"dst_port": let(value("DestinationPort"), lambda p: F.when(p.rlike(r"^\d+$"), p.try_cast("int"))), "image": F.nullif(F.coalesce(value("Image"), value("SourceImage")), F.lit("")), "parent_image": full("ParentImage")}
        columns |= {"command_line": full("CommandLine"), "target_image": full("TargetImage"), "granted_access": full("GrantedAccess"), "target_filename": full("TargetFilename"), "query": full("QueryName"), "protocol": full("Protocol")}
        return F.struct(*[c.alias(k) for k, c in columns.items()])

    event = let(F.split(_strip(F.col("value")), ";", 4), lambda parts: let(pairs(F.get(parts, F.lit(3))), lambda found: let(names(found), lambda known: told(parts, found, known))))
    return _told(lines, event, "sysmon")


def parse_firewall(lines: DataFrame, **_) -> DataFrame:
    """``DATE TIME ACTION PROTOCOL ADDRESS:PORT -> ADDRESS:PORT`` and further facts, of which BYTES=N is read."""

    def event(p: Callable[[int], Column]) -> Column:
        good = p(2).isin("ACCEPT", "ALLOW", "DROP", "DENY", "REJECT") & p(3).rlike(r"^\w+$") & p(4).rlike(r"^[\d.]+:\d+$") & (p(5) == "->") & p(6).rlike(r"^[\d.]+:\d+")
        size = F.regexp_extract(F.coalesce(p(7), F.lit("")), r"BYTES=(\d+)", 1)
        columns = {
            "ts": F.try_to_timestamp(F.concat_ws(" ", p(0), p(1)), F.lit("yyyy-MM-dd HH:mm:ss")), "kind": F.when(p(2).isin("ACCEPT", "ALLOW"), "fw_allow").otherwise("fw_deny"), "src_ip": F.substring_index(p(4), ":", 1),
            "dst_ip": F.substring_index(p(6), ":", 1), "dst_port": F.regexp_extract(p(6), r":(\d+)", 1).try_cast("int"), "protocol": F.lower(p(3)), "bytes": F.coalesce(size.try_cast("long"), F.lit(0)), "action": F.lower(p(2)), "sensor": F.lit(FIREWALL_SENSOR),
        }
        return F.when(good, F.struct(*[c.alias(k) for k, c in columns.items()]))

    return _told(lines, _parts(_strip(F.col("value")), r"\s+", event, 8), "firewall")


def parse_web(lines: DataFrame, host: str = WEB_HOST, **_) -> DataFrame:
    """The combined log format: ``client identity user [time] "METHOD target protocol" status size``, then ``"referer" "agent"`` if they are there, one space apart.

    A target has no white space, but may have quotes: where it ends, only what follows tells."""

    def told(x: Column) -> Column:
        """After the target: the rest of the request up to its quote, status and size.  A quote that ends the target is the request's if none follows."""
        sent, rest, target = r"^ \d{3} (\d+|-)", x["rest"], x["target"]
        quote = F.instr(rest, '"')
        after = F.when(quote > 0, F.substring(rest, quote + 1, F.length(rest)))
        ends = target.endswith('"') & rest.rlike(sent)
        first = F.coalesce(after.rlike(sent), F.lit(False))
        found = F.struct(F.when(first, target).when(ends, F.substring(target, F.lit(1), F.length(target) - 1)).alias("url"), F.when(first, after).when(ends, rest).alias("after"))
        return let(found, lambda f: event(x, f["url"], f["after"]))

    def event(x: Column, url: Column, after: Column) -> Column:
        mark, size, agent = F.instr(url, "?"), F.regexp_extract(after, r"^ \d{3} (\d+|-)", 1), F.regexp_extract(after, r'^ \d{3} \S+ "[^"]*" "([^"]*)"', 1)
        good = (x["ip"] != "") & (x["identity"] != "") & (x["user"] != "") & x["method"].rlike("^[A-Z]+$") & (url != "")
        columns = {
            "ts": F.try_to_timestamp(x["time"], F.lit("d/MMM/yyyy:HH:mm:ss Z")), "kind": F.lit("http_request"), "host": F.lit(host), "user": F.when(x["user"] != "-", x["user"]), "src_ip": x["ip"], "method": x["method"], "url": url,
            "uri_path": F.substring_index(url, "?", 1), "uri_query": F.when(mark > 0, F.substring(url, mark + 1, F.length(url))).otherwise(""), "status": F.substring(after, 2, 3).try_cast("int"), "bytes": F.coalesce(size.try_cast("long"), F.lit(0)),
            "user_agent": F.nullif(agent, F.lit("")),
        }
        return F.when(good, F.struct(*[c.alias(k) for k, c in columns.items()]))

    def asked(x: Column) -> Column:
        """From the time's bracket on: time, method, target, rest."""
        close = F.instr(x["rest"], '] "')
        time = F.substring(x["rest"], F.lit(2), close - 2)
        request = F.substring(x["rest"], close + 3, F.length(x["rest"]))
        method = F.substring_index(request, " ", 1)
        tail = F.substring(request, F.length(method) + 2, F.length(request))
        target = F.regexp_extract(tail, r"^\S+", 0)
        got = F.struct(x["ip"], x["identity"], x["user"], time.alias("time"), method.alias("method"), target.alias("target"), F.substring(tail, F.length(target) + 1, F.length(tail)).alias("rest"))
        return F.when(x["rest"].startswith("[") & (close > 2) & ~time.contains("]"), let(got, told))

    fields = lambda p: let(F.struct(p(0).alias("ip"), p(1).alias("identity"), p(2).alias("user"), p(3).alias("rest")), asked)
    return _told(lines, _parts(_strip(F.col("value")), " ", fields, 4), "apache")


#: Add a source here: from lines (value, at) to event rows.
PARSERS: dict[str, Callable[..., DataFrame]] = {"auth": parse_auth, "sysmon": parse_sysmon, "firewall": parse_firewall, "apache": parse_web}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, valid UTF-8, with the place that orders them in their file."""
    raw = spark.read.text(path).select(F.make_valid_utf8("value").alias("value"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"))
    return raw.where(F.trim(F.regexp_replace("value", r"\s", "")) != "")


def parse(lines: DataFrame, source: str, **options) -> DataFrame:
    """Events and skipped lines (``ok`` is false).  What a parser of one's own knows beyond the columns of an event it gives in the column OPEN, which rules reach by name."""
    rows = PARSERS[source](lines, **options)
    if OPEN not in rows.columns:
        rows = rows.withColumn(OPEN, F.lit(None).cast("variant"))
    return rows.withColumn("ok", F.col("ts").isNotNull() & F.col("kind").isNotNull()).withColumn("us", F.unix_micros("ts"))


def with_seq(rows: DataFrame) -> DataFrame:
    """Adds ``seq``, which orders rows of one time by source and line.

    It is packed from the source's rank and the line's place, so no rank over all events is needed.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("source"))
    return rows.withColumn("seq", F.coalesce(rank, F.lit(len(RANK))).cast("long") * F.lit(1 << 58) + F.col("at.n"))


def samples(rows: DataFrame) -> DataFrame:
    """source and the first three skipped lines, 120 characters each; only lines that are none are read where rows are kept by ``ok``."""
    line = F.substring(_strip(F.col("raw")), 1, 120)
    few = rows.where("not ok").select("source", line.alias("line"), F.row_number().over(Window.partitionBy("source").orderBy("at")).alias("n")).where("n <= 3")
    return few.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("samples"))


def counted(rows: DataFrame, watch: Observation | str, sources: list[str] | None = None) -> DataFrame:
    """``rows`` unchanged; as they pass, whatever becomes of them, their lines are counted by source.  A batch gives an Observation, to be read after its one
    action; a stream a name, under which each micro-batch's counts stand in its progress."""
    of = lambda s: F.col("source") == s
    metrics = [m for s in sources or PARSERS for m in (F.count_if(of(s)).alias(f"total:{s}"), F.count_if(of(s) & F.col("ok")).alias(f"parsed:{s}"))]
    return rows.observe(watch, *metrics)


def stats_of(counts: dict[str, int], rows: DataFrame) -> DataFrame:
    """As ``parse_stats``, from what ``counted`` saw; ``rows`` are read for the samples alone."""
    seen = [(k[6:], n, counts[f"parsed:{k[6:]}"], n - counts[f"parsed:{k[6:]}"]) for k, n in counts.items() if k.startswith("total:") and n]
    table = rows.sparkSession.createDataFrame(seen, "source string, total long, parsed long, skipped long")  # a row a source
    return table.join(samples(rows), "source", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def parse_stats(rows: DataFrame) -> DataFrame:
    """source, total, parsed, skipped and the first three skipped lines, 120 characters each."""
    count = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("skipped"))
    return count.join(samples(rows), "source", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_rows(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Lines of the known files in a folder (absent ones are left out), parsed, with ``ok`` and ``at``."""
    found = [parse(read_lines(spark, p), s, **options) for s, f in FILES.items() if exists(spark, p := os.path.join(folder, f))]
    if not found:
        raise FileNotFoundError(f"no log files in {folder}")
    return reduce(DataFrame.unionByName, found)


def events_of(rows: DataFrame) -> DataFrame:
    return with_seq(rows.where("ok")).drop("ok", "at")


def read_directory(spark: SparkSession, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    """Events of a folder's files, and parse statistics."""
    rows = read_rows(spark, folder, **options)
    return events_of(rows), parse_stats(rows)
