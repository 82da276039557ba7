"""Streams give what batches give."""

import os
import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from wardlight.operators.bursts import SECOND, bursts
from wardlight.operators.correlation import correlate
from wardlight.operators.fused import Watch, watched
from wardlight.operators.sessions import sessions
from wardlight.streaming.detect import fold_stream, step, threshold_stream
from wardlight.streaming.incidents import Incidents, incident_stream
from wardlight.streaming.rules import Machine, late_rows, watch_stream

SCHEMA = "ts timestamp, key string"


def replay(spark, tmp_path, rows, make):
    """Rows in three files, read one a batch; a last row far ahead moves the watermark on."""
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        if i == 2:
            part = part + [(1e7, "end")]
        spark.createDataFrame(part, "s double, key string").select(F.col("s").cast("timestamp").alias("ts"), "key").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        name = next(p for p in os.listdir(tmp_path / f"w{i}") if p.endswith(".parquet"))
        os.rename(tmp_path / f"w{i}" / name, src / f"{i}.parquet")
        os.utime(src / f"{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = make(stream).writeStream.outputMode("append").format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        return spark.table("out").where("key <> 'end'").collect()
    finally:
        q.stop()


def sample(seed):
    r = random.Random(seed)
    rows = sorted((float(r.randrange(0, 4000, 2)), f"k{r.randrange(5)}") for _ in range(600))
    for i in range(0, len(rows) - 5, 5):  # a little out of order
        rows[i], rows[i + 3] = rows[i + 3], rows[i]
    return rows


def test_fold(spark, tmp_path):
    rows = sample(1)
    got = sorted((r["key"], int(r["first_seen"].timestamp()), int(r["last_seen"].timestamp()), r["n"]) for r in replay(spark, tmp_path, rows, lambda s: fold_stream(s, ["key"], 12, "200 seconds")))
    df = spark.createDataFrame([(k, int(s), i) for i, (s, k) in enumerate(rows)], "key string, us long, seq long")
    want = sessions(df, ["key"], 12).groupBy("key", "sid").agg(F.min("us"), F.max("us"), F.count(F.lit(1))).drop("sid").collect()
    assert got == sorted(map(tuple, want))


def test_threshold(spark, tmp_path):
    rows = sample(2)
    got = sorted(map(tuple, replay(spark, tmp_path, rows, lambda s: threshold_stream(s, 4, 20, "200 seconds"))))
    df = spark.createDataFrame([(k, int(s) * SECOND, i) for i, (s, k) in enumerate(rows)], "key string, us long, seq long")
    assert got == sorted((r["key"], r["first_us"], r["last_us"], r["n"]) for r in bursts(df, ["key"], 4, 20).collect())


def test_steps_in_parts():
    """However times are cut into steps, bursts are those of one step, and what is kept is bounded by the rule's count."""
    r = random.Random(9)
    for need in (1, 2, 5):
        times = sorted(r.randrange(3000) for _ in range(400))
        whole = step(times, [], None, need, 15)
        recent, burst, closed, at = [], None, [], 0
        while at < len(times):
            n = r.randrange(1, 40)
            recent, burst, more = step(times[at : at + n], recent, burst, need, 15)
            closed, at = closed + more, at + n
            assert len(recent) <= need
        assert (burst, closed) == whole[1:] and len(closed) > 3


WATCHES = [
    Watch("count", 4, 20 * SECOND), Watch("distinct", 3, 30 * SECOND), Watch("sum", 60, 25 * SECOND), Watch("sequence", 2, 40 * SECOND), Watch("beacon", 4, 300 * SECOND, 0.5, 2, 100), Watch("count", 1, 5 * SECOND),
]
TAGGED = "rule int, g string, ts timestamp, us long, seq long, v long, x string, p boolean"


def tagged_rows(seed, n=500):
    r = random.Random(seed)
    base = sorted((r.randrange(0, 4000) * SECOND, r.randrange(6), r.randrange(30), f"v{r.randrange(4)}" if r.random() < 0.9 else None, r.random() < 0.6) for _ in range(n))
    rows = [(rule, f"k{k}", datetime.fromtimestamp(us / 1e6, timezone.utc), us, i, v, x, p) for i, (us, k, v, x, p) in enumerate(base) for rule in range(len(WATCHES))]
    for i in range(0, len(rows) - 40, 31):  # out of order
        rows[i], rows[i + 37] = rows[i + 37], rows[i]
    return rows


def stream_of(spark, tmp_path, parts, schema):
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        name = next(p for p in os.listdir(tmp_path / f"w{i}") if p.endswith(".parquet"))
        os.rename(tmp_path / f"w{i}" / name, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_every_form_on_a_stream(spark, tmp_path):
    """A stream in four batches, out of order, finds what a batch over all rows finds; a row behind the watermark is counted."""
    rows = tagged_rows(11)
    far = datetime.fromtimestamp(1e6, timezone.utc)
    end = (0, "end", far, 10**12, 10**6, 0, None, False)
    late = (0, "k0", datetime.fromtimestamp(1, timezone.utc), SECOND, 10**6 + 1, 0, None, False)
    q = len(rows) // 3
    stream = stream_of(spark, tmp_path, [rows[:q], rows[q : 2 * q], [*rows[2 * q :], end], [late]], TAGGED)
    query = watch_stream(stream, WATCHES, "300 seconds").writeStream.outputMode("append").format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        got = spark.table("watched").where("g <> 'end'").collect()
        assert late_rows(query) == 1
    finally:
        query.stop()
    batch = watched(spark.createDataFrame(rows, TAGGED).drop("ts"), WATCHES).collect()
    form = lambda r: WATCHES[r["rule"]].form
    show = lambda r: (r["rule"], r["g"], r["first_us"], r["trigger_us"]) + ((round(r["mean_s"], 9), round(r["cv"], 9)) if form(r) == "beacon" else (r["last_us"], r["n"]))
    assert sorted(map(show, got), key=repr) == sorted(map(show, batch), key=repr)
    assert {r["rule"] for r in got} == set(range(len(WATCHES)))


@pytest.mark.parametrize("watch", WATCHES, ids=lambda w: w.form)
def test_machine_in_parts(watch):
    """However rows are cut into steps, alerts are those of one step."""
    rows = sorted((us, seq, v, x, p) for rule, _, _, us, seq, v, x, p in tagged_rows(12, 300) if rule == 0)
    r = random.Random(1)

    def run(cuts):
        window, opened, out, at = [], None, [], 0
        while at < len(rows):
            m = Machine(watch, window, opened)
            n = cuts()
            for row in rows[at : at + n]:
                m.take(row)
            at += n
            m.passed(rows[min(at, len(rows)) - 1][0], rows[at][0] if at < len(rows) else None)
            window, opened = m.window, m.open
            out += m.out
        m.close()
        return out + [o for o in m.out if o not in out]

    assert run(lambda: len(rows)) == run(lambda: r.randrange(1, 9)) != []


ALERT = "ord long, first_us long, last_us long, host string, user string, src_ip string, dst_ip string"


def test_incidents_batch_by_batch(spark, tmp_path):
    """A replay in ten batches, some out of order, gives the incidents of one batch; batches that are run twice change nothing."""
    r = random.Random(13)
    rows = []
    for i in range(1, 241):
        at = r.randrange(0, 40_000) * SECOND
        rows.append((i, at, at + r.randrange(900) * SECOND, r.choice(("", *(f"h{k}" for k in range(12)))), r.choice(("", *(f"u{k}" for k in range(40)))), r.choice(("", *(f"9.9.9.{k}" for k in range(40)))), ""))
    assets = spark.createDataFrame([("h1", "h1", "9.9.9.1", "high", "")], "host_key string, host string, ip string, criticality string, role string")
    df = spark.createDataFrame(rows, ALERT)
    want = sorted((x["ord"], x["incident"]) for x in correlate(df, assets, 600).select("ord", "incident").collect())
    state = Incidents(spark, str(tmp_path / "state"), assets, 600)
    r.shuffle(rows)
    for i in range(10):
        part = spark.createDataFrame(rows[i * 24 : (i + 1) * 24], ALERT)
        state.add(part, i)
        if i == 5:
            state.add(part, i)
    assert sorted((x["ord"], x["incident"]) for x in state.members().collect()) == want
    assert len({b for _, b in want}) > 3 and max(sum(1 for _, b in want if b == i) for i in {b for _, b in want}) > 10
    assert state.members(3).count() == 96


def test_incident_stream(spark, tmp_path):
    at = lambda o, s, host: (o, s * SECOND, s * SECOND, host, "", "", "")
    stream = stream_of(spark, tmp_path, [[at(1, 0, "a"), at(2, 50, "b")], [at(3, 100, "a"), at(4, 9000, "b")], [(5, 120 * SECOND, 130 * SECOND, "a", "", "", ""), (6, 60 * SECOND, 60 * SECOND, "a", "", "9.9.9.9", ""), (7, 60 * SECOND, 61 * SECOND, "b", "", "9.9.9.9", "")]], ALERT)
    assets = spark.createDataFrame([], "host_key string, host string, ip string, criticality string, role string")
    state = Incidents(spark, str(tmp_path / "state"), assets, 60, keep_us=10**12)
    q = incident_stream(stream, state, str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, state.members().select("ord", "incident").collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (6, 1), (7, 1)]
    assert sorted(map(tuple, state.members(0).select("ord", "incident").collect())) == [(1, 1), (2, 2)]
