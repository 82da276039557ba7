"""Outputs of a run: alerts and incidents as JSON, a summary, technique counts, and a page for each incident."""

from __future__ import annotations

import json
import os
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import event_json
from ..functions.levels import TACTICS
from .context import load_yaml

if TYPE_CHECKING:
    from ..plans.triage import Result

#: When a step is due.
PHASES = ("Now", "Today", "Before closing")
#: What a team does when a stage of an attack shows, by stage; (phase, step).  "*" holds for every incident, "critical" where a host of the highest worth is in it.
PLAYBOOK: dict[str, list[tuple[int, str]]] = {
    "*": [(0, "Name one person who leads and one who keeps the log."), (2, "Check that nothing in this incident has shown up again for a week."), (2, "Note which alert came too late or not at all, and change its rule.")],
    "critical": [(0, "Call the owner of the critical host before it is switched off or cut off."), (1, "Test that its backups can be restored and are older than the first alert.")],
    "Reconnaissance": [(1, "Limit the request rate of the outside address."), (2, "Take down pages and ports that answered it without need.")],
    "Initial Access": [(0, "Suspend the account or close the service that let the attacker in."), (1, "List every sign-in and upload by the same way since the first alert."), (2, "Require a second factor or a patch there before it opens again.")],
    "Execution": [(0, "Isolate the host, with its memory kept."), (1, "Decode the command line and search all hosts for the files and names in it.")],
    "Persistence": [(1, "Export, then delete, the task, service or page that would start again."), (2, "Rebuild the host from a known image if its start-up can't be vouched for.")],
    "Privilege Escalation": [(0, "Withdraw the elevated right until its use is explained."), (1, "Compare local administrators and sudo rules with their reference.")],
    "Defense Evasion": [(1, "Restore logging on the host and fetch copies of what was cleared from the collector.")],
    "Credential Access": [(0, "Block the guessing source, and force new passwords for accounts that it reached."), (1, "Treat every secret held on the host as known to others, and replace it from a clean one.")],
    "Discovery": [(1, "Ask the owner of the scanning host whether the scan was theirs."), (1, "List what the scan could see and did reach.")],
    "Lateral Movement": [(0, "Cut the path between the two hosts, for file shares and remote services alike."), (1, "Examine the target as closely as the source.")],
    "Collection": [(1, "Find the archive or folder in which data was gathered.")],
    "Command and Control": [(0, "Block the outside address and name at the border and at the resolver."), (1, "Look for other hosts with the same beat or the same name.")],
    "Exfiltration": [(0, "Stop the transfer at the border."), (1, "Measure what left: bytes, hours, kinds of data."), (1, "Inform whoever answers for the data, and for duties to report.")],
    "Impact": [(0, "Disconnect shared storage that can still be written."), (1, "Restore the most needed service first, on clean hosts.")],
}


def techniques() -> dict[str, str]:
    """Public names of the techniques that bundled rules name, as they stand beside them."""
    return load_yaml(None, "rules.yml").get("techniques") or {}


def technique_name(technique: Column) -> Column:
    """The name of a technique, or itself."""
    known = techniques()
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in known.items() for v in kv]), technique), technique)


def actions(incidents: DataFrame) -> DataFrame:
    """incident and ``actions``: steps of the playbook for the incident's stages, by phase; ``incidents`` has tactics and score_breakdown."""
    rows = [(tactic, phase, i, n, step) for i, (tactic, steps) in enumerate(PLAYBOOK.items()) for n, (phase, step) in enumerate(steps)]
    book = incidents.sparkSession.createDataFrame(rows, "tactic string, phase int, nth int, place int, step string")  # as many rows as are stated above
    worth = F.exists("score_breakdown", lambda p: p["reason"].endswith("of critical worth"))
    asked = F.concat(F.array(F.lit("*")), F.when(worth, F.array(F.lit("critical"))).otherwise(F.array().cast("array<string>")), F.col("tactics"))
    due = incidents.select("incident", F.explode(asked).alias("tactic")).join(F.broadcast(book), "tactic")
    say = F.concat(F.element_at(F.array(*map(F.lit, PHASES)), F.col("phase") + 1), F.lit(": "), F.col("step"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("phase", "nth", "place", say.alias("say")))), lambda x: x["say"])
    return due.groupBy("incident").agg(listed.alias("actions"))


def _line(*parts: Any) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _at(us: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_micros(us), form)


def narrative() -> Column:
    """An incident's row in two sentences: why it matters, and what happened."""
    reason = F.coalesce(F.get(F.transform(F.array_sort("score_breakdown", lambda a, b: b["points"] - a["points"]), lambda p: p["reason"]), 0), F.lit("nothing that scores"))
    span = (F.col("last_us") - F.col("first_us")) / 60_000_000
    took = F.when(span < 1, F.lit("less than a minute")).when(span < 120, _line(F.bround(span, 0).cast("int").cast("string"), " minutes")).otherwise(_line(F.bround(span / 60, 1).cast("string"), " hours"))
    stages = F.when(F.size("tactics") > 1, _line(F.size("tactics").cast("string"), " stages, ", F.get("tactics", 0), " first and ", F.element_at("tactics", -1), " furthest")).otherwise(_line("one stage", F.when(F.size("tactics") == 1, _line(", ", F.get("tactics", 0))).otherwise("")))
    return _line(F.col("priority"), " mainly because ", reason, ". ", F.col("n_alerts").cast("string"), " alerts in ", took, ": ", stages, ".")


def reports(result: Result) -> DataFrame:
    """id and a Markdown ``value`` for each incident: its score first, then what happened by stage, with one line of proof an alert, what is known, and what to do."""
    order = F.array_position(F.array(*map(F.lit, TACTICS)), F.col("tactic"))
    order = F.when(order == 0, len(TACTICS) + 1).otherwise(order)
    where = F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in ("host", "user", "src_ip")])
    proof = F.coalesce(_line("\n  > ", F.get("evidence", 0)), F.lit(""))
    what = _line("- ", _at(F.col("first_us"), "HH:mm:ss"), " ", F.col("rule_title"), " (", F.col("rule_id"), F.coalesce(_line(", ", technique_name(F.nullif("technique", F.lit("")))), F.lit("")), "), ", F.col("count").cast("string"), " times: ", where, proof)
    stage = result.alerts.select("incident", order.alias("nth"), F.coalesce(F.nullif("tactic", F.lit("")), F.lit("Other")).alias("tactic"), "first_us", "ord", what.alias("what"))
    # an incident's alerts become the text of one row, stage by stage
    by_stage = stage.groupBy("incident", "nth", "tactic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_us", "ord", "what"))), lambda x: x["what"]), "\n").alias("t"))
    told = by_stage.groupBy("incident").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", _line("### ", F.col("tactic"), "\n", F.col("t")).alias("t")))), lambda x: x["t"]), "\n\n").alias("stages"))
    points = F.array_join(F.transform("score_breakdown", lambda p: _line("- +", p["points"].cast("string"), " ", p["reason"])), "\n")
    involved = F.concat_ws("\n", *[F.when(F.size(c) > 0, _line("- ", label, ": ", F.array_join(c, ", "))) for label, c in (("machines", "hosts"), ("people", "users"), ("outside", "external_ips"), ("inside", "internal_ips"))])
    known = F.array_join(F.transform("intel", lambda i: _line("- ", i["indicator"], " stands in ", i["source"], " as ", i["threat"], ", ", i["confidence"].cast("string"), " of 100 sure")), "\n")
    steps = F.array_join(F.transform("actions", lambda s: _line("- [ ] ", s)), "\n")
    page = F.concat_ws(
        "\n\n", _line("# ", F.col("id"), " ", F.col("name")), narrative(), _line("Seen ", _at(F.col("first_us")), " to ", _at(F.col("last_us")), " UTC."), _line("## Why ", F.col("score").cast("string"), " of 100\n", points),
        _line("## What happened\n\n", F.col("stages")), F.when(involved != "", _line("## Who and where\n", involved)), F.when(known != "", _line("## Known before\n", known)), _line("## To do\n", steps),
    )
    return result.incidents.join(told, "incident").join(actions(result.incidents), "incident").select("id", page.alias("value"))


#: Versions and domain of the layer format.
LAYER = {"versions": {"attack": "15", "navigator": "5.1.0", "layer": "4.5"}, "domain": "enterprise-attack"}
COLOURS = ["#eef4fb", "#1f5fa8"]


def navigator(alerts: DataFrame) -> dict[str, Any]:
    """Counts by technique as a layer; one row a technique comes to the driver."""
    rows = sorted((r["technique"], r["count"]) for r in alerts.where("technique <> ''").groupBy("technique").count().collect())
    most = max((n for _, n in rows), default=1)
    return {"name": "Alerts by technique", **LAYER, "gradient": {"colors": COLOURS, "minValue": 0, "maxValue": most}, "techniques": [{"techniqueID": t, "score": n} for t, n in rows]}


def write(result: Result, out: str, events: bool = False) -> dict[str, Any]:
    """Tables by Spark, in any store; the two small documents as Spark text files beside them.  With ``events`` each event, too, as one JSON object a line."""
    from ..plans.triage import summary

    spark = result.alerts.sparkSession
    result.alerts.drop("stage", "rule_no", "trigger_seq").orderBy("ord").write.mode("overwrite").json(os.path.join(out, "alerts.json"))
    result.ranked().write.mode("overwrite").json(os.path.join(out, "incidents.json"))
    reports(result).write.mode("overwrite").option("lineSep", "\n").partitionBy("id").text(os.path.join(out, "reports"))
    if events:
        result.events.select(event_json(result.events.columns).alias("value")).write.mode("overwrite").text(os.path.join(out, "events.json"))
    facts = summary(result)
    for name, doc in (("summary.json", facts), ("navigator.json", navigator(result.alerts))):
        spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(out, name))
    return facts
