"""python -m wardlight detect | evaluate | rules | sigma-to-spl"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone


def shown(facts: dict, incidents: list) -> list[str]:
    """A run's outcome for people: what came in, and the incidents that come first."""
    lines = [f"{facts['events']} events, {facts['alerts']} alerts, {facts['incidents']} incidents; " + ", ".join(f"{n} {p}" for p, n in facts["priorities"].items())]
    wide = max([len(r["name"]) for r in incidents], default=0)
    return lines + [f"{r['priority']} {r['score']:>3}  {r['id']}  {r['name']:<{wide}}  {r['n_alerts']} alerts since {_utc(r['first_us'])}" for r in incidents]


def _utc(us: int) -> str:
    return f"{datetime.fromtimestamp(us / 1e6, timezone.utc):%Y-%m-%d %H:%M}"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="wardlight", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("detect", "evaluate"):
        q = sub.add_parser(name)
        q.add_argument("--logs", required=True)
        q.add_argument("--year", type=int)
        for option in ("--env", "--intel", "--rules", "--sigma"):
            q.add_argument(option)
        if name == "detect":
            q.add_argument("--out", required=True)
            q.add_argument("--top", type=int, default=20, help="incidents to list")
            q.add_argument("--events", action="store_true", help="write the events, too")
            q.add_argument("--json", action="store_true", help="the summary as JSON in place of the list")
    q = sub.add_parser("rules")
    for option in ("--rules", "--sigma"):
        q.add_argument(option)
    q = sub.add_parser("sigma-to-spl")
    q.add_argument("--rule", required=True)
    q.add_argument("--index", default="main")
    a = p.parse_args(argv)
    from .plans.detector import Detector
    from .plans.export import to_spl
    from .plans.rules import load_rules, load_sigma

    try:
        if a.command == "sigma-to-spl":
            print("\n\n".join(to_spl(r, a.index) for r in load_sigma(a.rule)))
            return 0
        if a.command == "rules":
            for r in Detector(*load_rules(a.rules, a.sigma)).catalog():
                print(f"{r['id']:<12}{r['severity']:<10}{r['type']:<11}{r['technique']:<11}{r['title']}")
            return 0
        from pyspark.sql import SparkSession

        from .plans.triage import evaluate, run
        from .sources.sinks import write

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        result = run(spark, a.logs, year=a.year, env=a.env, intel=a.intel, rules=a.rules, sigma=a.sigma)
        if a.command == "detect":
            facts = write(result, a.out, a.events)
            print(json.dumps(facts, sort_keys=True) if a.json else "\n".join(shown(facts, result.ranked().limit(a.top).collect())))
            for r in result.parse_stats.where("skipped > 0").orderBy("source").collect():  # a row a source
                print(f"{r['source']}: {r['skipped']} of {r['total']} lines were not understood, such as {r['samples'][0]!r}", file=sys.stderr)
            return 0
        report = evaluate(spark, result)
        print(json.dumps(report, sort_keys=True))
        return 0 if all(s["pass"] for s in report["scenarios"]) else 1
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
