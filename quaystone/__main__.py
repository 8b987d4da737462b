"""python -m quaystone generate|batch|analytics: raw data, all layers, ad-hoc queries."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from quaystone.operators import synth
from quaystone.plans import reports, star
from quaystone.session import build_session
from quaystone.sources import landing, sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quaystone", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    generate = sub.add_parser("generate", help="write synthetic raw files")
    generate.add_argument("--raw", required=True)
    for name, kind in (("seed", int), ("n-customers", int), ("n-transactions", int), ("n-merchants", int), ("date-start", dt.date.fromisoformat), ("date-end", dt.date.fromisoformat), ("fraud-rate", float)):
        generate.add_argument(f"--{name}", type=kind)
    batch = sub.add_parser("batch", help="land, check, split, build the star and the marts; exit code 1 if a gate fails")
    batch.add_argument("--raw", required=True)
    batch.add_argument("--out", required=True)
    batch.add_argument("--date-start", type=dt.date.fromisoformat, default=synth.GeneratorConfig.date_start)
    batch.add_argument("--date-end", type=dt.date.fromisoformat, default=synth.GeneratorConfig.date_end)
    batch.add_argument("--run-id", default="run")
    batch.add_argument("--summary", help="JSON file for the summary")
    batch.add_argument("--strict", action="store_true", help="warnings fail as well")
    adhoc = sub.add_parser("analytics", help="ad-hoc queries on raw files as Markdown")
    adhoc.add_argument("--raw", required=True)
    adhoc.add_argument("--report", required=True)
    args = parser.parse_args(argv)
    spark = build_session()
    if args.command == "generate":
        given = {k: getattr(args, k) for k in ("seed", "n_customers", "n_transactions", "n_merchants", "date_start", "date_end", "fraud_rate")}
        synth.write_raw(spark, synth.configure(**given), args.raw)
        return 0
    if args.command == "analytics":
        at = dt.datetime.now().isoformat(timespec="seconds")
        bronze = landing.land_transactions(spark, f"{args.raw}/transactions/txn_*", "adhoc", at)
        reports.analytics_report(bronze, landing.land_csv(spark, f"{args.raw}/merchants.csv", "merchants", "adhoc", at), args.report)
        return 0
    summary = star.run_batch(spark, args.raw, args.out, start=args.date_start, end=args.date_end, run_id=args.run_id, at=dt.datetime.now().isoformat(timespec="seconds"))
    if args.summary:
        sinks.write_json(args.summary, summary)
    gates = [ok for layer in summary["gates"].values() for ok, _ in layer.values()]
    good = summary["verdict"] == "PASS" or (summary["verdict"] == "PASS_WITH_WARNINGS" and not args.strict)
    return 0 if good and all(gates) else 1


if __name__ == "__main__":
    sys.exit(main())
