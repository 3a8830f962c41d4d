"""python -m sigloom plan|probe|manifest|doctor ...: whole runs from the command line. Exit 0, 1 on an error, 2 on wrong use."""

from __future__ import annotations

import argparse
import sys


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sigloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("plan", help="print the cells of a worker document")
    p.add_argument("--config", required=True)
    p.add_argument("--library", action="append")
    p.add_argument("--route", action="append", required=True)
    p.add_argument("--treatment", action="append")
    p.add_argument("--profile", default="default")
    p.add_argument("--queue", help="file that takes unknown libraries")
    p.add_argument("--priority", type=int, choices=(0, 1, 2), default=0)
    p = sub.add_parser("probe", help="compare exported functions of labelled cases")
    p.add_argument("--case", action="append", required=True, metavar="LABEL=JSONL")
    p.add_argument("--output", required=True)
    p = sub.add_parser("manifest", help="write the records of a run (a Parquet table) as a manifest and report what is incomplete")
    p.add_argument("--records", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--order", action="append", help="columns that order the rows")
    p = sub.add_parser("doctor", help="say whether what a run needs is there")
    p.add_argument("--config")
    return top


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    from pyspark.sql import SparkSession

    from sigloom.errors import RequestsUnknown
    from sigloom.plans import flows
    from sigloom.plans.session import ship

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    try:
        if args.command == "plan":
            config = flows.select(flows.load(spark, args.config, args.library), args.route, args.treatment, args.profile)
            print("\n".join(flows.plan(config)))
        elif args.command == "manifest":
            print(flows.finish(spark.read.parquet(args.records), args.output, args.order or ["library", "route", "treatment"]))
        elif args.command == "doctor":
            report = flows.health(spark, args.config)
            print("\n".join(f"{'ok' if ok else 'FAIL':4} {name}: {text}" for name, ok, text in report))
            return 0 if all(ok for _, ok, _ in report) else 1
        else:
            cases = dict(c.split("=", 1) for c in args.case if "=" in c)
            for name, path in flows.probe(spark, cases, args.output).items():
                print(f"{name}: {path}")
        return 0
    except RequestsUnknown as error:
        if args.queue:
            flows.record_missing(spark, args.queue, error.requests, args.priority, args.route)
        print(error, file=sys.stderr)
        return 1
    except (ValueError, RuntimeError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
