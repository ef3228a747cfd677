"""Command line: ``python -m lispmill analyze|stats|list|info|genconf|dump``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lispmill.operators.registry import RULES
from lispmill.plans import analyze, config, report, stats
from lispmill.sources import files


def show(df) -> None:
    """Prints a report's rows as they come, a partition at a time."""
    for r in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lispmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="findings of the enabled rules")
    a.add_argument("paths", nargs="+")
    a.add_argument("--format", default="summary", choices=report.FORMATS)
    a.add_argument("--config", help="YAML file; else one is looked for upward from the first path")
    a.add_argument("--count-finding", action="store_true", help="print the number of findings only")
    a.add_argument("--timing", action="store_true")
    a.add_argument("--to", help="folder to write to instead of printing")
    s = sub.add_parser("stats", help="function measures")
    s.add_argument("path")
    s.add_argument("--raw", action="store_true", help="a row per function and measure instead of histograms")
    s.add_argument("--to", help="folder for one CSV per measure")
    sub.add_parser("list", help="ids of all rules")
    i = sub.add_parser("info", help="what a rule looks for")
    i.add_argument("rule", nargs="?")
    sub.add_parser("genconf", help="a configuration with all defaults")
    d = sub.add_parser("dump", help="the node table as JSON")
    d.add_argument("path")
    return p


def main(argv: list[str] | None = None) -> int:
    args, start = parser().parse_args(argv), time.time()
    if args.command == "list":
        print("\n".join(sorted(RULES)))
    elif args.command == "info":
        for k in [args.rule] if args.rule else sorted(RULES):
            if k not in RULES:
                print(f"no rule {k}", file=sys.stderr)
                return 1
            print(f"{k}\t{RULES[k].severity}\t{RULES[k].group}\t{RULES[k].description}")
    elif args.command == "genconf":
        print(config.generate(), end="")
    else:
        spark = SparkSession.builder.appName("lispmill").getOrCreate()
        if args.command == "dump":
            show(files.nodes(files.scan(spark, args.path, analyze_tests=True)).drop("kids", "sub").select(F.to_json(F.struct("*"))))
        elif args.command == "stats":
            measured = stats.function_stats(files.nodes(files.scan(spark, args.path, analyze_tests=True, case_sensitive=True)))
            if args.to:
                stats.write_histograms(measured, args.to)
            else:
                show(stats.raw_stats(measured) if args.raw else stats.histograms(measured))
        else:
            chosen = config.load(args.config or config.find(args.paths[0]))
            src = files.scan(spark, *args.paths, analyze_tests=chosen.analyze_tests)
            # parsed and judged once, however often the report reads its findings
            found = analyze.findings(files.written(files.nodes(src)), chosen).persist()
            form = "count" if args.count_finding else args.format
            if args.to:
                report.write(found, src, form, args.to)
            else:
                show(report.render(found, src, form))
        if getattr(args, "timing", False):
            print(f"Execution time: {time.time() - start:.2f}s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
