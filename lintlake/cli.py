"""The command line: python -m lintlake.cli PATH [options]. Exit codes: 0 clean, 1 findings, 2 errors."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.findings import SEVERITIES
from .operators.suppress import with_fingerprint
from .plans.dims import remediation
from .plans.scan import scan
from .session import session
from .sinks import reports
from .sources.files import read_baseline, walk
from .sources.rules import SHIPPED, load_rules


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lintlake", description="Scans a file or a tree of source code.")
    p.add_argument("path")
    p.add_argument("--format", choices=("json", "markdown", "html", "sarif"), default="json")
    p.add_argument("--output", help="a file for the report; standard output without it")
    p.add_argument("--severity", choices=SEVERITIES, help="leave out what is below")
    p.add_argument("--ignore", action="append", default=[], metavar="PATTERN", help="*.ext or a part of a path; may come again")
    p.add_argument("--disable", action="append", default=[], metavar="RULE", help="a rule or a type of findings; may come again")
    p.add_argument("--rules", help="a folder of pattern rules beside the shipped ones")
    p.add_argument("--baseline", help="a JSON file of known findings, which are left out")
    p.add_argument("--write-baseline", metavar="FOLDER", help="write what is found as a baseline, and report nothing as new")
    p.add_argument("--deep", action="store_true", help="also follow calls across files and the taint graph")
    p.add_argument("--changed", metavar="FILE", help="a text file that names, a line each, the files to scan")
    return p


def report(found: DataFrame, errors: DataFrame, kind: str) -> str:
    if kind == "sarif":
        return reports.sarif_document(found)
    if kind == "markdown":
        return reports.markdown_report(found, errors)
    if kind == "html":
        return reports.html_report(found, errors, remediation(found.sparkSession))
    return reports.json_report(found, errors)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = options().parse_args(argv)
    if not os.path.exists(a.path):
        print(f"no such path: {a.path}", file=sys.stderr)
        return 2
    spark = spark or session("lintlake", **{"spark.ui.showConsoleProgress": "false"})
    files = walk(spark, os.path.abspath(a.path), patterns=a.ignore).where("reason is null").select("file_path", "language", "code")
    if a.changed:
        files = files.join(spark.read.text(os.path.abspath(a.changed)).select(F.trim("value").alias("file_path")).distinct(), "file_path", "left_semi")
    rules = [*SHIPPED, *(load_rules(a.rules) if a.rules else [])]
    try:
        known = read_baseline(spark, os.path.abspath(a.baseline)) if a.baseline else None
        found = scan(files, rules, baseline=known, severity=a.severity, disabled=a.disable, across=a.deep, graph=a.deep).persist()
        errors = spark.createDataFrame([], "file_path string, error string")
        if a.write_baseline:
            reports.write_baseline(with_fingerprint(found.drop("fingerprint")), os.path.abspath(a.write_baseline))
        text = report(found, errors, a.format)
        code = reports.exit_status(found, 0, suppressed=bool(a.write_baseline))
        found.unpersist()
    except Exception as e:  # whatever it is, a pipeline must see it in the exit code
        print(f"{type(e).__name__}: {e}".splitlines()[0], file=sys.stderr)
        return 2
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
