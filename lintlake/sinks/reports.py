"""Reports: JSON, Markdown, HTML, SARIF, baselines and exit codes. Rows are shaped in Spark; only what a report shows reaches the driver."""

from __future__ import annotations

import json
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_escape, title_case
from ..operators.findings import sarif_position
from ..operators.quality import severity_counts
from ..plans.dims import SARIF_LEVELS, SEVERITIES, literal_map, severity_rank

MAX_ERRORS = 20


@F.pandas_udf(T.StringType())
def uri_quote(paths: pd.Series) -> pd.Series:
    """Percent-encoding that leaves slashes and unreserved characters, which url_encode doesn't."""
    return paths.map(lambda p: None if p is None else quote(p.replace("\\", "/"), safe="/-._~"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule_id, file_path, line, result (JSON) of each finding."""
    line = sarif_position(F.col("line"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.coalesce(F.element_at(literal_map(SARIF_LEVELS), F.col("severity")), F.lit("warning")).alias("level"),
        F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(uri_quote("file_path").alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    return findings.select("rule_id", "file_path", line.cast("long").alias("line"), F.to_json(result).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One descriptor per rule, from its first finding by file and line."""
    first = findings.groupBy("rule_id").agg(F.min_by(F.struct("vuln_type", "message"), F.struct("file_path", "line")).alias("f"))
    rule = F.struct(F.col("rule_id").alias("id"), title_case(F.col("f.vuln_type")).alias("name"), F.struct(F.col("f.message").alias("text")).alias("shortDescription"))
    return first.select("rule_id", F.to_json(rule).alias("rule")).orderBy("rule_id")


def write_sarif(findings: DataFrame, path: str, tool: str = "lintlake") -> None:
    """One SARIF 2.1.0 run per part file of results, under path/results, and its head under path/head: a consumer joins them, so that no task holds all results."""
    rules = [json.loads(r[0]) for r in sarif_rules(findings).select("rule").collect()]  # one per rule
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": []}]}
    spark = findings.sparkSession
    sarif_results(findings).select("result").write.mode("overwrite").text(f"{path}/results")
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def sarif_document(findings: DataFrame, tool: str = "lintlake") -> str:
    """The whole document as a string, for findings that fit the driver."""
    rules = [json.loads(r[0]) for r in sarif_rules(findings).select("rule").collect()]
    results = [json.loads(r[0]) for r in sarif_results(findings).orderBy("file_path", "line", "rule_id").select("result").toLocalIterator()]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]})


def summary(findings: DataFrame, errors: DataFrame) -> dict:
    stats = {r[0]: r[1] for r in severity_counts(findings).collect()}
    return {"total_issues": sum(stats.values()), "files_with_issues": findings.select("file_path").distinct().count(), "severity_stats": stats, "errors": [r.asDict() for r in errors.limit(MAX_ERRORS).collect()]}


def json_report(findings: DataFrame, errors: DataFrame) -> str:
    rows = findings.groupBy("file_path").agg(F.to_json(F.array_sort(F.collect_list(F.struct("line", "rule_id", "vuln_type", "severity", "message")))).alias("f")).orderBy("file_path")
    return json.dumps({"summary": summary(findings, errors), "results": {r[0]: json.loads(r[1]) for r in rows.toLocalIterator()}}, ensure_ascii=False)


def markdown_lines(findings: DataFrame) -> DataFrame:
    """file_path, n, text: a section of each file, its findings by severity and line."""
    item = F.concat(F.lit("- **"), "severity", F.lit("** line "), F.col("line").cast("string"), F.lit(": "), "rule_id", F.lit(" - "), F.coalesce("message", F.lit("")))
    per = findings.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct((-severity_rank(F.col("severity"))).alias("r"), "line", "rule_id", item.alias("t")))).alias("l"))
    return per.select("file_path", F.size("l").alias("n"), F.concat(F.lit("## "), "file_path", F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n")).alias("text"))


def markdown_report(findings: DataFrame, errors: DataFrame, title: str = "Findings") -> str:
    s = summary(findings, errors)
    head = [f"# {title}", "", f"{s['total_issues']} findings in {s['files_with_issues']} files.", "", *(f"- {k}: {s['severity_stats'][k]}" for k in SEVERITIES), ""]
    tail = ["## Errors", "", *(f"- {e}" for e in s["errors"])] if s["errors"] else []
    return "\n".join([*head, *(r[0] for r in markdown_lines(findings).orderBy("file_path").select("text").toLocalIterator()), *tail])


def html_report(findings: DataFrame, errors: DataFrame, remedies: DataFrame | None = None, title: str = "Findings") -> str:
    """Escaped throughout; with remedies (vuln_type, remedy) each finding shows its own."""
    rows = findings if remedies is None else findings.join(remedies.select("vuln_type", "remedy"), "vuln_type", "left")
    cells = ["file_path", "line", "severity", "rule_id", "message", *([] if remedies is None else ["remedy"])]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    body = "\n".join(r[0] for r in rows.orderBy("file_path", "line", "rule_id").select(row.alias("r")).toLocalIterator())
    s = summary(findings, errors)
    head = "".join(f"<th>{c}</th>" for c in cells)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1><p>{s['total_issues']} findings</p><table><tr>{head}</tr>\n{body}\n</table></body></html>"


def write_baseline(entries: DataFrame, path: str) -> None:
    """One stable JSON file {version, findings}; a baseline is what people keep in a repository, so it fits one task."""
    ordered = entries.select("rule_id", "file_path", "line", "fingerprint")
    one = ordered.agg(F.array_sort(F.collect_list(F.struct("file_path", "line", "rule_id", "fingerprint"))).alias("findings")).select(F.lit(1).alias("version"), "findings")
    one.coalesce(1).write.mode("overwrite").json(path)


def quality_markdown(rows: DataFrame) -> str:
    """A table of confusion counts and ratios."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join("all" if v is None else str(v) for v in r) + " |" for r in rows.collect())])


def exit_status(findings: DataFrame, n_errors: int, suppressed: bool = False) -> int:
    if n_errors:
        return 2
    return int(not suppressed and findings.limit(1).count() > 0)
