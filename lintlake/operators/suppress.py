"""Baselines, marks of false positives, and markers in the source itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint, line_comment

MARKER = "lint-ignore"  #: what a comment says to silence findings; ": TYPE" after it names one type


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line")))


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline lacks."""
    return with_fingerprint(findings).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def known_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return with_fingerprint(findings).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi")


def add_to_baseline(baseline: DataFrame, findings: DataFrame) -> DataFrame:
    """The baseline and the findings that it lacked, each fingerprint once."""
    fresh = new_findings(findings, baseline).dropDuplicates(["fingerprint"])
    return baseline.unionByName(fresh.select(*baseline.columns)).orderBy("file_path", "line", "rule_id", "fingerprint")


def drop_marked(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Without findings that were marked as false: file, line and type equal, and the details part of the mark's, if both have any."""
    f, m = findings.alias("f"), marks.alias("m")
    same = F.expr("f.file_path = m.file_path and f.line = m.line and f.vuln_type = m.vuln_type")
    details = F.expr("coalesce(f.details, '') = '' or coalesce(m.details, '') = '' or contains(m.details, f.details)")
    return f.join(m, same & details, "left_anti")


def markers_loose(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """file_path, line, only_type: what a marker anywhere in a line silences, which is its own line and the next."""
    m = rf"(?i){marker}(?:\s*:\s*([A-Za-z0-9_]+))?"
    found = lines.where(F.col("line_text").rlike(m)).select("file_path", "line", F.upper(F.nullif(F.regexp_extract("line_text", m, 1), F.lit(""))).alias("only_type"))
    # what is on the line itself is looked at first, but either suffices
    return found.unionByName(found.withColumn("line", F.col("line") + 1)).distinct()


def markers_in_comments(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """file_path, line, only_type for markers in comments outside quotes: a comment alone on its line speaks of the next, another one of its own."""
    comment = line_comment(F.col("line_text"))
    m = rf"(?i)(?:#|//)\s*{marker}(?:\s*:\s*([A-Za-z_]+))?"
    found = lines.withColumn("comment", comment).where(F.col("comment").rlike(m))
    alone = F.trim(F.substr("line_text", F.lit(1), F.length("line_text") - F.length("comment"))) == ""
    return found.select("file_path", (F.col("line") + F.when(alone, 1).otherwise(0)).alias("line"), F.upper(F.nullif(F.regexp_extract("comment", m, 1), F.lit(""))).alias("only_type")).distinct()


def drop_silenced(findings: DataFrame, markers: DataFrame) -> DataFrame:
    f, m = findings.alias("f"), markers.alias("m")
    return f.join(m, F.expr("f.file_path = m.file_path and f.line = m.line and (m.only_type is null or m.only_type = upper(f.vuln_type))"), "left_anti")
