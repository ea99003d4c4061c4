"""Small dimensions: languages, severities, remediation. They are literals in plans, never joins that grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import PATTERNS

# File suffix -> language, with full support, then partial.
EXTENSIONS = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".php": "php", ".phtml": "php", ".php5": "php", ".java": "java", ".go": "go",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".hxx": "cpp",
}
# Names that a language goes by.
ALIASES = {
    "py": "python", "python": "python", "js": "javascript", "jsx": "javascript", "javascript": "javascript", "ts": "typescript", "tsx": "typescript", "typescript": "typescript",
    "php": "php", "java": "java", "go": "go", "golang": "go", "c": "c", "cc": "cpp", "c++": "cpp", "cpp": "cpp", "cxx": "cpp",
}
# Fixed values.
SEVERITIES = ("Critical", "High", "Medium", "Low")
CONFIDENCE = {"high": 0.9, "medium": 0.5, "low": 0.3}
SARIF_LEVELS = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note"}
# Vulnerability type -> (cwe, one-line remedy).
REMEDIATION = {
    "SQL_INJECTION": ("CWE-89", "Bind parameters instead of building statements from text."),
    "NOSQL_INJECTION": ("CWE-943", "Build queries from typed values and refuse operator keys."),
    "XSS_RISK": ("CWE-79", "Escape for the output context, or use a template that does."),
    "RCE_COMMAND_EXEC": ("CWE-78", "Call programs with an argument list and no shell."),
    "PATH_TRAVERSAL": ("CWE-22", "Resolve the path and check that it stays below its root."),
    "SSRF": ("CWE-918", "Allow only known hosts, and none of the internal network."),
    "OPEN_REDIRECT": ("CWE-601", "Redirect to known targets only."),
    "DESERIALIZATION": ("CWE-502", "Read a data-only format instead of objects."),
    "HARDCODED_CREDENTIALS": ("CWE-798", "Read secrets from a vault or the environment."),
}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def severity_rank(severity: Column, default: int = 2) -> Column:
    """Critical 4 to Low 1, unknown 2."""
    out = F.lit(default)
    for i, s in enumerate(reversed(SEVERITIES), 1):
        out = F.when(severity == s, i).otherwise(out)
    return out


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path's last part, with its dot; none for dot-files."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]+)\z", 1))


def language_of(alias: Column, path: Column) -> Column:
    """The alias if it is known, else by suffix, else null."""
    return F.coalesce(F.element_at(literal_map(ALIASES), F.lower(F.trim(F.coalesce(alias, F.lit(""))))), F.element_at(literal_map(EXTENSIONS), suffix(path)))


def registry(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """The registry as a table, with pattern_ord; extra rows come last."""
    rows = [(i, k, n, m, p, [x.strip() for x in langs.split(",")], what, sev or None, cwe or None) for i, (k, n, m, p, langs, what, sev, cwe) in enumerate([*PATTERNS, *extra], 1)]
    return spark.createDataFrame(rows, "pattern_ord int, kind string, name string, match string, pattern string, languages array<string>, category string, severity string, cwe string")


def remediation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REMEDIATION.items()], "vuln_type string, cwe_id string, remedy string")
