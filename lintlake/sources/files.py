"""Project trees, changes from version control, and the JSON files that go with a scan."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fingerprint, normalise_newlines
from ..operators.match import lines_of
from ..plans.dims import language_of

MAX_BYTES = 2 * 1024 * 1024
# Fixed values.
PACKED = (".min.js", ".min.css", ".min.js.map", ".bundle.js", ".chunk.js", ".map")
NOT_CODE = (".md", ".txt", ".json", ".xml", ".yaml", ".yml", ".csv", ".tsv", ".log", ".data", ".dump", ".pdf", ".doc", ".docx", ".xls", ".xlsx")
CONFIG_FILES = ("package.json", "tsconfig.json", "webpack.config.js", "babel.config.js", ".eslintrc.json")
DOT_FILES = (".gitignore", ".env", ".env.example")
EXCLUDED_DIRS = ("node_modules", ".git", "dist", "build", "venv", ".venv", "__pycache__", "vendor")
COVERAGE_DIRS = ("coverage", ".nyc_output")


def ignored(rel: Column, excluded_dirs: Iterable[str] = EXCLUDED_DIRS, excluded_files: Iterable[str] = (), patterns: Iterable[str] = ()) -> Column:
    """Whether a path, relative to its project, is left out: by its name, by a folder on its way, by its kind, or by a pattern (*.ext or a path component)."""
    parts = F.split(F.replace(rel, F.lit("\\"), F.lit("/")), "/")
    name = F.element_at(parts, -1)
    out = name.isin(*excluded_files) if excluded_files else F.lit(False)
    out = out | F.arrays_overlap(parts, F.array(*map(F.lit, excluded_dirs)))
    for s in PACKED:
        out = out | name.endswith(s)
    kind = F.regexp_extract(F.lower(name), r".(\.[^.]+)\z", 1)
    out = out | kind.isin(*NOT_CODE) & ~F.lower(name).isin(*CONFIG_FILES)
    out = out | F.arrays_overlap(F.transform(parts, F.lower), F.array(*map(F.lit, COVERAGE_DIRS)))
    for p in patterns:
        if p.startswith("*."):
            out = out | name.endswith(p[1:])
        elif "*" not in p:
            out = out | F.array_contains(parts, p)
    return out | name.startswith(".") & ~name.isin(*DOT_FILES)


def skip_reason(rel: Column, size: Column, excluded_dirs: Iterable[str] = EXCLUDED_DIRS, excluded_files: Iterable[str] = (), patterns: Iterable[str] = (), max_bytes: int = MAX_BYTES) -> Column:
    """Why a file isn't scanned (excluded, unsupported_type, too_large); null if it is."""
    unsupported = language_of(F.lit(None).cast("string"), rel).isNull()
    return F.when(ignored(rel, excluded_dirs, excluded_files, patterns), "excluded").when(unsupported, "unsupported_type").when(size > max_bytes, "too_large")


@F.pandas_udf(T.StringType())
def lenient_utf8(content: pd.Series) -> pd.Series:
    """Bytes that are not UTF-8 are dropped; the built-in decode would replace or refuse them."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))


def walk(spark: SparkSession, root: str, excluded_dirs: Iterable[str] = EXCLUDED_DIRS, excluded_files: Iterable[str] = (), patterns: Iterable[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """file_path (relative), size, language, reason (null: scanned), code. The contents of files that a reason leaves out are not decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"\A[a-z]+:/*", "/"), r"\A\Q" + base + r"\E/*", "")
    seen = files.select(rel.alias("file_path"), F.col("length").alias("size"), "content")
    seen = seen.withColumn("language", language_of(F.lit(None).cast("string"), F.col("file_path")))
    why = skip_reason(F.col("file_path"), F.col("size"), excluded_dirs, excluded_files, patterns, max_bytes)
    return seen.withColumn("reason", why).withColumn("code", F.when(F.col("reason").isNull(), normalise_newlines(lenient_utf8(F.when(F.col("reason").isNull(), F.col("content")))))).drop("content")


def changed_files(*feeds: DataFrame) -> DataFrame:
    """The union of change feeds (file_path): committed, staged and untracked; those of unsupported kinds go."""
    out = feeds[0].select("file_path")
    for f in feeds[1:]:
        out = out.unionByName(f.select("file_path"))
    return out.distinct().where(language_of(F.lit(None).cast("string"), F.col("file_path")).isNotNull())


def changed_lines(diffs: DataFrame) -> DataFrame:
    """file_path, line of the added and changed lines that the hunk heads of unified diffs (file_path, diff) name; a count of 0 names none."""
    heads = diffs.select("file_path", F.explode(F.regexp_extract_all("diff", F.lit(r"(?m)^@@ -\S+ \+(\d+(?:,\d+)?) @@"), 1)).alias("h"))
    start, count = F.split("h", ",").getItem(0).cast("int"), F.coalesce(F.get(F.split("h", ","), F.lit(1)).cast("int"), F.lit(1))
    return heads.withColumns({"s": start, "n": count}).where("n > 0").select("file_path", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("line")).distinct()


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, file_path, line, fingerprint. A root that isn't JSON raises; entries without a rule, file or line are passed over, a missing fingerprint is made."""
    entry = "struct<rule_id:string,file_path:string,line:int,fingerprint:string>"
    root = spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(f"version int, findings array<{entry}>").json(path)
    rows = root.select(F.explode("findings").alias("f")).select("f.*").where("rule_id is not null and file_path is not null and line is not null")
    return rows.withColumn("fingerprint", F.coalesce("fingerprint", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line"))))


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """file_path, line, vuln_type, details of findings that were marked as false."""
    entry = "struct<file_path:string,line:int,type:string,details:string,reason:string,created_at:string>"
    root = spark.read.option("multiLine", "true").schema(f"version string, false_positives array<{entry}>").json(path)
    return root.select(F.explode("false_positives").alias("f")).select("f.file_path", "f.line", F.col("f.type").alias("vuln_type"), "f.details", "f.reason", "f.created_at").where("file_path is not null and line is not null")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """id, file, vuln_type, line_candidates, is_true_positive, in_scope from a JSON array of expectations."""
    schema = "file string, line int, line_candidates array<int>, type string, is_true_positive boolean, in_scope boolean, expected_pattern string"
    rows = spark.read.option("multiLine", "true").schema(schema).json(path)
    return rows.select(F.monotonically_increasing_id().alias("id"), "file", F.col("type").alias("vuln_type"), F.coalesce("line_candidates", F.array("line")).alias("line_candidates"), F.coalesce("is_true_positive", F.lit(True)).alias("is_true_positive"), F.coalesce("in_scope", F.lit(True)).alias("in_scope"))


def in_python(files: DataFrame, facts, schema: str) -> DataFrame:
    """A Python function (path, language, code) -> rows over files, a batch at a time: the way in for rules written in Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in schema.split(",")]
        for b in batches:
            yield pd.DataFrame([r for p, la, c in zip(b["file_path"], b["language"], b["code"], strict=True) for r in facts(p, la, c or "")], columns=names)

    return files.select("file_path", "language", "code").mapInPandas(run, schema)


__all__ = ["changed_files", "changed_lines", "ignored", "in_python", "lenient_utf8", "lines_of", "read_baseline", "read_marks", "read_truth", "skip_reason", "walk"]
