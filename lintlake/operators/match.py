"""Lines, pattern rules and registry lookups."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import Rule, compile_pattern, java


def lines_of(files: DataFrame, code: str = "code") -> DataFrame:
    """One row per line, 1-based, under the names line and line_text; a trailing newline makes an empty last line. Other columns stay, the code goes."""
    kept = [c for c in files.columns if c != code]
    split = files.select(*kept, F.posexplode(F.split(code, "\n", -1)).alias("line", "line_text"))
    return split.withColumn("line", F.col("line") + 1)


def path_allows(path: Column, wanted: str | None, unwanted: str | None) -> Column:
    out = F.lit(True)
    if wanted:
        out = out & path.rlike(java(wanted))
    if unwanted:
        out = out & ~path.rlike(java(unwanted))
    return out


def _matches(pattern, text: Column, path: Column) -> Column:
    """Array of the matches of one pattern in a line that meet its constraints: one literal regular expression, compiled once a task."""
    c = compile_pattern(pattern.text)
    groups = [F.regexp_extract_all(text, F.lit(c.regex), F.lit(i)).alias(f"g{i}") for i in range(0, len(c.names) + 1)]
    found = F.arrays_zip(*groups)

    def fits(m: Column) -> Column:
        out = F.lit(True)
        for name, (wanted, unwanted) in pattern.metavariables.items():
            if name not in c.names:
                return F.lit(False)
            value = m[f"g{c.names.index(name) + 1}"]
            if wanted is not None:
                out = out & value.rlike(java(wanted))
            if unwanted is not None:
                out = out & ~value.rlike(java(unwanted))
        return out

    kept = F.filter(found, fits) if pattern.metavariables else found
    as_maps = F.transform(kept, lambda m: F.map_from_arrays(F.array(F.lit("0"), *map(F.lit, c.names)), F.array(*[m[f"g{i}"] for i in range(len(c.names) + 1)])))
    return F.when(path_allows(path, pattern.file_regex, pattern.file_not_regex) & text.rlike(c.regex), as_maps)


def _row(meta: dict):
    return lambda m, i: F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], i.alias("match_ord"), m.alias("captures"))


def match_rules(lines: DataFrame, rules: Iterable[Rule], path: str = "file_path", language: str = "language") -> DataFrame:
    """lines with one row per rule, pattern and match: rule_ord, pattern_ord, match_ord, rule_id, vuln_type, severity, message, captures (map).

    A narrow plan: every line is scanned once for all rules of its language, and no rule table is joined.
    """
    cases = []
    for r_ord, r in enumerate(rules):
        for p_ord, p in enumerate(r.patterns):
            hit = F.when(F.col(language) == r.language, _matches(p, F.col("line_text"), F.col(path)))
            meta = {"rule_ord": r_ord, "pattern_ord": p_ord, "rule_id": r.id, "vuln_type": r.vuln_type, "severity": r.severity.title(), "message": r.message}
            cases.append(F.transform(hit, _row(meta)))
    if not cases:
        empty = F.expr("cast(array() as array<struct<rule_ord:int,pattern_ord:int,rule_id:string,vuln_type:string,severity:string,message:string,match_ord:int,captures:map<string,string>>>)")
        cases = [empty]
    every = F.flatten(F.filter(F.array(*cases), lambda a: a.isNotNull()))
    out = lines.withColumn("m", F.explode(every))
    return out.select(*lines.columns, "m.*")


def drop_reported(findings: DataFrame, reported: DataFrame, keys=("file_path", "line", "vuln_type"), order=("rule_ord", "pattern_ord", "match_ord")) -> DataFrame:
    """Of findings with equal keys the first by order, unless the keys are in reported already."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return findings.join(reported.select(*keys).distinct(), list(keys), "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def embedded_tests(spark, rules: Iterable[Rule]) -> DataFrame:
    """rule_id, name, expected, found, passed of the cases that rules carry. Cases without any match count 0."""
    rows, schema = [], "rule_id string, name string, language string, file_path string, code string, expected string"
    rules = list(rules)
    for r in rules:
        rows += [(r.id, t["name"], r.language, t.get("file_path") or f"<{r.id}>", t["code"], str(t["expect_findings"])) for t in r.tests]
    cases = spark.createDataFrame(rows, schema)
    found = match_rules(lines_of(cases.withColumnRenamed("rule_id", "case_rule")), rules).where("case_rule = rule_id")
    counts = found.groupBy("rule_id", "name").agg(F.count(F.lit(1)).alias("found"))
    out = cases.join(counts, ["rule_id", "name"], "left").select("rule_id", "name", "expected", F.coalesce("found", F.lit(0)).alias("found"))
    passed = F.when(F.lower("expected") == "true", F.col("found") > 0).when(F.lower("expected") == "false", F.col("found") == 0).otherwise(F.col("found") == F.col("expected").cast("long"))
    return out.withColumn("passed", passed)


def pattern_hit(text: Column, match: str, pattern: str) -> Column:
    return F.contains(F.lower(text), F.lit(pattern.lower())) if match == "sub" else text.rlike("(?iu)" + java(pattern))


def first_registered(text: Column, language: Column, patterns: Iterable[tuple], kind: str) -> Column:
    """The name of the first pattern of a kind that fits, those of the language before those of all ('*'); null without any. patterns: rows of the registry."""
    own, common = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, name, match, pattern, langs, *_ in reversed([p for p in patterns if p[0] == kind]):
        names = [x.strip() for x in langs.split(",")]
        hit = pattern_hit(text, match, pattern)
        if "*" in names:
            common = F.when(hit, F.lit(name)).otherwise(common)
        names = [n for n in names if n != "*"]
        if names:
            own = F.when(language.isin(names) & hit, F.lit(name)).otherwise(own)
    return F.coalesce(own, common)


def any_of(text: Column, regexes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(r) for r in regexes], F.lit(False))
