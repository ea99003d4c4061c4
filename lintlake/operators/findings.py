"""Shaping, deduplicating and ordering findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dims import CONFIDENCE, SEVERITIES, literal_map, severity_rank

KNOWN = ("rule_id", "vuln_type", "type", "severity", "confidence", "file_path", "file", "line", "column", "message", "details", "fix_suggestion", "cwe_id", "end_line", "end_column")


def normalise(raw: Column) -> Column:
    """A finding given as map<string,string>, as a struct: names that mean the same are merged, words become numbers, the rest is kept in extra."""
    get = lambda *ks: F.coalesce(*[F.element_at(raw, k) for k in ks])
    severity = F.initcap(get("severity"))
    confidence = F.lower(get("confidence"))
    return F.struct(
        F.coalesce(get("rule_id"), get("type", "vuln_type"), F.lit("")).alias("rule_id"),
        F.coalesce(get("vuln_type", "type"), F.lit("")).alias("vuln_type"),
        F.when(severity.isin(*SEVERITIES), severity).otherwise("Medium").alias("severity"),
        F.coalesce(F.element_at(literal_map(CONFIDENCE), confidence), F.expr("try_cast(1.0 as double)") * F.try_to_number(confidence, F.lit("9.99")).cast("double"), F.lit(0.5)).alias("confidence"),
        get("file_path", "file").alias("file_path"),
        F.coalesce(F.regexp_extract(get("line"), r"\A\d+\z", 0), F.lit("")).alias("_line"),
        F.coalesce(get("message", "details"), F.lit("")).alias("message"),
        F.coalesce(get("details", "message"), F.lit("")).alias("details"),
        get("fix_suggestion").alias("fix_suggestion"),
        get("cwe_id").alias("cwe_id"),
        F.map_filter(raw, lambda k, _: ~k.isin(*KNOWN)).alias("extra"),
    )


def sarif_position(value: Column, default: int = 1) -> Column:
    """An int of at least 1, else the default."""
    n = F.expr(f"try_cast({value._jc.toString()} as int)") if isinstance(value, str) else value.try_cast("int")
    return F.when(n >= 1, n).otherwise(F.lit(default))


def diagnostic(findings: DataFrame) -> DataFrame:
    """Editor positions: 0-based, the whole line (to column 999) where no range is known."""
    start = F.greatest(F.coalesce("start_line", "line", F.lit(1)) - 1, F.lit(0))
    ranged = F.col("start_character").isNotNull() & F.col("end_character").isNotNull()
    level = F.when(F.col("severity").isin("Critical", "High"), 1).when(F.col("severity") == "Medium", 2).when(F.col("severity") == "Low", 3).otherwise(2)
    return findings.select("file_path", "rule_id", "message", start.alias("start_line"), F.when(ranged, F.col("start_character")).otherwise(0).alias("start_character"), F.greatest(F.coalesce(F.col("end_line") - 1, start), start).alias("end_line"), F.when(ranged, F.col("end_character")).otherwise(999).alias("end_character"), level.alias("level"))


def at_least(findings: DataFrame, threshold: str | None) -> DataFrame:
    """At or above a severity; an unknown threshold is Medium."""
    ranks = dict(zip(reversed(SEVERITIES), range(1, 5), strict=True))
    return findings.where(severity_rank(F.col("severity")) >= ranks.get(threshold, 2))


def first_wins(findings: DataFrame, keys=("file_path", "rule_id", "line", "vuln_type"), order=("ord",)) -> DataFrame:
    """The first of equal findings; those without a rule id all stay."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return findings.withColumn("_n", F.when(F.coalesce("rule_id", F.lit("")) == "", 1).otherwise(n)).where("_n = 1").drop("_n")


def best_of_group(findings: DataFrame, keys=("file_path", "line", "vuln_type"), order=("ord",), severity: str = "severity") -> DataFrame:
    """The severest of each group, ties by order."""
    w = Window.partitionBy(*keys).orderBy(severity_rank(F.col(severity), 0).desc(), *order)
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def thin_lines(findings: DataFrame, window: int, keys: list[str], line: str = "line", against: str = "last") -> DataFrame:
    """keys and the lines that stay: in rising order, a line stays if it is more than ``window`` from the last that stayed ('last') or from every one ('any').

    A fold over each group's distinct lines. It isn't a lag: what counts is what stayed, not what came before.
    """
    far = (lambda kept, x: x - F.element_at(kept, -1) > window) if against == "last" else (lambda kept, x: F.forall(kept, lambda k: F.abs(k - x) > window))
    kept = F.aggregate(
        F.array_sort(F.collect_set(F.col(line).cast("long"))),
        F.expr("cast(array() as array<bigint>)"),
        lambda acc, x: F.when((F.size(acc) == 0) | far(acc, x), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return findings.groupBy(*keys).agg(kept.alias("_kept")).select(*keys, F.explode("_kept").alias(line))


def thin_nearby(findings: DataFrame, window: int, types: list[str], against: str = "last") -> DataFrame:
    """Findings of the given types thinned by thin_lines within file, type, rule and details; all others pass."""
    keys = ["file_path", "vuln_type", "rule_id", "details"]
    mine = findings.where(F.col("vuln_type").isin(types))
    kept = thin_lines(mine, window, keys, against=against)
    first = Window.partitionBy(*keys, "line").orderBy("ord")
    mine = mine.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    cond = [mine[k].eqNullSafe(kept[k]) for k in keys] + [mine["line"] == kept["line"]]
    return mine.join(kept, cond, "left_semi").unionByName(findings.where(~F.col("vuln_type").isin(types)))


def merge_findings(found: DataFrame, more: DataFrame) -> DataFrame:
    """Findings of both by file, rule, type and line; of those in both the related locations (an array) are united, the first's other columns hold."""
    keys = ["file_path", "rule_id", "vuln_type", "line"]
    both = found.withColumn("_from", F.lit(0)).unionByName(more.withColumn("_from", F.lit(1)))
    rest = [c for c in found.columns if c not in (*keys, "related")]
    return both.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_from", "related"))), lambda x: x["related"]))).alias("related"), *[F.min_by(c, "_from").alias(c) for c in rest]).select(*found.columns)


def by_priority(findings: DataFrame, *ties: str) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "line", "message", "file_path", *ties)
