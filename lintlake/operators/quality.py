"""Quality of findings against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dims import SEVERITIES


def severity_counts(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """One row per severity, those without findings too; all other values are 'Unknown'."""
    known = F.when(F.col(severity).isin(*SEVERITIES), F.col(severity)).otherwise("Unknown")
    counts = findings.groupBy(known.alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    every = findings.sparkSession.createDataFrame([(s,) for s in (*SEVERITIES, "Unknown")], "severity string")
    return every.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def confusion(rows: DataFrame, expected: Column, found: Column, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn overall and by each of, and all, the given columns, in one pass (grouping sets); a null column is 'all'. The level counts the columns that are set."""
    a, b = by
    sets = rows.select(*by, expected.alias("_e"), found.alias("_f"))
    agg = [F.count_if(F.expr(x)).alias(n) for n, x in (("tp", "_e and _f"), ("fp", "not _e and _f"), ("fn", "_e and not _f"), ("tn", "not _e and not _f"))]
    return sets.groupingSets([[], [F.col(a)], [F.col(b)], [F.col(a), F.col(b)]], F.col(a), F.col(b)).agg(*agg, F.grouping_id().alias("level"))


def metrics(counts: DataFrame) -> DataFrame:
    """recall, precision, fpr and f1, rounded to 4 places; 0 where there is nothing to divide by."""
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return counts.withColumns({"recall": F.round(recall, 4), "precision": F.round(precision, 4), "fpr": F.round(ratio(fp, fp + tn), 4), "f1": F.round(ratio(2 * precision * recall, precision + recall), 4)})


def gates(counts: DataFrame, limits: DataFrame, on: list[str]) -> DataFrame:
    """What breaks its limits: min_tp, max_fp, max_fn, min_tn; a null limit holds always."""
    met = counts.join(limits, on)
    broken = F.array(*[F.when(F.expr(x), F.lit(n)) for n, x in (("tp", "tp < min_tp"), ("fp", "fp > max_fp"), ("fn", "fn > max_fn"), ("tn", "tn < min_tn"))])
    return met.withColumn("broken", F.array_join(F.filter(broken, lambda x: x.isNotNull()), ",")).withColumn("passed", F.col("broken") == "")


def compare(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """by, both, only_a, only_b: counts of distinct keys, in one aggregation of the union instead of three set operations."""
    sides = a.select(*keys).distinct().withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(b.select(*keys).distinct().withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    per = sides.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return per.groupBy(by).agg(F.count_if(F.expr("_a = 1 and _b = 1")).alias("both"), F.count_if(F.expr("_b = 0")).alias("only_a"), F.count_if(F.expr("_a = 0")).alias("only_b"))


def exit_code(errors: Column, findings: Column, suppressed: bool = False) -> Column:
    return F.when(errors > 0, 2).when((findings > 0) & ~F.lit(suppressed), 1).otherwise(0)


def scan_totals(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files (file_path, reason), those scanned (no reason), those with findings, and findings. Counts by file come before the join."""
    per = findings.groupBy("file_path").agg(F.count(F.lit(1)).alias("_n"))
    met = files.select("file_path", "reason").join(per, "file_path", "left")
    return met.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("reason").isNull()).alias("scanned"), F.count("_n").alias("with_issues"), F.coalesce(F.sum("_n"), F.lit(0)).alias("issues"))
