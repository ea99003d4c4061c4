"""Working on what has changed: snapshots, functions, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FULL_ABOVE = 0.6  #: share of changed functions above which the whole file is scanned


def changed_files(old: DataFrame, new: DataFrame, key: str = "file_path", hash_: str = "hash") -> DataFrame:
    """key, change (added, removed, changed, same) of two snapshots."""
    a, b = old.select(key, F.col(hash_).alias("_a"), F.lit(True).alias("_old")), new.select(key, F.col(hash_).alias("_b"), F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def scan_modes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, mode, changed (names) from functions of two versions (file_path, name, hash, file_hash).

    reuse: the text is equal. full: none, or more than FULL_ABOVE of the functions changed, or one is gone. partial: the rest.
    """
    a = old.select("file_path", "name", F.col("hash").alias("ha"), F.col("file_hash").alias("fa"))
    b = new.select("file_path", "name", F.col("hash").alias("hb"), F.col("file_hash").alias("fb"))
    met = a.join(b, ["file_path", "name"], "full_outer")
    per = met.groupBy("file_path").agg(F.max("fa").alias("fa"), F.max("fb").alias("fb"), F.count_if(F.expr("hb is null")).alias("gone"), F.count("hb").alias("n"), F.array_sort(F.collect_set(F.when(F.col("hb").isNotNull() & ~F.col("ha").eqNullSafe(F.col("hb")), F.col("name")))).alias("changed"))
    mode = F.when(F.col("fa") == F.col("fb"), "reuse").when((F.size("changed") == 0) | (F.col("gone") > 0) | (F.size("changed") > FULL_ABOVE * F.col("n")), "full").otherwise("partial")
    return per.select("file_path", mode.alias("mode"), "changed")


def partial_source(code: F.Column, spans: F.Column) -> F.Column:
    """The text with all lines blank but imports and the spans (array of struct<start, end>, 1-based), so that numbers of lines hold."""
    keep = lambda line, i: F.exists(spans, lambda s: (i + 1 >= s["start"]) & (i + 1 <= s["end"])) | line.rlike(r"\A\s*(?:import\b|from\s+\S+\s+import\b|(?:const|let|var)\s.*\brequire\s*\(|use\s|package\s|#include)")
    return F.array_join(F.transform(F.split(code, "\n"), lambda line, i: F.when(keep(line, i), line).otherwise("")), "\n")


def shifted(findings: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Cached findings (file_path, name, line, …) moved by as much as their function's start did; functions that are gone take theirs along."""
    moved = old.select("file_path", "name", F.col("start").alias("_from")).join(new.select("file_path", "name", F.col("start").alias("_to")), ["file_path", "name"])
    return findings.join(moved, ["file_path", "name"]).withColumn("line", F.col("line") + F.col("_to") - F.col("_from")).drop("_from", "_to").select(*findings.columns)


def cache_key(path: F.Column, code: F.Column, rules_hash: str) -> F.Column:
    return F.concat_ws("_", F.md5(path), F.md5(code), F.lit(rules_hash[:12]))


def probe(files: DataFrame, cache: DataFrame, now: F.Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): entries of the cache (cache_key, cached_at, …) younger than its lifetime, and the files that have none."""
    live = cache.where(F.col("cached_at") > now - F.make_dt_interval(hours=F.lit(hours)))
    return files.join(live, "cache_key"), files.join(live.select("cache_key"), "cache_key", "left_anti")


def on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on changed lines (file_path, line); files of which no changed line is known keep all of theirs."""
    known = changed.select("file_path").distinct().withColumn("_known", F.lit(True))
    hit = changed.select("file_path", "line").distinct().withColumn("_hit", F.lit(True))
    return findings.join(known, "file_path", "left").join(hit, ["file_path", "line"], "left").where("_known is null or _hit").select(*findings.columns)
