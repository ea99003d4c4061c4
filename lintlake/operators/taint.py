"""Taint graphs: assignments to nodes and edges, sinks' arguments, and what reaches what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import node_id
from ..plans.registry import PATTERNS
from .graph import first_per_sink, sanitised, simple_paths
from .match import first_registered

ASSIGNMENT = {
    "php": r"^\s*(\$\w+)\s*=(?![=>])\s*(.+?);?\s*$",
    "go": r"^\s*(?:var\s+)?(\w+)(?:\s*,\s*\w+)*\s*:?=(?!=)\s*(.+?)\s*$",
    "java": r"^\s*(?:(?:final\s+)?[\w.<>\[\]]+\s+)?(\w+)\s*=(?!=)\s*(.+?);?\s*$",
    "other": r"^\s*(?:const\s+|let\s+|var\s+)?([\w$.]+)\s*=(?![=>~])\s*(.+?);?\s*$",
}


def assignments(lines: DataFrame) -> DataFrame:
    """file_path, language, line, lhs, rhs of assignments, a line each (file_path, language, line, line_text)."""
    out = None
    for language, r in ASSIGNMENT.items():
        mine = F.col("language") == language if language != "other" else ~F.col("language").isin("php", "go", "java")
        x = lines.where(mine & F.col("line_text").rlike(r)).select("file_path", "language", "line", F.regexp_extract("line_text", r, 1).alias("lhs"), F.regexp_extract("line_text", r, 2).alias("rhs"))
        out = x if out is None else out.unionByName(x)
    return out


def nodes(assigns: DataFrame, calls: DataFrame, patterns=PATTERNS) -> DataFrame:
    """id, name, node_type (source, sanitizer, variable, sink), file_path, line, pattern.

    A variable that is cleaned is a sanitizer, else one that takes input a source. calls (file_path, language, line, text): those that fit a sink. patterns: the registry, or one that extends it.
    """
    cleaner, source, sink = (lambda c, k=k: first_registered(F.col(c), F.col("language"), patterns, k) for k in ("sanitizer", "source", "sink"))
    kind = F.when(F.col("cleaner").isNotNull(), "sanitizer").when(F.col("source").isNotNull(), "source").otherwise("variable")
    a = assigns.withColumns({"cleaner": cleaner("rhs"), "source": source("rhs")}).select(node_id(F.col("file_path"), F.col("line"), F.lit(0), F.col("lhs")).alias("id"), F.col("lhs").alias("name"), kind.alias("node_type"), "file_path", "line", F.coalesce("cleaner", "source").alias("pattern"), F.col("rhs").alias("text"))
    s = calls.withColumn("pattern", sink("text")).where("pattern is not null").select(node_id(F.col("file_path"), F.col("line"), F.lit(1), F.col("pattern")).alias("id"), F.col("pattern").alias("name"), F.lit("sink").alias("node_type"), "file_path", "line", "pattern", "text")
    return a.unionByName(s).dropDuplicates(["id"])


def edges(nodes: DataFrame, whole_words: bool = False) -> DataFrame:
    """src, dst: from each variable's latest definition above to nodes whose text holds its name (as a substring, or as a whole word).

    Per file, an equi-join on it; the latest definition by a window, so that a pair comes once.
    """
    d, u = nodes.where("node_type <> 'sink'").alias("d"), nodes.alias("u")
    holds = F.expr("u.text rlike concat('(?<![\\\\w$])\\\\Q', d.name, '\\\\E(?![\\\\w$])')") if whole_words else F.expr("contains(u.text, d.name)")
    met = u.join(d, F.expr("u.file_path = d.file_path and d.line < u.line") & holds)
    latest = Window.partitionBy("u.id", "d.name").orderBy(F.desc("d.line"), "d.id")
    return met.select(F.col("d.id").alias("src"), F.col("u.id").alias("dst"), F.row_number().over(latest).alias("n")).where("n = 1").drop("n")


def paths(nodes: DataFrame, edges: DataFrame, max_nodes: int = 20) -> DataFrame:
    """All simple paths from sources to sinks with is_sanitised, risk, confidence."""
    pick = lambda k: nodes.where(F.col("node_type") == k).select(F.col("id").alias("node"))
    return sanitised(simple_paths(edges, pick("source"), pick("sink"), max_nodes), pick("sanitizer"))


def findings(nodes: DataFrame, paths: DataFrame, per_sink: bool = True) -> DataFrame:
    """file_path, line, name, risk of open paths, one per sink or one per path."""
    found = first_per_sink(paths) if per_sink else paths.where("not is_sanitised")
    return found.withColumn("id", F.element_at("path", -1)).join(nodes.select("id", "file_path", "line", "name"), "id").select("file_path", "line", "name", "risk", "path")


def tracked(assigns: DataFrame) -> DataFrame:
    """file_path, tainted (names) after all assignments in order: input taints, a cleaner cleans, a copy or a text that holds a tainted name passes it on, all else clears. A fold per file."""
    with_kind = assigns.withColumns({"clean": first_registered(F.col("rhs"), F.col("language"), PATTERNS, "sanitizer").isNotNull(), "source": first_registered(F.col("rhs"), F.col("language"), PATTERNS, "source").isNotNull()})

    def step(names, e):
        rest = F.filter(names, lambda n: n != e["lhs"])
        dirty = ~e["clean"] & (e["source"] | F.exists(names, lambda n: F.contains(e["rhs"], n)))
        return F.when(dirty, F.array_union(rest, F.array(e["lhs"]))).otherwise(rest)

    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("line", "lhs", "rhs", "clean", "source"))), F.expr("cast(array() as array<string>)"), step)
    return with_kind.groupBy("file_path").agg(F.array_sort(folded).alias("tainted"))
