"""Paths and dominators over edge tables, as joins with materialised rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_NODES = 20  #: of a path


def settle(df: DataFrame) -> DataFrame:
    """df through the shared checkpoint folder; where none is set (tests), through memory and disk."""
    spark = df.sparkSession
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        return df.persist()
    path = f"{there}/lintlake-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def simple_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """path (array of nodes), n_nodes: all simple paths from a source to a sink that end at the first sink they meet after their start.

    edges: src, dst; sources, sinks: node. A round adds an edge to every open path; paths at a sink are closed.
    """
    edges = edges.select("src", "dst").distinct()
    if max_nodes < 2:
        return sources.select(F.array("node").alias("path"), F.lit(1).alias("n_nodes")).where(F.lit(False))
    ends = sinks.select("node").distinct().withColumn("is_sink", F.lit(True))
    open_ = sources.select("node").distinct().select(F.array("node").alias("path"), F.col("node").alias("at"))
    done = None
    for _ in range(max_nodes - 1):
        step = open_.join(edges, open_["at"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")).join(ends, F.col("at") == ends["node"], "left").select("path", "at", F.coalesce("is_sink", F.lit(False)).alias("is_sink"))
        step = settle(step)
        closed = step.where("is_sink").select("path")
        done = closed if done is None else done.unionByName(closed)
        open_ = step.where("not is_sink").select("path", "at")
        if not open_.limit(1).count():
            break
    return done.withColumn("n_nodes", F.size("path"))


def sanitised(paths: DataFrame, cleaners: DataFrame) -> DataFrame:
    """paths with is_sanitised, risk and confidence: a cleaner between the ends makes a path low risk."""
    inner = paths.withColumn("_id", F.monotonically_increasing_id())
    hit = inner.select("_id", F.explode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))).alias("node")).join(cleaners.select("node").distinct(), "node").select("_id").distinct().withColumn("is_sanitised", F.lit(True))
    out = inner.join(hit, "_id", "left").drop("_id").withColumn("is_sanitised", F.coalesce("is_sanitised", F.lit(False)))
    return out.withColumns({"risk": F.when(F.col("is_sanitised"), "Low").otherwise("High"), "confidence": F.when(F.col("is_sanitised"), 0.3).otherwise(0.9)})


def shortest(paths: DataFrame) -> DataFrame:
    """The shortest path between each pair of ends, ties by the nodes."""
    w = Window.partitionBy("source", "sink").orderBy("n_nodes", "path")
    ends = paths.withColumns({"source": F.element_at("path", 1), "sink": F.element_at("path", -1)})
    return ends.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_per_sink(paths: DataFrame, of: list[str] = ()) -> DataFrame:
    """The first open path of each sink (and category): what a rule reports."""
    w = Window.partitionBy(F.element_at("path", -1), *of).orderBy("n_nodes", "path")
    return paths.where("not is_sanitised").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reached(edges: DataFrame, start: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, origin, node, depth): all nodes that origins reach, with the fewest steps; semi-naive. start: keys, origin, node."""
    keys = list(keys)
    seen = start.select(*keys, "origin", "node").distinct().withColumn("depth", F.lit(0))
    fresh, depth = seen, 0
    edges = edges.select(*keys, "src", "dst").distinct()
    while True:
        depth += 1
        nxt = fresh.join(edges, [*[fresh[k] == edges[k] for k in keys], fresh["node"] == edges["src"]]).select(*[fresh[k] for k in keys], "origin", F.col("dst").alias("node")).distinct()
        fresh = settle(nxt.join(seen.select(*keys, "origin", "node"), [*keys, "origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not fresh.limit(1).count():
            return seen
        seen = seen.unionByName(fresh)


def back_to_source(edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """node, source, depth: the nearest source upstream of each node, ties by name.

    All sources spread along the edges at once, and a node keeps the first that comes to it: of those that come in the same round the smallest. A round holds
    new nodes only, so that the work grows with the edges, not with the nodes times what lies upstream of them.
    """
    edges = settle(edges.select("src", "dst").distinct())
    seen = fresh = settle(sources.select("node").where("node is not null").distinct().select("node", F.col("node").alias("source"), F.lit(0).alias("depth")))
    depth = 0
    while fresh.limit(1).count():
        depth += 1
        came = fresh.join(edges, fresh["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("source").alias("source"))
        fresh = settle(came.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(fresh)
    return nodes.select("node").distinct().join(seen, "node").select("node", "source", "depth")


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(graph, a, b): a dominates b, itself included. edges: graph, src, dst; entries: graph, node.

    By definition, in sets: b's dominators are b and what dominates all its predecessors that the entry reaches. Sets shrink until none changes.
    """
    live = reached(edges, entries.select("graph", F.col("node").alias("origin"), "node"), ["graph"]).select("graph", "node").distinct()
    live = settle(live)
    e = edges.join(live.select("graph", F.col("node").alias("src")), ["graph", "src"]).join(live.select("graph", F.col("node").alias("dst")), ["graph", "dst"]).select("graph", "src", "dst").distinct()
    e = e.join(entries.select("graph", F.col("node").alias("dst")), ["graph", "dst"], "left_anti")
    everything = live.groupBy("graph").agg(F.array_sort(F.collect_set("node")).alias("all"))
    start = live.join(everything, "graph").join(entries.withColumn("is_entry", F.lit(True)), ["graph", "node"], "left")
    dom = settle(start.select("graph", "node", F.when(F.col("is_entry"), F.array("node")).otherwise(F.col("all")).alias("dom")))
    while True:
        per = e.join(dom.select("graph", F.col("node").alias("src"), "dom"), ["graph", "src"]).groupBy("graph", F.col("dst").alias("node")).agg(F.collect_list("dom").alias("doms"))
        common = F.aggregate(F.slice("doms", F.lit(2), F.size("doms")), F.element_at("doms", 1), lambda a, x: F.array_intersect(a, x))
        new = dom.join(per, ["graph", "node"], "left").select("graph", "node", F.when(F.col("doms").isNull(), F.col("dom")).otherwise(F.array_sort(F.array_union(common, F.array("node")))).alias("dom"), F.col("dom").alias("old"))
        new = settle(new)
        moved = new.where(F.size("dom") < F.size("old")).limit(1).count()
        dom = new.select("graph", "node", "dom")
        if not moved:
            return dom.select("graph", F.explode("dom").alias("a"), F.col("node").alias("b"))


def immediate(dom: DataFrame) -> DataFrame:
    """(graph, node, idom): of a node's strict dominators the one that most dominate."""
    depth = dom.groupBy("graph", F.col("b").alias("a")).agg(F.count(F.lit(1)).alias("depth"))
    strict = dom.where("a <> b").join(depth, ["graph", "a"])
    return strict.groupBy("graph", F.col("b").alias("node")).agg(F.max_by("a", "depth").alias("idom"))


def frontier(dom: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, at): where the dominance of a node ends."""
    met = dom.join(edges.select("graph", F.col("src").alias("b"), F.col("dst").alias("at")), ["graph", "b"]).select("graph", F.col("a").alias("node"), "at").distinct()
    strict = dom.where("a <> b").select("graph", F.col("a").alias("node"), F.col("b").alias("at"))
    return met.join(strict, ["graph", "node", "at"], "left_anti")


def guarded(dom: DataFrame, edges: DataFrame, guards: DataFrame, exits: DataFrame) -> DataFrame:
    """(graph, guard, node): what a guard's successors that don't leave dominate."""
    inner = edges.join(guards.select("graph", F.col("node").alias("src")), ["graph", "src"]).join(exits.select("graph", F.col("node").alias("dst")), ["graph", "dst"], "left_anti")
    return inner.join(dom.select("graph", F.col("a").alias("dst"), F.col("b").alias("node")), ["graph", "dst"]).select("graph", F.col("src").alias("guard"), "node").distinct()


def guard_chain(guards: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, src, dst, is_exit): guards in order, each with an edge to the next and one out."""
    w = Window.partitionBy(*keys).orderBy(order)
    chain = guards.withColumn("dst", F.lead(order).over(w)).where("dst is not null").select(*keys, F.col(order).alias("src"), "dst", F.lit(False).alias("is_exit"))
    return chain.unionByName(guards.select(*keys, F.col(order).alias("src"), (-F.col(order)).alias("dst"), F.lit(True).alias("is_exit")))


def stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), *[F.count_if(F.col("node_type") == k).alias(f"{k}s") for k in ("source", "sink", "sanitizer")], F.count_if("is_tainted").alias("tainted"))
