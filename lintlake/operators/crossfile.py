"""Modules: resolution, dependents, re-exports, and contracts that spread through calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import reached, settle

SUFFIXES = ("", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".py", "/index.js", "/index.ts", "/__init__.py")


def candidates(imports: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """imports (file_path, target) with ord and candidate: where a module may be, in the order in which it is looked for. Relative targets are taken from the importer's folder."""
    folder = F.regexp_replace("file_path", r"[^/]*\z", "")
    base = F.when(F.col("target").startswith("."), F.concat(folder, "target")).otherwise(F.regexp_replace("target", r"\.(?=\w)", "/"))
    # a/./b and a/x/../b, folded from the left
    parts = F.aggregate(F.split(base, "/"), F.expr("cast(array() as array<string>)"), lambda a, p: F.when(p.isin(".", ""), a).when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p))))
    return imports.withColumn("_base", F.array_join(parts, "/")).select(*imports.columns, F.posexplode(F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat("_base", s))).alias("ord", "candidate"))


def resolve(cands: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and resolved: the first candidate that is a file. files: file_path."""
    met = cands.join(files.select(F.col("file_path").alias("candidate")).distinct(), "candidate")
    return met.groupBy(*keys).agg(F.min_by("candidate", "ord").alias("resolved"))


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """file_path: what changed and its direct importers (one hop). edges: importer, imported."""
    hop = edges.join(changed.select(F.col("file_path").alias("imported")), "imported").select(F.col("importer").alias("file_path"))
    return changed.select("file_path").unionByName(hop).distinct()


def reexported(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """origin, node, depth: where exports lead through re-exports; the last of a chain is what has none itself. aliases: src, dst."""
    seen = reached(aliases, wanted.select(F.col("node").alias("origin"), "node"))
    return seen.join(aliases.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("origin", "node", "depth")


def contract_fixpoint(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """(func, param, finding): calls (caller, caller_param, callee, callee_param) carry contracts (func, param, finding) to callers until nothing is new."""
    known = contracts.select("func", "param", "finding").distinct()
    fresh = known
    calls = calls.select("caller", "caller_param", "callee", "callee_param").distinct()
    while True:
        nxt = fresh.join(calls, (F.col("func") == F.col("callee")) & (F.col("param") == F.col("callee_param"))).select(F.col("caller").alias("func"), F.col("caller_param").alias("param"), "finding").distinct()
        fresh = settle(nxt.join(known, ["func", "param", "finding"], "left_anti"))
        if not fresh.limit(1).count():
            return known
        known = known.unionByName(fresh)


def cross_file_findings(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """Calls with tainted arguments whose callee has a contract on that parameter. calls: file_path, line, start, end, callee, param, is_tainted; contracts: func, param, rule_id, vuln_type."""
    met = calls.where("is_tainted").join(contracts, (calls["callee"] == contracts["func"]) & (calls["param"] == contracts["param"]))
    return met.select("file_path", "rule_id", "vuln_type", "line", "start", "end", "callee").dropDuplicates()


def summaries(events: DataFrame) -> DataFrame:
    """func, returns_tainted, tainted_params: from ordered events (func, ord, kind, name, refs array).

    kind: param (name), assign (name, refs), clean (name), return (refs). One fold per function keeps, for each variable, the set of parameters that it carries ('*' is a source).
    """
    empty = F.expr("cast(map() as map<string,array<string>>)")
    start = F.struct(empty.alias("vars"), F.expr("cast(array() as array<string>)").alias("out"))
    carried = lambda state, refs: F.array_distinct(F.flatten(F.transform(refs, lambda r: F.coalesce(F.element_at(state["vars"], r), F.when(r == "*", F.array(r)), F.expr("cast(array() as array<string>)")))))
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))

    def step(s, e):
        value = F.when(e["kind"] == "param", F.array(e["name"])).when(e["kind"] == "assign", carried(s, e["refs"])).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.when(e["kind"] == "return", s["vars"]).otherwise(put(s["vars"], F.coalesce(e["name"], F.lit("")), value)).alias("vars"), F.when(e["kind"] == "return", F.array_union(s["out"], carried(s, e["refs"]))).otherwise(s["out"]).alias("out"))

    got = events.groupBy("func").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("ord", "kind", "name", "refs"))), start, step, lambda s: s["out"]).alias("out"))
    return got.select("func", F.array_contains("out", "*").alias("returns_tainted"), F.array_sort(F.filter("out", lambda x: x != "*")).alias("tainted_params"))


IMPORTS = (r"""(?:import|export)\s[^'"\n;]*?from\s*['"]([^'"]+)['"]""", r"""(?:require|import)\s*\(\s*['"]([^'"]+)['"]""", r"""(?m)^\s*import\s*['"]([^'"]+)['"]""")
PY_IMPORTS = (r"(?m)^\s*from\s+([.\w]+)\s+import\b", r"(?m)^\s*import\s+([\w.]+)")


def import_targets(files: DataFrame, code: str = "code") -> DataFrame:
    """(file_path, target) by regular expressions on the text, for JavaScript and Python."""
    js = F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(r), 1) for r in IMPORTS]))
    py = F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(r), 1) for r in PY_IMPORTS]))
    return files.select("file_path", F.explode(F.array_distinct(F.when(F.col("language") == "python", py).otherwise(js))).alias("target"))


def export_hash(code: F.Column) -> F.Column:
    """What importers see of a file: md5 of its stripped lines that export or define."""
    lines = F.filter(F.transform(F.split(code, "\n"), F.trim), lambda x: x.rlike(r"\A(?:export|def|class|function|public|func|module\.exports)"))
    return F.md5(F.array_join(lines, "\n"))
