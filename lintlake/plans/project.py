"""What a scan of a whole project finds beyond single files: calls into other files, and paths of the taint graph; and scans of what has changed alone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import crossfile, incremental, pyfacts, sast, taint
from ..operators.graph import settle
from ..operators.match import first_registered, lines_of
from .dims import literal_map
from .registry import PATTERNS
from .sinks import SOURCES

GRAPH_NODES = 8  #: of a path in the taint graph

# Categories of the registry's sinks, and the types that findings have.
CATEGORY_TYPES = {"RCE": "RCE_COMMAND_EXEC", "XSS": "XSS_RISK", "COMMAND_INJECTION": "RCE_COMMAND_EXEC", "REDIRECT": "OPEN_REDIRECT"}


def _module_functions(facts: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, alias, member (null: the whole module), module_path: what imported names of Python files mean, for modules that are files here."""
    imports = facts.where("kind = 'import'").select("file_path", F.col("name").alias("alias"), F.split("target", ":").alias("t"))
    imports = imports.select("file_path", "alias", F.get("t", F.lit(0)).alias("module"), F.get("t", F.lit(1)).alias("member"))
    # from . import x names a module or a member of the package
    dots = F.length(F.regexp_extract("module", r"\A\.*", 0))
    up = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    rest = F.regexp_replace(F.regexp_replace("module", r"\A\.+", ""), r"\.", "/")
    target = F.when(dots > 0, F.concat(up, rest)).otherwise(F.col("module"))
    whole = imports.select("file_path", "alias", "member", target.alias("target"))
    inner = imports.where("member is not null").select("file_path", "alias", F.lit(None).cast("string").alias("member"), F.concat(target, F.when(rest == "", F.lit("")).otherwise(F.lit("/")), "member").alias("target"))
    both = whole.unionByName(inner)
    # a module beside the importer, or below the root
    beside = both.where("target not like '.%'").withColumn("target", F.concat(F.lit("./"), F.replace("target", F.lit("."), F.lit("/"))))
    cands = crossfile.candidates(both.unionByName(beside).distinct(), ("", ".py", "/__init__.py"))
    keys = ["file_path", "alias", "member"]
    met = cands.join(files.select(F.col("file_path").alias("candidate")).distinct(), "candidate")
    return met.groupBy(*keys, "target").agg(F.min_by("candidate", "ord").alias("module_path")).select(*keys, "module_path").distinct()


def _carries(args: Column, tainted: Column) -> Column:
    """Whether an argument names input, or a variable that carries it."""
    return args.rlike(SOURCES["python"]) | F.coalesce(F.exists(tainted, lambda n: F.array_contains(F.regexp_extract_all(args, F.lit(r"[A-Za-z_]\w*"), F.lit(0)), n)), F.lit(False))


def cross_file(files: DataFrame) -> DataFrame:
    """file_path, line, rule_id, vuln_type, severity, message of calls that hand input to a parameter of another file's function which does harm with it.

    Contracts say which parameters do; where a function hands a parameter on to such a function, the contract spreads to it, until nothing is new. Everything is
    an equi-join on the file and the name of a function. Python's parser gives the calls, so that calls are Python's.
    """
    python = files.where("language = 'python'").select("file_path", "language", "code")
    facts = pyfacts.python_facts(python)
    own = sast.parameter_contracts(python).select(F.concat_ws("::", "file_path", "func").alias("func"), F.col("position").alias("param"), F.struct("rule_id", "vuln_type").alias("finding"))
    defined = pyfacts.functions(facts).select("file_path", F.col("name").alias("func"), "params", "start", "end")
    names = _module_functions(facts, python)
    calls = facts.where("kind = 'call'").select("file_path", F.col("name").alias("caller"), "target", "args", F.col("start").alias("line"), "end")
    calls = calls.withColumns({"alias": F.substring_index("target", ".", 1), "rest": F.nullif(F.expr("substring(target, length(substring_index(target, '.', 1)) + 2)"), F.lit(""))})
    abroad = calls.join(names, ["file_path", "alias"]).withColumn("name", F.when(F.col("member").isNotNull() & F.col("rest").isNull(), F.col("member")).when(F.col("member").isNull(), F.col("rest"))).where("name is not null")
    abroad = abroad.select("file_path", "caller", F.concat_ws("::", "module_path", "name").alias("callee"), "args", "line", "end", F.lit(True).alias("abroad"))
    local = calls.join(defined.select("file_path", F.col("func").alias("target")).distinct(), ["file_path", "target"])
    local = local.select("file_path", "caller", F.concat_ws("::", "file_path", "target").alias("callee"), "args", "line", "end", F.lit(False).alias("abroad"))
    given = abroad.unionByName(local).select("file_path", "caller", "callee", "line", "end", "abroad", F.posexplode("args").alias("param", "arg"))
    # a caller's parameter that is handed on as it is
    handed = given.join(defined.select("file_path", F.col("func").alias("caller"), "params"), ["file_path", "caller"])
    handed = handed.withColumn("at", F.array_position("params", F.trim("arg"))).where("at > 0")
    handed = handed.select(F.concat_ws("::", "file_path", "caller").alias("caller"), (F.col("at") - 1).cast("int").alias("caller_param"), "callee", F.col("param").alias("callee_param"))
    contracts = crossfile.contract_fixpoint(handed, own).select("func", "param", "finding.rule_id", "finding.vuln_type")
    tainted = taint.tracked(taint.assignments(lines_of(python)))
    open_ = given.where("abroad").join(tainted, "file_path", "left").withColumn("is_tainted", _carries(F.col("arg"), F.col("tainted")))
    found = crossfile.cross_file_findings(open_.select("file_path", "line", F.col("line").alias("start"), "end", "callee", "param", "is_tainted"), contracts)
    said = F.concat(F.lit("Input goes to "), F.replace("callee", F.lit("::"), F.lit(": ")), F.lit(", which does harm with it."))
    return found.groupBy("file_path", "line", "rule_id", "vuln_type").agg(F.min("callee").alias("callee")).select("file_path", "line", F.concat(F.lit("XF_"), "rule_id").alias("rule_id"), "vuln_type", F.lit("High").alias("severity"), said.alias("message"))


def taint_graph(files: DataFrame, extra: Iterable[tuple] = (), max_nodes: int = GRAPH_NODES) -> DataFrame:
    """file_path, line, rule_id, vuln_type, severity, message of sinks that the taint graph reaches from a source without a cleaner between. extra: more rows of the registry, which come last."""
    patterns = [*PATTERNS, *extra]
    lines = lines_of(files.select("file_path", "language", "code"))
    nodes = settle(taint.nodes(taint.assignments(lines), lines.select("file_path", "language", "line", F.col("line_text").alias("text")), patterns))
    paths = taint.paths(nodes, settle(taint.edges(nodes, whole_words=True)), max_nodes)
    found = taint.findings(nodes, paths)
    sinks = {p[1]: (CATEGORY_TYPES.get(p[5], p[5] or "OTHER"), p[6] or "Medium") for p in reversed(patterns) if p[0] == "sink"}
    kind, severity = (F.element_at(literal_map({k: v[i] for k, v in sinks.items()}), F.col("name")) for i in (0, 1))
    return found.select("file_path", "line", F.concat(F.lit("GRAPH_"), F.upper("name")).alias("rule_id"), kind.alias("vuln_type"), severity.alias("severity"), F.lit("Input reaches a dangerous call.").alias("message"))


def incremental_scan(files: DataFrame, entries: DataFrame, cached: DataFrame, rules_hash: str, now: Column, scan, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(findings, entries) of files (file_path, language, code), of which those with a live entry are not scanned again.

    entries: cache_key, cached_at; cached: cache_key and the columns of findings. Both results carry cache_key, so they are the next run's cache: findings of files that
    are gone or changed are left behind. scan: files -> findings.
    """
    keyed = files.withColumn("cache_key", incremental.cache_key(F.col("file_path"), F.col("code"), rules_hash))
    hits, misses = incremental.probe(keyed, entries, now, hours)
    names = [c for c in cached.columns if c != "cache_key"]
    fresh = scan(misses.drop("cache_key")).join(misses.select("file_path", "cache_key"), "file_path").select("cache_key", *names)
    kept = cached.join(hits.select("cache_key").distinct(), "cache_key", "left_semi").select("cache_key", *names)
    known = hits.select("cache_key", "cached_at").unionByName(misses.select("cache_key", now.alias("cached_at"))).distinct()
    return kept.unionByName(fresh), known


def registered(text: Column, language: Column, kind: str, extra: Iterable[tuple] = ()) -> Column:
    """The first pattern of the registry, and of what extends it, that fits a text."""
    return first_registered(text, language, [*PATTERNS, *extra], kind)
