"""More of the engine's operators as queries, over findings, lines of C and graphs made from the standard tables, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import cpp, crossfile, enrich, findings, graph, incremental, joins, match, quality, suppress, taint
from ..session import table
from ..sinks import reports
from ..sources import files
from .queries import CFG_SQL, DOM_SQL, LINES_SQL, SEV_CASE, _cfg, _dom, _lines, _severity, query

TYPES = ("XSS_RISK", "SQL_INJECTION", "SSRF", "OTHER")
FE = f"""fe as (select event_id as ord, 'src/f' || (user_id % 50) || '.py' as file_path, event_id % 97 + 1 as line, 'R' || (event_id % 5) as rule_id,
  case event_id % 4 when 0 then 'XSS_RISK' when 1 then 'SQL_INJECTION' when 2 then 'SSRF' else 'OTHER' end as vuln_type, {SEV_CASE} as severity, event_type as message, 'd' || (event_id % 3) as details from events)"""
RANK = "case severity when 'Critical' then 4 when 'High' then 3 when 'Medium' then 2 when 'Low' then 1 else 2 end"


def _fe(spark, d) -> DataFrame:
    """Findings, one from each event."""
    text = lambda c: c.cast("string")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("event_id") % 4).cast("int") + 1)
    return table(spark, d, "events").select(
        F.col("event_id").alias("ord"), F.concat(F.lit("src/f"), text(F.col("user_id") % 50), F.lit(".py")).alias("file_path"), (F.col("event_id") % 97 + 1).alias("line"), F.concat(F.lit("R"), text(F.col("event_id") % 5)).alias("rule_id"),
        kind.alias("vuln_type"), _severity().alias("severity"), F.col("event_type").alias("message"), F.concat(F.lit("d"), text(F.col("event_id") % 3)).alias("details"))


def _values(spark, names: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, names)


def _sql_values(rows: list[tuple]) -> str:
    quoted = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


# --- findings ---


@query(f"with {FE} select ord, severity from fe where {RANK} >= 3")
def at_least_high(spark, d):
    return findings.at_least(_fe(spark, d), "High").select("ord", "severity")


@query(f"with {FE} select ord, vuln_type from fe where severity in ('Critical', 'Low')")
def reviewed_severities(spark, d):
    return enrich.of_severities(_fe(spark, d), ["Critical", "Low"]).select("ord", "vuln_type")


@query(f"with {FE} select severity as risk, count(*) as n, count(*) filter (where ord % 2 = 0) as confirmed, count(*) filter (where ord % 3 = 0) as to_review from fe group by 1")
def review_counts(spark, d):
    return enrich.review_summary(_fe(spark, d).select(F.col("severity").alias("risk"), (F.col("ord") % 2 == 0).alias("is_real"), (F.col("ord") % 3 == 0).alias("needs_review")))


@query(f"with {FE} select vuln_type, count(*) as n from fe group by 1")
def type_counts(spark, d):
    return enrich.by_type(_fe(spark, d))


@query(f"with {FE} select vuln_type, file_path, count(*) as n, max({RANK}) as worst from fe group by grouping sets ((vuln_type), (vuln_type, file_path))")
def tree_rollup(spark, d):
    return enrich.type_tree(_fe(spark, d)).select("vuln_type", "file_path", "n", "worst")


@query(f"with {FE} select ord, severity, line from fe order by {RANK} desc, line, message, file_path, ord limit 20")
def topk_findings(spark, d):
    """The report of the first 20: the limit is the feature."""
    return findings.by_priority(_fe(spark, d), "ord").limit(20).select("ord", "severity", "line")


@query(f"with {FE} select ord, file_path, line, vuln_type from (select *, row_number() over (partition by file_path, line, vuln_type order by case when severity = 'odd' then 0 else {RANK} end desc, ord) as n from fe) where n = 1")
def best_of_group(spark, d):
    return findings.best_of_group(_fe(spark, d)).select("ord", "file_path", "line", "vuln_type")


@query(f"with {FE}, b as (select * replace (case when ord % 9 = 0 then '' else rule_id end as rule_id) from fe) select ord from (select *, row_number() over (partition by file_path, rule_id, line, vuln_type order by ord) as n from b) where n = 1 or rule_id = ''")
def first_reported(spark, d):
    f = _fe(spark, d).withColumn("rule_id", F.when(F.col("ord") % 9 == 0, "").otherwise(F.col("rule_id")))
    return findings.first_wins(f).select("ord")


@query(f"""with recursive {FE}, g as (select distinct file_path, vuln_type, rule_id, details, line from fe where vuln_type = 'XSS_RISK'),
  kept as (select file_path, vuln_type, rule_id, details, min(line) as line from g group by all union all
    select file_path, vuln_type, rule_id, details, line from (select k.file_path, k.vuln_type, k.rule_id, k.details, min(g.line) as line from kept k join g on g.file_path = k.file_path and g.rule_id = k.rule_id and g.details = k.details and g.line > k.line + 6 group by k.file_path, k.vuln_type, k.rule_id, k.details, k.line))
  select min(f.ord) as ord from fe f join kept k using (file_path, vuln_type, rule_id, details, line) group by file_path, vuln_type, rule_id, details, line union all select ord from fe where vuln_type <> 'XSS_RISK'""")
def thinned_nearby(spark, d):
    return findings.thin_nearby(_fe(spark, d), 6, ["XSS_RISK"], against="any").select("ord")


@query(f"""with {FE}, a as (select * from fe where ord % 3 <> 0), b as (select * from fe where ord % 2 = 0), u as (select 0 as s, * from a union all select 1, * from b)
  select file_path, rule_id, vuln_type, line, count(distinct ord % 7) as n_related from u group by all""")
def merged_findings(spark, d):
    names = ["file_path", "rule_id", "vuln_type", "line"]
    f = _fe(spark, d).withColumn("related", F.array((F.col("ord") % 7).cast("string")))
    got = findings.merge_findings(f.where("ord % 3 <> 0").select(*names, "related"), f.where("ord % 2 = 0").select(*names, "related"))
    return got.select(*names, F.size("related").cast("long").alias("n_related"))


@query(f"""with {FE} select ord, greatest(line - 1, 0) as start_line, case when ord % 4 = 0 then ord % 10 else 0 end as start_character, greatest(line + 1, line - 1) as end_line, case when ord % 4 = 0 then ord % 10 + 5 else 999 end as end_character,
  case severity when 'Critical' then 1 when 'High' then 1 when 'Medium' then 2 when 'Low' then 3 else 2 end as level from fe""")
def editor_positions(spark, d):
    f = _fe(spark, d).withColumns({"message": F.col("ord").cast("string"), "start_line": F.lit(None).cast("long"), "end_line": F.col("line") + 2})
    f = f.withColumns({"start_character": F.when(F.col("ord") % 4 == 0, F.col("ord") % 10), "end_character": F.when(F.col("ord") % 4 == 0, F.col("ord") % 10 + 5)})
    return findings.diagnostic(f).select(F.col("message").cast("long").alias("ord"), "start_line", "start_character", "end_line", "end_character", "level")


@query(f"with {FE} select ord, cast(to_json({{type: vuln_type, rule_id: rule_id, severity: severity, file: file_path, line: line, message: message, details: details}}) as varchar) as finding from fe")
def legacy_rows(spark, d):
    return enrich.legacy(_fe(spark, d).withColumn("extra", F.col("ord"))).select(F.col("extra").alias("ord"), "finding")


@query("select event_id, case when try_cast(v as integer) >= 1 then try_cast(v as integer) else 1 end as line from (select event_id, case event_id % 4 when 0 then 'x' when 1 then '-3' when 2 then cast(event_id % 50 as varchar) end as v from events)")
def sarif_lines(spark, d):
    v = F.when(F.col("event_id") % 4 == 0, "x").when(F.col("event_id") % 4 == 1, "-3").when(F.col("event_id") % 4 == 2, (F.col("event_id") % 50).cast("string"))
    return table(spark, d, "events").select("event_id", findings.sarif_position(v).alias("line"))


@query(f"with {FE}, f as (select rule_id, arg_min({{v: vuln_type, m: message}}, {{f: file_path, l: line, o: ord}}) as x from fe where ord % 4 = cast(rule_id[2:] as int) % 4 group by 1) select rule_id, cast(to_json({{id: rule_id, name: case x.v when 'XSS_RISK' then 'Xss Risk' when 'SQL_INJECTION' then 'Sql Injection' when 'SSRF' then 'Ssrf' else 'Other' end, shortDescription: {{text: 'm'}}}}) as varchar) as rule from f")
def sarif_descriptors(spark, d):
    f = _fe(spark, d).where("ord % 4 = cast(substr(rule_id, 2) as int) % 4").withColumn("message", F.lit("m"))
    return reports.sarif_rules(f)


@query(f"""with {FE}, i as (select file_path, {RANK} as r, line, rule_id, '- **' || severity || '** line ' || line || ': ' || rule_id || ' - ' || message as t from fe)
  select file_path, count(*) as n, length('## ' || file_path || chr(10) || chr(10) || string_agg(t, chr(10)) || chr(10)) as chars from i group by 1""")
def markdown_sections(spark, d):
    return reports.markdown_lines(_fe(spark, d)).select("file_path", F.col("n").cast("long").alias("n"), F.length("text").cast("long").alias("chars"))


@query(f"with {FE} select file_path, case when count(*) filter (where ord % 101 = 0) > 0 then 2 when count(*) filter (where severity = 'Critical') > 0 then 1 else 0 end as code from fe group by 1")
def exit_codes(spark, d):
    per = _fe(spark, d).groupBy("file_path").agg(F.count_if(F.col("ord") % 101 == 0).alias("errors"), F.count_if(F.col("severity") == "Critical").alias("n"))
    return per.select("file_path", quality.exit_code(F.col("errors"), F.col("n")).alias("code"))


# --- baselines, marks, changed lines ---

PRINT = "substr(sha256(rule_id || '|' || file_path || '|' || line), 1, 16)"


@query(f"with {FE}, p as (select distinct rule_id, file_path, line, {PRINT} as fingerprint, ord % 2 as old from fe) select distinct rule_id, file_path, line, fingerprint from p")
def baseline_grown(spark, d):
    f = _fe(spark, d)
    old = suppress.with_fingerprint(f.where("ord % 2 = 1")).select("rule_id", "file_path", "line", "fingerprint").distinct()
    return suppress.add_to_baseline(old, f)


@query("with " + LINES_SQL + """, c as (select file_path, line, line_text || case when line % 3 = 0 then ' # lint-ignore' when line % 3 = 1 then '' else '  // lint-ignore: style' end as t from l where not regexp_matches(line_text, '["''`#/]')),
  m as (select file_path, line + case when trim(regexp_replace(t, '\\s*(#|//).*$', '')) = '' then 1 else 0 end as line, case when line % 3 = 2 then 'STYLE' end as only_type from c where line % 3 <> 1) select distinct file_path, line, only_type from m""")
def comment_markers(spark, d):
    lines = _lines(spark, d).where(~F.col("line_text").rlike("[\"'`#/]"))
    mark = F.when(F.col("line") % 3 == 0, " # lint-ignore").when(F.col("line") % 3 == 1, "").otherwise("  // lint-ignore: style")
    return suppress.markers_in_comments(lines.withColumn("line_text", F.concat("line_text", mark)))


@query(f"with {FE}, c as (select distinct 'src/f' || (c_custkey % 40) || '.py' as file_path, c_custkey % 89 + 1 as line from customer) select ord from fe f where not exists (select 1 from c where c.file_path = f.file_path) or exists (select 1 from c where c.file_path = f.file_path and c.line = f.line)")
def on_changed_lines(spark, d):
    changed = table(spark, d, "customer").select(F.concat(F.lit("src/f"), (F.col("c_custkey") % 40).cast("string"), F.lit(".py")).alias("file_path"), (F.col("c_custkey") % 89 + 1).alias("line"))
    return incremental.on_changed_lines(_fe(spark, d), changed).select("ord")


@query("with h as (select o_orderkey, 'f' || (o_orderkey % 30) as file_path, o_orderkey % 500 + 1 as s, o_orderkey % 4 as n from orders), w as (select file_path, unnest(range(s, s + n)) as line from h) select distinct file_path, line from w")
def diff_lines(spark, d):
    o = F.col("o_orderkey")
    head = F.format_string("diff\n@@ -%d,2 +%d,%d @@ x\n+a\n", o % 7, o % 500 + 1, o % 4)
    head = F.when(o % 4 == 1, F.format_string("@@ -3 +%d @@\n+a", o % 500 + 1)).otherwise(head)
    diffs = table(spark, d, "orders").select(F.concat(F.lit("f"), (o % 30).cast("string")).alias("file_path"), head.alias("diff"))
    return files.changed_lines(diffs).withColumn("line", F.col("line").cast("long"))


@query("select 'f' || c_custkey || '.py' as file_path from customer where c_custkey % 3 = 0 union select 'f' || c_custkey || '.go' from customer where c_custkey % 5 = 0 union select 'f' || c_custkey || '.py' from customer where c_custkey % 2 = 0")
def changed_feeds(spark, d):
    c = table(spark, d, "customer")
    name = lambda kind: F.concat(F.lit("f"), F.col("c_custkey").cast("string"), F.lit(kind)).alias("file_path")
    return files.changed_files(c.where("c_custkey % 3 = 0").select(name(".py")), c.where("c_custkey % 5 = 0").select(name(".go")), c.where("c_custkey % 2 = 0").select(name(".py")), c.select(name(".md")))


@query("""with o as (select o_custkey as f, o_orderkey as n, o_orderkey % 5 as h, o_custkey % 4 as fh from orders), a as (select f, n, h, fh from o where n % 7 <> 0), b as (select f, n, case when n % 3 = 0 then h + 1 else h end as h, case when f % 4 = 1 then fh else fh + 10 end as fh from o where n % 11 <> 0),
  m as (select coalesce(a.f, b.f) as f, a.h as ha, b.h as hb, a.fh as fa, b.fh as fb, coalesce(a.n, b.n) as n from a full join b on a.f = b.f and a.n = b.n),
  p as (select f, max(fa) as fa, max(fb) as fb, count(*) filter (where hb is null) as gone, count(hb) as n, count(*) filter (where hb is not null and ha is distinct from hb) as c from m group by 1)
  select cast(f as varchar) as file_path, case when fa = fb then 'reuse' when c = 0 or gone > 0 or c > 0.6 * n then 'full' else 'partial' end as mode, c as n_changed from p""")
def scan_modes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file_path"), F.col("o_orderkey").alias("n"), (F.col("o_orderkey") % 5).alias("h"), (F.col("o_custkey") % 4).alias("fh"), (F.col("o_custkey") % 4).alias("k"))
    name = F.col("n").cast("string").alias("name")
    old = o.where("n % 7 <> 0").select("file_path", name, F.col("h").alias("hash"), F.col("fh").alias("file_hash"))
    new = o.where("n % 11 <> 0").select("file_path", name, F.when(F.col("n") % 3 == 0, F.col("h") + 1).otherwise(F.col("h")).alias("hash"), F.when(F.col("k") == 1, F.col("fh")).otherwise(F.col("fh") + 10).alias("file_hash"))
    return incremental.scan_modes(old, new).select("file_path", "mode", F.size("changed").cast("long").alias("n_changed"))


@query("select l_orderkey, l_linenumber, l_partkey % 50 + (l_suppkey % 9 - l_suppkey % 4) as line from lineitem where l_suppkey % 6 <> 0")
def shifted_findings(spark, d):
    li = table(spark, d, "lineitem")
    f = li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("line"), F.lit("f").alias("file_path"), F.col("l_suppkey").alias("name"))
    s = li.select(F.lit("f").alias("file_path"), F.col("l_suppkey").alias("name")).distinct()
    moved = incremental.shifted(f, s.withColumn("start", F.col("name") % 4), s.where("name % 6 <> 0").withColumn("start", F.col("name") % 9))
    return moved.select("l_orderkey", "l_linenumber", "line")


@query("with e as (select distinct c_custkey as importer, c_nationkey as imported from customer) select distinct importer as file_path from e join nation n on n.n_nationkey = e.imported where n_nationkey % 5 < 4 and n_nationkey % 3 = 1")
def export_cascade(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("file_path"))
    old = n.where("file_path % 5 < 4").withColumn("export_hash", F.lit("a"))
    new = n.withColumn("export_hash", F.when(F.col("file_path") % 3 == 1, "b").otherwise("a"))
    return enrich.cascade(old, new, table(spark, d, "customer").select(F.col("c_custkey").alias("importer"), F.col("c_nationkey").alias("imported")))


# --- joins ---

EV = "e as (select event_id, user_id, event_type, value, cast(floor(epoch(ts)) as bigint) as s from events)"


@query("with " + EV + """ select event_id, click_id from (select a.event_id, c.event_id as click_id, row_number() over (partition by a.event_id order by c.s desc, c.event_id desc) as n from e a left join e c on c.user_id = a.user_id and c.event_type = 'click' and c.s between a.s - 7200 and a.s - 1) where n = 1""")
def asof_within(spark, d):
    from .queries import _events

    e = _events(spark, d)
    got = joins.latest_before(e, ["user_id"], ["s", "event_id"], F.when(F.col("event_type") == "click", F.col("event_id")), "click_id", within=7200, at="s")
    return got.select("event_id", "click_id")


@query("select coalesce(a.k, b.k) as k, a.x, b.y from (select o_custkey as k, count(*) as x from orders where o_orderkey % 3 = 0 group by 1) a full join (select c_custkey as k, c_nationkey as y from customer where c_custkey % 4 = 0) b on a.k = b.k")
def outer_merge(spark, d):
    a = table(spark, d, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("x"))
    return joins.full_merge(a, table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("y")), ["k"])


@query("with " + LINES_SQL + """, f as (select doc_id, file_path, line from l where regexp_matches(line_text, '(?i)license'))
  select f.doc_id, f.line, length(string_agg(l.line_text, chr(10) order by l.line)) as context from f join l on l.file_path = f.file_path and l.line between f.line - 2 and f.line + 2 group by all""")
def with_context(spark, d):
    lines = _lines(spark, d)
    f = lines.where(F.col("line_text").rlike("(?i)license")).select("doc_id", "file_path", "line")
    return enrich.with_context(f, lines).select("doc_id", "line", F.length("context").cast("long").alias("context"))


@query(f"""with {FE}, n as (select 'src/f' || (c_custkey % 50) || '.py' as file_path, c_custkey % 120 as node_line, 'n' || c_custkey as node from customer where c_custkey % 2 = 0)
  select ord, node from (select f.ord, n.node, row_number() over (partition by f.ord order by abs(f.line - n.node_line), n.node_line, n.node) as r from fe f join n on n.file_path = f.file_path and abs(f.line - n.node_line) <= 3) where r = 1""")
def related_nodes(spark, d):
    k = F.col("c_custkey")
    nodes = table(spark, d, "customer").select(F.concat(F.lit("src/f"), (k % 50).cast("string"), F.lit(".py")).alias("file_path"), (k % 120).alias("line"), F.concat(F.lit("n"), k.cast("string")).alias("name"), (k % 2 == 0).alias("is_tainted"))
    return enrich.related_path(_fe(spark, d), nodes).select("ord", "node")


# --- graphs ---


@query(f"with recursive {CFG_SQL}, nodes as (select distinct graph, n from (select graph, src as n from cfg union select graph, dst from cfg)), r(graph, origin, node, depth) as (select graph, n, n, 0 from nodes union select r.graph, r.origin, e.dst, r.depth + 1 from r join cfg e on e.graph = r.graph and e.src = r.node where r.depth < 9) select graph, origin, node, min(depth) as depth from r group by all")
def reachable(spark, d):
    e = _cfg(spark, d)
    n = e.select("graph", F.col("src").alias("n")).union(e.select("graph", "dst")).distinct()
    return graph.reached(e, n.select("graph", F.col("n").alias("origin"), F.col("n").alias("node")), ["graph"])


@query(DOM_SQL + """, depth as (select graph, b as a, count(*) as depth from dom group by 1, 2) select s.graph, s.b as node, arg_max(s.a, x.depth) as idom from dom s join depth x on x.graph = s.graph and x.a = s.a where s.a <> s.b group by 1, 2""")
def immediate_dominators(spark, d):
    return graph.immediate(_dom(spark, d)[0])


@query(DOM_SQL + """, g as (select graph, graph * 10 + 1 as node from nodes group by 1) select distinct g.graph, g.node as guard, m.b as node from g join cfg e on e.graph = g.graph and e.src = g.node join dom m on m.graph = e.graph and m.a = e.dst where e.dst <> e.graph * 10 + 2""")
def guarded_nodes(spark, d):
    dom, e = _dom(spark, d)
    g = e.select("graph").distinct()
    return graph.guarded(dom, e, g.withColumn("node", F.col("graph") * 10 + 1), g.withColumn("node", F.col("graph") * 10 + 2))


@query("""with g as (select distinct l_orderkey, l_linenumber from lineitem), c as (select l_orderkey, l_linenumber as src, lead(l_linenumber) over (partition by l_orderkey order by l_linenumber) as dst from g)
  select l_orderkey, src, dst, false as is_exit from c where dst is not null union all select l_orderkey, l_linenumber, -l_linenumber, true from g""")
def guard_chains(spark, d):
    return graph.guard_chain(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey"], "l_linenumber")


P_SQL = "p as (select l_orderkey as a, l_partkey % 40 as b, l_suppkey % 40 + 100 as c, l_linenumber as n from lineitem)"


def _short_paths(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    nodes = lambda *cs: F.array(*[c.cast("long") for c in cs])
    a, b, c = F.col("l_orderkey"), F.col("l_partkey") % 40, F.col("l_suppkey") % 40 + 100
    path = F.when(F.col("l_linenumber") % 2 == 0, nodes(-a, b, c)).otherwise(nodes(-a, c))
    return li.select(path.alias("path"), F.size(path).alias("n_nodes"))


@query("with " + P_SQL + """, x as (select a, c, n, n % 2 = 0 and b % 5 = 0 as s from p) select -a as source, c as sink, count(*) as n, count(*) filter (where s) as sanitised, min(case when s then 0.3 else 0.9 end) as confidence from x group by 1, 2""")
def sanitised_paths(spark, d):
    p = _short_paths(spark, d)
    got = graph.sanitised(p, spark.range(0, 40, 5).select(F.col("id").alias("node")))
    return got.groupBy(F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("sink")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_sanitised").alias("sanitised"), F.min("confidence").alias("confidence"))


@query("with " + P_SQL + """, x as (select case when n % 2 = 0 then [-a, b, c] else [-a, c] end as path, c, n % 2 = 0 and b % 5 = 0 as s from p) select c as sink, array_to_string(path, '>') as path from (select *, row_number() over (partition by c order by len(path), path) as r from x where not s) where r = 1""")
def path_per_sink(spark, d):
    got = graph.first_per_sink(graph.sanitised(_short_paths(spark, d), spark.range(0, 40, 5).select(F.col("id").alias("node"))))
    return got.select(F.element_at("path", -1).alias("sink"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("select count(*) as nodes, count(*) filter (where event_type = 'click') as sources, count(*) filter (where event_type = 'purchase') as sinks, count(*) filter (where event_type = 'signup') as sanitizers, count(*) filter (where user_id % 2 = 0) as tainted from events")
def graph_stats(spark, d):
    kind = F.when(F.col("event_type") == "click", "source").when(F.col("event_type") == "purchase", "sink").when(F.col("event_type") == "signup", "sanitizer").otherwise("variable")
    return graph.stats(table(spark, d, "events").select(kind.alias("node_type"), (F.col("user_id") % 2 == 0).alias("is_tainted")))


@query("""with n as (select 'u' || user_id as file_path, event_id as line, event_type from events), p as (select file_path, bool_or(event_type = 'click') as s, min(case when event_type = 'purchase' then line end) as line from n group by 1)
  select file_path, line from p where s and line is not null and file_path not in (select 'u' || c_custkey from customer where c_custkey % 3 = 0)""")
def co_occurring(spark, d):
    name = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path")
    kind = F.when(F.col("event_type") == "click", "source").when(F.col("event_type") == "purchase", "sink").otherwise("variable")
    nodes = table(spark, d, "events").select(name, F.col("event_id").alias("line"), kind.alias("node_type"))
    return enrich.co_occurring(nodes, table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("file_path")))


@query("""with recursive al as (select distinct l_partkey as src, l_partkey + 7 as dst from lineitem where l_partkey % 3 <> 0), r(origin, node, depth) as (select distinct l_partkey, l_partkey, 0 from lineitem union select r.origin, al.dst, r.depth + 1 from r join al on al.src = r.node)
  select origin, node, depth from r where node not in (select src from al)""")
def reexported_names(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") + 7).alias("dst")).distinct()
    return crossfile.reexported(p.where("src % 3 <> 0"), p.select(F.col("src").alias("node")))


@query("""with c as (select 'f' || (o_custkey % 20) as file_path, o_orderkey as line, o_orderkey + 1 as start, o_orderkey + 2 as "end", o_orderkey % 60 as callee, o_orderkey % 3 as param from orders where o_orderkey % 4 <> 0), k as (select distinct p_partkey % 60 as func, p_partkey % 3 as param from part where p_partkey % 2 = 0)
  select c.file_path, 'XF' as rule_id, 'SQL_INJECTION' as vuln_type, c.line, c.start, c."end", c.callee from c join k on k.func = c.callee and k.param = c.param""")
def tainted_calls(spark, d):
    o = F.col("o_orderkey")
    calls = table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 20).cast("string")).alias("file_path"), o.alias("line"), (o + 1).alias("start"), (o + 2).alias("end"), (o % 60).alias("callee"), (o % 3).alias("param"), (o % 4 != 0).alias("is_tainted"))
    contracts = table(spark, d, "part").where("p_partkey % 2 = 0").select((F.col("p_partkey") % 60).alias("func"), (F.col("p_partkey") % 3).alias("param"), F.lit("XF").alias("rule_id"), F.lit("SQL_INJECTION").alias("vuln_type")).distinct()
    return crossfile.cross_file_findings(calls, contracts)


# --- text functions, over every document ---

PATHS = [("src/a.py", False), ("node_modules/x.js", True), ("a/vendor/b.go", True), ("lib/x.min.js", True), ("readme.md", True), ("package.json", False), ("a/.env", False), ("a/.hidden.py", True), ("a/coverage/x.ts", True), ("a/b.tmp.py", False)]


@query(f"select doc_id, e as is_ignored from (select doc_id, doc_id % 10 as k from documents) join (select row_number() over () - 1 as k, e from (values {_sql_values(PATHS)}) v(p, e)) using (k)")
def ignored_paths(spark, d):
    path = F.element_at(F.array(*[F.lit(p) for p, _ in PATHS]), (F.col("doc_id") % 10).cast("int") + 1)
    return table(spark, d, "documents").select("doc_id", files.ignored(path).alias("is_ignored"))


@query("select page_id, url glob '*/en/*' or url glob 'https://*[0-9].html' as excluded from pages")
def excluded_urls(spark, d):
    return table(spark, d, "pages").select("page_id", texts.path_excluded(F.col("url"), F.col("url"), ["*/en/*", "https://*[0-9].html"]).alias("excluded"))


@query("select doc_id, text as back from documents")
def lenient_text(spark, d):
    return table(spark, d, "documents").select("doc_id", files.lenient_utf8(F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFFE")))).alias("back"))


@query("""select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) as escaped, substr(md5(lang || ':' || doc_id), 1, 12) as node, regexp_matches(lower(source), 'seed|migration|fixture|factory|factories|mock|dummy') as is_seed,
  md5(replace(replace(text || chr(13) || chr(10) || 'x' || chr(13), chr(13) || chr(10), chr(10)), chr(13), chr(10))) as lines from documents""")
def text_functions(spark, d):
    docs = table(spark, d, "documents")
    ends = texts.normalise_newlines(F.concat("text", F.lit("\r\nx\r")))
    return docs.select("doc_id", F.md5(texts.html_escape(F.col("text"))).alias("escaped"), texts.node_id(F.col("lang"), F.col("doc_id")).alias("node"), texts.likely_seed(F.col("source")).alias("is_seed"), F.md5(ends).alias("lines"))


LITERALS = [("abc", 3, None, False), (r"a\nb", 3, None, False), (r"\x41\101z", 3, None, False), ("x # y", 5, "# y", False), ('"#" // z', 8, "// z", False), ("changeme", 8, None, True), ("<key>", 5, None, True), ("your_token", 10, None, True), ("${V}", 4, None, True), ("plain", 5, None, False)]


@query(f"select doc_id, n, c, p from (select doc_id, doc_id % 10 as k from documents) join (select row_number() over () - 1 as k, n, c, p from (values {_sql_values(LITERALS)}) v(t, n, c, p)) using (k)")
def literal_functions(spark, d):
    t = F.element_at(F.array(*[F.lit(x[0]) for x in LITERALS]), (F.col("doc_id") % 10).cast("int") + 1)
    return table(spark, d, "documents").select("doc_id", texts.literal_length(t).alias("n"), texts.line_comment(t).alias("c"), texts.placeholder(t).alias("p"))


HEADS = [("import flask", "a.py", "flask"), ("const e = require('express')", "b.js", "express"), ("x", "app/django/v.py", "django"), ("mysql2 and mysql", "c.js", "mysql2"), ("nothing", "d.go", None)]


@query(f"select doc_id, f as framework from (select doc_id, doc_id % 5 as k from documents) join (select row_number() over () - 1 as k, f from (values {_sql_values(HEADS)}) v(t, p, f)) using (k)")
def frameworks(spark, d):
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in HEADS]), (F.col("doc_id") % 5).cast("int") + 1)
    return table(spark, d, "documents").select("doc_id", enrich.framework_of(pick(0), pick(1)).alias("framework"))


REMEDIES = [("SQL_INJECTION", "x(req.query.id)", "mysql2", "await connection.execute('SELECT * FROM t WHERE id = ?', [req.query.id])"), ("SQL_INJECTION", "run(sql)", None, "bind sql as a parameter"), ("XSS_RISK", "show(a, 'input', b)", None, "escape(value)"), ("SSRF", "get(request.json)", "flask", "allow request.json only if its host is listed"), ("OTHER", "x", None, None)]


@query(f"select doc_id, r as remedy_code from (select doc_id, doc_id % 5 as k from documents) join (select row_number() over () - 1 as k, r from (values {_sql_values(REMEDIES)}) v(t, c, f, r)) using (k)")
def remedies(spark, d):
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in REMEDIES]), (F.col("doc_id") % 5).cast("int") + 1)
    f = table(spark, d, "documents").select("doc_id", pick(0).alias("vuln_type"), pick(1).alias("context"), pick(2).alias("framework"))
    return enrich.with_remedy(f).select("doc_id", "remedy_code")


# --- files of source code, a line of each kind a document ---

C_LINES = ["char buf[8];", 'strcpy(buf, "short");', 'strcpy(buf, "far too long for it");', "cin >> buf;", "if (a = b) x();", "x = malloc(9);", 'system("ls"); // strcpy(a, b)', "EnterCriticalSection(&m);", "LeaveCriticalSection(&k);", "if (p) q();", "v = p->a->b;"]
#: What each line is, by type: none of it depends on the others but for the array's size, the check of p and the section that is held.
C_FOUND = [(3, "BUFFER_OVERFLOW", "Critical"), (4, "BUFFER_OVERFLOW", "Critical"), (5, "ASSIGNMENT_IN_CONDITION", "Medium"), (6, "MEMORY_LEAK", "High"), (7, "RCE_COMMAND_EXEC", "Critical"), (9, "LOCK_MISMATCH", "High"), (11, "NULL_DEREFERENCE", "High")]


def _c_files(spark, d) -> DataFrame:
    """Each document as a C file: the lines above, so many lines further down as the id says."""
    code = F.concat(F.repeat(F.lit("\n"), (F.col("doc_id") % 13).cast("int")), F.lit("\n".join(C_LINES)))
    return table(spark, d, "documents").select(F.concat(F.lit("c/"), F.col("doc_id").cast("string"), F.lit(".c")).alias("file_path"), F.lit("c").alias("language"), code.alias("code"))


C_SQL = "d as (select 'c/' || doc_id || '.c' as file_path, doc_id % 13 as down from documents)"


@query(f"with {C_SQL} select file_path, down + n as line, t as vuln_type, s as severity from d, (values {_sql_values(C_FOUND)}) v(n, t, s)")
def c_findings(spark, d):
    return cpp.analyse(_c_files(spark, d)).select("file_path", F.col("line").cast("long").alias("line"), "vuln_type", "severity")


@query(f"with {C_SQL} select file_path, 'buf' as name, cast(8 as bigint) as size from d")
def c_arrays(spark, d):
    return cpp.arrays(cpp.code_lines(_c_files(spark, d)))


@query(f"with {C_SQL} select file_path, down + 2 as line from d")
def c_safe_copies(spark, d):
    return cpp.safe_copies(cpp.code_lines(_c_files(spark, d))).withColumn("line", F.col("line").cast("long"))


@query(f"""with {C_SQL} select file_path, down + 3 as line, 'strncpy(buf, "far too long for it", sizeof(buf) - 1); buf[sizeof(buf) - 1] = ''\\0'';' as fixed from d union all select file_path, down + 4, 'cin >> std::setw(8) >> buf;' from d union all select file_path, down + 5, 'if (a == b) x();' from d union all select file_path, down + 9, 'LeaveCriticalSection(&m);' from d""")
def c_fixes(spark, d):
    lines = cpp.code_lines(_c_files(spark, d))
    found = cpp.analyse(_c_files(spark, d)).select("file_path", "line", "vuln_type")
    return enrich.cpp_fixes(found, lines, cpp.arrays(lines)).select("file_path", F.col("line").cast("long").alias("line"), "fixed")


@query("""with o as (select user_id, event_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as line from events where event_type in ('click', 'purchase')) select u.user_id as user, u.line, a.line as assigned from o u left join lateral (select max(line) as line from o where user_id = u.user_id and event_type = 'click' and line < u.line) a on true where u.event_type = 'purchase'""")
def latest_assignments(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    o = table(spark, d, "events").where("event_type in ('click', 'purchase')").select(F.col("user_id").alias("file_path"), F.lit("x").alias("name"), n.cast("long").alias("line"), "event_type", F.lit("v").alias("value"))
    got = cpp.latest_assignment(o.where("event_type = 'purchase'"), o.where("event_type = 'click'"))
    return got.select(F.col("file_path").alias("user"), "line", "assigned")


PY = ["import os", "from lib.db import run as go", "name = request.args.get('n')", "query = 'select ' + name", "safe = int(name)", "cursor.execute(query)", "def show(x):", "    return x", "name = 'fixed'"]
JS = ["import a from './a'", "const b = require('../b')", "export function f() {}", "import('./c')"]


def _py_files(spark, d) -> DataFrame:
    py, js = F.lit("\n".join(PY)), F.lit("\n".join(JS))
    even = F.col("doc_id") % 2 == 0
    path = F.concat(F.lit("s/"), F.col("doc_id").cast("string"), F.when(even, ".py").otherwise(".js"))
    return table(spark, d, "documents").select(path.alias("file_path"), F.when(even, "python").otherwise("javascript").alias("language"), F.when(even, py).otherwise(js).alias("code"))


PY_SQL = "d as (select 's/' || doc_id || case when doc_id % 2 = 0 then '.py' else '.js' end as file_path, doc_id % 2 = 0 as py from documents)"


@query(f"with {PY_SQL} select file_path, t as target from d, (values (true, 'os'), (true, 'lib.db'), (false, './a'), (false, '../b'), (false, './c')) v(p, t) where p = py")
def imported_modules(spark, d):
    return crossfile.import_targets(_py_files(spark, d))


@query(f"with {PY_SQL} select file_path, md5(case when py then 'def show(x):' else 'export function f() {{}}' end) as export_hash from d")
def export_hashes(spark, d):
    return _py_files(spark, d).select("file_path", crossfile.export_hash(F.col("code")).alias("export_hash"))


@query(f"with {PY_SQL}, t(p, target, base) as (values (true, 'os', 'os'), (true, 'lib.db', 'lib/db'), (false, './a', 's/a'), (false, '../b', 'b'), (false, './c', 's/c')), x(ord, s) as (values (0, ''), (1, '.js'), (2, '.jsx'), (3, '.mjs'), (4, '.cjs'), (5, '.ts'), (6, '.tsx'), (7, '.py'), (8, '/index.js'), (9, '/index.ts'), (10, '/__init__.py')) select file_path, target, ord, base || s as candidate from d join t on t.p = d.py, x")
def module_candidates(spark, d):
    return crossfile.candidates(crossfile.import_targets(_py_files(spark, d)))


ASSIGNED = [(3, "name", "request.args.get('n')"), (4, "query", "'select ' + name"), (5, "safe", "int(name)"), (9, "name", "'fixed'")]


@query(f"with {PY_SQL} select file_path, cast(n as bigint) as line, lhs, rhs from d, (values {_sql_values(ASSIGNED)}) v(n, lhs, rhs) where py")
def assignments(spark, d):
    lines = match.lines_of(_py_files(spark, d).where("language = 'python'"))
    return taint.assignments(lines).select("file_path", F.col("line").cast("long").alias("line"), "lhs", "rhs")
