"""The engine's operators as queries over the standard tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import Pattern, Rule
from ..functions.text import code_only, fingerprint, looks_secret
from ..operators import crossfile, findings, graph, incremental, joins, match, quality, suppress
from ..session import table
from ..sources.files import skip_reason
from .dims import REMEDIATION, language_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("code"))
    return match.lines_of(docs).withColumns({"file_path": F.concat(F.lit("docs/"), F.col("doc_id").cast("string")), "line": F.col("line").cast("long")})


LINES_SQL = """l as (select doc_id, lang, 'docs/' || doc_id as file_path, unnest(range(1, len(p) + 1)) as line, unnest(p) as line_text
  from (select doc_id, lang, string_split(text, chr(10)) as p from documents))"""


@query("with " + LINES_SQL + " select lang, count(*) as n_lines, count(distinct doc_id) as n_docs, max(line) as longest, cast(sum(length(line_text)) as bigint) as chars from l group by lang")
def scan_lines(spark, d):
    return _lines(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"), F.max("line").alias("longest"), F.sum(F.length("line_text")).alias("chars"))


@query("""select case when k = 1 then 'excluded' when k = 2 then 'unsupported_type' when n > 20000 then 'too_large' end as reason, count(*) as n_files, cast(sum(n) as bigint) as bytes
  from (select doc_id % 7 as k, length(text) as n from documents) group by 1""")
def skip_reasons(spark, d):
    folder = F.when(F.col("doc_id") % 7 == 1, "vendor/").otherwise("src/")
    kind = F.when(F.col("doc_id") % 7 == 2, ".qqq").otherwise(".py")
    files = table(spark, d, "documents").select(F.concat(folder, F.col("doc_id").cast("string"), kind).alias("file_path"), F.length("text").alias("size"))
    return files.groupBy(skip_reason(F.col("file_path"), F.col("size"), max_bytes=20000).alias("reason")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


@query("""with a(alias, language) as (values ('py','python'),('js','javascript'),('go','go'),('c++','cpp')), x(ext, language) as (values ('.html','typescript'),('.py','python'),('.java','java'))
  select p.page_id, coalesce(a.language, case regexp_extract(lower(p.url), '(\\.[a-z]+)$', 1) when '.java' then 'java' when '.py' then 'python' when '.go' then 'go' when '.c' then 'c' end) as language
  from (select page_id, url, case page_id % 4 when 0 then 'py' when 1 then ' JS ' when 2 then 'c++' else 'xx' end as k from pages) p left join a on a.alias = lower(trim(p.k))""")
def lang_resolve(spark, d):
    pages = table(spark, d, "pages")
    alias = F.element_at(F.array(F.lit("py"), F.lit(" JS "), F.lit("c++"), F.lit("xx")), (F.col("page_id") % 4).cast("int") + 1)
    return pages.select("page_id", language_of(alias, F.col("url")).alias("language"))


SECRET = Rule("text.hardcoded-secret", "text", "HIGH", "A secret is written in the text.", "HARDCODED_CREDENTIALS", (Pattern('$VAR = "$SECRET"', {"VAR": ("(?i)(password|passwd|pwd|secret|token|api_?key)", None), "SECRET": (None, "^(changeme|example|sample|test|null|none)$")}),))
LICENSE = Rule("text.license", "text", "LOW", "A license line.", "LICENSE", (Pattern("$NAME under the $WHAT"),))


def _matches(spark, d, rules) -> DataFrame:
    return match.match_rules(_lines(spark, d).withColumn("language", F.lit("text")), rules)


MATCHES_SQL = """m as (select doc_id, lang, file_path, line, 'text.hardcoded-secret' as rule_id, 'HARDCODED_CREDENTIALS' as vuln_type, 'High' as severity, 0 as rule_ord, unnest(a) as var, unnest(b) as secret
  from (select *, regexp_extract_all(line_text, '([^ \t\n\x0b\x0c\r]+)\\s*=\\s*"([^"]+)"', 1) as a, regexp_extract_all(line_text, '([^ \t\n\x0b\x0c\r]+)\\s*=\\s*"([^"]+)"', 2) as b from l)),
  f as (select * from m where regexp_matches(var, '(?i)(password|passwd|pwd|secret|token|api_?key)') and not regexp_matches(secret, '^(changeme|example|sample|test|null|none)$'))"""


@query("with " + LINES_SQL + ", " + MATCHES_SQL + " select doc_id, line, rule_id, severity, var, secret, length(secret) >= 12 and (length(regexp_replace(secret, '[^A-Za-z0-9+/=_\\-]', '', 'g')) >= 16 or length(secret) >= 20) as is_real from f")
def rule_secrets(spark, d):
    got = _matches(spark, d, [SECRET])
    return got.select("doc_id", "line", "rule_id", "severity", F.col("captures")["VAR"].alias("var"), F.col("captures")["SECRET"].alias("secret")).withColumn("is_real", looks_secret(F.col("secret")))


@query("with " + LINES_SQL + """, w as (select doc_id, line, case when regexp_matches(line_text, '\\S+\\s*under\\s*the\\s*\\S+') then 'text.license' end as a, case when regexp_matches(line_text, 'Version\\s*\\S+') then 'text.version' end as b from l)
  select doc_id, line, coalesce(a, b) as rule_id from w where (a is not null or b is not null) and not (doc_id % 5 = 0 and line % 2 = 0)""")
def rule_multi_dedupe(spark, d):
    version = Rule("text.version", "text", "LOW", "A version.", "LICENSE", (Pattern("Version $V"),))
    got = _matches(spark, d, [LICENSE, version])
    reported = _lines(spark, d).where("doc_id % 5 = 0 and line % 2 = 0").select("file_path", "line", F.lit("LICENSE").alias("vuln_type"))
    return match.drop_reported(got, reported).select("doc_id", "line", "rule_id")


PAGE_PATTERNS = [("sink", "script", "re", r"<script\b", "*", "XSS", "High", "CWE-79"), ("sink", "style", "sub", "<style", "html", "OTHER", "Low", ""), ("sink", "link", "re", r"href\s*=", "html", "OPEN_REDIRECT", "Medium", ""), ("sink", "nav", "sub", "<NAV", "html", "OTHER", "Low", "")]


@query("""with l as (select page_id, unnest(range(1, len(p) + 1)) as line, unnest(p) as t from (select page_id, string_split(html, '>') as p from pages))
  select page_id, line, case when contains(lower(t), '<style') then 'style' when regexp_matches(t, '(?i)href\\s*=') then 'link' when contains(lower(t), '<nav') then 'nav' when regexp_matches(t, '(?i)<script\\b') then 'script' end as sink
  from l where contains(lower(t), '<style') or regexp_matches(t, '(?i)href\\s*=') or contains(lower(t), '<nav') or regexp_matches(t, '(?i)<script\\b')""")
def registry_first_match(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", ">", -1)).alias("line", "t"))
    sink = match.first_registered(F.col("t"), F.lit("html"), PAGE_PATTERNS, "sink")
    return pages.select("page_id", (F.col("line") + 1).cast("long").alias("line"), sink.alias("sink")).where("sink is not null")


@query("""select page_id, len(regexp_extract_all(html, '(?i)<script\\b[^>]*>')) as n_scripts, len(regexp_extract_all(html, '(?i)\\bon[a-z]+\\s*=')) as n_handlers, regexp_matches(html, '(?i)<script\\b') as flagged from pages""")
def html_inline_script(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.regexp_count("html", F.lit(r"(?i)<script\b[^>]*>")).cast("long").alias("n_scripts"), F.regexp_count("html", F.lit(r"(?i)\bon[a-z]+\s*=")).cast("long").alias("n_handlers"), F.col("html").rlike(r"(?i)<script\b").alias("flagged"))


@query("""with s as (select page_id, string_split(html, chr(10)) as p from pages), l as (select page_id, unnest(range(1, len(p) + 1)) as line, unnest(p) as t from s)
  select page_id, line, length(trim(regexp_replace(regexp_replace(regexp_replace(t, '("(?:\\\\.|[^"\\\\])*")|//.*', '\\1', 'g'), '/\\*.*?\\*/', '', 'g'), '"(?:\\\\.|[^"\\\\])*"', '""', 'g'))) as code_length from l""")
def strip_code(spark, d):
    lines = match.lines_of(table(spark, d, "pages").select("page_id", F.col("html").alias("code")))
    return lines.select("page_id", F.col("line").cast("long").alias("line"), F.length(code_only(F.col("line_text"))).cast("long").alias("code_length"))


@query("""select event_id, event_type as rule_id, case k % 5 when 0 then 'Critical' when 1 then 'High' when 2 then 'Medium' when 3 then 'Low' else 'Medium' end as severity,
  cast(case k % 3 when 0 then 0.9 when 1 then 0.3 else 0.5 end as double) as confidence from (select event_id, event_type, cast(json_extract(props, '$.k') as bigint) as k from events)""")
def finding_normalise(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "HIGH", "Medium", "low", "bogus"))), k % 5 + 1)
    raw = F.map_filter(F.create_map(F.lit("type"), F.col("event_type"), F.lit("severity"), severity, F.lit("confidence"), F.element_at(F.array(*map(F.lit, ("high", "low", "medium"))), k % 3 + 1), F.lit("k"), k.cast("string")), lambda _, v: v.isNotNull())
    got = table(spark, d, "events").select("event_id", findings.normalise(raw).alias("f"))
    return got.select("event_id", "f.rule_id", "f.severity", "f.confidence")


@query("""with recursive days as (select distinct l_partkey, cast(date_diff('day', timestamp '1990-01-01', l_shipdate) as bigint) as day from lineitem),
  kept as (select l_partkey, min(day) as day from days group by 1 union all
    select l_partkey, day from (select k.l_partkey, min(d.day) as day from kept k join days d on d.l_partkey = k.l_partkey and d.day > k.day + 90 group by k.l_partkey, k.day))
  select l_partkey, day from kept""")
def nearline_dedupe(spark, d):
    days = table(spark, d, "lineitem").select("l_partkey", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("day"))
    return findings.thin_lines(days, 90, ["l_partkey"], line="day")


FOUND_SQL = LINES_SQL + ", lic as (select doc_id, file_path, line, 'text.license' as rule_id, 'LICENSE' as vuln_type, regexp_extract(line_text, '\\S+\\s*under\\s*the\\s*\\S+') as details from l where regexp_matches(line_text, '\\S+\\s*under\\s*the\\s*\\S+')), fp as (select *, substr(sha256(rule_id || '|' || file_path || '|' || line), 1, 16) as fingerprint from lic)"


def _found(spark, d) -> DataFrame:
    got = _matches(spark, d, [LICENSE]).select("doc_id", "file_path", "line", "rule_id", "vuln_type", "message", F.col("captures")["0"].alias("details"))
    return got.dropDuplicates(["doc_id", "line"])


def _baseline(spark, d) -> DataFrame:
    return _found(spark, d).where("doc_id % 3 = 0").select(fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line")).alias("fingerprint"))


@query("with " + FOUND_SQL + " select fingerprint, doc_id, line from fp where fingerprint not in (select fingerprint from fp where doc_id % 3 = 0)")
def baseline_diff(spark, d):
    return suppress.new_findings(_found(spark, d), _baseline(spark, d)).select("fingerprint", "doc_id", "line")


@query("with " + FOUND_SQL + " select fingerprint, doc_id, line from fp where fingerprint in (select fingerprint from fp where doc_id % 3 = 0)")
def baseline_semi(spark, d):
    return suppress.known_findings(_found(spark, d), _baseline(spark, d)).select("fingerprint", "doc_id", "line")


@query("with " + FOUND_SQL + " select doc_id, line from fp f where not exists (select 1 from (select file_path, line, case when doc_id % 4 = 0 then 'seen: ' || details when doc_id % 8 = 2 then 'other' else '' end as details from fp where doc_id % 2 = 0) m where m.file_path = f.file_path and m.line = f.line and (m.details = '' or contains(m.details, f.details)))")
def fp_marks(spark, d):
    f = _found(spark, d)
    marks = f.where("doc_id % 2 = 0").select("file_path", "line", "vuln_type", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("seen: "), "details")).when(F.col("doc_id") % 8 == 2, "other").otherwise("").alias("details"))
    return suppress.drop_marked(f, marks).select("doc_id", "line")


@query("with " + LINES_SQL + """, mk as (select file_path, line from l where regexp_matches(line_text, '(?i)license')), t as (select doc_id, file_path, line from l where length(line_text) > 40)
  select doc_id, line from t where not exists (select 1 from mk where mk.file_path = t.file_path and (mk.line = t.line or mk.line = t.line - 1))""")
def suppress_prevline(spark, d):
    lines = _lines(spark, d)
    long = lines.where(F.length("line_text") > 40).select("doc_id", "file_path", "line", F.lit("LONG").alias("vuln_type"))
    marks = suppress.markers_loose(lines, "license").withColumn("only_type", F.lit(None).cast("string"))
    return suppress.drop_silenced(long, marks).select("doc_id", "line")


EV = "e as (select event_id, user_id, event_type, value, cast(floor(epoch(ts)) as bigint) as s from events)"


def _events(spark, d) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", seconds.alias("s"))


@query("with " + EV + """, spans as (select user_id, event_id as span_id, s as lo, s + 86400 as hi from e where event_type = 'signup')
  select event_id, span_id from (select e.event_id, p.span_id, row_number() over (partition by e.event_id order by p.lo, p.span_id) as n from e join spans p on p.user_id = e.user_id and e.s between p.lo and p.hi) where n = 1""")
def range_bucket(spark, d):
    e = _events(spark, d)
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("s").alias("lo"), (F.col("s") + 86400).alias("hi"), F.struct("s", "event_id").alias("o"))
    return joins.first_interval(e, spans, ["user_id"], "s", "lo", "hi", "o", 86400).select("event_id", "span_id")


@query()
def tolerance_match(spark, d):
    lines = _lines(spark, d).where(F.length("line_text") > 0)
    found = lines.where("line % 2 = 0").select(F.col("doc_id").alias("d"), "file_path", "line", "lang").select((F.col("d") * 100000 + F.col("line")).alias("found_id"), "file_path", "line", F.col("lang").alias("vuln_type"))
    expected = lines.where("line % 5 = 0").select((F.col("doc_id") * 100000 + F.col("line")).alias("id"), F.concat(F.col("lang"), F.lit(":"), F.col("doc_id").cast("string")).alias("vuln_type"), F.col("file_path").alias("file"), F.array(F.col("line")).alias("line_candidates"), (F.col("doc_id") % 3 != 0).alias("is_true_positive"))
    found = found.withColumn("vuln_type", F.concat("vuln_type", F.lit(":"), F.regexp_extract("file_path", r"(\d+)", 1)))
    return joins.greedy_tolerance(expected, found).select("id", "found_id", "is_true_positive")


@query("with " + EV + """, a as (select * from e where event_type = 'purchase'), b as (select user_id, event_id as near_id, s as t from e where event_type = 'click')
  select event_id, near_id from (select a.event_id, b.near_id, row_number() over (partition by a.event_id order by abs(a.s - b.t), b.near_id) as n from a join b on a.user_id = b.user_id and abs(a.s - b.t) <= 3600) where n = 1""")
def band_nearby(spark, d):
    e = _events(spark, d)
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("near_id"), F.col("s").alias("t"))
    return joins.nearest_in_band(e.where("event_type = 'purchase'"), b, ["user_id"], "s", "t", 3600, ["near_id"]).select("event_id", "near_id")


@query("with " + EV + " select event_id, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding) as click_id from e")
def asof_guard(spark, d):
    e = _events(spark, d)
    return joins.latest_before(e, ["user_id"], ["s", "event_id"], F.when(F.col("event_type") == "click", F.col("event_id")), "click_id").select("event_id", "click_id")


_TYPES = list(REMEDIATION)


@query("""with r(t, cwe_id) as (values """ + ", ".join(f"('{k}', '{v[0]}')" for k, v in REMEDIATION.items()) + """)
  select e.event_id, e.vuln_type, coalesce(r.cwe_id, '') as cwe_id from (select event_id, case event_id % 11 """ + " ".join(f"when {i} then '{k}'" for i, k in enumerate(_TYPES)) + """ else 'OTHER' end as vuln_type from events) e left join r on r.t = e.vuln_type""")
def remediation_left(spark, d):
    from .dims import remediation

    kind = F.coalesce(F.get(F.array(*map(F.lit, _TYPES)), (F.col("event_id") % 11).cast("int")), F.lit("OTHER"))
    e = table(spark, d, "events").select("event_id", kind.alias("vuln_type"))
    return e.join(F.broadcast(remediation(spark)), "vuln_type", "left").select("event_id", "vuln_type", F.coalesce("cwe_id", F.lit("")).alias("cwe_id"))  # a fixed table of nine rows


SEV_CASE = "case event_id % 7 when 0 then 'Critical' when 1 then 'High' when 2 then 'High' when 3 then 'Low' when 4 then 'odd' when 5 then 'Low' else 'Low' end"


def _severity():
    return F.element_at(F.array(*map(F.lit, ("Critical", "High", "High", "Low", "odd", "Low", "Low"))), (F.col("event_id") % 7).cast("int") + 1)


@query(f"select s.severity, count(e.severity) as n from (values ('Critical'),('High'),('Medium'),('Low'),('Unknown')) s(severity) left join (select case when x in ('Critical','High','Medium','Low') then x else 'Unknown' end as severity from (select {SEV_CASE} as x from events)) e on e.severity = s.severity group by 1")
def severity_counts(spark, d):
    return quality.severity_counts(table(spark, d, "events").select(_severity().alias("severity")))


@query("with " + FOUND_SQL + " select (select count(*) from documents) as files, (select count(*) from documents where length(text) <= 20000) as scanned, count(distinct doc_id) as with_issues, count(*) as issues from fp")
def scan_stats(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("file_path"), F.when(F.length("text") > 20000, "too_large").alias("reason"))
    return quality.scan_totals(files, _found(spark, d))


PRED_SQL = "p as (select d.lang, d.source, l.quality = 0 as bad, regexp_matches(d.text, '[*&$%#!]{2}') as found from documents d join labels l using (doc_id))"
CONF_SQL = """c as (select lang, source, count(*) filter (where bad and found) as tp, count(*) filter (where not bad and found) as fp, count(*) filter (where bad and not found) as fn, count(*) filter (where not bad and not found) as tn, grouping(lang, source) as level
  from p group by grouping sets ((), (lang), (source), (lang, source)))"""


def _predicted(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("text").rlike(r"[*&$%#!]{2}").alias("found"))
    return docs.join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")


@query("with " + PRED_SQL + ", " + CONF_SQL + """, r as (select *, case when tp + fn > 0 then tp / (tp + fn) else 0 end as a, case when tp + fp > 0 then tp / (tp + fp) else 0 end as b from c)
  select lang, source, level, tp, fp, fn, tn, round(a, 4) as recall, round(b, 4) as "precision", round(case when fp + tn > 0 then fp / (fp + tn) else 0 end, 4) as fpr, round(case when a + b > 0 then 2 * a * b / (a + b) else 0 end, 4) as f1 from r""")
def quality_matrix(spark, d):
    p = _predicted(spark, d)
    got = quality.metrics(quality.confusion(p, F.col("bad"), F.col("found"), ["lang", "source"]))
    return got.select("lang", "source", "level", "tp", "fp", "fn", "tn", "recall", "precision", "fpr", "f1")


@query("with " + PRED_SQL + ", " + CONF_SQL + """ select lang, tp >= 1 and fp <= 5 and fn <= 50 and tn >= 10 as passed, array_to_string(list_filter([case when tp < 1 then 'tp' end, case when fp > 5 then 'fp' end, case when fn > 50 then 'fn' end, case when tn < 10 then 'tn' end], lambda x: x is not null), ',') as broken
  from c where level = 1""")
def quality_gate(spark, d):
    p = _predicted(spark, d)
    counts = quality.confusion(p, F.col("bad"), F.col("found"), ["lang", "source"]).where("level = 1")
    limits = p.select("lang").distinct().select("lang", F.lit(1).alias("min_tp"), F.lit(5).alias("max_fp"), F.lit(50).alias("max_fn"), F.lit(10).alias("min_tn"))
    return quality.gates(counts, limits, ["lang"]).select("lang", "passed", "broken")


@query("with " + LINES_SQL + """, a as (select distinct lang, doc_id, line from l where regexp_matches(line_text, '(?i)license')), b as (select distinct lang, doc_id, line from l where length(line_text) < 60)
  select coalesce(a.lang, b.lang) as lang, count(*) filter (where a.doc_id is not null and b.doc_id is not null) as "both", count(*) filter (where b.doc_id is null) as only_a, count(*) filter (where a.doc_id is null) as only_b from a full join b using (lang, doc_id, line) group by 1""")
def compare_sets(spark, d):
    lines = _lines(spark, d)
    return quality.compare(lines.where(F.col("line_text").rlike("(?i)license")), lines.where(F.length("line_text") < 60), ["lang", "doc_id", "line"], "lang")


# a layered graph: customers' nations -> regions -> nations -> suppliers
EDGES_SQL = """edges(src, dst) as (select distinct 'c' || c_nationkey, 'r' || n_regionkey from customer join nation on n_nationkey = c_nationkey union select distinct 'r' || n_regionkey, 'n' || n_nationkey from nation
  union select distinct 'n' || s_nationkey, 's' || s_suppkey from supplier union select distinct 's' || s_suppkey, 'r' || n_regionkey from supplier join nation on n_nationkey = s_nationkey)"""


def _edges(spark, d) -> DataFrame:
    n, c, s = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    a = c.select("c_nationkey").distinct().join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(name("c", "c_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    b = n.select(name("r", "n_regionkey"), name("n", "n_nationkey"))
    e = s.select(name("n", "s_nationkey"), name("s", "s_suppkey"))
    f = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(name("s", "s_suppkey"), name("r", "n_regionkey"))
    return a.union(b).union(e).union(f).distinct()


PATHS_SQL = "with recursive " + EDGES_SQL + """, paths(path, pos) as (select [src], src from (select distinct src from edges where src like 'c%') union all
  select list_append(p.path, e.dst), e.dst from paths p join edges e on e.src = p.pos where not list_contains(p.path, e.dst) and not (p.pos like 's%') and len(p.path) < 5)"""


def _paths(spark, d) -> DataFrame:
    e = _edges(spark, d)
    return graph.simple_paths(e, e.where("src like 'c%'").select(F.col("src").alias("node")), e.where("dst like 's%'").select(F.col("dst").alias("node")), max_nodes=5)


@query(PATHS_SQL + " select path[1] as source, path[-1] as sink, array_to_string(path, '>') as path, len(path) as n_nodes from paths where pos like 's%'")
def taint_paths(spark, d):
    return _paths(spark, d).select(F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("sink"), F.array_join("path", ">").alias("path"), F.col("n_nodes").cast("long").alias("n_nodes"))


@query(PATHS_SQL + """ select source, sink, path from (select path[1] as source, path[-1] as sink, array_to_string(path, '>') as path, row_number() over (partition by path[1], path[-1] order by len(path), path) as n from paths where pos like 's%') where n = 1""")
def taint_shortest(spark, d):
    return graph.shortest(_paths(spark, d)).select("source", "sink", F.array_join("path", ">").alias("path"))


@query("with recursive " + EDGES_SQL + """, back(origin, node, depth) as (select node, node, 0 from (select distinct dst as node from edges where dst like 's%') union select b.origin, e.src, b.depth + 1 from back b join edges e on e.dst = b.node where b.depth < 4)
  select node, source, depth from (select origin as node, node as source, depth, row_number() over (partition by origin order by depth, node) as n from back where node like 'c%') where n = 1""")
def backtrace_source(spark, d):
    e = _edges(spark, d)
    return graph.back_to_source(e, e.where("dst like 's%'").select(F.col("dst").alias("node")).distinct(), e.where("src like 'c%'").select(F.col("src").alias("node")).distinct())


CFG = [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1), (5, 6), (3, 7), (7, 6)]
CFG_SQL = "cfg(graph, src, dst) as (select n_nationkey, a + n_nationkey * 10, b + n_nationkey * 10 from nation, (values " + ", ".join(map(str, CFG)) + ") v(a, b))"


def _cfg(spark, d) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CFG]))
    g = table(spark, d, "nation").select(F.col("n_nationkey").alias("graph"), pairs.alias("e"))
    return g.select("graph", (F.col("e.a") + F.col("graph") * 10).alias("src"), (F.col("e.b") + F.col("graph") * 10).alias("dst"))


DOM_SQL = "with recursive " + CFG_SQL + """, nodes as (select distinct graph, n from (select graph, src as n from cfg union select graph, dst from cfg)),
  cut(graph, a, n) as (select n1.graph, n1.n, n1.graph * 10 from nodes n1 where n1.n <> n1.graph * 10 union select c.graph, c.a, e.dst from cut c join cfg e on e.graph = c.graph and e.src = c.n and e.dst <> c.a),
  dom as (select x.graph, x.n as a, y.n as b from nodes x join nodes y on x.graph = y.graph where x.n = x.graph * 10 or not exists (select 1 from cut c where c.graph = x.graph and c.a = x.n and c.n = y.n))"""


def _dom(spark, d):
    e = _cfg(spark, d)
    return graph.dominators(e, table(spark, d, "nation").select(F.col("n_nationkey").alias("graph"), (F.col("n_nationkey") * 10).alias("node"))), e


@query(DOM_SQL + " select graph, a, b from dom")
def dominators(spark, d):
    return _dom(spark, d)[0]


@query(DOM_SQL + " select distinct d.graph, d.a as node, e.dst as at from dom d join cfg e on e.graph = d.graph and e.src = d.b where not exists (select 1 from dom s where s.graph = d.graph and s.a = d.a and s.b = e.dst and s.a <> s.b)")
def dominance_frontier(spark, d):
    dom, e = _dom(spark, d)
    return graph.frontier(dom, e)


@query("""with p as (select page_id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) as path from pages), c as (select page_id, i as ord, path || s as candidate from p, (values (0, ''), (1, '.html'), (2, '/')) v(i, s)), f as (select distinct path from p)
  select page_id, arg_min(candidate, ord) as resolved from c join f on f.path = c.candidate group by 1""")
def module_resolve(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1).alias("path"))
    cands = pages.select("page_id", F.posexplode(F.transform(F.array(F.lit(""), F.lit(".html"), F.lit("/")), lambda s: F.concat("path", s))).alias("ord", "candidate"))
    return crossfile.resolve(cands, pages.select(F.col("path").alias("file_path")), ["page_id"])


@query("""with e as (select distinct n_nationkey as importer, (n_nationkey * 7 + 3) % 25 as imported from nation union select distinct n_nationkey, n_regionkey from nation), c as (select n_nationkey as file_path from nation where n_regionkey = 1)
  select file_path from c union select importer from e join c on e.imported = c.file_path""")
def affected_files(spark, d):
    n = table(spark, d, "nation")
    e = n.select(F.col("n_nationkey").alias("importer"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("imported")).union(n.select("n_nationkey", "n_regionkey")).distinct()
    return crossfile.affected(e, n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("file_path")))


@query("""with recursive calls as (select n_nationkey as caller, n_regionkey as caller_param, (n_nationkey * 3 + 1) % 25 as callee, n_regionkey as callee_param from nation union select n_nationkey, (n_regionkey + 1) % 5, (n_nationkey + 5) % 25, n_regionkey from nation),
  known(func, param, finding) as (select distinct s_nationkey, s_suppkey % 5, 'F' || (s_suppkey % 3) from supplier union select c.caller, c.caller_param, k.finding from known k join calls c on c.callee = k.func and c.callee_param = k.param)
  select cast(func as bigint) as func, cast(param as bigint) as param, finding from known""")
def contract_fixpoint(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    k, r = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    calls = n.select(k.alias("caller"), r.alias("caller_param"), ((k * 3 + 1) % 25).alias("callee"), r.alias("callee_param")).union(n.select(k, (r + 1) % 5, (k + 5) % 25, r))
    contracts = s.select(F.col("s_nationkey").cast("long").alias("func"), (F.col("s_suppkey") % 5).alias("param"), F.concat(F.lit("F"), (F.col("s_suppkey") % 3).cast("string")).alias("finding"))
    return crossfile.contract_fixpoint(calls, contracts)


@query("""with a as (select doc_id, md5(text) as h from documents where doc_id % 7 <> 0), b as (select doc_id, md5(case when doc_id % 5 = 0 then text || 'x' else text end) as h from documents where doc_id % 11 <> 0)
  select doc_id, case when a.h is null then 'added' when b.h is null then 'removed' when a.h = b.h then 'same' else 'changed' end as change from a full join b using (doc_id)""")
def change_detect(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    a = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("hash"))
    b = docs.where("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash"))
    return incremental.changed_files(a, b, "doc_id")


@query("""with f as (select doc_id, md5('docs/' || doc_id) || '_' || md5(text) || '_' || 'r0' as k from documents), c as (select k, doc_id % 48 < 24 as live from f where doc_id % 2 = 0)
  select f.doc_id, exists (select 1 from c where c.k = f.k and c.live) as hit from f""")
def cache_probe(spark, d):
    f = table(spark, d, "documents").select("doc_id", incremental.cache_key(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")), F.col("text"), "r0").alias("cache_key"))
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    cache = f.where("doc_id % 2 = 0").select("cache_key", F.timestamp_seconds(F.unix_timestamp(now) - (F.col("doc_id") % 48) * 3600).alias("cached_at")).dropDuplicates(["cache_key"])
    hits, misses = incremental.probe(f, cache, now)
    return hits.select("doc_id", F.lit(True).alias("hit")).union(misses.select("doc_id", F.lit(False)))


@query("select event_id, user_id from (select event_id, user_id, lead(ts) over (partition by user_id order by ts, event_id) - ts as gap from events) where gap is null or gap > interval 30 minute")
def debounce(spark, d):
    from ..streaming.documents import settled

    return settled(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "ts", 1800.0).select("event_id", "user_id")


@query("""with v as (select conv_id, max(turn) as newest from conversations where role = 'user' group by 1) select c.conv_id, turn, role from conversations c join v using (conv_id) where turn >= newest""")
def version_guard(spark, d):
    from ..streaming.documents import newest_only

    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("version"))
    return newest_only(turns, turns.where("role = 'user'"), "conv_id").select("conv_id", "turn", "role")


@query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), q as (select * from v where vec_id % 20 = 0)
  select query_id, vec_id, rank from (select q.vec_id as query_id, v.vec_id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, v.e), 9) desc, v.vec_id) as rank from q, v where v.vec_id <> q.vec_id) where rank <= 5""")
def embed_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return joins.nearest_vectors(v.where("vec_id % 20 = 0"), v, "vec_id", "e", 5)


@query("with " + FOUND_SQL + """ select rule_id, file_path, line, cast(to_json({ruleId: rule_id, level: 'note', message: {text: 'A license line.'}, locations: [{physicalLocation: {artifactLocation: {uri: file_path}, region: {startLine: line}}}]}) as varchar) as result from fp""")
def sarif_rows(spark, d):
    from ..sinks.reports import sarif_results

    return sarif_results(_found(spark, d).withColumn("severity", F.lit("Low")))


@query("select date_trunc('day', ts) as start, event_type, count(*) as count from events group by 1, 2")
def watermark_window(spark, d):
    """An addition: tumbling windows, whose streaming form has a watermark."""
    from ..streaming.documents import windowed_counts

    got = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"], "1 hour")
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))
