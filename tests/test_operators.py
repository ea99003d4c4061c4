import json
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lintlake.functions import patterns, text
from lintlake.operators import cpp, crossfile, findings, graph, incremental, joins, match, pyfacts, quality, sast, suppress, taint
from lintlake.plans import dims
from lintlake.plans.scan import scan
from lintlake.sinks import reports
from lintlake.sources import files, rules


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


# -- patterns and registry -----------------------------------------------------------------------------------------


def test_pattern_language():
    c = patterns.compile_pattern('$VAR = "$SECRET"')
    assert c.names == ("VAR", "SECRET") and c.regex == r'(\S+)\s*=\s*"([^"]+)"'
    assert patterns.compile_pattern("f($A, $A)").names == ()
    assert patterns.compile_pattern("f'{$X}'").regex == r"f'\{([^}]+)\}'"
    assert not patterns.re2_ok(r"(?!a)b") and patterns.re2_ok(r"a+b")


def test_shipped_rules_pass_their_own_tests(spark):
    got = match.embedded_tests(spark, rules.SHIPPED).collect()
    assert got and all(r.passed for r in got)


def test_rules_from_yaml(tmp_path, spark):
    (tmp_path / "b.yaml").write_text('id: x\nlanguage: python\nseverity: high\nmessage: m\nvuln_type: T\npatterns:\n  - pattern: eval($A)\n    where: {file_not_regex: "test"}\ntests:\n  - {name: one, code: "eval(x)", expect_findings: true}\n')
    (tmp_path / "a.yml").write_text("nonsense: [")
    (tmp_path / "c.yaml").write_text("id: y\n")
    loaded = rules.load_rules(tmp_path)
    assert [r.id for r in loaded] == ["x"] and match.embedded_tests(spark, loaded).first().passed
    assert rules.safe_folders(["sub", "../out", "."], tmp_path) == [tmp_path / "sub", tmp_path]
    lines = match.lines_of(frame(spark, [("t/test_a.py", "python", "eval(q)"), ("a.py", "python", "x\neval(q)\n")], "file_path string, language string, code string"))
    assert rows_of(match.match_rules(lines, loaded), "file_path", "line", "severity") == [("a.py", 2, "High")]


def test_registry_is_first_match(spark):
    df = frame(spark, [("urllib.request.urlopen(u)", "python"), ("x = print(1)", "python"), ("eval(x)", "php"), ("EVAL(x)", "javascript")], "t string, l string")
    pick = lambda k: match.first_registered(F.col("t"), F.col("l"), dims.PATTERNS, k)
    got = df.select("t", pick("sink").alias("s"), pick("sanitizer").alias("c")).collect()
    assert [r.s for r in got] == ["open_file", None, "php_eval", "eval"] and got[1].c == "int_cast_py"
    assert dims.registry(spark).count() == 149


def test_languages(spark):
    df = frame(spark, [(" Py ", "a.go"), (None, "x/B.TSX"), ("zz", "a.h"), (None, ".py"), (None, None)], "a string, p string")
    assert [r[0] for r in df.select(dims.language_of(F.col("a"), F.col("p"))).collect()] == ["python", "typescript", "c", None, None]


# -- text -------------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    df = frame(spark, [('a("x // y"); // c', "<b>&'", r"a\n\x41\101z")], "c string, h string, l string")
    r = df.select(text.code_only(F.col("c")), text.html_escape(F.col("h")), text.literal_length(F.col("l")), text.line_comment(F.lit("s = '# no' # yes")), text.line_comment(F.lit('"//"')), text.fingerprint(F.lit("SQL_INJECTION"), F.lit("a.py"), F.lit(3))).first()
    assert tuple(r) == ('a("");', "&lt;b&gt;&amp;&#x27;", 5, "# yes", None, "6bc07cb7cd32bdb3")
    assert [bool(x) for x in df.select(*[F.lit(p).rlike(text.glob_regex(g)) for p, g in [("a/b.py", "*.py"), ("a/b.pyc", "*.py"), ("x1", "x[0-9]"), ("xa", "x[!0-9]")]]).first()] == [True, False, True, True]


# -- findings ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("against", ["last", "any"])
def test_thin_lines_equals_a_loop(spark, against):
    rng = random.Random(1)
    data = [(g, rng.randrange(60)) for g in "abc" for _ in range(25)]
    want = []
    for g in "abc":
        kept = []
        for x in sorted({v for h, v in data if h == g}):
            if not kept or (x - kept[-1] > 4 if against == "last" else all(abs(x - k) > 4 for k in kept)):
                kept.append(x)
        want += [(g, x) for x in kept]
    assert rows_of(findings.thin_lines(frame(spark, data, "g string, line int"), 4, ["g"], against=against), "g", "line") == sorted(want, key=str)


def test_shaping(spark):
    raw = frame(spark, [({"type": "X", "severity": "HIGH", "confidence": "low", "file": "a", "line": "7", "odd": "1"},), ({"rule_id": "r", "severity": "?", "confidence": "0.75"},)], "m map<string,string>")
    a, b = [r.f for r in raw.select(findings.normalise(F.col("m")).alias("f")).collect()]
    assert (a.rule_id, a.severity, a.confidence, a.file_path, a.extra) == ("X", "High", 0.3, "a", {"odd": "1"}) and (b.severity, b.confidence) == ("Medium", 0.75)
    d = findings.diagnostic(frame(spark, [("a", "r", "m", 3, None, None, None, None, "Low")], "file_path string, rule_id string, message string, line int, start_line int, start_character int, end_line int, end_character int, severity string")).first()
    assert (d.start_line, d.start_character, d.end_character, d.level) == (2, 0, 999, 3)
    f = frame(spark, [("a", "r", 1, "T", "Low", 1), ("a", "r", 1, "T", "High", 2), ("a", "", 1, "T", "Low", 3), ("a", "", 1, "T", "Low", 4)], "file_path string, rule_id string, line int, vuln_type string, severity string, ord int")
    assert rows_of(findings.first_wins(f), "ord") == [(1,), (3,), (4,)] and rows_of(findings.best_of_group(f), "ord") == [(2,)]
    assert findings.at_least(f, "High").count() == 1 and findings.at_least(f, "odd").count() == 1


def test_merge_unites_locations(spark):
    s = "file_path string, rule_id string, vuln_type string, line int, related array<string>, message string"
    got = findings.merge_findings(frame(spark, [("a", "r", "T", 1, ["x"], "m")], s), frame(spark, [("a", "r", "T", 1, ["x", "y"], "n"), ("b", "r", "T", 1, [], "n")], s))
    assert rows_of(got, "file_path", "related", "message") == [("a", ["x", "y"], "m"), ("b", [], "n")]


# -- suppression ------------------------------------------------------------------------------------------------------


def test_markers(spark):
    code = "a() # lint-ignore\nb()\n// lint-ignore: XSS\nc()\ns = '# lint-ignore'\nd()"
    lines = match.lines_of(frame(spark, [("f", code)], "file_path string, code string"))
    found = frame(spark, [("f", n, t) for n in range(1, 7) for t in ("XSS", "SQL")], "file_path string, line int, vuln_type string")
    assert rows_of(suppress.drop_silenced(found, suppress.markers_in_comments(lines)), "line", "vuln_type") == [(2, "SQL"), (2, "XSS"), (3, "SQL"), (3, "XSS"), (4, "SQL"), (5, "SQL"), (5, "XSS"), (6, "SQL"), (6, "XSS")]
    assert rows_of(suppress.drop_silenced(found, suppress.markers_loose(lines)), "line", "vuln_type") == [(3, "SQL"), (4, "SQL")]


def test_baseline_and_marks(spark, tmp_path):
    s = "rule_id string, file_path string, line int, vuln_type string, details string"
    f = frame(spark, [("r", "a", 1, "T", "abc"), ("r", "a", 2, "T", "zz"), ("r", "b", 1, "T", "")], s)
    base = suppress.with_fingerprint(f.where("line = 1")).select("rule_id", "file_path", "line", "fingerprint")
    assert rows_of(suppress.new_findings(f, base), "file_path", "line") == [("a", 2)] and suppress.known_findings(f, base).count() == 2
    assert suppress.add_to_baseline(base, f).count() == 3
    reports.write_baseline(base, str(tmp_path / "base"))
    assert rows_of(files.read_baseline(spark, str(tmp_path / "base")), "fingerprint") == rows_of(base, "fingerprint")
    marks = frame(spark, [("a", 1, "T", "xabcx"), ("a", 2, "T", "other"), ("b", 1, "T", "any")], "file_path string, line int, vuln_type string, details string")
    assert rows_of(suppress.drop_marked(f, marks), "file_path", "line") == [("a", 2)]


# -- joins ------------------------------------------------------------------------------------------------------------


def test_joins_equal_loops(spark):
    rng = random.Random(2)
    pts = [(i, rng.choice("ab"), rng.randrange(100)) for i in range(60)]
    spans = [(i, rng.choice("ab"), lo, lo + rng.randrange(30)) for i, lo in enumerate(rng.randrange(100) for _ in range(25))]
    p = frame(spark, pts, "id int, f string, at int")
    got = joins.first_interval(p, frame(spark, spans, "sid int, f string, lo int, hi int"), ["f"], "at", "lo", "hi", "sid", 10)
    want = [(i, min(s for s, g, lo, hi in spans if g == f and lo <= at <= hi)) for i, f, at in pts if any(g == f and lo <= at <= hi for _, g, lo, hi in spans)]
    assert rows_of(got, "id", "sid") == sorted(want, key=str)
    near = joins.nearest_in_band(p, frame(spark, [(s, f, lo) for s, f, lo, _ in spans], "sid int, f string, x int"), ["f"], "at", "x", 3, ["sid"])
    best = {i: min(((abs(at - lo), s) for s, g, lo, _ in spans if g == f and abs(at - lo) <= 3), default=None) for i, f, at in pts}
    assert rows_of(near, "id", "sid") == sorted(((i, b[1]) for i, b in best.items() if b), key=str)


def test_greedy_tolerance(spark):
    e = frame(spark, [(1, "T", "a.py", [5], True), (2, "T", "a.py", [6, 40], True), (3, "T", "a.py", [6], False), (4, "U", "a.py", [5], True)], "id long, vuln_type string, file string, line_candidates array<int>, is_true_positive boolean")
    f = frame(spark, [(10, "src/a.py", 6, "T"), (11, "src/a.py", 8, "T")], "found_id long, file_path string, line int, vuln_type string")
    assert rows_of(joins.greedy_tolerance(e, f), "id", "found_id") == [(1, 10), (2, 11), (3, None), (4, None)]


def test_nearest_vectors_equal_sql_on_odd_vectors(spark):
    rng = random.Random(6)
    some = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(some)] + [(100 + i, some[0]) for i in range(12)] + [(200 + i, [2 * x for x in some[5]]) for i in range(4)]
    rows += [(300, [0.0] * 4), (301, [0.0] * 4), (310, None), (320, [float("nan"), 1.0, 0.0, 0.0]), (330, [1e200] * 4), (340, [1e-200] * 4), (None, some[3])]
    asked = [0, 5, 7, 100, 300, 310, 320, 330, 340]
    have = frame(spark, rows, "vec_id long, e array<double>")
    c = duckdb.connect()
    c.execute("create table v (vec_id bigint, e double[])")
    c.executemany("insert into v values (?, ?)", rows)
    want = """select query_id, vec_id, rank from (select q.vec_id as query_id, v.vec_id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, v.e), 9) desc, v.vec_id) as rank from v q, v where v.vec_id <> q.vec_id and q.vec_id in %s) where rank <= %d"""
    for k, block, query_block in ((5, 10_000, 2_000), (60, 7, 3), (5, 7, 3)):
        got = joins.nearest_vectors(have.where(F.col("vec_id").isin(asked)), have, "vec_id", "e", k, block, query_block)
        assert rows_of(got, "query_id", "vec_id", "rank") == sorted(c.sql(want % (tuple(asked), k)).fetchall(), key=str)


def test_nearest_vectors_form_no_pairs_before_the_nearest_are_taken(spark):
    have = frame(spark, [(i, [float(i), 1.0]) for i in range(9)], "vec_id long, e array<double>")
    got = joins.nearest_vectors(have, have, "vec_id", "e", 2)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.where("query_id = 8").orderBy("rank").select("vec_id").collect() == [(7,), (6,)]


# -- graphs -----------------------------------------------------------------------------------------------------------


def test_paths_equal_depth_first_search(spark):
    rng = random.Random(3)
    es = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(22)}
    out = defaultdict(list)
    for a, b in es:
        out[a].append(b)
    sinks, want = {"n7", "n8"}, []

    def walk(path):
        for b in out[path[-1]]:
            if b not in path:
                if b in sinks:
                    want.append([*path, b])
                elif len(path) + 1 < 6:
                    walk([*path, b])

    for s in ("n0", "n1"):
        walk([s])
    one = lambda x: frame(spark, [(n,) for n in x], "node string")
    got = graph.simple_paths(frame(spark, list(es), "src string, dst string"), one(["n0", "n1"]), one(sinks), max_nodes=6)
    assert sorted(r.path for r in got.collect()) == sorted(want)
    marked = graph.sanitised(got, one(["n3"]))
    assert all(r.is_sanitised == ("n3" in r.path[1:-1]) for r in marked.collect())


def test_nearest_source_by_breadth_first_search(spark):
    rng = random.Random(5)
    es = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(80)})
    sources, nodes = {0, 1, 2, 11, 30}, {*range(0, 60, 2), 99, 1}
    into = defaultdict(set)
    for a, b in es:
        into[b].add(a)
    want = []
    for n in nodes:
        seen, layer, depth = {n}, {n}, 0
        while layer and not layer & sources:
            layer = {a for b in layer for a in into[b]} - seen
            seen, depth = seen | layer, depth + 1
        if layer:
            want.append((n, min(layer & sources), depth))
    one = lambda x: frame(spark, [(n,) for n in [*x, *list(x)[:2], None]], "node int")
    got = graph.back_to_source(frame(spark, [*es, *es[:3], (None, 2)], "src int, dst int"), one(nodes), one(sources))
    assert rows_of(got, "node", "source", "depth") == sorted(want, key=str)


def test_nearest_source_keeps_as_many_rows_as_there_are_nodes(spark, monkeypatch):
    n, held, settle = 200, [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: held.append(out := settle(df)) or out)
    # all sinks lead back to the hub that all of them come from
    es = [("hub", f"s{i}") for i in range(n)] + [(f"s{i}", "hub") for i in range(n)] + [("c", "hub")]
    one = lambda x: frame(spark, [(v,) for v in x], "node string")
    got = graph.back_to_source(frame(spark, es, "src string, dst string"), one([f"s{i}" for i in range(n)]), one(["c"]))
    assert rows_of(got, "source", "depth") == [("c", 2)] * n
    assert max(df.count() for df in held) <= len(es)


def test_dominators_by_removal(spark):
    rng = random.Random(4)
    es = sorted({(i, rng.randrange(i + 1, 9)) for i in range(8) for _ in range(2)} | {(6, 2)})
    succ = defaultdict(set)
    for a, b in es:
        succ[a].add(b)

    def live(cut):
        seen, todo = set(), [0]
        while todo:
            n = todo.pop()
            if n != cut and n not in seen:
                seen.add(n)
                todo += succ[n]
        return seen

    nodes = live(None)
    want = sorted((a, b) for a in nodes for b in nodes if a == b or b not in live(a))
    dom = graph.dominators(frame(spark, [(1, *e) for e in es], "graph int, src int, dst int"), frame(spark, [(1, 0)], "graph int, node int"))
    assert sorted((r.a, r.b) for r in dom.collect()) == want
    idom = dict((r.node, r.idom) for r in graph.immediate(dom).collect())
    assert all((idom[n], n) in want and all((d, idom[n]) in want for d, b in want if b == n and d != n) for n in nodes - {0})


def test_taint_graph(spark):
    code = ["a = req.query.id", "b = a + 1", "c = parseInt(a)", "d = other", "eval(b)", "eval(c)"]
    lines = frame(spark, [("f.js", "javascript", i, t) for i, t in enumerate(code, 1)], "file_path string, language string, line int, line_text string")
    assigns = taint.assignments(lines)
    calls = lines.where(F.col("line_text").startswith("eval")).withColumnRenamed("line_text", "text")
    n = taint.nodes(assigns, calls)
    p = taint.paths(n, taint.edges(n, whole_words=True))
    assert rows_of(taint.findings(n, p), "line") == [(5,)]
    assert taint.tracked(assigns).first().tainted == ["a", "b"]


# -- modules ----------------------------------------------------------------------------------------------------------


def test_modules(spark):
    f = frame(spark, [("app/a.js", "javascript", "import x from './lib/b'\nconst c = require('../c')\nexport function f() {}"), ("app/lib/b.ts", "typescript", "export * from './d'"), ("c/index.js", "javascript", ""), ("m.py", "python", "from pkg.mod import z\nimport os")], "file_path string, language string, code string")
    targets = crossfile.import_targets(f)
    assert rows_of(targets, "file_path", "target") == [("app/a.js", "../c"), ("app/a.js", "./lib/b"), ("app/lib/b.ts", "./d"), ("m.py", "os"), ("m.py", "pkg.mod")]
    got = crossfile.resolve(crossfile.candidates(targets), f, ["file_path", "target"])
    assert rows_of(got, "target", "resolved") == [("../c", "c/index.js"), ("./lib/b", "app/lib/b.ts")]
    edges = got.select(F.col("file_path").alias("importer"), F.col("resolved").alias("imported"))
    assert rows_of(crossfile.affected(edges, frame(spark, [("c/index.js",)], "file_path string")), "file_path") == [("app/a.js",), ("c/index.js",)]
    re_ = crossfile.reexported(frame(spark, [("a", "b"), ("b", "c"), ("x", "x2")], "src string, dst string"), frame(spark, [("a",)], "node string"))
    assert rows_of(re_, "origin", "node", "depth") == [("a", "c", 2)]


def test_summaries_fold_events(spark):
    ev = [("f", 1, "param", "a", None), ("f", 2, "param", "b", None), ("f", 3, "assign", "x", ["a"]), ("f", 4, "clean", "b", None), ("f", 5, "assign", "y", ["x", "b"]), ("f", 6, "return", None, ["y"]), ("g", 1, "assign", "q", ["*"]), ("g", 2, "return", None, ["q"])]
    got = crossfile.summaries(frame(spark, ev, "func string, ord int, kind string, name string, refs array<string>"))
    assert rows_of(got, "func", "returns_tainted", "tainted_params") == [("f", False, ["a"]), ("g", True, [])]


def test_python_facts(spark):
    f = frame(spark, [("a.py", "python", "import pickle as p\nclass C:\n    def f(self, x):\n        return p.loads(x)\n"), ("bad.py", "python", "def (")], "file_path string, language string, code string")
    facts = pyfacts.python_facts(f)
    assert rows_of(pyfacts.functions(facts), "name", "params", "start", "end") == [("C.f", ["self", "x"], 3, 4)]
    assert rows_of(pyfacts.calls_by_alias(facts), "caller", "callee", "args") == [("C.f", "pickle.loads", ["x"])]


# -- incremental ------------------------------------------------------------------------------------------------------


def test_incremental(spark):
    s = "file_path string, name string, hash string, file_hash string, start int"
    old = frame(spark, [("a", "f", "1", "A", 1), ("a", "g", "2", "A", 10), ("b", "f", "1", "B", 1), ("c", "f", "1", "C", 1), ("d", "f", "1", "D", 1), ("d", "g", "1", "D", 3)], s)
    new = frame(spark, [("a", "f", "1", "X", 1), ("a", "g", "9", "X", 14), ("b", "f", "1", "B", 1), ("c", "f", "9", "Y", 1), ("d", "f", "1", "Z", 1)], s)
    assert rows_of(incremental.scan_modes(old, new), "file_path", "mode", "changed") == [("a", "partial", ["g"]), ("b", "reuse", []), ("c", "full", ["f"]), ("d", "full", [])]
    moved = incremental.shifted(frame(spark, [("a", "g", 12), ("d", "g", 4)], "file_path string, name string, line int"), old, new)
    assert rows_of(moved, "file_path", "line") == [("a", 16)]
    src = frame(spark, [("import a\nx\ndef f():\n  1\ny",)], "c string").select(incremental.partial_source(F.col("c"), F.array(F.struct(F.lit(3).alias("start"), F.lit(4).alias("end"))))).first()[0]
    assert src == "import a\n\ndef f():\n  1\n"
    f = frame(spark, [("a", 1), ("a", 2), ("b", 1)], "file_path string, line int")
    assert rows_of(incremental.on_changed_lines(f, frame(spark, [("a", 2)], "file_path string, line int")), "file_path", "line") == [("a", 2), ("b", 1)]


# -- engines ----------------------------------------------------------------------------------------------------------

VULNERABLE = {
    ("python", "RCE_COMMAND_EXEC"): "import subprocess as sp\ndef f(request):\n    sp.run('ls ' + request.GET['d'], shell=True)",
    ("python", "SQL_INJECTION"): "def f(cursor, request):\n    n = request.args['n']\n    cursor.execute(f\"SELECT * FROM t WHERE n = '{n}'\")",
    ("python", "DESERIALIZATION"): "from pickle import loads\nloads(request.data)",
    ("python", "PATH_TRAVERSAL"): "p = request.args.get('p')\nopen(p)",
    ("python", "HARDCODED_CREDENTIALS"): "api_key = 'a8f5f167f44f4964e6c998dee827110c'",
    ("javascript", "XSS_RISK"): "el.innerHTML = req.query.q",
    ("javascript", "NOSQL_INJECTION"): "app.post('/', (req, res) => {\n  const u = req.body.u\n  db.users.findOne({ name: u })\n})",
    ("javascript", "SSRF"): "const u = req.query.u;\nfetch(u)",
    ("javascript", "OPEN_REDIRECT"): "res.redirect(req.query.next)",
    ("php", "SQL_INJECTION"): "<?php\n$id = $_GET['id'];\n$q = \"SELECT * FROM t WHERE id = $id\";\nmysqli_query($c, $q);",
    ("php", "XSS_RISK"): "<?php echo $_GET['x'];",
    ("java", "SQL_INJECTION"): "class A { void f(HttpServletRequest r, Statement s) {\n String id = r.getParameter(\"id\");\n String q = \"SELECT * FROM t WHERE id = \" + id;\n s.executeQuery(q);\n} }",
    ("java", "RCE_COMMAND_EXEC"): "class A { void f(HttpServletRequest r) {\n Runtime.getRuntime().exec(r.getParameter(\"c\"));\n} }",
    ("go", "PATH_TRAVERSAL"): 'func h(w http.ResponseWriter, r *http.Request) {\n\tn := r.FormValue("f")\n\tos.Open("/x/" + n)\n}',
    ("go", "RCE_COMMAND_EXEC"): 'func h(r *http.Request) {\n\texec.Command("sh", "-c", r.FormValue("c"))\n}',
}
SAFE = {
    ("python", "RCE_COMMAND_EXEC"): "import subprocess\nsubprocess.run(['ls', '-l'])",
    ("python", "SQL_INJECTION"): "cursor.execute('SELECT * FROM t WHERE n = ?', (request.args['n'],))",
    ("python", "DESERIALIZATION"): "import yaml\nyaml.load(request.data, Loader=yaml.SafeLoader)",
    ("python", "HARDCODED_CREDENTIALS"): "password = 'changeme'",
    ("javascript", "XSS_RISK"): "el.innerHTML = DOMPurify.sanitize(req.query.q)",
    ("javascript", "SSRF"): "fetch('https://example.com/a')",
    ("php", "SQL_INJECTION"): "<?php\n$id = intval($_GET['id']);\nmysqli_query($c, \"SELECT * FROM t WHERE id = $id\");",
    ("php", "XSS_RISK"): "<?php echo htmlspecialchars($_GET['x']);",
    ("java", "SQL_INJECTION"): 'class A { void f(HttpServletRequest r, Connection c) {\n PreparedStatement s = c.prepareStatement("SELECT * FROM t WHERE id = ?");\n s.setString(1, r.getParameter("id"));\n} }',
    ("go", "RCE_COMMAND_EXEC"): 'func h() {\n\texec.Command("ls", "-l")\n}',
}


def test_program_text_rules():
    for (language, kind), code in VULNERABLE.items():
        assert kind in {f[3] for f in sast.scan_text("app/x", language, code)}, (language, kind)
    for (language, kind), code in SAFE.items():
        assert kind not in {f[3] for f in sast.scan_text("app/x", language, code)}, (language, kind)
    assert sast.scan_text("x", "cobol", "MOVE A TO B") == [] and sast.scan_text("x", "python", "") == []


CPP = """char name[8];
strcpy(name, "short");
strcpy(name, "much too long");
cin >> name;
if (a = b) { }
EnterCriticalSection(&l1);
EnterCriticalSection(&l2);
LeaveCriticalSection(&l1);
if (p) {
  p->q->r = 1;
}
// gets(x);
printf("gets(");
system(cmd);"""


def test_cpp(spark):
    got = cpp.analyse(frame(spark, [("a.cpp", "cpp", CPP)], "file_path string, language string, code string"))
    assert rows_of(got, "line", "vuln_type") == sorted([(3, "BUFFER_OVERFLOW"), (4, "BUFFER_OVERFLOW"), (5, "ASSIGNMENT_IN_CONDITION"), (8, "LOCK_MISMATCH"), (10, "NULL_DEREFERENCE"), (14, "RCE_COMMAND_EXEC")], key=str)
    at = cpp.latest_assignment(frame(spark, [("f", "x", 5)], "file_path string, name string, line int"), frame(spark, [("f", "x", 1, "a"), ("f", "x", 3, "b"), ("f", "x", 5, "c")], "file_path string, name string, line int, value string"))
    assert rows_of(at, "assigned", "assigned_value") == [(3, "b")]


def project(spark, tmp_path):
    src = {"app/a.py": VULNERABLE["python", "PATH_TRAVERSAL"].encode(), "app/b.php": VULNERABLE["php", "XSS_RISK"].encode(), "lib/c.cpp": CPP.encode(), "node_modules/x.js": b"eval(a)", "README.md": b"x", "big.js": b"x" * 3_000_000, "bad.py": b"a = '\xff\xfe'\r\nb", "x.min.js": b"eval(a)", "package.json": b"{}", "weird.xyz": b"?"}
    for name, data in src.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return files.walk(spark, str(tmp_path))


def test_walk_and_scan_and_reports(spark, tmp_path):
    tree = project(spark, tmp_path / "p")
    why = dict(map(tuple, tree.select("file_path", "reason").collect()))
    assert why == {"app/a.py": None, "app/b.php": None, "lib/c.cpp": None, "bad.py": None, "node_modules/x.js": "excluded", "README.md": "excluded", "x.min.js": "excluded", "big.js": "too_large", "package.json": "unsupported_type", "weird.xyz": "unsupported_type"}
    assert tree.where("file_path = 'bad.py'").first().code == "a = ''\nb"
    found = scan(tree.where("reason is null")).persist()
    assert {"app/a.py", "app/b.php", "lib/c.cpp"} == {r.file_path for r in found.collect()}
    errors = spark.createDataFrame([("x", "boom")], "file_path string, error string")
    doc = json.loads(reports.sarif_document(found))
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == found.count() and {r["level"] for r in doc["runs"][0]["results"]} <= {"error", "warning", "note"}
    assert json.loads(reports.json_report(found, errors))["summary"]["total_issues"] == found.count()
    assert "## app/a.py" in reports.markdown_report(found, errors)
    assert "<td>app/a.py</td>" in reports.html_report(found, errors, dims.remediation(spark))
    reports.write_sarif(found, str(tmp_path / "sarif"))
    assert spark.read.text(str(tmp_path / "sarif/results")).count() == found.count()
    assert (reports.exit_status(found, 1), reports.exit_status(found, 0), reports.exit_status(found, 0, True)) == (2, 1, 0)
    base = suppress.with_fingerprint(found)
    assert scan(tree.where("reason is null"), baseline=base).count() == 0


def test_scan_does_not_depend_on_order_or_partitions(spark, tmp_path):
    tree = project(spark, tmp_path).where("reason is null").select("file_path", "language", "code")
    a, b = scan(tree), scan(tree.repartition(5).orderBy(F.rand(1)))
    assert rows_of(a, "file_path", "line", "rule_id") == rows_of(b, "file_path", "line", "rule_id")


def test_diffs(spark):
    d = frame(spark, [("a.py", "@@ -1,2 +3,2 @@ x\n+q\n@@ -9 +12 @@\n@@ -20,3 +30,0 @@")], "file_path string, diff string")
    assert rows_of(files.changed_lines(d), "line") == [(12,), (3,), (4,)]
    one = lambda *x: frame(spark, [(n,) for n in x], "file_path string")
    assert rows_of(files.changed_files(one("a.py", "b.md"), one("a.py"), one("c.go")), "file_path") == [("a.py",), ("c.go",)]


# -- quality ----------------------------------------------------------------------------------------------------------


def test_confusion_and_gates(spark):
    rows = frame(spark, [("x", "py", True, True), ("x", "js", True, False), ("y", "py", False, True), ("y", "py", False, False)], "c string, l string, e boolean, f boolean")
    got = {(r.c, r.l): r for r in quality.metrics(quality.confusion(rows, F.col("e"), F.col("f"), ["c", "l"])).collect()}
    assert len(got) == 1 + 2 + 2 + 3
    r = got[None, None]
    assert (r.tp, r.fp, r.fn, r.tn, r.recall, r.precision, r.fpr, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    assert got["y", "py"].recall == 0.0
    counts = frame(spark, [("t", 2, 3, 0, 1)], "k string, tp int, fp int, fn int, tn int")
    limits = frame(spark, [("t", 3, 3, None, 1)], "k string, min_tp int, max_fp int, max_fn int, min_tn int")
    g = quality.gates(counts, limits, ["k"]).first()
    assert (g.passed, g.broken) == (False, "tp")
