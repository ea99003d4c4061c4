"""Scans of whole projects: calls across files, the taint graph, what has changed, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from lintlake import cli
from lintlake.plans import project
from lintlake.plans.scan import scan

FILES = "file_path string, language string, code string"
DB = "def run(cursor, q):\n    return open(q)\n\ndef safe(cursor, n):\n    return open('fixed')\n"
SERVICE = "from lib.db import run\n\ndef lookup(cursor, name):\n    return run(cursor, name)\n"


def py(spark, **files):
    return spark.createDataFrame([(k.replace("__", "/") + ".py", "python", v) for k, v in files.items()], FILES)


def lines_of(df, path):
    return sorted((r.line, r.vuln_type) for r in df.collect() if r.file_path == path)


def test_input_handed_to_another_file(spark):
    app = "from lib.db import run, safe\nimport lib.db as db\nx = request.args.get('x')\nrun(c, x)\ndb.run(c, request.form['y'])\nsafe(c, x)\nrun(c, 'fixed')\n"
    got = project.cross_file(py(spark, lib__db=DB, app=app))
    assert lines_of(got, "app.py") == [(4, "PATH_TRAVERSAL"), (5, "PATH_TRAVERSAL")]
    assert got.where("file_path <> 'app.py'").count() == 0


def test_contracts_spread_through_callers(spark):
    app = "from service import lookup\nlookup(c, request.args['x'])\n"
    got = project.cross_file(py(spark, lib__db=DB, service=SERVICE, app=app))
    assert lines_of(got, "app.py") == [(2, "PATH_TRAVERSAL")]
    assert project.cross_file(py(spark, app="from nowhere import f\nf(request.args)\n")).count() == 0


def test_relative_imports_and_packages(spark):
    a = "from .db import run\nrun(c, request.args['x'])\n"
    b = "from . import db\ndb.run(c, request.args['x'])\n"
    got = project.cross_file(py(spark, pkg__db=DB, pkg__a=a, pkg__b=b))
    assert lines_of(got, "pkg/a.py") == lines_of(got, "pkg/b.py") == [(2, "PATH_TRAVERSAL")]


def test_the_graph_and_a_registry_that_grows(spark):
    code = "x = request.args.get('x')\ny = x + '!'\nlaunch(y)\n"
    files = py(spark, a=code)
    assert project.taint_graph(files).count() == 0
    more = [("sink", "launch", "sub", "launch(", "python", "RCE", "Critical", "CWE-78")]
    got = project.taint_graph(files, more).collect()
    assert [(r.line, r.vuln_type, r.severity) for r in got] == [(3, "RCE_COMMAND_EXEC", "Critical")]
    assert (3, "RCE_COMMAND_EXEC") in lines_of(scan(files, registry=more, graph=True), "a.py") and lines_of(scan(files), "a.py") == []
    cleaned = py(spark, a="x = request.args.get('x')\ny = int(x)\nlaunch(y)\n")
    assert project.taint_graph(cleaned, more).count() == 0


def test_only_what_changed_is_scanned_again(spark):
    files = py(spark, a="import os\nos.system(request.args['c'])\n", b="x = 1\n")
    columns = "cache_key string, file_path string, line int, rule_id string, vuln_type string, severity string, message string, details string, ord int"
    seen = []

    def counted(rows):
        seen.append(sorted(r.file_path for r in rows.collect()))
        return scan(rows)

    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    found, entries = project.incremental_scan(files, spark.createDataFrame([], "cache_key string, cached_at timestamp"), spark.createDataFrame([], columns), "r1", now, counted)
    first = {(r.file_path, r.line) for r in found.collect()}
    cache, entries = spark.createDataFrame(found.collect(), found.schema), spark.createDataFrame(entries.collect(), entries.schema)
    changed = files.withColumn("code", F.when(F.col("file_path") == "b.py", "import os\nos.system(request.args['d'])\n").otherwise(F.col("code")))
    found, later = project.incremental_scan(changed, entries, cache, "r1", now, counted)
    assert first == {("a.py", 2)} and {(r.file_path, r.line) for r in found.collect()} == {("a.py", 2), ("b.py", 2)}
    assert seen == [["a.py", "b.py"], ["b.py"]] and later.count() == 2
    project.incremental_scan(changed, entries, cache, "r2", now, counted)
    assert seen[-1] == ["a.py", "b.py"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    (root / "lib").mkdir(parents=True)
    (root / "a.py").write_text("import os\nos.system(request.args['c'])\n")
    (root / "lib/b.py").write_text("x = 1\n")
    (root / "lib/c.php").write_text("<?php\necho $_GET['q'];\n")
    return root


def test_command_line(spark, tree, tmp_path, capsys):
    out = tmp_path / "report"
    assert cli.main([str(tree), "--output", str(out)], spark) == 1
    doc = json.loads(out.read_text())
    assert set(doc["results"]) == {"a.py", "lib/c.php"} and doc["summary"]["total_issues"] == 2
    assert cli.main([str(tree), "--format", "sarif"], spark) == 1
    assert len(json.loads(capsys.readouterr().out)["runs"][0]["results"]) == 2
    assert cli.main([str(tree), "--severity", "Critical", "--format", "markdown", "--output", str(out)], spark) == 1 and "lib/c.php" not in out.read_text()
    assert cli.main([str(tree), "--ignore", "*.php", "--disable", "RCE_COMMAND_EXEC"], spark) == 0
    assert cli.main([str(tree / "missing")], spark) == 2
    changed = tmp_path / "changed"
    changed.write_text("lib/b.py\n")
    assert cli.main([str(tree), "--changed", str(changed)], spark) == 0
    capsys.readouterr()


def test_command_line_with_a_baseline(spark, tree, tmp_path, capsys):
    base = tmp_path / "base"
    assert cli.main([str(tree), "--write-baseline", str(base)], spark) == 0
    assert cli.main([str(tree), "--baseline", str(base)], spark) == 0
    (tree / "new.py").write_text("eval(request.args['x'])\n")
    assert cli.main([str(tree), "--baseline", str(base), "--format", "html"], spark) == 1
    assert "new.py" in capsys.readouterr().out
    (tmp_path / "broken.json").write_text("[")
    assert cli.main([str(tree), "--baseline", str(tmp_path / "broken.json")], spark) == 2
