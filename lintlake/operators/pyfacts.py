"""Facts of Python files, from the standard library's parser: functions, imports, calls. A file that doesn't parse has none."""

from __future__ import annotations

import ast
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import in_python

FACTS = "file_path string, kind string, name string, params array<string>, target string, args array<string>, start int, end int, hash string"


def facts(path: str, language: str, code: str) -> list[tuple]:
    if language != "python":
        return []
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = code.split("\n"), []

    def visit(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            name = prefix
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{prefix}.{child.name}" if prefix else child.name
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                a = child.args
                params = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
                text = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                out.append((path, "function", name, params, None, None, child.lineno, child.end_lineno, hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()))
            elif isinstance(child, ast.Import):
                out.extend((path, "import", x.asname or x.name, None, x.name, None, child.lineno, child.end_lineno, None) for x in child.names)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                out.extend((path, "import", x.asname or x.name, None, f"{module}:{x.name}", None, child.lineno, child.end_lineno, None) for x in child.names)
            elif isinstance(child, ast.Call):
                args = [ast.unparse(x) for x in child.args] + [f"{k.arg}={ast.unparse(k.value)}" for k in child.keywords if k.arg]
                out.append((path, "call", prefix, None, ast.unparse(child.func), args, child.lineno, child.end_lineno, None))
            visit(child, name)

    visit(tree, "")
    return out


def python_facts(files: DataFrame) -> DataFrame:
    return in_python(files, facts, FACTS)


def functions(facts: DataFrame) -> DataFrame:
    """file_path, name, params, start, end, hash; of a name that a file defines more than once each has its number."""
    f = facts.where("kind = 'function'")
    return f.select("file_path", "name", "params", "start", "end", "hash")


def calls_by_alias(facts: DataFrame) -> DataFrame:
    """file_path, caller, callee (with the imported name written out), args, line."""
    imports = facts.where("kind = 'import'").select("file_path", F.col("name").alias("alias"), F.replace("target", F.lit(":"), F.lit(".")).alias("full")).dropDuplicates(["file_path", "alias"])
    head = F.regexp_extract("target", r"\A[A-Za-z_]\w*", 0)
    calls = facts.where("kind = 'call'").withColumn("alias", head).join(imports, ["file_path", "alias"], "left")
    callee = F.when(F.col("full").isNull(), F.col("target")).otherwise(F.concat("full", F.expr("substring(target, length(alias) + 1)")))
    return calls.select("file_path", F.col("name").alias("caller"), callee.alias("callee"), "args", F.col("start").alias("line"))
