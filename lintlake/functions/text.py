"""Scalar functions over text, paths and hashes, all built in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_newlines(code: Column) -> Column:
    return F.regexp_replace(code, "\r\n?", "\n")


def hash_prefix(*parts: Column, n: int = 16, kind: str = "sha256", sep: str = "|") -> Column:
    text = F.concat_ws(sep, *[p.cast("string") for p in parts])
    return F.substring(F.sha2(text, 256) if kind == "sha256" else F.md5(text), 1, n)


def fingerprint(rule_id: Column, path: Column, line: Column) -> Column:
    """What a finding is known by in a baseline."""
    return hash_prefix(rule_id, path, line)


def node_id(*parts: Column) -> Column:
    return hash_prefix(*parts, n=12, kind="md5", sep=":")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression: * crosses folders, as in fnmatch."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def path_excluded(path: Column, relative: Column, globs: list[str]) -> Column:
    """A pattern fits the whole path, the relative one, or that with a leading slash."""
    hit = F.lit(False)
    for g in globs:
        r = glob_regex(g)
        hit = hit | path.rlike(r) | relative.rlike(r) | F.concat(F.lit("/"), relative).rlike(r)
    return hit


def file_matches(path: Column, wanted: Column) -> Column:
    """A ground-truth file: a suffix of the path, or a part of it."""
    return path.endswith(wanted) | F.contains(path, wanted)


def likely_seed(path: Column) -> Column:
    return F.lower(path).rlike("seed|migration|fixture|factory|factories|mock|dummy")


def title_case(rule_id: Column) -> Column:
    return F.initcap(F.regexp_replace(F.lower(rule_id), "_", " "))


def code_only(line: Column) -> Column:
    """A C-like line without its comments and with its strings emptied: strings are skipped as whole tokens, so that // in one is none."""
    kept = F.regexp_replace(line, r"""("(?:\\.|[^"\\])*+")|//.*""", "$1")
    kept = F.regexp_replace(kept, r"/\*.*?\*/", "")
    return F.trim(F.regexp_replace(kept, r'"(?:\\.|[^"\\])*+"', '""'))


def literal_length(body: Column) -> Column:
    """Characters of a C string body, an escape sequence being one."""
    return F.length(F.regexp_replace(body, r"\\(?:[xX][0-9a-fA-F]*|[0-7]{1,3}|.)", "x"))


def line_comment(line: Column) -> Column:
    """The first # or // comment outside quotes, from its marker on; null without one."""
    rest = F.regexp_replace(line, r"""\A(?:[^"'`#/]|/(?!/)|"(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+'|`(?:\\.|[^`\\])*+`)*+""", "")
    return F.when(rest.startswith("#") | rest.startswith("//"), rest)


def looks_secret(value: Column) -> Column:
    """12 characters at least, and of those 16 of high variety, or 20 in all."""
    return (F.length(value) >= 12) & ((F.length(F.regexp_replace(value, r"[^A-Za-z0-9+/=_\-]", "")) >= 16) | (F.length(value) >= 20))


def placeholder(value: Column) -> Column:
    return F.lower(value).rlike(r"\A(?:changeme|change_me|example|sample|test|null|none|todo|xxx+|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|\*+)\z")
