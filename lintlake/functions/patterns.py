"""Line patterns with metavariables ($NAME), compiled for the JVM's regular expressions and for RE2."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_META = re.compile(r"\$(\w+)")
_SPECIAL = set("\\.[]{}()*+?^$|")


@dataclass(frozen=True)
class Pattern:
    text: str
    #: name -> (regex that a capture must hold, regex that it must not)
    metavariables: dict = field(default_factory=dict)
    file_regex: str | None = None
    file_not_regex: str | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    language: str
    severity: str
    message: str
    vuln_type: str
    patterns: tuple[Pattern, ...]
    tests: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Compiled:
    regex: str
    names: tuple[str, ...]  #: of the groups, in order
    re2_ok: bool


def _literal(text: str) -> str:
    """Blanks may be any white space or none; all else stands for itself."""
    return "".join(r"\s*" if c == " " else "\\" + c if c in _SPECIAL else c for c in text)


def _capture(before: str, after: str) -> str:
    """What a metavariable takes: up to the quote or brace beside it, else what isn't white space."""
    if after in ('"', "'"):
        return f"[^{after}]+"
    return {"{": "[^{}\"']+", "}": "[^}]+"}.get(after, r"\S+")


def compile_pattern(pattern: str) -> Compiled:
    """Positional groups, which both dialects have. A name used twice is an error in a pattern: it never matches."""
    parts, names, at = [], [], 0
    for m in _META.finditer(pattern):
        parts += [_literal(pattern[at : m.start()]), "(" + _capture(pattern[m.start() - 1 : m.start()], pattern[m.end() : m.end() + 1]) + ")"]
        names.append(m[1])
        at = m.end()
    parts.append(_literal(pattern[at:]))
    if len(set(names)) < len(names) or any(n[0].isdigit() for n in names):
        return Compiled(r"[^\s\S]", (), True)
    return Compiled("".join(parts), tuple(names), True)


def java(regex: str) -> str:
    """Python's flavour for the JVM: named groups lose underscores, which it refuses, and classes know all of Unicode."""
    return re.sub(r"\(\?P<(\w+)>", lambda m: "(?<" + m[1].replace("_", "") + ">", regex)


def re2_ok(regex: str) -> bool:
    return not re.search(r"\(\?<?[!=]|\\\d|[*+?}]\+", regex)
