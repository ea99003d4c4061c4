"""Rules from YAML, and those that ship with the engine."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from ..functions.patterns import Pattern, Rule

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def rule_from(data: dict) -> Rule:
    """Raises ValueError for what isn't a rule."""
    try:
        patterns = tuple(
            Pattern(str(p["pattern"]), {k: (v.get("regex"), v.get("not_regex")) for k, v in (p.get("metavariables") or {}).items()}, (p.get("where") or {}).get("file_regex"), (p.get("where") or {}).get("file_not_regex"))
            for p in data["patterns"]
        )
        rule = Rule(str(data["id"]), str(data["language"]).lower(), str(data["severity"]).upper(), str(data["message"]), str(data["vuln_type"]), patterns, tuple({"file_path": None, **t} for t in data.get("tests") or ()))
    except (KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"not a rule: {e!r}") from e
    if not patterns or rule.severity not in SEVERITIES:
        raise ValueError("a rule needs a pattern and a known severity")
    return rule


@lru_cache(256)
def _load(path: str, mtime: int, size: int) -> Rule | None:
    import yaml

    try:
        return rule_from(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    except (ValueError, yaml.YAMLError, UnicodeDecodeError):
        return None


def load_rules(folder: str | Path) -> list[Rule]:
    """Rules of *.yml, then *.yaml, by name; files that aren't rules are passed over. Unchanged files are read once."""
    found = [*sorted(Path(folder).glob("*.yml")), *sorted(Path(folder).glob("*.yaml"))]
    rules = [_load(str(p), (s := p.stat()).st_mtime_ns, s.st_size) for p in found]
    return [r for r in rules if r]


def safe_folders(folders: list[str], root: str | Path) -> list[Path]:
    """Those below the root, without '..' in them."""
    base = Path(root).resolve()
    return [p for f in folders if ".." not in Path(f).parts and ((p := (base / f).resolve()) == base or base in p.parents)]


_NAMES = "(?i)(password|passwd|pwd|secret|token|api_?key)"
_NOT = "^(changeme|example|sample|test|null|none)$"
_REQUEST = r"(?i)\b(?:req|request)\.(?:query|body|params|cookies|headers)\b|\b(?:location\.(?:search|hash)|document\.cookie|window\.name)\b"


def _secret(language: str, *patterns: str) -> Rule:
    meta = {"VAR": (_NAMES, None), "SECRET": (None, _NOT)}
    return Rule(f"{language}.hardcoded-password", language, "HIGH", "A credential is written in the source.", "HARDCODED_CREDENTIALS", tuple(Pattern(p, meta) for p in patterns), ({"name": "finds a password", "code": f'password {":=" if language == "go" else "="} "S3cr3tValue!"', "expect_findings": 1, "file_path": None}, {"name": "passes a placeholder", "code": f'password {":=" if language == "go" else "="} "example"', "expect_findings": 0, "file_path": None}))


# The patterns.
SHIPPED = (
    _secret("go", '$VAR := "$SECRET"', '$VAR = "$SECRET"'),
    Rule("go.sql-injection-concat", "go", "HIGH", "A statement is built by concatenation.", "SQL_INJECTION", (Pattern('$DB.Query("SELECT" + $EXPR)'), Pattern('$DB.Exec("DELETE" + $EXPR)'))),
    Rule("javascript.sql-injection-concat", "javascript", "HIGH", "A statement is built by concatenation.", "SQL_INJECTION", (Pattern('$DB.query("SELECT" + $EXPR)'), Pattern('$DB.query("SELECT $SQL" + $EXPR)'), Pattern("$DB.query('SELECT' + $EXPR)"), Pattern("$DB.query('SELECT $SQL' + $EXPR)"), Pattern("$DB.query($SQL)", {"SQL": (r"(?i)\b(?:req|request)\.(?:query|body|params)\b|\b(?:location|document\.cookie)\b", None)}))),
    Rule("javascript.xss-innerhtml", "javascript", "HIGH", "Input becomes markup.", "XSS_RISK", (Pattern("$ELEM.innerHTML = $EXPR", {"EXPR": (None, r"""^(?!(?:req|request|location|document|window)\b)[A-Za-z_$][A-Za-z0-9_$]*(?:\[['"][^'"]+['"]\]|\.[A-Za-z_$][A-Za-z0-9_$]*)+\s*;?$""")}, None, "(?i)test|fixture"),)),
    Rule("javascript.xss-response-send", "javascript", "MEDIUM", "Input is sent back.", "XSS_RISK", (Pattern("res.send($EXPR)", {"EXPR": (_REQUEST, None)}), Pattern("res.write($EXPR)", {"EXPR": (_REQUEST, None)}))),
    _secret("python", '$VAR = "$SECRET"'),
    Rule("python.sql-injection-format", "python", "HIGH", "A statement is built by formatting.", "SQL_INJECTION", tuple(Pattern(p) for p in ('$CURSOR.execute("SELECT" % $EXPR)', '$CURSOR.execute("SELECT $SQL" % $EXPR)', "$CURSOR.execute('SELECT' % $EXPR)", "$CURSOR.execute('SELECT $SQL' % $EXPR)", '$CURSOR.execute(f"SELECT {$EXPR}")', '$CURSOR.execute(f"SELECT $SQL{$EXPR}")', "$CURSOR.execute(f'SELECT {$EXPR}')", "$CURSOR.execute(f'SELECT $SQL{$EXPR}')"))),
    Rule("python.xss-marksafe", "python", "HIGH", "Input is marked as safe.", "XSS_RISK", (Pattern("mark_safe($EXPR)", file_not_regex="(?i)test|fixture"),)),
)
