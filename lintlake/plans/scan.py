"""The whole scan of a set of files as one plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Rule
from ..operators import cpp, sast
from ..operators.findings import at_least, thin_nearby
from ..operators.match import drop_reported, lines_of, match_rules
from ..operators.suppress import MARKER, drop_silenced, markers_in_comments, markers_loose, new_findings
from ..sources.rules import SHIPPED
from .project import cross_file, taint_graph

COLUMNS = ["file_path", "line", "rule_id", "vuln_type", "severity", "message", "details", "ord"]


def scan(files: DataFrame, rules: Iterable[Rule] = SHIPPED, marker: str = MARKER, baseline: DataFrame | None = None, severity: str | None = None, disabled: Iterable[str] = (), registry: Iterable[tuple] = (), across: bool = False, graph: bool = False) -> DataFrame:
    """Findings of files (file_path, language, code): engines by language, pattern rules where these are silent, near lines thinned, silenced and known ones dropped.

    across: also calls that hand input to functions of other files. graph: also lines that the taint graph reaches and that nothing else reports; registry: more rows
    for the registry of its sources, sinks and cleaners. Both take more passes over the files, so they are asked for.
    """
    files = files.where("code is not null and language is not null")
    lines = lines_of(files.select("file_path", "language", "code"))
    own = sast.scan(files.where(~F.col("language").isin("c", "cpp"))).unionByName(cpp.analyse(files).select("file_path", "line", "rule_id", "vuln_type", "severity", "message"))
    extra = drop_reported(match_rules(lines, rules), own).select("file_path", "line", "rule_id", "vuln_type", "severity", "message")
    found = own.unionByName(extra)
    if across:
        more = cross_file(files).join(found.select("file_path", "line", "vuln_type").distinct(), ["file_path", "line", "vuln_type"], "left_anti")
        found = found.unionByName(more)
    if graph:
        more = taint_graph(files, registry).join(found.select("file_path", "line").distinct(), ["file_path", "line"], "left_anti")
        found = found.unionByName(more)
    found = found.withColumns({"details": F.col("message"), "ord": F.col("line")}).select(COLUMNS)
    # what near lines mean is set by language: PHP thins four types within 4 lines, scripts XSS within 6
    kinds = files.select("file_path", "language")
    found = found.join(kinds, "file_path")
    php = thin_nearby(found.where("language = 'php'"), 4, ["SQL_INJECTION", "PATH_TRAVERSAL", "OPEN_REDIRECT", "DESERIALIZATION"])
    script = thin_nearby(found.where("language in ('javascript', 'typescript')"), 6, ["XSS_RISK"])
    found = php.unionByName(script).unionByName(found.where("language not in ('php', 'javascript', 'typescript')"))
    for markers in (markers_loose(lines, marker), markers_in_comments(lines, marker)):
        found = drop_silenced(found, markers)
    if disabled := list(disabled):
        found = found.where(~F.col("vuln_type").isin(disabled) & ~F.col("rule_id").isin(disabled))
    if severity:
        found = at_least(found, severity)
    return new_findings(found, baseline) if baseline is not None else found
