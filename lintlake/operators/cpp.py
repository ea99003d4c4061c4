"""C and C++ by line patterns, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_only, literal_length
from ..plans.dims import literal_map
from .findings import best_of_group
from .match import any_of, lines_of

# Fixed values.
SEVERITY = {"BUFFER_OVERFLOW": "Critical", "FORMAT_STRING": "High", "MEMORY_LEAK": "High", "USE_AFTER_FREE": "High", "RCE_COMMAND_EXEC": "Critical", "PATH_TRAVERSAL": "High", "THREAD_LIFECYCLE_RISK": "High", "ASSIGNMENT_IN_CONDITION": "Medium", "NULL_DEREFERENCE": "High", "LOCK_MISMATCH": "High"}
# Any of these in a line is a finding of the type.
BASIC = {
    "BUFFER_OVERFLOW": [r"(?i)\bstrcpy\s*\(", r"(?i)\bstrcat\s*\(", r"(?i)\bgets\s*\(", r"(?i)\bsprintf\s*\(", r"(?i)\bstrncpy\s*\(\s*[^,]+,\s*[^,]+,\s*strlen"],
    "FORMAT_STRING": [r"(?i)\bprintf\s*\(\s*[A-Za-z_]\w*\s*\)", r"(?i)\bsprintf\s*\(\s*[^,]+,\s*[A-Za-z_]\w*\s*\)", r"(?i)\bprintf\s*\(\s*[^,]+,\s*[^)]+\)", r"(?i)\bsprintf\s*\(\s*[^,]+,\s*[^,]+,\s*[^)]+\)"],
    "MEMORY_LEAK": [r"(?i)\bmalloc\s*\([^)]+\)\s*;"],
    "USE_AFTER_FREE": [r"(?i)\bfree\s*\([^)]+\)\s*;"],
    "RCE_COMMAND_EXEC": [r"(?i)\bsystem\s*\(", r"(?i)\bexecve\s*\(", r"(?i)\bexecvp\s*\("],
    "PATH_TRAVERSAL": [r"(?i)\bfopen\s*\(\s*.*\+"],
    "THREAD_LIFECYCLE_RISK": [r"(?i)\b(?:TerminateThread|SuspendThread)\s*\("],
}
ARRAY = r"\bchar\s+(?!\*)\s*([A-Za-z_]\w*)\s*\[\s*(\d+)\s*\]"
CONDITION = r"\b(?:if|while)\s*\((.*)\)"
ASSIGNMENT = r"(?<![=!<>+\-*/%&|^])=(?!=)"
LITERAL_COPY = r'(?i)\bstrcpy\s*\(\s*([^,]+?)\s*,\s*(?:u8|u|U|L)?"((?:\\.|[^"\\])*)"\s*\)'
NESTED = r"\b([A-Za-z_]\w*)\s*->\s*([A-Za-z_]\w*)\s*->"
LOOK_BACK = 5


def code_lines(files: DataFrame) -> DataFrame:
    return lines_of(files.where(F.col("language").isin("c", "cpp")).select("file_path", "code")).withColumn("c", code_only(F.col("line_text")))


def arrays(lines: DataFrame) -> DataFrame:
    """file_path, name, size of fixed char arrays; the last declaration of a name holds."""
    found = lines.where(F.col("c").rlike(ARRAY)).select("file_path", "line", F.posexplode(F.arrays_zip(F.regexp_extract_all("c", F.lit(ARRAY), F.lit(1)).alias("name"), F.regexp_extract_all("c", F.lit(ARRAY), F.lit(2)).alias("size"))).alias("i", "a"))
    sized = found.select("file_path", F.col("a.name").alias("name"), F.col("a.size").cast("long").alias("size"), F.struct("line", "i").alias("o")).where("size > 0")
    return sized.groupBy("file_path", "name").agg(F.max_by("size", "o").alias("size"))


def basic(lines: DataFrame) -> DataFrame:
    hits = F.filter(F.array(*[F.when(any_of(F.col("c"), rs), F.lit(t)) for t, rs in BASIC.items()]), lambda x: x.isNotNull())
    return lines.select("file_path", "line", F.explode(hits).alias("vuln_type"))


def safe_copies(lines: DataFrame) -> DataFrame:
    """file_path, line where a literal that fits is copied into a fixed array."""
    copies = lines.where(F.col("line_text").rlike(LITERAL_COPY)).select("file_path", "line", F.regexp_extract(F.regexp_extract("line_text", LITERAL_COPY, 1), r"([A-Za-z_]\w*)\s*\z", 1).alias("name"), literal_length(F.regexp_extract("line_text", LITERAL_COPY, 2)).alias("n"))
    return copies.join(arrays(lines), ["file_path", "name"]).where(F.col("n") + 1 <= F.col("size")).select("file_path", "line")


def stream_input(lines: DataFrame) -> DataFrame:
    """>> into a fixed array without setw."""
    into = lines.where(F.col("c").rlike(r"\bcin\b") & ~F.contains("c", F.lit("setw"))).select("file_path", "line", F.explode(F.regexp_extract_all("c", F.lit(r">>\s*([A-Za-z_]\w*)"), 1)).alias("name"))
    return into.join(arrays(lines), ["file_path", "name"], "left_semi").select("file_path", "line").distinct().withColumn("vuln_type", F.lit("BUFFER_OVERFLOW"))


def assignments_in_conditions(lines: DataFrame) -> DataFrame:
    return lines.where(F.regexp_extract("c", CONDITION, 1).rlike(ASSIGNMENT)).select("file_path", "line", F.lit("ASSIGNMENT_IN_CONDITION").alias("vuln_type"))


def shallow_guards(lines: DataFrame) -> DataFrame:
    """a->b->… after a check of a alone in the five lines before: the nearest condition that names a decides."""
    uses = lines.where(F.col("c").rlike(NESTED)).select("file_path", "line", F.explode(F.arrays_zip(F.regexp_extract_all("c", F.lit(NESTED), F.lit(1)).alias("base"), F.regexp_extract_all("c", F.lit(NESTED), F.lit(2)).alias("field"))).alias("u")).select("file_path", "line", "u.base", "u.field")
    checks = lines.where(F.contains("c", F.lit("if")) & F.col("c").rlike(CONDITION)).select("file_path", F.col("line").alias("at"), F.regexp_extract("c", CONDITION, 1).alias("condition"), F.col("c").alias("check"))
    near = checks.withColumn("line", F.explode(F.sequence(F.col("at") + 1, F.col("at") + LOOK_BACK)))
    met = uses.join(near, ["file_path", "line"]).where(F.contains("check", F.col("base")))
    nearest = met.groupBy("file_path", "line", "base", "field").agg(F.max_by("condition", "at").alias("condition"))
    flat = F.regexp_replace("condition", r"\s+", "")
    deep = F.contains(flat, F.concat("base", F.lit("->"), "field")) | F.expr("condition rlike concat('(?i)\\\\b', base, '\\\\s*->\\\\s*\\\\w*(?:num|count)\\\\w*\\\\s*>\\\\s*0\\\\b')")
    alone = F.concat(F.lit("if("), "condition", F.lit(")")).rlike(r"(?i)\bif\s*\(\s*[A-Za-z_]\w*\s*(?:!=\s*(?:NULL|nullptr|0))?\s*\)")
    return nearest.where(~deep & alone).select("file_path", "line").distinct().withColumn("vuln_type", F.lit("NULL_DEREFERENCE"))


def lock_mismatches(lines: DataFrame) -> DataFrame:
    """A section left that isn't the one entered last: a fold over each file's enters and leaves, whose stack a mismatch empties."""
    enter, leave = (rf"\b{x}CriticalSection\s*\(\s*&([A-Za-z_]\w*)\s*\)" for x in ("Enter", "Leave"))
    ops = lines.where(F.col("c").rlike(enter) | F.col("c").rlike(leave)).select("file_path", "line", F.col("c").rlike(enter).alias("enters"), F.when(F.col("c").rlike(enter), F.regexp_extract("c", enter, 1)).otherwise(F.regexp_extract("c", leave, 1)).alias("name"))
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("stack"), F.expr("cast(array() as array<int>)").alias("bad"))

    def step(s, e):
        empty = F.size(s["stack"]) == 0
        same = F.element_at(s["stack"], -1) == e["name"]
        stack = F.when(e["enters"], F.concat(s["stack"], F.array(e["name"]))).when(empty, s["stack"]).when(same, F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).otherwise(none)
        bad = F.when(~e["enters"] & ~empty & ~F.coalesce(same, F.lit(False)), F.concat(s["bad"], F.array(e["line"]))).otherwise(s["bad"])
        return F.struct(stack.alias("stack"), bad.alias("bad"))

    # element_at would fail on an empty stack, so it always has a bottom that no section is called
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("line", "enters", "name"))), start, lambda s, e: _guarded(s, e, step), lambda s: s["bad"])
    return ops.groupBy("file_path").agg(folded.alias("bad")).select("file_path", F.explode("bad").alias("line"), F.lit("LOCK_MISMATCH").alias("vuln_type"))


def _guarded(s, e, step):
    safe = F.struct(F.when(F.size(s["stack"]) == 0, F.array(F.lit(""))).otherwise(s["stack"]).alias("stack"), s["bad"].alias("bad"))
    got = step(safe, e)
    empty_leave = ~e["enters"] & (F.size(s["stack"]) == 0)
    stack = F.filter(got["stack"], lambda x: x != "")
    return F.struct(F.when(empty_leave, s["stack"]).otherwise(stack).alias("stack"), F.when(empty_leave, s["bad"]).otherwise(got["bad"]).alias("bad"))


def analyse(files: DataFrame) -> DataFrame:
    """file_path, line, vuln_type, severity, rule_id, message: one per line and type. The severest holds; all of a type are alike."""
    lines = code_lines(files)
    found = basic(lines)
    fits = safe_copies(lines).withColumn("vuln_type", F.lit("BUFFER_OVERFLOW"))
    found = found.join(fits, ["file_path", "line", "vuln_type"], "left_anti")
    for more in (stream_input(lines), assignments_in_conditions(lines), shallow_guards(lines), lock_mismatches(lines)):
        found = found.unionByName(more)
    rated = found.withColumns({"severity": F.element_at(literal_map(SEVERITY), F.col("vuln_type")), "ord": F.lit(0)})
    out = best_of_group(rated).drop("ord")
    return out.withColumns({"rule_id": F.concat("vuln_type", F.lit("_CPP")), "message": F.concat(F.lit("C/C++: "), F.replace(F.lower("vuln_type"), F.lit("_"), F.lit(" ")))})


def latest_assignment(uses: DataFrame, assigns: DataFrame) -> DataFrame:
    """uses (file_path, name, line) with the line and value of the latest assignment above: one window over both."""
    both = uses.select("file_path", "name", "line", F.lit(None).cast("string").alias("value"), F.lit(1).alias("use")).unionByName(assigns.select("file_path", "name", "line", "value", F.lit(0).alias("use")))
    w = Window.partitionBy("file_path", "name").orderBy("line", F.desc("use")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("use") == 0, F.struct("line", "value")), ignorenulls=True).over(w)
    return both.withColumn("a", last).where("use = 1").select("file_path", "name", "line", F.col("a.line").alias("assigned"), F.col("a.value").alias("assigned_value"))
