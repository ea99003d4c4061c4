"""Chat formatting: transcripts of plain lines become turns with roles in one canonical form.

A hidden Markov model reads lines. Its states say whose line it is (system, user, assistant) and whether the line begins a turn
or goes on with it; what it sees of a line is its speaker marker, its length, its ending, whether it is the conversation's first line. Viterbi
recovers the states, so that turns without a marker, or with an odd one, still get a role.

Lines are range-sorted by conversation and place (rows at one place by their texts), so a conversation of any length is spread over partitions. Each partition
reduces its part of a conversation to a matrix of best scores from state to state; for the conversations that cross partitions these few matrices
are chained, which fixes the states at the cuts, and every part is then decoded by itself, with the same result as in one go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise
from .jaccard_join import in_groups

ROLES = ("system", "user", "assistant")
STATES = [f"{at}-{role}" for role in ROLES for at in ("begin", "on")]
S = len(STATES)
#: Speaker markers, by role. Fixed values.
MARKERS = {"system": "system|sys|instructions?", "user": "user|human|customer|me|question|q", "assistant": "assistant|ai|bot|gpt|agent|answer|a"}
#: Sizes of the feature tables: marker (none or a role's or another's), length, ending, first line
SIZES = (len(ROLES) + 2, 6, 4, 2)
NEVER = -1e18


def marker(names: str) -> str:
    return rf"(?i)\A\s*(?:[#*>\[(<|_-]+\s*)?(?:{names})\s*(?:[\])>|*_]+\s*:?|:|>)\s*"


ANY_MARKER = marker("|".join(MARKERS.values()))
OTHER_MARKER = r"\A\s*(?:[#*>\[(<|_-]+\s*)?[\p{L}][\p{L}\p{N} _.-]{0,24}\s*:\s+"


def features(line: Column, first: Column) -> Column:
    """One number for all that the model sees of a line."""
    who = F.lit(0)
    who = F.when(line.rlike(OTHER_MARKER), F.lit(len(ROLES) + 1)).otherwise(who)
    for i, role in enumerate(ROLES):
        who = F.when(line.rlike(marker(MARKERS[role])), F.lit(i + 1)).otherwise(who)
    n = F.length(line)
    size = F.when(n == 0, 0).when(n < 40, 1).when(n < 120, 2).when(n < 300, 3).when(n < 800, 4).otherwise(5)
    end = F.when(line.rlike(r"\?\s*\z"), 1).when(line.rlike(r"[.!…]\s*\z"), 2).when(line.rlike(r"[:,;]\s*\z"), 3).otherwise(0)
    out = who
    for x, of in ((size, SIZES[1]), (end, SIZES[2]), (first.cast("int"), SIZES[3])):
        out = out * of + x
    return out.cast("int")


#: What orders the lines of a conversation: the place of their row, the hash of its text and, among equal rows, any number; the line within the row
ORDER = ["o", "h", "m", "line"]


def lines_of(turns: DataFrame, key: str, order: str, text: str, role: str | None = None) -> DataFrame:
    """(k, ORDER, text, seen, truth) of all lines; truth is the state that a known role says, else -1."""
    known = F.lit(-1)
    if role:
        known = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.trim(role))).cast("int") - 1, F.lit(-1))
    rows = turns.select(F.col(key).alias("k"), F.col(order).alias("o"), known.alias("r"), F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n").alias("t"))
    rows = rows.withColumns({"h": F.xxhash64("t", "r"), "m": F.monotonically_increasing_id()})
    split = rows.select("k", "o", "h", "m", "r", F.posexplode(F.split("t", "\n")).alias("line", "text"))
    first = F.col("line") == 0
    return split.select("k", *ORDER, "text", features(F.col("text"), first & F.coalesce(F.col("o") == 0, F.lit(False))).alias("seen"), F.when(F.col("r") >= 0, F.col("r") * 2 + F.when(first, 0).otherwise(1)).otherwise(-1).cast("int").alias("truth"))


def spread(lines: DataFrame) -> DataFrame:
    """lines in order, with the part they are in; settled in files, as the parts' bounds are by chance."""
    return materialise(lines.repartitionByRange("k", *ORDER).withColumn("part", F.spark_partition_id()), "chat-lines")


def by_part(spreaded: DataFrame, parts: int) -> DataFrame:
    """Each part in a partition of its own, in order."""
    return spreaded.repartitionById(max(1, parts), F.col("part")).sortWithinPartitions("part", "k", *ORDER)


class Model:
    """Log probabilities: start[s], move[s, t], see[s, f] for each value f of features()."""

    def __init__(self, start: np.ndarray, move: np.ndarray, tables: list[np.ndarray]):
        log = lambda x: np.log(x / x.sum(-1, keepdims=True))
        self.start, self.move = log(start), log(move)
        grid = np.indices(SIZES).reshape(len(SIZES), -1)
        self.see = sum(log(t)[:, g] for t, g in zip(tables, grid, strict=True))

    @staticmethod
    def untrained() -> Model:
        return Model(*_prior())


def _prior() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Pseudo-counts: a marker tells its role and begins a turn, turns alternate, the system speaks first if at all."""
    begins = np.array([s.startswith("begin") for s in STATES])
    start = np.where(begins, [2.0, 2, 5, 5, 2, 2], 0.05)
    move = np.full((S, S), 0.05)
    for r in range(len(ROLES)):
        for at in (0, 1):
            move[2 * r + at, 2 * r + 1] = 4
            for t in range(len(ROLES)):
                move[2 * r + at, 2 * t] = {(0, 1): 4.0, (1, 2): 4.0, (2, 1): 4.0}.get((r, t), 0.2)  # the same for all roles, so that long turns favour none
    who = np.full((S, SIZES[0]), 0.2)
    who[:, 0] = np.where(begins, 2, 12)
    for r in range(len(ROLES)):
        who[2 * r, r + 1] = 10
    first = np.where(begins[:, None], [[2.0, 1.0]], [[4.0, 0.05]])
    return start, move, [who, np.ones((S, SIZES[1])), np.ones((S, SIZES[2])), first]


def fit(spreaded: DataFrame, parts: int) -> Model:
    """The prior and the counts over all lines whose truth is known; the driver gets one row for each count, not for each line."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        move, see, start = np.zeros((S, S)), np.zeros((S, int(np.prod(SIZES)))), np.zeros(S)
        last_key, last = None, -1
        for b in batches:
            k, y, f = b["k"].to_numpy(), b["truth"].to_numpy(), b["seen"].to_numpy()
            for i in range(len(b)):
                if y[i] >= 0:
                    see[y[i], f[i]] += 1
                    if k[i] == last_key and last >= 0:
                        move[last, y[i]] += 1
                    elif f[i] % SIZES[3]:
                        start[y[i]] += 1
                last_key, last = k[i], y[i]
        for kind, m in (("move", move), ("see", see), ("start", start[None])):
            i, j = np.nonzero(m)
            yield pd.DataFrame({"kind": kind, "i": i, "j": j, "n": m[i, j]})

    start, move, tables = _prior()
    grid = np.indices(SIZES).reshape(len(SIZES), -1)
    got = by_part(spreaded.select("part", "k", *ORDER, "truth", "seen"), parts).mapInPandas(count, "kind string, i long, j long, n double").groupBy("kind", "i", "j").agg(F.sum("n")).collect()
    for kind, i, j, n in got:
        if kind == "move":
            move[i, j] += n
        elif kind == "start":
            start[j] += n
        else:
            for t, g in zip(tables, grid, strict=True):
                t[i, g[j]] += n
    return Model(start, move, tables)


def viterbi(seen: np.ndarray, model: Model, entry: int | None = None, leave: int | None = None) -> np.ndarray:
    """The best states; entry: the state before the first line (None: this is the beginning); leave: the last line's state."""
    best = (model.start if entry is None else model.move[entry]) + model.see[:, seen[0]]
    back = np.zeros((len(seen), S), np.int8)
    for i in range(1, len(seen)):
        steps = best[:, None] + model.move
        back[i] = steps.argmax(0)
        best = steps[back[i], range(S)] + model.see[:, seen[i]]
    out = np.zeros(len(seen), np.int64)
    out[-1] = best.argmax() if leave is None else leave
    for i in range(len(seen) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def transfer(seen: np.ndarray, model: Model) -> np.ndarray:
    """m[s, t]: the best score of these lines from state s before them (row S: the beginning) to t at their end."""
    m = np.vstack([model.move, model.start[None]]) + model.see[:, seen[0]]
    for f in seen[1:]:
        m = (m[:, :, None] + model.move[None]).max(1) + model.see[:, f]
    return m


def parse(transcripts: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", role: str | None = None) -> DataFrame:
    """key, order and line where a turn begins, role, n_lines, content (without the marker), rendered.

    transcripts: rows of text in the order of ``order`` within ``key``; each may hold any number of lines and turns. role: a column with known
    roles to fit the model on (unknown or null roles are not learned from); the decoding never sees it. A null key is a conversation of its own,
    a null text an empty line, a null place comes first. Rows at the same place come one after the other, in the order of their texts' hashes; repeated rows are
    lines again. Texts may be of any length: a conversation's lines are spread over tasks, and only one turn's are ever gathered. Columns other than key, order, text
    and role are not read, so their names can't clash. An empty table gives no rows. A conversation's first turn begins with its first line, whatever the state.
    """
    lines = lines_of(transcripts, key, order, text, role)
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    lines = spread(lines)
    n_parts = (lines.agg(F.max("part")).first()[0] or 0) + 1
    model = fit(lines, n_parts) if role else Model.untrained()
    # conversations that cross parts: fewer than there are parts
    parts = lines.groupBy("k").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("k")
    cut = {r[0] for r in parts.collect()}
    shared = lines.sparkSession.sparkContext.broadcast((model, cut))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in in_groups(batches, ["part", "k"]):
            yield pd.DataFrame({"k": g["k"].iloc[:1], "part": g["part"].iloc[:1], "x": [transfer(g["seen"].to_numpy(), shared.value[0]).ravel()]})

    bounds: dict[tuple, tuple[int | None, int | None]] = {}
    if cut:
        some = lines.join(F.broadcast(parts), lines.k.eqNullSafe(parts.k), "left_semi")
        found: dict = {}
        for k, p, m in by_part(some.select("part", "k", *ORDER, "seen"), n_parts).mapInPandas(reduce, f"k {kinds['k']}, part int, x array<double>").collect():
            found.setdefault(k, []).append((p, np.array(m).reshape(S + 1, S)))
        for k, ms in found.items():
            ms.sort(key=lambda x: x[0])
            best, back = ms[0][1][S], []
            for _, m in ms[1:]:
                steps = best[:, None] + m[:S]
                back.append(steps.argmax(0))
                best = steps.max(0)
            ends = [int(best.argmax())]
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends.reverse()
            for i, (p, _) in enumerate(ms):
                bounds[(k, p)] = (None if i == 0 else ends[i - 1], ends[i])
    at_cuts = lines.sparkSession.sparkContext.broadcast(bounds)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in in_groups(batches, ["part", "k"]):
            k, p = g["k"].iloc[0], int(g["part"].iloc[0])
            k = None if pd.isna(k) else k
            entry, leave = at_cuts.value.get((k, p), (None, None))
            states = viterbi(g["seen"].to_numpy(), shared.value[0], entry, leave)
            begins = states % 2 == 0
            if entry is None:
                begins[0] = True
            # a change of role without a beginning begins a turn as well
            begins[1:] |= states[1:] // 2 != states[:-1] // 2
            if entry is not None:
                begins[0] |= states[0] // 2 != entry // 2
            turn = np.cumsum(begins) - 1
            at = np.flatnonzero(begins)
            where = np.where(turn >= 0, at[np.maximum(turn, 0)] if len(at) else 0, 0)
            out = g.drop(columns="seen").assign(role=states // 2, known=turn >= 0)
            for name in ORDER:  # where the turn begins that a line belongs to
                out["b_" + name] = g[name].to_numpy()[where]
            yield out

    begin = [f"b_{name}" for name in ORDER]
    done = by_part(lines.drop("truth"), n_parts).mapInPandas(decode, f"k {kinds['k']}, o {kinds['o']}, h long, m long, line int, text string, part int, role int, known boolean, b_o {kinds['o']}, b_h long, b_m long, b_line int")
    done = materialise(done, "chat-decoded")
    if not cut:
        drop(lines)
    if cut:  # lines before the first beginning of a part belong to the last turn of the parts before
        last = done.where("known").join(F.broadcast(parts), done.k.eqNullSafe(parts.k), "left_semi").groupBy("k", "part").agg(F.max(F.struct(*ORDER, *begin)).alias("x")).select("k", "part", *[f"x.{b}" for b in begin]).collect()
        fill = []
        for k, p in sorted(bounds, key=lambda b: b[1]):
            before = [r for r in last if r[0] == k and r[1] < p]
            if before:
                fill.append((k, p, *max(before, key=lambda r: r[1])[2:]))
        if fill:
            extra = done.sparkSession.createDataFrame(fill, f"fk {kinds['k']}, fp int, f_o {kinds['o']}, f_h long, f_m long, f_line int")
            done = done.join(F.broadcast(extra), done.k.eqNullSafe(extra.fk) & (done.part == extra.fp), "left").withColumns({f"b_{n}": F.when(F.col("known"), F.col(f"b_{n}")).otherwise(F.col(f"f_{n}")) for n in ORDER})
    turns = done.groupBy("k", *begin).agg(F.min(F.struct(*ORDER, "role"))["role"].alias("r"), F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(F.struct(*ORDER, "text"))).alias("l"))
    content = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), ANY_MARKER, "")
    name = F.element_at(F.array(*map(F.lit, ROLES)), F.col("r") + 1)
    turns = turns.select(F.col("k").alias(key), F.col("b_o").alias(order), F.col("b_line").alias("line"), name.alias("role"), "n_lines", F.trim(content).alias("content"))
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>")))


def as_transcript(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with known roles written the way people paste chats: markers in several styles, and none on a quarter of the turns (by a hash)."""
    pick = F.pmod(F.xxhash64(F.col(key), F.col(order), F.lit(8)), F.lit(8)).cast("int")
    name = F.initcap(F.coalesce(F.col(role), F.lit("")))
    styles = [F.concat(name, F.lit(": ")), F.concat(F.lit("### "), name, F.lit(":\n")), F.concat(F.lit("["), F.upper(name), F.lit("] ")), F.concat(name, F.lit("> ")), F.concat(F.lit("**"), name, F.lit("**: ")), F.concat(F.lower(name), F.lit(": ")), F.lit(""), F.lit("")]
    mark = F.element_at(F.array(*styles), pick + 1)
    return turns.withColumn(text, F.concat(F.when(name != "", mark).otherwise(F.lit("")), F.coalesce(F.col(text), F.lit(""))))
