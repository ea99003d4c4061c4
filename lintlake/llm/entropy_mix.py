"""Mixing sources to target weights by entropy balancing.

Each document gets a rate exp(lambda * size / mean size of its source), at most ``max_copies``: the rates nearest to 1
in relative entropy that meet the source's token target. The dual of that problem is convex and separates by source; its
Newton steps, kept inside a bracket, run for all sources at once over a histogram of sizes, so that a source with a third of
all rows is only as many rows as it has different sizes. The rates become whole copies by dithered rounding: a hash of the
document's id against one offset per source, chosen so that the rounded words meet the target as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
BROADCAST_ROWS = 400_000  #: hashes of 8 bytes that may be sent to every executor
NEWTON_STEPS = 100
TOLERANCE = 1e-9
GRID = 16
GRID_PASSES = 4
FIXES = 2  #: documents of each source whose copies may then change by one, to come nearer still


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: source, source_size, target. Weights repeat over the sources in code point order, null last.

    The targets are min(max_copies * size, level * weight) with the one level at which they sum to share * all sizes, which is
    where handing on the excess by weight ends. With the sources sorted by the level at which each is full, that level
    follows from two running sums over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    cap = F.col("source_size") * float(max_copies)
    per = per.withColumn("weight", weight).withColumn("full_at", cap / F.col("weight"))
    everything = Window.partitionBy()
    rising = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    per = (
        per.withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("capped", F.sum(cap).over(rising) - cap)
        .withColumn("left", F.sum("weight").over(everything) - F.sum("weight").over(rising) + F.col("weight"))
        # as if this source and all that fill up later were below their caps
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at") * (1 + 1e-12), F.struct((-F.col("full_at")).alias("k"), F.col("level").alias("v")))).over(everything)["v"])
    )
    return per.select("source", "source_size", "n_docs", F.least(cap, F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _rate(lam, z, cap: int):
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * z, F.lit(50.0))))


def balance(sized: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """targets with the columns lam and mean: the dual's solution of each source; and gap, how far its rates miss the target."""
    hist = materialise(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    state = targets.withColumns({"mean": F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)), "lam": F.lit(0.0), "lo": F.lit(-1e4), "hi": F.lit(1e4), "gap": F.lit(1.0)})
    state = materialise(state.where("target > 0"), "mix-state")
    for _ in range(NEWTON_STEPS):
        h = hist.where("size > 0").join(state.select("source", "lam", "mean"), hist.source.eqNullSafe(state.source)).select(state.source, "lam", "size", "n", (F.col("size") / F.col("mean")).alias("z"))
        rate = _rate(F.col("lam"), F.col("z"), max_copies)
        words = F.col("n") * F.col("size") * rate
        sums = h.groupBy("source").agg(F.sum(words).alias("f"), F.sum(F.when(rate < max_copies, words * F.col("z")).otherwise(0.0)).alias("slope"))
        s = state.alias("s").join(sums.alias("f"), F.expr("s.source <=> f.source")).select("s.*", "f.f", "f.slope")
        s = s.withColumns({"lo": F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("f") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))})
        # Newton on log f, whose slope is slope / f: it is nearly linear in lam
        step = F.col("lam") - F.log(F.col("f") / F.col("target")) * F.try_divide("f", "slope")
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        middle = F.when(F.col("lo") <= -1e4, F.col("hi") * 2 - 1).when(F.col("hi") >= 1e4, F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        s = s.withColumns({"gap": F.abs(F.col("f") / F.col("target") - 1), "next": F.when(inside, step).otherwise(middle)})
        s = s.withColumn("lam", F.when(F.col("gap") < TOLERANCE, F.col("lam")).otherwise(F.greatest(F.lit(-1e4), F.least(F.lit(1e4), F.col("next")))))
        before, state = state, materialise(s.select(state.columns), "mix-state")
        drop(before)
        # a source that takes all it may only nears its target: its rates are set below
        left = state.where((F.col("gap") >= TOLERANCE) & (F.col("target") < F.col("source_size") * max_copies * (1 - 1e-9)) & (F.col("hi") - F.col("lo") > 1e-12)).limit(1).count()
        if not left:
            break
    full = F.col("target") >= F.col("source_size") * max_copies * (1 - 1e-9)
    gap = F.when(full, F.lit(0.0)).otherwise(F.coalesce("gap", F.lit(0.0))).alias("gap")
    return targets.alias("t").join(state.select("source", "mean", "lam", "gap").alias("s"), F.expr("t.source <=> s.source"), "left").select("t.*", gap, F.coalesce("mean", F.lit(1.0)).alias("mean"), F.when(full, F.lit(1e4)).otherwise(F.coalesce("lam", F.lit(0.0))).alias("lam"))


def _copies(offset, max_copies: int):
    """Dithered rounding: more copies with a smaller offset."""
    return F.greatest(F.lit(0), F.least(F.lit(max_copies), F.floor(F.col("rate") + F.col("dither") - offset))).cast("int")


def entropy_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target, mix_rate, mix_gap (how far the rates miss the target, as a share of it) and mix_copies (0 to max_copies).

    Null and empty texts have size 0, take no words and get one copy times their rate (1). A null source is a source of its
    own, the last one. Rows that repeat key, source and size each count and are rounded each by itself, by where they stand in the table; all others by their key alone,
    so that they agree whatever the partitions. An empty table stays empty. Columns of docs pass through untouched whatever their names: where one
    begins with ``mix_``, all new columns begin with more underscores (``prefix``).
    """
    names, prefix = docs.columns, free_prefix(docs.columns)
    inside = [f"in_{i}" for i in range(len(names))]
    text, source, key = (inside[names.index(c)] for c in (text, source, key))
    base = docs.toDF(*inside).withColumn("mix_size", word_count(F.col(text)))
    unit = lambda *c: (F.pmod(F.xxhash64(*c, F.lit(20251)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    alike = F.xxhash64(F.col(source), F.col(key), F.col("mix_size"))
    repeats = materialise(base.select(alike.alias("mix_alike")).groupBy("mix_alike").count().where("count > 1").select(F.col("mix_alike").alias("mix_repeat")), "mix-repeats")
    n_repeats = repeats.count()
    if n_repeats:
        base = base.withColumns({"mix_alike": alike, "mix_at": F.monotonically_increasing_id()})
        base = base.join(F.broadcast(repeats) if n_repeats <= BROADCAST_ROWS else repeats, F.col("mix_alike") == F.col("mix_repeat"), "left")
        base = base.withColumn("mix_dither", F.when(F.col("mix_repeat").isNull(), unit(F.col(key))).otherwise(unit(F.col(key), F.col("mix_at")))).drop("mix_alike", "mix_repeat", "mix_at")
    else:
        base = base.withColumn("mix_dither", unit(F.col(key)))
    sized = materialise(base.select(F.col(source).alias("source"), F.col("mix_size").alias("size"), F.col("mix_dither").alias("dither")), "mix-sizes")
    targets = materialise(source_targets(sized, weights, share, max_copies), "mix-targets")
    solved = materialise(balance(sized, targets, max_copies), "mix-solved")
    rated = sized.join(solved, sized.source.eqNullSafe(solved.source)).select(solved.source, "size", "dither", "target", _rate(F.col("lam"), F.col("size") / F.col("mean"), max_copies).alias("rate"))
    # no offset of a source takes more than a pass over its rows; each pass narrows it to one of GRID parts
    offsets = solved.select("source", "target", F.lit(-1.0).alias("from"), F.lit(1.0).alias("to"))
    for _ in range(GRID_PASSES):
        r = rated.alias("r").join(offsets.alias("o"), F.expr("r.source <=> o.source")).select("o.source", "size", "rate", "dither", "from", "to")
        at = [F.col("from") + (F.col("to") - F.col("from")) * (i / GRID) for i in range(GRID + 1)]
        sums = r.groupBy("source").agg(*[F.sum(F.col("size") * _copies(x, max_copies)).alias(f"w{i}") for i, x in enumerate(at)])
        o = offsets.alias("o").join(sums.alias("w"), F.expr("o.source <=> w.source")).select("o.*", *[f"w{i}" for i in range(GRID + 1)])
        part = F.greatest(F.lit(0), F.least(F.lit(GRID - 1), sum((F.when(F.col(f"w{i}") >= F.col("target"), 1).otherwise(0) for i in range(1, GRID + 1)), F.lit(0))))
        near = F.element_at(F.array(*[F.col(f"w{i}") for i in range(GRID + 1)]), part + 1) - F.col("target") <= F.col("target") - F.element_at(F.array(*[F.col(f"w{i}") for i in range(GRID + 1)]), part + 2)
        width = (F.col("to") - F.col("from")) / GRID
        offsets = materialise(o.select("source", "target", (F.col("from") + width * part).alias("from"), (F.col("from") + width * (part + 1)).alias("to"), F.when(near, F.col("from") + width * part).otherwise(F.col("from") + width * (part + 1)).alias("offset")), "mix-offsets").withColumn("offset", F.col("offset"))
        final, offsets = offsets, offsets.drop("offset")
    final = _nearer(rated, final.select("source", "target", "offset"), max_copies)
    drop(sized)
    per = solved.alias("t").join(final.select("source", "offset", "fixes").alias("o"), F.expr("t.source <=> o.source"), "left").select(
        F.col("fixes").alias("mix_fixes"), F.col("t.source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("t.target").alias("mix_target"), F.col("lam").alias("mix_lam"), F.col("mean").alias("mix_mean"), F.col("gap").alias("mix_gap"), F.coalesce("offset", F.lit(0.0)).alias("mix_offset"))
    out = base.join(per, base[source].eqNullSafe(per.mix_source)).withColumn("mix_rate", _rate(F.col("mix_lam"), F.col("mix_size") / F.col("mix_mean"), max_copies))
    copies = _fixed(F.greatest(F.lit(0), F.least(F.lit(max_copies), F.floor(F.col("mix_rate") + F.col("mix_dither") - F.col("mix_offset")))), F.col("mix_fixes"), F.col("mix_size"), F.col("mix_dither"))
    out = out.withColumn("mix_copies", copies.cast("int"))
    return out.select(*[F.col(i).alias(n) for i, n in zip(inside, names, strict=True)], *[F.col(f"mix_{n}").alias(prefix + n) for n in ("size", "source_size", "target", "rate", "gap", "copies")])


def free_prefix(names: list[str]) -> str:
    """mix_, with as many underscores before it as it takes to begin none of the names."""
    prefix = "mix_"
    while any(n.lower().startswith(prefix) for n in names):
        prefix = "_" + prefix
    return prefix


def _fixed(copies, fixes, size, dither):
    """copies and the change, if any, of the document that this is."""
    mine = F.filter(fixes, lambda x: (x["size"] == size) & (x["dither"] == dither))
    return copies + F.coalesce(F.aggregate(mine, F.lit(0), lambda a, x: a + x["change"]), F.lit(0))


def _nearer(rated: DataFrame, state: DataFrame, max_copies: int) -> DataFrame:
    """state (source, target, offset) with fixes: in each of FIXES passes the one document whose change by a copy best closes what is left of the gap."""
    state = state.withColumn("fixes", F.expr("cast(array() as array<struct<size: bigint, dither: double, change: int>>)"))
    for _ in range(FIXES):
        r = rated.alias("r").join(state.alias("o"), F.expr("r.source <=> o.source")).select("o.source", "size", "dither", "o.target", _fixed(_copies(F.col("offset"), max_copies), F.col("fixes"), F.col("size"), F.col("dither")).alias("copies"))
        gaps = r.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
        r = r.alias("r").join(gaps.alias("g"), F.expr("r.source <=> g.source")).select("g.source", "size", "dither", "copies", "gap")
        change = F.signum("gap").cast("int")
        left = F.abs(F.col("gap") - change * F.col("size"))
        may = (F.col("size") > 0) & (left < F.abs("gap")) & (F.col("copies") + change).between(0, max_copies)
        best = r.where(may).groupBy("source").agg(F.min(F.struct(left.alias("left"), "size", "dither", change.alias("change"))).alias("b"))
        found = state.alias("s").join(best.alias("b"), F.expr("s.source <=> b.source"), "left")
        state = materialise(found.select("s.source", "s.target", "s.offset", F.when(F.col("b.b").isNull(), F.col("s.fixes")).otherwise(F.concat("s.fixes", F.array(F.struct(F.col("b.b.size").alias("size"), F.col("b.b.dither").alias("dither"), F.col("b.b.change").alias("change"))))).alias("fixes")), "mix-fixes")
    return state


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as its copies say."""
    inside = [f"doc_{i}" for i in range(len(docs.columns))]
    options = {k: f"doc_{docs.columns.index(options.pop(k, d))}" for k, d in (("text", "text"), ("source", "source"), ("key", "doc_id"))} | options
    out = entropy_mix(docs.toDF(*inside), **options).withColumn("mix_n", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies"))))
    return out.select(*[F.col(i).alias(n) for i, n in zip(inside, docs.columns, strict=True)])
