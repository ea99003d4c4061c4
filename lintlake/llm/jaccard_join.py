"""Exact Jaccard self-join of word n-gram sets, as a join in a metric space.

1 - Jaccard similarity is a metric, so with r = 1 - threshold, two linked documents differ by at most r in their distance to any
pivot. The join goes from coarse to fine:

* Copies with equal sets become one node (a partial aggregate before the shuffle).
* Pivots: two linked sets share at least L of the first P hashes of either set, in hash order, so a node has a possible partner only if L of its P hashes occur
  elsewhere too, and it must meet that partner under one of its S - L + 1 rarest shared hashes (S: how many it shares). The
  smallest node under a hash is its pivot; each node joins the regions of its pivots. No pair is formed here, and no order depends on a
  cap: any linked pair shares a region.
* Regions: within a region, further pivots divide the nodes into Voronoi cells; a node is replicated to each cell whose pivot is no
  more than 2 r further than its nearest one, and cells are joined recursively. Pairs already connected are not compared again here:
  all that is wanted at this point are the classes.
* Large regions are dealt into chunks that all hold the region's pivot. What then is not connected with the bulk of its
  region is compared with all chunks, block by block, where their distances to the pivot differ by r at most.
* Links become classes by label propagation with pointer jumping.
* Within the classes of three nodes or more all links are then counted, also those that were not needed to connect them: blocks of a
  class meet in pairs, hashes that many of their nodes hold are compared as a matrix product, all others by their few holders. What leaves a task is a count for
  each node, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise

WORDS = 5
PERCENT = 80
CACHED_WORDS = 100_000
CHUNK_NODES, CHUNK_HASHES = 256, 200_000  #: what one task compares at a time
ACROSS = 4  #: what is compared across chunks goes in chunks that are larger by this factor, against blocks of half their size
BLOCK_NODES, BLOCK_HASHES = 1024, 1_000_000  #: of a class, that meet others at a time when links are counted
OFTEN = 64  #: pairs of nodes that share a hash, from which on it is compared as a matrix
LEAF = 48
CELLS = 16
FILE_ROWS = 2_000  #: documents, or edges of a round of label propagation, to a file of what is written, where shuffles have more partitions
BROADCAST_ROWS = 400_000  #: keys of 8 bytes that may be sent to every executor; beyond that, rows are shuffled

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingler(words: int = WORDS) -> Callable[[str | None], np.ndarray]:
    """text -> the sorted distinct 64-bit hashes of its word n-grams; with fewer words, of the whole sequence; without any, none."""
    from xxhash import xxh3_64_intdigest

    known: dict[bytes, int] = {}
    odd = np.uint64(0x9E3779B97F4A7C15)

    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def shingles(text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not parts:
            return np.zeros(0, np.uint64)
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(parts).difference(known):
            known[w] = xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        n = min(words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix(out * odd + h[i : len(h) - n + 1 + i])
        return np.unique(out)

    return shingles


def least_overlap(n, percent: int = PERCENT):
    """Fewest common elements of a set of n and any set linked with it: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def prefix_lengths(n, percent: int = PERCENT):
    """(P, L): of the first P elements in one order for all sets, linked sets share L at least."""
    spare = n - least_overlap(n, percent)
    extra = np.maximum(1, (spare + 2) // 3)
    return spare + extra, extra


class Joiner:
    """Links among sets held in memory. labels[i]: the class of set i, kept up to date."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.r = percent, 1 - percent / 100
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        values, self.all = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)
        self.labels = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.all[self.start[i] : self.start[i + 1]]
        self.mark[own] = True
        n = self.size[others]
        first = np.r_[0, np.cumsum(n)]
        at = np.repeat(self.start[others] - first[:-1], n) + np.arange(first[-1])
        out = np.add.reduceat(self.mark[self.all[at]].astype(np.int32), first[:-1])
        self.mark[own] = False
        return out

    def compare(self, i: int, others: np.ndarray) -> np.ndarray:
        """Distances; links are recorded."""
        both = self.common(i, others)
        union = self.size[i] + self.size[others] - both
        for j in others[100 * both >= self.percent * union]:
            self.link(i, int(j))
        return 1 - both / union

    def link(self, i: int, j: int) -> None:
        a, b = self.labels[i], self.labels[j]
        if a != b:
            self.labels[self.labels == max(a, b)] = min(a, b)
            self.links.append((i, j))

    def fits(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those that are neither connected with i nor too large or too small to be linked."""
        n, m = self.size[i], self.size[others]
        return others[(self.labels[others] != self.labels[i]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))]

    def join(self, nodes: np.ndarray) -> None:
        """All links among nodes, up to what connects them already."""
        if len(nodes) < 2 or (self.labels[nodes] == self.labels[nodes[0]]).all():
            return
        if len(nodes) <= LEAF:
            self.leaf(nodes, nodes)
            return
        rows, nearest, pivot = [], np.full(len(nodes), 2.0), 0
        for _ in range(min(CELLS, int(len(nodes) ** 0.5))):
            rows.append(self.compare(int(nodes[pivot]), nodes))
            nearest = np.minimum(nearest, rows[-1])
            pivot = int(np.argmax(nearest))
            if nearest[pivot] <= 0 or (self.labels[nodes] == self.labels[nodes[0]]).all():
                break
        d = np.array(rows)
        home = d.argmin(0)
        for cell in range(len(d)):
            core, window = home == cell, d[cell] <= nearest + 2 * self.r + 1e-9
            if window.sum() <= 0.8 * len(nodes):
                self.join(nodes[window])
            else:
                self.leaf(nodes[core], nodes[window], d[:, core], d[:, window])

    def leaf(self, core: np.ndarray, window: np.ndarray, d_core: np.ndarray | None = None, d_window: np.ndarray | None = None) -> None:
        for k, i in enumerate(core):
            near = window if d_core is None else window[(np.abs(d_window - d_core[:, k : k + 1]) <= self.r + 1e-9).all(0)]
            if len(near := self.fits(int(i), near)):
                self.compare(int(i), near)


def in_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come sorted by keys."""
    held: list[pd.DataFrame] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        k = b[keys]
        k = (k.astype(object).where(k.notna(), None) if k.isna().any(axis=None) else k).to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if held and (last != k[0]).any():
            yield pd.concat(held)
            held = []
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(b)], strict=True):
            if lo:
                yield pd.concat(held)
                held = []
            held.append(b.iloc[lo:hi])
        last = k[-1]
    if held:
        yield pd.concat(held)


def _sets(values: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint64) for v in values]


def _hash_sets(docs: DataFrame, key: str, text: str, words: int, percent: int, parts: str) -> DataFrame:
    """parts: 'name' for (k, n, name), 'prefix' for (k, n, name, prefix)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        shingles = shingler(words)
        for b in batches:
            for lo in range(0, len(b), 1000):
                k = b["k"].iloc[lo : lo + 1000]
                sets = [shingles(t) for t in b["t"].iloc[lo : lo + 1000]]
                out = {"k": k.to_numpy(), "n": [len(s) for s in sets]}
                out["name"] = [xxh3_128_digest(s.tobytes()) for s in sets]
                if parts == "prefix":
                    out["prefix"] = [s[: int(prefix_lengths(len(s), percent)[0])].view(np.int64) for s in sets]
                yield pd.DataFrame(out).astype({"k": "Int64"} if kind in ("bigint", "int") else {})

    more = {"name": ", name binary", "prefix": ", name binary, prefix array<long>"}[parts]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, n long{more}")


def _sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of texts (node, name, t) whose set has that name: documents that share a key may differ. Rows that repeat stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        shingles = shingler(words)
        for b in batches:
            rows = [(n, shingles(t).tobytes(), m) for n, m, t in zip(b["node"], b["name"], b["t"], strict=True)]
            rows = [(n, h) for n, h, m in rows if xxh3_128_digest(h) == bytes(m)]
            for lo in range(0, len(rows), 1000):
                yield pd.DataFrame(rows[lo : lo + 1000], columns=["node", "hashes"])

    return texts.select("node", "name", "t").mapInPandas(run, "node long, hashes binary")


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which of the sets a and b are linked, as a matrix."""
    sizes = [np.array([len(x) for x in s], np.int64) for s in (a, b)]
    rows = [np.repeat(np.arange(len(s)), n) for s, n in zip((a, b), sizes, strict=True)]
    values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ends = len(rows[0])
    at = [at[:ends], at[ends:]]
    held = [np.bincount(x, minlength=len(values)) for x in at]
    both = np.zeros((len(a), len(b)), np.float32)
    often = (held[0] > 0) & (held[1] > 0) & (held[0] * held[1] > OFTEN)
    place = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 4096):
        dense = []
        for x, r, s in zip(at, rows, (a, b), strict=True):
            mine = often[x] & (place[x] >= lo) & (place[x] < lo + 4096)
            m = np.zeros((len(s), min(4096, int(often.sum()) - lo)), np.float32)
            m[r[mine], place[x[mine]] - lo] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    order = np.argsort(at[1], kind="stable")
    starts = np.r_[0, np.cumsum(held[1])]
    few = ~often[at[0]]
    x, r = at[0][few], rows[0][few]
    n = held[1][x]
    if n.sum():
        left = np.repeat(r, n)
        right = rows[1][order[np.repeat(starts[x] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]]
        both += np.bincount(left * len(b) + right, minlength=both.size).reshape(both.shape)
    union = sizes[0][:, None] + sizes[1][None] - both
    return 100 * both >= percent * union


def link_counts(classes: DataFrame, sets: DataFrame, percent: int, block_nodes: int, block_hashes: int, files: int | None = None) -> DataFrame:
    """(node, links): to how many rows of other sets each node is linked, for nodes of classes (node, label, n, n_copies) with more than one node."""
    per = classes.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.sum("n_copies").alias("rows")).where("c > 1")
    per = materialise(per.withColumn("blocks", F.greatest(F.ceil(F.col("c") / block_nodes), F.ceil(F.col("w") / block_hashes)).cast("int")), "class-blocks", files)
    mine = classes.join(per, "label")
    pairs = mine.where("c = 2").select("node", (F.col("rows") - F.col("n_copies")).alias("links"))  # two nodes of a class are linked
    mine = mine.where("c > 2").withColumn("own", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    # a task for each pair of blocks i <= j
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = mine.select("label", "node", "n_copies", "own", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).join(sets, "node")
    keys = ["label", "i", "j"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in in_groups(batches, keys):
            g = g.drop_duplicates("node")
            i, j = g["i"].iloc[0], g["j"].iloc[0]
            a, b = g[g["own"] == i], g[g["own"] == j]
            if not len(a) or not len(b):
                continue
            yes = linked(_sets(a["hashes"]), _sets(b["hashes"]), percent)
            if i == j:
                np.fill_diagonal(yes, False)
            yield pd.DataFrame({"node": a["node"], "links": yes @ b["n_copies"].to_numpy()})
            if i != j:
                yield pd.DataFrame({"node": b["node"], "links": yes.T @ a["n_copies"].to_numpy()})

    counted = dealt.select(*keys, "node", "n_copies", "own", "hashes").repartition(*keys).sortWithinPartitions(*keys, "node").mapInPandas(count, "node long, links long")
    out = materialise(counted.unionByName(pairs).groupBy("node").agg(F.sum("links").alias("links")), "class-links", files)
    drop(per)
    return out


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node of the class.

    Rounds are many and their tables small: they are written in parts of about FILE_ROWS, however many partitions shuffles have.
    """
    both = links.where("a <> b").select("a", "b")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", files)
    files = 1 + both.count() // FILE_ROWS
    step = lambda df: materialise(df, "labels", files)
    labels = step(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        low = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("low"))
        new = step(labels.join(low, labels.node == low.a).select("node", "label", F.least("label", "low").alias("new")))
        jump = new.select(F.col("node").alias("at"), F.col("new").alias("far"))
        far = step(new.join(jump, new.new == jump["at"]).select("node", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("moved")))
        drop(labels, new)
        labels = far
        if not far.where("moved").limit(1).count():
            drop(both)
            return labels.drop("moved")


def _pick(rows: DataFrame, keys: DataFrame, on: str, n_keys: int) -> DataFrame:
    """rows whose key is in keys, by broadcast if the keys are few."""
    return rows.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys, on)


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, text: str = "text", key: str = "doc_id", chunk_nodes: int = CHUNK_NODES, chunk_hashes: int = CHUNK_HASHES, block_nodes: int = BLOCK_NODES, block_hashes: int = BLOCK_HASHES, count_links: bool = True) -> DataFrame:
    """key, n_shingles, component_id (the smallest key that links reach, the row's own included), n_copies (rows with an equal set), n_links (other rows that this one is linked with, those with an equal set included).

    Sets link at 100 * intersection >= percent * union. Null and empty texts, and texts of white space, have no shingles and are alone: their
    component is their own key. A row with a null key takes part through rows with an equal set that have one; without any it is alone, and its
    component null. Without ``count_links`` n_links counts equal sets alone. Repeated rows come back as often as they came. An empty table gives no rows. Other columns are not read.
    """
    named = materialise(_hash_sets(docs, key, text, words, percent, "name"), "sets")
    files = 1 + named.count() // FILE_ROWS
    keep = lambda df, name: materialise(df, name, files)
    first = _hash_sets(docs, key, text, words, percent, "prefix").where("n > 0").groupBy("name").agg(F.min("k").alias("doc"), F.max("n").alias("n"), F.min("prefix").alias("prefix"), F.count(F.lit(1)).alias("n_copies"))
    nodes = keep(first.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once and for all
    spare = F.col("n") - F.expr(f"(n * {percent} + 99) div 100")
    extra = F.greatest(F.lit(1), F.floor((spare + 2) / 3))
    hashes = nodes.select("node", F.explode("prefix").alias("h"))
    shared = keep(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    met = hashes.join(shared.hint("merge"), "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("met"))
    sizes = nodes.select("node", "n", extra.cast("int").alias("extra"))
    keys = met.join(sizes, "node").where(F.size("met") >= F.col("extra")).select("node", "n", F.explode(F.slice("met", F.lit(1), F.size("met") - F.col("extra") + 1)).alias("m")).select("node", "n", F.col("m.h").alias("h"))
    keys = keep(keys, "keys")
    drop(shared)
    pivots = keep(keys.groupBy("h").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "pivot"), "pivots")
    met = members = keep(keys.join(pivots.hint("merge"), "h").select("pivot", "node", "n").distinct(), "members")
    # nodes once under a pivot of its own are done
    regions = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).where("c > 1")
    parts = lambda c, w, by: F.greatest(F.ceil(F.col(c) / (chunk_nodes * by)), F.ceil(F.col(w) / (chunk_hashes * by)), F.lit(1)).cast("int")
    regions = keep(regions.select("pivot", parts("c", "w", 1).alias("chunks"), parts("c", "w", ACROSS).alias("wide")), "regions")
    members = members.join(regions.select("pivot", "chunks"), "pivot")
    last = F.col("chunks") - 1
    dealt = members.withColumn("chunk", F.explode(F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), last)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))))
    dealt = keep(dealt.select("pivot", "node", "chunk", "chunks"), "dealt")
    drop(keys, pivots, met)
    used = keep(dealt.select("node").distinct().join(nodes.select("node", "name", "doc"), "node").select("node", "name", "doc"), "used")
    n_used = used.count()
    texts = _pick(docs.select(F.col(key).alias("doc"), F.col(text).alias("t")), used.where("doc is not null"), "doc", n_used)
    sets = keep(_sets_of(texts, words), "hashes")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in in_groups(batches, ["pivot", "chunk"]):
            g = g.drop_duplicates("node")
            ids = g["node"].to_numpy()
            j = Joiner(_sets(g["hashes"]), percent)
            at = np.flatnonzero(ids == g["pivot"].iloc[0])
            d = j.compare(int(at[0]), np.arange(len(ids))) if len(at) else np.zeros(len(ids))
            j.join(np.arange(len(ids)))
            if j.links:
                a, b = np.array(j.links).T
                yield pd.DataFrame({"pivot": -1, "a": ids[a], "b": ids[b], "d": 0.0})
            if g["chunks"].iloc[0] > 1:
                yield pd.DataFrame({"pivot": g["pivot"].to_numpy(), "a": ids, "b": ids, "d": d})

    filled = dealt.hint("merge").join(sets, "node")
    found = keep(filled.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "node").mapInPandas(solve, "pivot long, a long, b long, d double"), "links")
    drop(dealt)
    links = found.where("pivot = -1").select("a", "b")
    large = keep(found.where("pivot <> -1").select("pivot", F.col("a").alias("node"), "d").dropDuplicates(["pivot", "node"]), "large")
    if large.limit(1).count():
        links = links.unionByName(_across(large, sets, components(links, files), regions.select("pivot", F.col("wide").alias("chunks")), nodes.select("node", "n"), lambda: parts("c", "w", ACROSS / 2), percent, files))
    labels = components(links, files)
    classes = nodes.select("node", "name", "doc", "n", "n_copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = keep(classes, "classes")
    least = classes.groupBy("label").agg(F.min("doc").alias("component_id"))
    by_name, counted = classes.join(least, "label").withColumn("links", F.lit(0).cast("long")), []
    if count_links:
        counted = [link_counts(classes.select("node", "label", "n", "n_copies"), sets, percent, block_nodes, block_hashes, files)]
        by_name = by_name.drop("links").join(counted[0], "node", "left")
    by_name = keep(by_name.select("name", "component_id", "n_copies", (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "by-name")
    drop(sets, nodes, used, regions, found, large, classes, *counted)
    out = named.join(by_name, "name", "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _across(large: DataFrame, sets: DataFrame, labels: DataFrame, regions: DataFrame, sizes: DataFrame, blocks_of, percent: int, files: int | None = None) -> DataFrame:
    """Links between the chunks of large regions that labels do not know yet.

    Of a region, what isn't in the class of most of its nodes is compared with everything, in blocks against chunks; of a pair in
    a task, the triangle inequality at the pivot decides first whether it needs looking at.
    """
    known = large.join(labels, "node", "left").join(sizes, "node").withColumn("label", F.coalesce("label", "node"))
    known = materialise(known.select("pivot", "node", "d", "n", "label"), "known", files)
    bulk = known.groupBy("pivot", "label").count().groupBy("pivot").agg(F.max_by("label", F.struct("count", "label")).alias("bulk"), F.count(F.lit(1)).alias("labels"))
    open_ = materialise(bulk.where("labels > 1").join(regions, "pivot"), "open", files)
    rows = known.join(open_, "pivot")
    outside = rows.where("label <> bulk")
    blocks = outside.groupBy("pivot").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).select("pivot", blocks_of().alias("blocks"))
    blocks = materialise(blocks, "blocks", files)
    left = outside.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("outside", F.lit(True))
    right = rows.join(blocks, "pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")).withColumn("outside", F.lit(False))
    names = ["pivot", "chunk", "block", "node", "label", "d", "outside"]
    both = left.select(names).unionByName(right.select(names)).join(sets, "node")
    keys = ["pivot", "chunk", "block"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in in_groups(batches, keys):
            g = g.drop_duplicates(["node", "outside"])
            out = g["outside"].to_numpy()
            if not out.any() or out.all():
                continue
            j = Joiner(_sets(g["hashes"]), percent)
            j.labels = np.unique(g["label"].to_numpy(), return_inverse=True)[1]
            d, others = g["d"].to_numpy(), np.flatnonzero(~out)
            for i in np.flatnonzero(out):
                near = j.fits(int(i), others[np.abs(d[others] - d[i]) <= j.r + 1e-9])
                if len(near):
                    j.compare(int(i), near)
            if j.links:
                ids = g["node"].to_numpy()
                a, b = np.array(j.links).T
                yield pd.DataFrame({"a": ids[a], "b": ids[b]})

    return materialise(both.repartition(*keys).sortWithinPartitions(*keys, "node").mapInPandas(solve, "a long, b long"), "links-across", files)
