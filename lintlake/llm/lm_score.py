"""Masked pseudo-likelihood: how well each token of a text follows from the tokens on both of its sides.

Tokens are words. The commonest are tokens of their own; all others share BUCKETS tokens by a hash, and within a bucket a word has the share that
its count in the corpus says, kept for CELLS cells of the hash. A network of one hidden layer, in numpy, sees SIDE tokens before and SIDE after the
masked one (0 stands for what lies beyond a text's ends) and gives a softmax over groups of tokens and one over the group's members. A text's score
is the sum of the log-probabilities of all its words.

The network is trained on every position of the corpus, each once. Texts are cut into pieces (with the tokens around the cut) and dealt to shards by
a hash; in each round every shard makes steps from the common parameters on its own share of positions, and the results are averaged by their numbers of
positions. Shards, their order and their number come from the data alone, so the scores don't depend on how the table is partitioned
but for the rounding of sums (below 1e-6 of a score).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise
from .jaccard_join import in_groups

GROUPS, MEMBERS = 64, 64
TOKENS = GROUPS * MEMBERS
BUCKETS = 1024  #: of the tokens, those that words share
CELLS = 1 << 19  #: of the hash, for the counts of words that share a token
SIDE = 2  #: tokens seen on each side
EMBED, HIDDEN = 16, 32
ROUNDS = 2  #: a position is trained on in one of them
SHARD = 2_000_000  #: positions of a shard, about
PIECE = 16_384  #: positions of a piece, at most
BATCH, RATE = 8192, 3e-2  #: the rate falls evenly to 0 over the rounds
BLOCK = 8192  #: parameters that travel in one row
CACHED_WORDS = 200_000
FLUSH = 4_000_000  #: words that are counted at a time
AT_ONCE = 16_384  #: positions that are scored at a time

SHAPES = {"embed": (TOKENS + 1, EMBED), "into": (2 * SIDE * EMBED, HIDDEN), "bias": (HIDDEN,), "group": (HIDDEN, GROUPS), "group_rest": (GROUPS,), "member": (GROUPS, HIDDEN, MEMBERS), "member_rest": (GROUPS, MEMBERS)}
STEPS = [s for s in range(-SIDE, SIDE + 1) if s]


def word_hashes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """A 32-bit number for each word in lower case."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = crc32(w)
    return np.fromiter(map(known.__getitem__, words), "<u4", len(words))


def hashed(docs: DataFrame) -> DataFrame:
    """(k, words): the words of each text, four bytes each."""
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "words": [word_hashes(t, known).tobytes() for t in b["t"]]}).astype({"k": "Int64"} if kind in ("bigint", "int") else {})

    return docs.mapInPandas(run, f"k {kind}, words binary")


class Vocabulary:
    """top: the hashes of the words with a token of their own, commonest first, and their counts; cells: (cell, count, words) of all others."""

    def __init__(self, top: np.ndarray, counts: np.ndarray, cells: list[np.ndarray]):
        self.owner, self.own = np.zeros(CELLS, np.uint32), np.zeros(CELLS, np.uint16)
        at = top[::-1] % CELLS  # of two words in a cell the commoner has it
        self.owner[at], self.own[at] = top[::-1], np.arange(len(top), 0, -1)
        self.counts = np.zeros(TOKENS + 1)
        self.counts[1 : len(top) + 1] = counts
        cell, n, words = cells
        bucket = self.bucket(cell)
        self.counts += np.bincount(bucket, n, TOKENS + 1)
        self.share = np.zeros(CELLS, np.float32)  # log of a word's share of its bucket
        self.share[cell] = np.log(n / np.maximum(words, 1) / self.counts[bucket])
        lost = top[self.owner[top % CELLS] != top]
        if len(lost):  # words whose cell is another's: as one more word of their bucket
            n = counts[np.isin(top, lost)]
            self.counts += np.bincount(self.bucket(lost), n, TOKENS + 1)
            self.share[lost % CELLS] = np.log(n / self.counts[self.bucket(lost)])

    @staticmethod
    def bucket(h: np.ndarray) -> np.ndarray:
        return TOKENS - BUCKETS + 1 + (h % BUCKETS).astype(np.int64)

    def tokens(self, words: np.ndarray) -> np.ndarray:
        cell = words % CELLS
        return np.where((self.owner[cell] == words) & (self.own[cell] > 0), self.own[cell], self.bucket(words)).astype("<u2")

    def shares(self, words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens > TOKENS - BUCKETS, self.share[words % CELLS], 0)


def vocabulary(words: DataFrame) -> tuple[Vocabulary, int]:
    """Of hashed(): the vocabulary, and how many words there are. The driver gets the commonest TOKENS - BUCKETS and a row per cell at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            for w in b["words"]:
                held.append(np.frombuffer(w, "<u4"))
                n += len(held[-1])
                if n > FLUSH:
                    yield rows(held)
                    held, n = [], 0
        yield rows(held)

    def rows(held: list[np.ndarray]) -> pd.DataFrame:
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *held]), return_counts=True)
        return pd.DataFrame({"h": h.astype(np.int64), "n": n})

    per = materialise(words.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    top = per.orderBy(F.desc("n"), "h").limit(TOKENS - BUCKETS)
    got = top.collect()
    own = F.broadcast(words.sparkSession.createDataFrame([(r[0],) for r in got], "h long"))
    cells = per.join(own, "h", "left_anti").groupBy(F.pmod("h", F.lit(CELLS)).alias("cell")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow()
    cells = [cells[c].to_numpy().astype(np.int64) for c in ("cell", "n", "words")]
    total = sum(r[1] for r in got) + int(cells[1].sum())
    drop(per)
    return Vocabulary(np.array([r[0] for r in got], np.uint32), np.array([r[1] for r in got], float), cells), total


def initial(counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """counts: of all tokens."""
    rng = np.random.default_rng(seed)
    p = {k: rng.standard_normal(s).astype(np.float32) * 0.1 for k, s in SHAPES.items()}
    p["bias"][:] = 0
    n = counts[1:].reshape(GROUPS, MEMBERS) + 0.1
    p["group_rest"] = np.log(n.sum(1) / n.sum()).astype(np.float32)
    p["member_rest"] = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = np.array(v[at : at + n], np.float32).reshape(s), at + n
    return out


def hidden(p: dict[str, np.ndarray], whole: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context tokens, their embeddings, hidden layer) of the positions."""
    c = np.stack([whole[at + s] for s in STEPS], axis=1)
    e = p["embed"].take(c, axis=0).reshape(len(at), -1)
    return c, e, np.tanh(e @ p["into"] + p["bias"])


def exponentials(z: np.ndarray) -> np.ndarray:
    """The sums of the logits' exponentials, which take their place."""
    np.minimum(z, 80, out=z)
    np.maximum(z, -80, out=z)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def by_group(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the positions in which groups are together, and where each is."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS))
    return order, [(g, slice(lo, hi)) for g, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)) if hi > lo]


def member_logits(p: dict[str, np.ndarray], hs: np.ndarray, places: list[tuple[int, slice]], z: np.ndarray) -> None:
    """Of the members of each position's group, into z."""
    for q, s in places:
        np.matmul(hs[s], p["member"][q], out=z[s])
        z[s] += p["member_rest"][q]


def gradient(p: dict[str, np.ndarray], whole: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss over the positions."""
    n, rows = len(at), np.arange(len(at))
    group, member = np.divmod(whole[at].astype(np.int64) - 1, MEMBERS)
    c, e, h = hidden(p, whole, at)
    ones = np.ones(n, np.float32)
    dz = h @ p["group"]
    dz += p["group_rest"]
    dz /= exponentials(dz)[:, None]
    dz[rows, group] -= 1
    g = {"group": h.T @ dz, "group_rest": ones @ dz, "member": np.zeros_like(p["member"]), "member_rest": np.zeros_like(p["member_rest"])}
    dh = dz @ p["group"].T
    order, places = by_group(group)
    hs, ds = h.take(order, axis=0), np.empty_like(h)
    member_logits(p, hs, places, dz)
    dz /= exponentials(dz)[:, None]
    dz[rows, member.take(order)] -= 1
    for q, s in places:
        np.matmul(hs[s].T, dz[s], out=g["member"][q])
        np.matmul(ones[s], dz[s], out=g["member_rest"][q])
        np.matmul(dz[s], p["member"][q].T, out=ds[s])
    back = np.empty_like(order)
    back[order] = rows
    dh += ds.take(back, axis=0)
    h *= h
    dh *= np.subtract(1, h, out=h)
    g["bias"], g["into"] = ones @ dh, e.T @ dh
    de, c = (dh @ p["into"].T).reshape(-1, EMBED), c.ravel()
    order = np.argsort(c, kind="stable")
    c = c.take(order)
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    g["embed"] = np.zeros_like(p["embed"])
    g["embed"][c[first]] = np.add.reduceat(de.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)  # two numbers at a time
    return {k: x / n for k, x in g.items()}


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.step = p, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def __call__(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        by = rate / (1 - 0.9**self.step)
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (x - m)
            x *= x
            x -= v
            v += 0.01 * x
            self.p[k] -= by * m / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)


def log_probabilities(p: dict[str, np.ndarray], whole: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the token at each position."""
    out = np.empty(len(at))
    for lo in range(0, len(at), AT_ONCE):
        a = at[lo : lo + AT_ONCE]
        rows = np.arange(len(a))
        group, member = np.divmod(whole[a].astype(np.int64) - 1, MEMBERS)
        h = hidden(p, whole, a)[2]
        z = h @ p["group"]
        z += p["group_rest"]
        got = np.clip(z[rows, group], -80, 80)
        got -= np.log(exponentials(z))
        order, places = by_group(group)
        member_logits(p, h.take(order, axis=0), places, z)
        more = np.clip(z[rows, member.take(order)], -80, 80)
        more -= np.log(exponentials(z))
        got[order] += more
        out[lo : lo + AT_ONCE] = got
    return out


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole, at, text): all texts in a row with 0 between them, the places of their tokens, and whose they are."""
    gap = np.zeros(SIDE, np.uint16)
    whole = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    n = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), n)
    return whole, np.arange(n.sum()) + SIDE * (text + 1), text


def dealt(words: DataFrame, shared, shards: int, piece: int) -> DataFrame:
    """(shard, name, ids): pieces of all texts, each with the SIDE tokens around it. Rows that repeat key and text spread over the shards as well, by their place among their equals in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = shared.value
        for b in batches:
            rows = []
            for k, w in zip(b["k"], b["words"], strict=True):
                ids = vocab.tokens(np.frombuffer(w, "<u4"))
                ids = np.concatenate([np.zeros(SIDE, "<u2"), ids, np.zeros(SIDE, "<u2")])
                for lo in range(0, len(ids) - 2 * SIDE, piece):
                    x = ids[lo : lo + piece + 2 * SIDE].tobytes()
                    rows.append((crc32(str(k).encode("utf-8", "replace"), crc32(x)), x))
            out = pd.DataFrame(rows, columns=["name", "ids"]).astype({"name": "int64", "ids": object})
            yield out.assign(copy=out.groupby("name").cumcount().astype("int64"))

    made = words.mapInPandas(run, "name long, ids binary, copy long")
    return made.select(F.pmod(F.xxhash64("name", "copy"), F.lit(shards)).cast("int").alias("shard"), "name", "ids")


def fit(words: DataFrame, vocab: Vocabulary, total: int, rounds: int = ROUNDS, shard: int = SHARD, piece: int = PIECE) -> dict[str, np.ndarray]:
    """words: hashed(); total: how many there are."""
    spark = words.sparkSession
    shards = max(1, -(-total // shard))
    at_hand = spark.sparkContext.broadcast(vocab)
    pieces = materialise(dealt(words, at_hand, shards, piece), "lm-pieces")
    p = initial(vocab.counts)
    size = len(flat(p))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(flat(p))

        def step(batches: Iterator[pd.DataFrame], shared=shared, r=r) -> Iterator[pd.DataFrame]:
            for g in in_groups(batches, ["shard"]):
                texts = [np.frombuffer(x, "<u2") for x in g["ids"]]
                starts = np.cumsum([0, *map(len, texts)])
                at = np.concatenate([np.arange(lo + SIDE, hi - SIDE, dtype=np.int64) for lo, hi in zip(starts[:-1], starts[1:], strict=True)])
                at = np.random.default_rng(len(at)).permutation(at)[r::rounds]
                if not len(at):
                    continue
                whole, own = np.concatenate(texts), unflat(shared.value)
                adam = Adam(own)
                for lo in range(0, len(at), BATCH):
                    adam(gradient(own, whole, at[lo : lo + BATCH]), RATE * (1 - (r + lo / len(at)) / rounds))
                v = flat(own)
                yield pd.DataFrame({"block": range(-(-size // BLOCK)), "shard": g["shard"].iloc[0], "n": len(at), "x": [v[lo : lo + BLOCK].tobytes() for lo in range(0, size, BLOCK)]})

        def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, total, n = None, None, 0
            for b in batches:
                for i, m, x in zip(b["block"], b["n"], b["x"], strict=True):
                    if i != block:
                        if block is not None:
                            yield pd.DataFrame({"block": [block], "x": [(total / n).tobytes()]})
                        block, total, n = i, 0.0, 0
                    total, n = total + np.frombuffer(x, np.float32).astype(float) * m, n + m
            if block is not None:
                yield pd.DataFrame({"block": [block], "x": [(total / n).tobytes()]})

        ordered = pieces.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "name", "ids")
        own = ordered.mapInPandas(step, "block int, shard int, n long, x binary").repartition("block").sortWithinPartitions("block", "shard")
        got = own.mapInPandas(average, "block int, x binary").collect()  # the parameters, in blocks
        shared.unpersist()
        if not got:
            break
        p = unflat(np.concatenate([np.frombuffer(x) for _, x in sorted((i, bytes(x)) for i, x in got)]))
    drop(pieces)
    return p


def pseudo_likelihood(docs: DataFrame, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """key, n_tokens, log_likelihood (the sum over all words) and mean_log_likelihood.

    Null and empty texts have no tokens, a sum of 0 and a null mean. Repeated rows are trained on and scored each; a null key is kept. Texts of any
    length are read in whole; a text is held by one task, its positions are worked on AT_ONCE at a time. Columns other than key and text are not read,
    so their names can't clash. An empty table gives no rows.
    """
    words = materialise(hashed(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))), "lm-hashes")
    vocab, total = vocabulary(words)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, fit(words, vocab, total, rounds)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, p = shared.value
        for b in batches:
            texts = [np.frombuffer(w, "<u4") for w in b["words"]]
            n = np.array([len(t) for t in texts], np.int64)
            total, ends, lo = np.zeros(len(b)), np.cumsum(n), 0
            while lo < len(b):  # so many texts that their positions fit in memory
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, "right")))
                tokens = [vocab.tokens(t) for t in texts[lo:hi]]
                whole, at, of = padded(tokens)
                words = np.concatenate(texts[lo:hi])
                got = log_probabilities(p, whole, at) + vocab.shares(words, whole[at])
                total[lo:hi] = np.bincount(of, got, minlength=hi - lo)
                lo = hi
            yield pd.DataFrame({"k": b["k"], "n_tokens": n, "log_likelihood": total}).astype({"k": b["k"].dtype})

    out = words.mapInPandas(score, f"k {words.schema['k'].dataType.simpleString()}, n_tokens long, log_likelihood double")
    return out.select(F.col("k").alias(key), "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
