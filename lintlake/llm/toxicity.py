"""Toxicity behind disguise: a noisy channel turns leetspeak, spaced letters and stretched letters back into words, then the words are scored.

A disguised token is a lattice: each character it shows may stand for itself, for the letters it imitates, for a repeat of
the letter before, or for nothing; in a run of spaced letters each gap may be inside a word or between two. Viterbi finds the
likeliest letters and word ends under a character trigram model counted over all documents. Plain tokens pass through. Words and word beginnings are then weighed by how much likelier labelled toxic documents
hold them, and the strongest weights of a document are calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, drop, materialise

MAX_LABELLED = 30_000  #: labelled rows that the classifier is fitted on, about; counts of characters cover all rows
PREFIXES = range(3, 8)  #: lengths of the word beginnings that are features
MIN_TOXIC_DOCS = 3
CACHED_WORDS = 120_000  #: tokens whose weight a worker keeps
FLUSH = 150_000  #: features that a worker counts before it hands them on
THRESHOLD = 0.5

#: What a shown character may stand for, besides itself. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "%": "x", "&": "a", "*": "aeiou"}
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
N = len(ALPHABET) + 2  #: 0 is a word's edge, N - 1 any letter that is not Latin
SAME, IMITATED, DROPPED, IGNORED, REPEATED = (math.log(p) for p in (0.9, 0.7, 0.05, 0.0005, 0.3))
INSIDE, BETWEEN = math.log(0.8), math.log(0.2)  #: a gap of a run of spaced letters is inside a word or ends one; the other way round if it is wider than the run's others

#: Latin letters with marks, by the letter that they are made from
BASES = {"a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľł", "n": "ñńņň", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşšß", "t": "ţťŧ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž"}


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x10000 in lower case."""
    out = np.zeros(0x10000, dtype=np.int32)
    for i in range(0x100, 0x10000):
        if chr(i).isalpha():
            out[i] = N - 1
    for i in range(0x80, 0x100):
        if chr(i).isalpha():
            out[i] = N - 1
    for i, c in enumerate(ALPHABET):
        out[ord(c)] = out[ord(c.upper())] = i + 1
        for x in BASES.get(c, ""):
            out[ord(x)] = i + 1
            if len(x.upper()) == 1:
                out[ord(x.upper())] = i + 1
    return out


def trigram_counts(texts: Iterable[str | None], table: np.ndarray) -> np.ndarray:
    total = np.zeros(N**3, dtype=np.int64)
    for t in texts:
        if t:
            s = table[np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 0xFFFF)]
            s = np.concatenate(([0], s, [0]))
            s = s[(s > 0) | np.r_[True, s[:-1] > 0]]  # edges in a row count once
            s = np.concatenate(([0], s))
            total += np.bincount((s[:-2] * N + s[1:-1]) * N + s[2:], minlength=N**3)
    return total


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed by the bigram and the single character."""
    c = counts.reshape(N, N, N).astype(float)
    uni = (c.sum((0, 1)) + 1) / (c.sum() + N)
    bi = (c.sum(0) + 5 * uni) / (c.sum((0, 2))[:, None] + 5)
    return np.log((c + 5 * bi[None]) / (c.sum(2, keepdims=True) + 5))


class Restorer:
    """Decodes tokens. model: log_model()."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.table = symbol_table()
        self.restored = lru_cache(20_000)(self._restored)

    def symbol(self, c: str) -> int:
        return int(self.table[min(ord(c), 0xFFFF)])

    def decode(self, shown: str, keep: bool = False, spaced: bool = False) -> str:
        """The likeliest letters; the state of a path is its last two symbols. keep: no imitation of a letter is ignored.
        spaced: single letters with gaps, each of which ends a word (a space in what is returned) or not.

        No word has a letter more than three times on end, so further showings are repeats on every path and are left out.
        """
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        nodes = [x for x in GAP.split(shown) if x] if spaced else [LONG_RUN.sub(r"\1\1\1", shown)]
        narrow = min((len(x) for x in nodes if GAP.match(x)), default=0) if spaced else 0
        for node in nodes:
            gap = spaced and GAP.match(node)
            for c in (" ",) if gap else node:
                options = [(c, self.symbol(c), SAME)] if c.isalpha() else []
                options += [(x, self.symbol(x), IMITATED - math.log(len(LEET[c]))) for x in LEET.get(c, "")]
                new: dict[tuple[int, int], tuple[float, tuple | None]] = {}

                def offer(state, score, path, new=new):
                    if state not in new or new[state][0] < score:
                        new[state] = (score, path)

                if gap:
                    inside, between = (BETWEEN, INSIDE) if len(node) > narrow else (INSIDE, BETWEEN)
                    for (a, b), (score, path) in paths.items():
                        offer((a, b), score + inside, path)
                        if b:
                            offer((b, 0), score + between + self.model[a][b][0], (path, " "))
                    paths = new
                    continue
                for (a, b), (score, path) in paths.items():
                    rows = self.model[a][b]
                    for letter, s, p in options:
                        offer((b, s), score + p + rows[s], (path, letter))
                    if c == before and b:
                        offer((a, b), score + REPEATED, path)
                    elif not c.isalpha() and not (keep and c in LEET):
                        offer((a, b), score + (IGNORED if c in LEET else DROPPED), path)
                paths, before = new, c
        best = max(((s + self.model[a][b][0], p) for (a, b), (s, p) in paths.items()), key=lambda x: x[0], default=(0.0, None))[1]
        out = []
        while best is not None:
            best, letter = best
            out.append(letter)
        return "".join(reversed(out))

    def _restored(self, inner: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys(filter(None, (self.decode(inner), self.decode(inner, keep=True)))))

    def token(self, word: str) -> tuple[str, ...]:
        """The words that a token in lower case may be: without the marks around it, and restored if it looks disguised."""
        if word.isalpha() and not STRETCHED.search(word):
            return (word,)
        plain = word.strip(MARKS)
        out = (plain,) if plain else ()
        inner = ENDS.sub("", word.strip(OUTER)).strip(OUTER)
        if inner and DISGUISED.search(inner):
            out += tuple(w for w in self.restored(inner) if w not in out)
        return out


MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»„“”‘’…¿¡–—"
OUTER = "".join(c for c in MARKS if c not in LEET) + "".join(c for c in "!#%&+(<|*")
#: a letter and an imitation or a mark inside, or a stretched letter
DISGUISED = re.compile(r"[^\W\d_][^\w\s]*[0-9@$!|+(<€£#%&*]|[0-9@$!|+(<€£#%&*][^\w\s]*[^\W\d_]|[^\W\d_][._~^-]+[^\W\d_]|([^\W\d_])\1\1")
GAP = re.compile(r"([ \t._*~-]+)")  #: what SPACED has between its letters
LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
STRETCHED = re.compile(r"(.)\1\1")
#: a mark twice or more at the end of a token is an ornament
ENDS = re.compile(r"[.,;:]?([^\w\s])\1+[.,;:]?\Z")
SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[ \t._*~-]{1,2}(?:[^\W_]|[@$!|+])){3,}(?!\S)")


def spaced_words(text: str, restorer: Restorer) -> set[str]:
    """The words that runs of single letters hold. The pattern only finds the runs; the lattice restores their letters and says where words end.

    A word that the model doesn't know may be parted wrongly, so the letters also count from each place on, as far as
    word beginnings reach (a longer rest is marked as going on), as the lattice reads them and as they are shown.
    """
    out: set[str] = set()
    reach = max(PREFIXES)
    for m in SPACED.finditer(text):
        closed = {"".join(GAP.split(m[0])[::2])}
        for keep in (False, True):
            reading = restorer.decode(m[0], keep, spaced=True)
            out.update(reading.split())
            closed.add(reading.replace(" ", ""))
        for letters in closed:
            out.update(letters[i : i + reach] + "…" * (i + reach < len(letters)) for i in range(max(0, len(letters) - 2)))
    return out


def words_of(text: str | None, restorer: Restorer) -> set[str]:
    """The distinct words of a text in lower case, with what is restored."""
    text = (text or "").lower()
    out = spaced_words(text, restorer)
    for w in set(text.split()):
        out.update(restorer.token(w))
    return out


def features(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in PREFIXES if k < len(w)} | {w + " " for w in words if len(w) > 1}


class Weights:
    """feature -> log odds; a token counts with the strongest feature of what it may stand for."""

    def __init__(self, weight: dict[str, float], restorer: Restorer):
        self.weight, self.restorer = weight, restorer
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        get = self.weight.get
        return max([0.0, get(word + " ", 0.0), *[get(word[:k], 0.0) for k in PREFIXES if k < len(word)]])

    def summary(self, text: str | None) -> tuple[float, float, float]:
        """The strongest weight, the sum of the next four, and the log of the number of distinct tokens."""
        text = (text or "").lower()
        tokens = set(text.split())
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in tokens.difference(known):
            known[w] = max(map(self.word, self.restorer.token(w)), default=0.0)
        best = [x for x in map(known.__getitem__, tokens) if x]
        best += [x for x in map(self.word, spaced_words(text, self.restorer)) if x]
        best = sorted(best, reverse=True)[:5]
        return (best[0] if best else 0.0, sum(best[1:]), math.log1p(len(tokens)))


def learn_weights(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log odds of the features that speak for toxicity, with a penalty for the chance that few documents show."""
    out = {}
    for f, t in toxic.items():
        c = clean.get(f, 0)
        if t >= MIN_TOXIC_DOCS:
            w = math.log((t - 0.5 * math.sqrt(t) + 0.1) / (n_toxic + 1)) - math.log((c + math.sqrt(c) + 0.5) / (n_clean + 1))
            if w > 1.0:
                out[f] = w
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the first is the constant) by Newton steps with a small penalty."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + l2 * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + l2 * len(x) * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def logistic(x: np.ndarray, fitted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = fitted
    return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (np.asarray(x, float) - mean) / scale] @ w, -30, 30)))


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log_model() of all documents; the driver gets a row per trigram at most, N ** 3 of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = symbol_table(), np.zeros(N**3, dtype=np.int64)
        for b in batches:
            total += trigram_counts(b["t"], table)
        i = np.flatnonzero(total)
        yield pd.DataFrame({"i": i, "n": total[i]})

    counts = np.zeros(N**3, dtype=np.int64)
    for i, n in docs.select(F.col(text).alias("t")).mapInPandas(count, "i long, n long").groupBy("i").agg(F.sum("n")).collect():
        counts[i] = n
    return log_model(counts)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED):
    """(character model, weights, calibration) from all documents and about max_labelled labelled ones, by a hash of their keys.

    Half of these weigh the features, the other half calibrate. Without labels of both kinds there are no weights, and every score
    is the share of toxic labels (0 if none).
    """
    model = character_model(docs, text)
    wanted = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).groupBy("k").agg(F.max("y").alias("y"))
    n = wanted.count()
    part = F.pmod(F.xxhash64("k", F.lit(77)), F.lit(1 << 30))
    chosen = wanted.where(part < int((1 << 30) * min(1.0, max_labelled / max(1, n)))).withColumn("half", F.pmod(F.xxhash64("k", F.lit(78)), F.lit(2)).cast("int"))
    rows = materialise(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(chosen, "k").groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y"), F.first("half").alias("half")), "toxic-labelled")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, seen, n = Restorer(shared.value), {0: Counter(), 1: Counter()}, Counter()
        for b in batches:
            for t, y in zip(b["t"], b["y"], strict=True):
                y = int(y > 0)
                seen[y].update(features(words_of(t, restorer)))
                n[y] += 1
                if len(seen[y]) > FLUSH:  # what is rare here may be common elsewhere, so all of it goes on
                    yield pd.DataFrame({"f": list(seen[y]), "y": y, "n": list(seen[y].values())})
                    seen[y].clear()
        for y in (0, 1):
            yield pd.DataFrame({"f": ["", *seen[y]], "y": y, "n": [n[y], *seen[y].values()]})

    counts = rows.where("half = 0").select("t", "y").mapInPandas(count, "f string, y int, n long")
    per = counts.groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    n_of = {bool(y): n for y, n in rows.where("half = 0").groupBy(F.col("y") > 0).count().collect()}
    n_toxic, n_clean = n_of.get(True, 0), n_of.get(False, 0)
    # the bound of learn_weights, with a little room for rounding
    odds = F.log((F.col("toxic") - 0.5 * F.sqrt("toxic") + 0.1) / (n_toxic + 1)) - F.log((F.col("clean") + F.sqrt("clean") + 0.5) / (n_clean + 1))
    per = per.where((F.col("f") != "") & (F.col("toxic") >= MIN_TOXIC_DOCS) & (odds > 1.0 - 1e-6))
    toxic, clean = Counter(), Counter()
    for f, t, c in per.collect():  # bounded with the labelled sample
        toxic[f], clean[f] = t, c
    weights = learn_weights(toxic, clean, n_toxic, n_clean)
    share = n_toxic / max(1, n_toxic + n_clean)
    known = rows.sparkSession.sparkContext.broadcast((model, weights))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Weights(known.value[1], Restorer(known.value[0]))
        for b in batches:
            yield pd.DataFrame([(*w.summary(t), y) for t, y in zip(b["t"], b["y"], strict=True)], columns=["a", "b", "c", "y"])

    got = rows.where("half = 1").select("t", "y").mapInPandas(summarise, "a double, b double, c double, y int").toPandas()
    drop(rows)
    fitted = None
    if n_toxic and n_clean and got["y"].nunique() == 2:
        fitted = fit_logistic(got[["a", "b", "c"]].to_numpy(), (got["y"] > 0).to_numpy())
    return model, weights, fitted, share


def score(docs: DataFrame, fitted, text: str = "text", name: str = "toxicity") -> DataFrame:
    """docs and the column ``name``, 0 to 1. Null and empty texts score as a text without words. Other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, weights, calibration, share = shared.value
        w = Weights(weights, Restorer(model))
        for texts in batches:
            if calibration is None:
                yield pd.Series(np.full(len(texts), float(share)))
            else:
                yield pd.Series(logistic(np.array([w.summary(t) for t in texts]).reshape(-1, 3), calibration))

    return docs.withColumn(name, toxicity(F.col(text)))


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = 5, held_out: int = 0, name: str = "toxicity", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs and ``name``: fitted on labels whose fold (crc32 of the key as text, modulo folds) is not held_out, applied to all rows.

    Null and empty texts get a score (that of no words). Null keys and labels are not learned from. Of labels that differ for a key, the
    larger holds; documents that repeat a key are learned from once, the text that comes first in order, and scored each. Other columns pass through
    whatever their names, but for one called ``name``, which is replaced. An empty table gives no rows, no labels one score for all.
    """
    learn = labels.where(bucket_of(F.col(key), folds) != held_out)
    return score(docs, fit(docs, learn, text, key, label, max_labelled), text, name)
