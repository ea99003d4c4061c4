"""Nearest neighbours by largest inner product: inverted lists, scanned a block of rotated dimensions at a time.

A random rotation spreads the difference of two vectors evenly over the dimensions, so that d of D dimensions hold about d / D of
their squared distance, whatever the vectors. An inner product that would be among a query's k best means a distance of at most t; after every
block a test abandons the candidates whose partial distance is beyond (1 + EPSILON / sqrt(d)) times its share of that. A query starts with
the k-th best of a sample of all rows, which its k-th best of all can only exceed, so the tests bite from the first row on.
Survivors get their inner product in double precision from the original vectors.

There are about LISTS_PER_ROOT lists for each unit of the square root of the number of rows, and a query visits as many as reach
the recall TARGET for the sample's own nearest neighbours, measured when the index is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import drop, materialise

SAMPLE = 16_384  #: rows that the lists' centres, and the number of lists to visit, are fitted on, about
ASKED = 256  #: of them that are queries when recall is measured
LISTS_PER_ROOT, MOST_LISTS = 2.0, 4096
TARGET = 0.96
BLOCKS = (16, 32, 48)  #: dimensions read before each test
EPSILON = 3.0
CHUNK = 4_096  #: rows that one task holds, of one list or of several small ones
MANY = 0.08  #: share of pairs left up to which whole blocks are multiplied
AT_ONCE = 512  #: queries, and rows, that are compared at a time
QUERY_EVERY = 20


def usable(vector: str):
    """Not null, not all zeros, all components finite."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means on directions, from different points."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    unit = np.unique(unit, axis=0)
    rng = np.random.default_rng(seed)
    c = unit[rng.permutation(len(unit))[:lists]]
    for _ in range(rounds):
        own = np.argmax(unit @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, unit)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-12, sums / np.maximum(n, 1e-12), c)
    return c


def probes_for(sample: np.ndarray, c: np.ndarray, k: int, target: float = TARGET, asked: int = ASKED) -> int:
    """How many lists hold the share ``target`` of the k nearest neighbours within the sample, over ``asked`` of its rows."""
    rows = np.random.default_rng(1).permutation(len(sample))[:asked]
    scores = sample[rows] @ sample.T
    scores[np.arange(len(rows)), rows] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(c)
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    own = np.argmax(sample @ c.T, axis=1)
    order = np.argsort(-(sample[rows] @ c.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(c))[None], axis=1)
    needed = np.sort(np.take_along_axis(rank, own[top], axis=1), axis=None)
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


class Rotated:
    """Vectors, the same rotated, and the squared lengths of what is read of them after each dimension."""

    def __init__(self, v: np.ndarray, rot: np.ndarray):
        self.v, self.r = v, v @ rot
        self.read = np.cumsum(self.r * self.r, axis=1)

    def __getitem__(self, at) -> Rotated:
        out = object.__new__(Rotated)
        out.v, out.r, out.read = self.v[at], self.r[at], self.read[at]
        return out


def scan(q: Rotated, x: Rotated, q_ids: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray | None = None, epsilon: float = EPSILON, blocks=BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of the k nearest rows of x for each row of q, by score, then id; the row with the query's own id aside. floor: scores below which nothing is wanted."""
    qr, xr, q_read, x_read, dim = q.r, x.r, q.read, x.read, q.r.shape[1]
    stops = [b for b in blocks if b < dim] or [dim]
    q, x = q.v, x.v
    floor = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    found: list[list[np.ndarray]] = [[], [], []]
    best = np.full((len(q), k), -np.inf)
    for lo in range(0, len(x), AT_ONCE):
        part = slice(lo, lo + AT_ONCE)
        least = floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
        both = q_read[:, -1:] + x_read[None, part, -1]
        most = both - 2 * least[:, None] + 1e-9 * both  # squared distance that the least wanted score means
        share = lambda b: (1 + epsilon / np.sqrt(b)) ** 2 * (b / dim) if b < dim else 1.0
        alive, score, start = q_ids[:, None] != x_ids[None, part], np.zeros(both.shape), 0
        for n, b in enumerate(stops):  # all pairs, as long as many are left
            score += qr[:, start:b] @ xr[part, start:b].T
            alive &= q_read[:, b - 1 : b] + x_read[None, part, b - 1] - 2 * score <= share(b) * most
            start = b
            if np.count_nonzero(alive) < MANY * alive.size:
                break
        i, j = np.nonzero(alive)
        so_far, most = score[i, j], most[i, j]
        for b in [*stops[n + 1 :], dim]:  # from here on pair by pair
            if b > start:
                so_far = so_far + np.einsum("ij,ij->i", qr[i, start:b], xr[lo + j, start:b])
                alive = q_read[i, b - 1] + x_read[lo + j, b - 1] - 2 * so_far <= share(b) * most
                i, j, so_far, most, start = i[alive], j[alive], so_far[alive], most[alive], b
        keep = so_far >= least[i]
        i, j, so_far = i[keep], j[keep], so_far[keep]
        if not len(i):
            continue
        for a, v in zip(found, (i, j + lo, so_far), strict=True):
            a.append(v)
        some = np.unique(i)
        full = np.full((len(some), k + score.shape[1]), -np.inf)
        full[:, :k] = best[some]
        full[np.searchsorted(some, i), k + j] = so_far
        best[some] = -np.partition(-full, k - 1, axis=1)[:, :k]
        floor[some] = np.maximum(floor[some], best[some].min(axis=1))
    i, j, so_far = (np.concatenate(a) if a else np.zeros(0, int) for a in found)
    keep = so_far >= (floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[i]
    i, j = i[keep], j[keep]
    exact = (q[i] * x[j]).sum(axis=1) if len(i) else np.zeros(0)
    order = np.lexsort((x_ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    top = rank < k
    return i[top], j[top], exact[top]


def search(vectors: DataFrame, k: int = 20, every: int = QUERY_EVERY, lists: int | None = None, probes: int | None = None, chunk: int = CHUNK, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose key is divisible by ``every``, its k nearest others.

    Null, zero and non-finite vectors, null keys and vectors of another length than the most common one of the sample take no part. Ties go to the
    smaller key. Rows that repeat a key are candidates each, but one query, with the vector that comes first in order; all rows with a query's key are its own.
    A query visits the lists that the fit asked for, and more until they hold k others; fewer than k others in the table give all of them. Columns other than key
    and vector are not read, so their names can't clash. An empty table gives no rows.

    Lists are dealt into chunks of about ``chunk`` rows, so that a list with a third of all rows is many tasks and small ones share a task. Candidates
    are never copied: queries go to the chunks of the lists that they visit. Each chunk returns k rows a query, which are merged by one more shuffle.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30))
    sample = rows.where(part <= int((1 << 30) * min(1.0, SAMPLE / n))).toPandas()
    if not len(sample):
        sample = rows.limit(1).toPandas()
    dim = int(sample["v"].map(len).mode()[0])
    sample = sample[sample["v"].map(len) == dim]
    points, point_ids = np.stack(sample["v"].to_numpy()).astype(float), sample["id"].to_numpy()
    c = centres(points, lists or max(8, min(MOST_LISTS, int(LISTS_PER_ROOT * n**0.5))))
    rot = rotation(dim)
    lists, probes = len(c), min(probes or probes_for(points, c, k), len(c))
    shared = spark.sparkContext.broadcast((c, rot, points, point_ids))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                yield b.assign(list=np.argmax(x @ shared.value[0].T, axis=1).astype(np.int32))

    placed = materialise(rows.where(F.size("v") == dim).mapInPandas(assign, "id long, v array<double>, list int"), "ann-lists")
    sizes = {r[0]: r[1] for r in placed.groupBy("list").count().collect()}  # a row per list
    # lists side by side until a chunk is full; a list that fills one has as many as it needs to itself
    first, parts, at, room = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, chunk
    for i in range(lists):
        if (size := sizes.get(i, 0)) > chunk:
            at, room = at + (room < chunk), chunk
            first[i], parts[i] = at, -(-size // chunk)
            at += int(parts[i])
        else:
            if size > room:
                at, room = at + 1, chunk
            first[i], room = at, room - size
    chunks = at + 1
    literal = lambda a: F.element_at(F.array(*[F.lit(int(x)) for x in a]), F.col("list") + 1)
    layout = spark.sparkContext.broadcast((first, parts, np.array([sizes.get(i, 0) for i in range(lists)], np.int64)))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, _, points, point_ids = shared.value
        first, parts, size = layout.value
        point_list = np.argmax(points @ c.T, axis=1)
        for b in batches:
            same = b.set_index("id")["same"]
            for lo in range(0, len(b), AT_ONCE):
                ids, x = b["id"].to_numpy()[lo : lo + AT_ONCE], np.stack(b["v"].to_numpy()[lo : lo + AT_ONCE])
                order = np.argsort(-(x @ c.T), axis=1, kind="stable")
                # never fewer lists than hold k others
                enough = (np.cumsum(size[order], axis=1) < k + same[ids].to_numpy()[:, None]).sum(1) + 1
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(lists)[None], axis=1)
                visits = rank < np.maximum(probes, enough)[:, None]
                # the sample's rows in these lists are candidates: the k-th best of them is surely reached
                there = visits[:, point_list] & (ids[:, None] != point_ids[None])
                scores = np.where(there, x @ points.T, -np.inf)
                floor = np.partition(scores, -k, axis=1)[:, -k] if len(points) >= k else np.full(len(x), -np.inf)
                row, visited = np.nonzero(visits)
                n = parts[visited]
                row, visited = np.repeat(row, n), np.repeat(visited, n)
                where = first[visited] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                order = np.lexsort((visited, where, row))
                row, visited, where = row[order], visited[order].astype(np.int32), where[order].astype(np.int32)
                cuts = np.flatnonzero((row[1:] != row[:-1]) | (where[1:] != where[:-1])) + 1
                at = np.r_[0, cuts]
                yield pd.DataFrame({"chunk": where[at], "id": ids[row[at]], "v": list(x[row[at]]), "lists": np.split(visited, cuts), "floor": floor[row[at]]})

    queries = placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("same")).mapInPandas(visit, "chunk int, id long, v array<double>, lists array<int>, floor double")
    others = placed.select((literal(first) + F.pmod(F.xxhash64("id", F.lit(4)), literal(parts))).cast("int").alias("chunk"), "id", "v", "list")
    both = others.select("chunk", "id", "v", "list", F.lit(None).cast("array<int>").alias("lists"), F.lit(None).cast("double").alias("floor")).unionByName(queries.withColumn("list", F.lit(-1)))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_chunk, x_ids, x, x_list = None, None, None, None
        for chunk_id, b in by_chunk(batches):
            rows, asked = b[b["list"] >= 0], b[b["list"] < 0]
            if chunk_id != held_chunk:  # candidates come before the queries of their chunk, in the order of their lists
                held_chunk, x_ids, x, x_list = chunk_id, np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros(0, np.int32)
            if len(rows):
                x_ids, x, x_list = np.r_[x_ids, rows["id"].to_numpy()], np.vstack([x, np.stack(rows["v"].to_numpy())]), np.r_[x_list, rows["list"].to_numpy()]
            if len(asked) and len(x):
                turned = Rotated(x, shared.value[1])
            for lo in range(0, len(asked) if len(x) else 0, AT_ONCE):
                a = asked.iloc[lo : lo + AT_ONCE]
                q, q_ids, floor = Rotated(np.stack(a["v"].to_numpy()), shared.value[1]), a["id"].to_numpy(), a["floor"].to_numpy(float)
                wanted = np.zeros((len(a), lists), bool)
                wanted[np.repeat(np.arange(len(a)), a["lists"].map(len)), np.concatenate(a["lists"].to_list())] = True
                for v in np.unique(x_list):
                    at, mine = np.flatnonzero(wanted[:, v]), np.flatnonzero(x_list == v)
                    if len(at):
                        i, j, score = scan(q[at], turned[mine], q_ids[at], x_ids[mine], k, floor[at])
                        if len(i):
                            yield pd.DataFrame({"query_id": q_ids[at][i], "vec_id": x_ids[mine][j], "score": score})

    ordered = both.repartition(chunks, "chunk").sortWithinPartitions("chunk", F.col("list") < 0, "list", "id")
    found = ordered.mapInPandas(near, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = materialise(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-found")
    drop(placed)
    return out


def by_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each chunk that a batch holds."""
    for b in batches:
        for c, g in b.groupby("chunk", sort=True):
            yield int(c), g
