"""Quality by compression: text that a dictionary of good text compresses better than one of bad text is likely good.

Two zstandard dictionaries are built from labelled text. Every text is cut into blocks, since a long text soon is its own
dictionary, and each block is compressed with both; all blocks count. The difference of the two sizes, normalised by the larger, becomes a
probability through a calibration on other labelled rows, in which the rate of compression with the good dictionary, and the squares and the product of both, have a part:
junk that neither dictionary knows has a small difference and a high rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, drop, materialise
from .toxicity import fit_logistic, logistic

MAX_LABELLED = 12_000  #: labelled rows that dictionaries and calibration are made from, about
BLOCK = 1024  #: bytes
DICTIONARY = 65_536  #: bytes
MAX_BLOCKS = 6_000  #: of each kind of label that a dictionary is built from; every labelled row gives one before any gives a second, and so on
LEVEL = 3
THRESHOLD = 0.7


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary trained on the samples; where there are too few to train on, their bytes themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def make(data: bytes):
            extra = {"dict_data": zstandard.ZstdCompressionDict(data)} if len(data) >= 8 else {}
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **extra).compress

        self.ways = [make(good), make(bad)]

    def summary(self, text: str | None) -> list[float]:
        """How much larger the text is with the bad dictionary than with the good one, as a share of the larger; the rate with the good one; their squares and product."""
        parts = blocks(text)
        good, bad = (sum(len(way(b)) for b in parts) for way in self.ways)
        d, g = (bad - good) / max(1, good, bad), good / max(1, sum(map(len, parts)))
        return [d, g, d * d, g * g, d * g]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED):
    """(good dictionary, bad dictionary, calibration, share of good labels) from about max_labelled labelled rows, by a hash of their keys: half for the dictionaries, half for the calibration."""
    wanted = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).groupBy("k").agg(F.min("y").alias("y"))
    n = wanted.count()
    part = F.pmod(F.xxhash64("k", F.lit(55)), F.lit(1 << 30))
    chosen = wanted.where(part < int((1 << 30) * min(1.0, max_labelled / max(1, n)))).withColumn("half", F.pmod(F.xxhash64("k", F.lit(56)), F.lit(2)).cast("int"))
    rows = materialise(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(chosen, "k").groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y"), F.first("half").alias("half")), "quality-labelled")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t, y in zip(b["k"], b["t"], b["y"], strict=True):
                if parts := blocks(t):
                    yield pd.DataFrame({"k": k, "i": range(len(parts)), "y": int(y > 0), "b": parts})

    every = rows.where("half = 0").select("k", "t", "y").mapInPandas(cut, f"k {rows.schema['k'].dataType.simpleString()}, i int, y int, b binary")
    made = {}
    for y in (0, 1):
        turn = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("k", "i"), "i"))
        some = every.where(F.col("y") == y).withColumn("turn", turn).orderBy("turn", F.xxhash64("k", "i"), "k").select("b").limit(MAX_BLOCKS).collect()  # at most MAX_BLOCKS * BLOCK bytes
        made[y] = dictionary([bytes(r[0]) for r in some])
    shared = rows.sparkSession.sparkContext.broadcast(made)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways = Compressors(shared.value[1], shared.value[0])
        for b in batches:
            yield pd.DataFrame({"x": [ways.summary(t) for t in b["t"]], "y": b["y"]})

    got = rows.where("half = 1").select("t", "y").mapInPandas(summarise, "x array<double>, y int").toPandas()
    drop(rows)
    y = (got["y"] > 0).to_numpy() if len(got) else np.zeros(0)
    fitted = fit_logistic(np.array(got["x"].tolist()), y) if 0 < y.sum() < len(y) else None
    return made[1], made[0], fitted, float(y.mean()) if len(y) else 0.5


def score(docs: DataFrame, fitted, text: str = "text", name: str = "quality") -> DataFrame:
    """docs and the column ``name``, 0 to 1. Null and empty texts score as no bytes at all. Other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad, calibration, share = shared.value
        ways = Compressors(good, bad)
        for texts in batches:
            if calibration is None:
                yield pd.Series(np.full(len(texts), share))
            else:
                yield pd.Series(logistic(np.array([ways.summary(t) for t in texts]).reshape(-1, 5), calibration))

    return docs.withColumn(name, quality(F.col(text)))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", folds: int = 4, held_out: int = 2, name: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs and ``name``: fitted on labels whose fold (crc32 of the key as text, modulo folds) is not held_out, applied to all rows.

    Null and empty texts get the score of no bytes. Null keys and labels are not learned from. Of labels that differ for a key, the
    smaller holds; documents that repeat a key are learned from once, the text that comes first in order, and scored each. Other columns pass through
    whatever their names, but for one called ``name``, which is replaced. Without labels of both kinds every score is the share of
    good ones (0.5 if none). An empty table gives no rows.
    """
    learn = labels.where(bucket_of(F.col(key), folds) != held_out)
    return score(docs, fit(docs, learn, text, key, label, max_labelled), text, name)
