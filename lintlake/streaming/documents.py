"""A stream of document versions (uri, version, ts, text): debounced, guarded against late results, compared with what was known, and scanned.

settled() and newest_only() also say in batch what the streams do. The streams keep one small state a document; its lifetime is bounded by timeouts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEBOUNCE = 0.4  #: seconds
SCHEMA = "uri string, version long, ts timestamp, text string"


def settled(events: DataFrame, keys: list[str], order: list[str], ts: str, seconds: float = DEBOUNCE) -> DataFrame:
    """The events that no other of the same keys follows within so many seconds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.lead(ts).over(w)) - micros(F.col(ts))
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > int(seconds * 1e6))).drop("_gap")


def newest_only(results: DataFrame, versions: DataFrame, key: str = "uri") -> DataFrame:
    """Results that are not of an older version than the newest known."""
    newest = versions.groupBy(key).agg(F.max("version").alias("_newest"))
    return results.join(newest, key).where(F.col("version") >= F.col("_newest")).drop("_newest")


def debounced_stream(events: DataFrame, seconds: float = DEBOUNCE, watermark: str = "10 seconds") -> DataFrame:
    """The last version of each burst: a session window that a gap of ``seconds`` closes, once the watermark has passed it."""
    burst = F.session_window("ts", f"{int(seconds * 1000)} milliseconds")
    newest = events.withWatermark("ts", watermark).groupBy("uri", burst).agg(F.max(F.struct("version", "ts", "text")).alias("x"))
    return newest.select("uri", "x.version", "x.ts", "x.text")


def changed_stream(events: DataFrame, forget_after_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """uri, version, action: 'obsolete' for a version older than one seen, 'reuse' if its text is the one last seen, else 'scan'. State: version and hash, dropped after a day without events."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, seen = state.get if state.exists else (-1, "")
        rows = []
        for b in sorted((r for pdf in batches for r in zip(pdf["version"], pdf["hash"], strict=True)), key=lambda r: r[0]):
            action = "obsolete" if b[0] < version else "reuse" if b[1] == seen else "scan"
            rows.append((key[0], int(b[0]), action))
            if action != "obsolete":
                version, seen = int(b[0]), b[1]
        state.update((version, seen))
        state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(rows, columns=["uri", "version", "action"])

    hashed = events.select("uri", "version", F.md5("text").alias("hash"))
    return hashed.groupBy("uri").applyInPandasWithState(step, "uri string, version long, action string", "version long, seen string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, width: str, by: list[str], watermark: str) -> DataFrame:
    """An addition: tumbling counts with a bound on lateness."""
    return events.withWatermark(ts, watermark).groupBy(F.window(ts, width), *by).count().select(F.col("window.start").alias("start"), *by, "count")


def scan_stream(events: DataFrame, scan: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, keep_newest: bool = True):
    """Runs the batch plan on each micro-batch's newest versions and hands the findings on; batches that come again overwrite by their number."""

    def run(batch: DataFrame, number: int) -> None:
        if keep_newest:
            w = Window.partitionBy("uri").orderBy(F.desc("version"))
            batch = batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        write(scan(batch), number)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
