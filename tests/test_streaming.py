from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lintlake.operators.match import lines_of
from lintlake.streaming import documents

T0 = datetime(2024, 1, 1)


def events(spark, tmp_path, batches):
    """A stream that reads each batch as a file."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(u, v, T0 + timedelta(seconds=s), t) for u, v, s, t in rows], documents.SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(documents.SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


BURSTS = [[("a", 1, 0.0, "x"), ("a", 2, 0.2, "y"), ("b", 1, 0.1, "q")], [("a", 3, 5.0, "z"), ("c", 1, 100.0, "end")], [("c", 2, 200.0, "end")]]


def test_debounce_stream_equals_batch(spark, tmp_path):
    got = run(documents.debounced_stream(events(spark, tmp_path, BURSTS)), "debounced")
    rows = spark.createDataFrame([(u, v, T0 + timedelta(seconds=s), t) for b in BURSTS for u, v, s, t in b], documents.SCHEMA)
    want = {(r.uri, r.version) for r in documents.settled(rows, ["uri"], ["ts"], "ts").collect()}
    assert {(r.uri, r.version) for r in got.collect()} == want - {("c", 2)} and ("a", 1) not in want  # the last is still open


def test_changes_are_kept_by_document(spark, tmp_path):
    s = events(spark, tmp_path, [[("a", 1, 0, "x")], [("a", 3, 1, "y")], [("a", 2, 2, "old"), ("b", 1, 2, "q")], [("a", 4, 3, "y")]])
    got = run(documents.changed_stream(s), "changed")
    assert {(r.uri, r.version): r.action for r in got.collect()} == {("a", 1): "scan", ("a", 3): "scan", ("a", 2): "obsolete", ("b", 1): "scan", ("a", 4): "reuse"}


def test_scan_stream_writes_each_batch(spark, tmp_path):
    seen = []
    s = events(spark, tmp_path, [[("a", 1, 0, "one\ntwo"), ("a", 2, 1, "two")], [("b", 1, 2, "three")]])
    scan = lambda df: lines_of(df.select("uri", F.col("text").alias("code")))
    documents.scan_stream(s, scan, lambda df, n: seen.extend((n, r.uri, r.line_text) for r in df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(x[1:] for x in seen) == [("a", "two"), ("b", "three")]


def test_windows_and_versions(spark, tmp_path):
    s = events(spark, tmp_path, BURSTS)
    got = run(documents.windowed_counts(s, "ts", "10 seconds", ["uri"], "1 second"), "windows")
    assert {(r.uri, r["count"]) for r in got.collect()} == {("a", 3), ("b", 1), ("c", 1)}
    results = spark.createDataFrame([("a", 1), ("a", 2)], "uri string, version long")
    assert [r.version for r in documents.newest_only(results, results).collect()] == [2]
