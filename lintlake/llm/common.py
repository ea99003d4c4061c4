"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that goes to Python, about. Texts differ in length by orders of magnitude, so a count of rows bounds nothing.
BATCH_BYTES = 8 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Smaller batches to Python than Spark's own 64 MB, of which a worker holds several forms at once; what a session has set itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 * 1024 * 1024):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, or, where none is set and all runs on this machine, a new one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and spark.sparkContext.getCheckpointDir():
        there = spark.sparkContext.getCheckpointDir()
    if not there and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not there:
        there = "file://" + tempfile.mkdtemp(prefix="lintlake-")
        spark.sparkContext.setCheckpointDir(there)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def materialise(df: DataFrame, name: str = "step", files: int | None = None, by: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: its lineage ends there and lost executors cost nothing.

    files: at most so many. Small tables out of many partitions cost more in files than in rows; each file starts several processes on a local disk.
    by: a column whose values have files of their own, so that one of them is read without the others.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/lintlake/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables from materialise(), which nothing that is still to run may read."""
    for df in tables:
        if where := getattr(df, "written_to", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Shuffle files of what is done go when the driver's references go; rounds of many small jobs don't wait for the heap to fill."""
    gc.collect()
    spark._jvm.System.gc()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n: the fold of a labelled row."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n)).cast("int")
