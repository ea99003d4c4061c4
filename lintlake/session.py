"""Sessions and table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lintlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the plans are written for; what is given overrides them, and a running session is kept."""
    builder = SparkSession.builder.appName(name).config(
        map={
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
        }
        | conf
    )
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
