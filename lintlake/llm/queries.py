"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, words=4).select("doc_id", "n_shingles", "component_id", "n_copies", "n_links")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import THRESHOLD, score_quality

    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), name="score")
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, score_toxicity

    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), name="score")
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linkgraph import judge

    return judge(table(spark, sf_dir, "pages"))


def op5_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .entropy_mix import entropy_mix

    out = entropy_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pack import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, written as transcripts that miss a quarter of their markers, and parsed back into turns. Roles are learned from four of five conversations; the others are held out."""
    from .chat import as_transcript, parse

    held_out = F.coalesce(bucket_of(F.col("conv_id"), 5) == 0, F.lit(False))
    transcripts = as_transcript(table(spark, sf_dir, "conversations")).withColumn("role", F.when(~held_out, F.col("role")))
    return parse(transcripts, role="role").withColumn("held_out", held_out)


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among images drawn from all rows of embeddings, every tenth with a copy: cropped, turned, rescaled, noisy, edited or turned by a quarter."""
    from .media import copy_classes, rendered

    return copy_classes(rendered(table(spark, sf_dir, "embeddings")))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
