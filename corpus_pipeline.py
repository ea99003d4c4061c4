"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what it returns is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

All stages take null ids, texts and sources, empty and very long texts, repeated rows and ids, empty tables, and further columns of any name, which pass
through to the last stage untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import materialise, table
from lintlake.llm.entropy_mix import mixed
from lintlake.llm.jaccard_join import jaccard_classes
from lintlake.llm.pack import pack_documents
from lintlake.llm.quality import THRESHOLD as GOOD
from lintlake.llm.quality import score_quality
from lintlake.llm.toxicity import THRESHOLD as TOXIC
from lintlake.llm.toxicity import score_toxicity


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be none of the columns."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; documents that it calls toxic go. Null and empty texts score as texts without words; rows that share an id are judged each by its text."""
    name = free_name(docs, "toxicity")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), name=name)
    return scored.where(F.col(name) < TOXIC).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; documents that it calls bad go. Null and empty texts score as no bytes; rows that share an id are judged each by its text."""
    name = free_name(docs, "quality")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), name=name)
    return scored.where(F.col(name) >= GOOD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on five words and a similarity of 0.8; of each group of linked rows one with the smallest id stays (a null id only if there is no other).

    Rows are told apart by their place, so different texts under one id are different documents, and of rows that are equal one stays.
    Null and empty texts have no links and stay, each row.
    """
    row = free_name(docs, "row")
    placed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "stage-rows")
    classes = jaccard_classes(placed, percent=80, words=5, key=row, count_links=False).select(F.col(row).alias("r"), "component_id")
    ids = placed.select(F.col(row).alias("r"), F.col("doc_id").alias("id"))
    first = classes.join(ids, "r").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "r")).alias("first"))
    return placed.join(first.select(F.col("first.r").alias(row)), row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6; each document comes as often as its copies say. Null and empty texts take no words; a null source is a source."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; pieces with their sequences and places. Null and empty texts hold the end id alone."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", one_of_each_group),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned scores decide what stays, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
