"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Null texts, empty texts, repeated rows and empty tables pass through every stage as its operator defines; columns
beyond those of documents are dropped by the stages that rebuild rows. Each stage bounds the bytes of the session's
Arrow batches, so that the memory of a task does not follow the length of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, table, written
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.minhash import drop_near_duplicates
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.quality_classifier import classify_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    bound_batches(spark)
    return classify_quality(docs, table(spark, sf_dir, "labels")).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks that an earlier document holds; a document that loses all its words goes."""
    bound_batches(spark)
    left = dedup_lines(docs).filter(r"removed_lines = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    return left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles at similarity 0.8."""
    bound_batches(spark)
    return drop_near_duplicates(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it."""
    bound_batches(spark)
    mixed = mix_sources(docs).filter("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    bound_batches(spark)
    return pack_documents(docs, "word_bpe_49k.json", end_id=2)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), "pipeline-pack")
