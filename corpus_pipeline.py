"""From raw documents to packed training sequences: five stages, each written before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import language, near_texts, quality
from tabulon.llm.exact_dedup import deduplicate_in_batches
from tabulon.llm.packing import pack_documents
from tabulon.llm.shared import unused, written

MIN_LANGUAGE_SCORE = 0.5
MIN_QUALITY_SCORE = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of at least MIN_LANGUAGE_SCORE."""
    (found,) = unused(docs, "found")
    return language.identified(docs, out=found).where(
        (F.col(f"{found}.lang") != "und") & (F.col(f"{found}.score") >= MIN_LANGUAGE_SCORE)).drop(found)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least MIN_QUALITY_SCORE."""
    (score,) = unused(docs, "score")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(docs, labels, out=score).where(F.col(score) >= MIN_QUALITY_SCORE).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id."""
    rows, row = _numbered(docs)
    found = deduplicate_in_batches(rows.select("doc_id", "text", F.col(row).alias("tag")), tag_col="tag")
    return _without(docs, rows, row, found.where(~F.col("kept")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of at least 0.8): the one with the smallest id."""
    rows, row = _numbered(docs)
    found = written(near_texts.near_duplicates(rows, tag_col=row))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag"))
    kept = found.groupBy("component").agg(first.alias("first")).select(F.col("first.tag").alias("tag"))
    return _without(docs, rows, row, found.join(kept, "tag", "left_anti"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their training sequence and place."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number per row, stored: numbers of two readings may differ, as files are cut by the cores at hand."""
    (row,) = unused(docs, "row")
    return written(docs.withColumn(row, F.monotonically_increasing_id())), row


def _without(docs: DataFrame, rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The documents but the dropped ones: these are few and narrow, so Spark may see that they can be broadcast."""
    return rows.join(written(dropped.select(F.col("tag").alias(row))), row, "left_anti").select(*(f"`{c}`" for c in docs.columns))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None  # three of the five stages cannot be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
