"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of documents is reduced to one row per digest
(partial aggregation, so that a text that fills a third of the batch sends one row per task), the digests that
the index does not hold yet are found by a sort-merge anti-join without moving the index, and are appended along with the name of the batch.

A batch may be lost between the append and the use of its decisions, and be given again: digests that the same batch brought do not count
as known, and are not appended twice, so a repeated batch decides as before.

Defined results: a null text counts as empty; empty texts equal each other. Of equal texts the smallest id
stays; null ids come last; of rows that repeat both text and id one stays. A text that an earlier batch brought is not
kept again, its ``keep_id`` is the earlier one. An empty table gives an empty result. Other columns are not
read, whatever their names. Everything runs on DataFrame operations.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.shared import shared_folder, written


def normalised(text: Column) -> Column:
    """Null as empty, and each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """Digests seen so far, in a table bucketed and sorted by ``digest`` with the id that each one keeps."""

    def __init__(self, spark: SparkSession, table: str, folder: str | None = None, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.folder = folder or shared_folder(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, digests: DataFrame) -> None:
        """Add rows (digest, keep_id, batch); each bucket is written by one task."""
        (digests.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.mode("append").format("parquet").option("path", self.folder)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))

    def drop(self) -> None:
        """Forget the table; its files stay in its folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def deduplicate(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text",
                    tag_col: str | None = None) -> DataFrame:
        """Decide about every row and add the new digests to the index.

        Returns (doc_id, keep_id, group_size, kept, text_sha256): ``group_size`` counts equal rows of this batch. With ``tag_col`` that
        column is returned too, as ``tag``. ``batch`` names these documents: the same ones must come under the same name.
        """
        tags = [F.col(f"`{tag_col}`").alias("tag")] if tag_col else []
        rows = written(docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"), *tags))
        best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
        groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
            "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
        if self.exists():
            known = self.read().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
            groups = groups.join(known.hint("merge"), "digest", "left")
        else:
            groups = groups.withColumns({"known_id": F.lit(None).cast(rows.schema["doc_id"].dataType),
                                         "known": F.lit(None).cast("boolean")})
        groups = written(groups)
        fresh = groups.select("digest", "keep_id", F.lit(batch).alias("batch"))
        if self.exists():
            fresh = fresh.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self.append(fresh)
        known = F.coalesce("known", F.lit(False))
        return rows.join(groups, "digest").select(
            "doc_id",
            F.when(known, F.col("known_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            "group_size",
            (~known & (F.col("row") == F.col("keep_row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"), *(["tag"] if tag_col else []))


def deduplicate_in_batches(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text",
                           tag_col: str | None = None) -> DataFrame:
    """The decisions about a whole table that comes in batches of ascending ids, each checked against the index of those before it.

    Since ids ascend, the first batch that brings a text brings its smallest id. ``group_size`` counts equal rows of the whole table.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    key = F.col(f"`{id_col}`")
    # Any boundaries give the same result; these share the rows out evenly.
    edges = sorted(set(docs.agg(F.percentile_approx(key, [i / batches for i in range(1, batches)], 1_000)).first()[0] or []))
    try:
        parts = []
        for i, (low, high) in enumerate(zip([None, *edges], [*edges, None])):
            within = (F.lit(True) if low is None else F.coalesce(key > low, F.lit(True))) & (
                F.lit(True) if high is None else F.coalesce(key <= high, F.lit(False)))  # null ids come last
            parts.append(written(index.deduplicate(docs.where(within), f"part {i}", id_col, text_col, tag_col)))
    finally:
        index.drop()
    found = functools.reduce(DataFrame.unionByName, parts)
    sizes = found.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    return found.drop("group_size").join(sizes, "text_sha256").select(*found.columns)
