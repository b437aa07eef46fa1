"""Packing of documents into training sequences by the sum-of-squares rule.

A bin of the rule is a sequence; its gap is the room left. Each piece goes where the sum over all gaps of the squared
number of open bins with that gap becomes smallest (a new bin counts like any other place; of equal places the fullest wins),
pieces taken from the longest to the shortest.

Pieces are dealt by hash to shards of a bounded number of pieces; each shard is packed in one task over small rows. The bins
that stay open are few; their pieces meet again in larger rounds, each of which joins many shards' open bins and packs them anew,
until one last shard is left or nothing is gained. So the waste is that of one small group, not of each shard, and no task sees more than a
shard.

Defined results: a null or empty text is one end mark. Only documents longer than a sequence are cut, into full pieces after a first
one that may be shorter. Repeated rows, null ids and ties are packed like other rows. An empty table gives no rows. Of the
input only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.shared import written
from tabulon.llm.tokens import encoded, read_tokenizer

SEQUENCE = 2048
SHARD_PIECES = 8192
OPEN_SHARE = 16  # a bin with a gap above 1/16 of a sequence is packed again in the next round


def pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shipped = read_tokenizer(docs.sparkSession, tokenizer)
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, sizes in encoded(batches, shipped.value, end_id):
            n = -(-sizes // length)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = sizes - (n - 1) * length  # of a document cut, the first piece takes the odd rest
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * length)
            size = np.where(piece == 0, first[row], length)
            base = (np.cumsum(sizes) - sizes)[row] + start
            raw = [ids[a:a + k].tobytes() for a, k in zip(base.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                 *([pa.array(raw, pa.binary())] if with_ids else [])], schema.names)

    return rows.mapInArrow(cut, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the given order, by the sum-of-squares rule."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by fill; full bins and empty ones do not count
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        # Moving one bin from fill f to f + size changes the sum of squares by 2 (count[f + size] - count[f]) + 2.
        fits = count[:capacity - size + 1]
        after = 2 * count[size:] + 1
        after[-1] = 0
        change = np.where(fits > 0, after - 2 * fits + 1, np.iinfo(np.int64).max)
        change[0] = after[0]
        fill = len(change) - 1 - int(np.argmin(change[::-1]))
        if fill:
            b = open_bins[fill].pop()
            count[fill] -= 1
        else:
            b, made = made, made + 1
        bins[i], offsets[i] = b, fill
        if fill + size < capacity:
            open_bins[fill + size].append(b)
            count[fill + size] += 1
    return bins, offsets


def _shard_packer(capacity: int, level: int):
    """A function that packs the pieces of one shard."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        return _packed_shard(rows, capacity, level)

    return packed


def _packed_shard(rows: pd.DataFrame, capacity: int, level: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable", ignore_index=True)
    bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
    fill = np.bincount(bins, rows["length"].to_numpy())
    shard = int(rows["shard"].iloc[0])
    return rows[["row"]].assign(
        length=rows["length"], sequence_id=(np.int64(level) << 58) | (np.int64(shard) << 24) | bins, offset=offsets,
        gap=capacity - fill[bins].astype(np.int64))


def pack(pieces_: DataFrame, capacity: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces, which must be a written table with the columns length and row (unique)."""
    schema = "row long, length long, sequence_id long, offset long, gap long"
    waiting, level, closed = pieces_.select("row", "length"), 0, []
    total = waiting.count()
    while total:
        shards = max(1, -(-total // shard_pieces))
        dealt = waiting.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
        packed = written(dealt.groupBy("shard").applyInPandas(_shard_packer(capacity, level), schema))
        left = packed.where(F.col("gap") > capacity // OPEN_SHARE).select("row", "length")
        remaining = left.count() if shards > 1 else 0
        if shards == 1 or remaining >= total * 0.9:
            closed.append(packed)
            break
        closed.append(packed.where(F.col("gap") <= capacity // OPEN_SHARE))
        waiting, total, level = left, remaining, level + 1
    if not closed:
        return pieces_.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    placed = closed[0]
    for more in closed[1:]:
        placed = placed.unionByName(more)
    return pieces_.join(placed.select("row", "sequence_id", "offset"), "row")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    cut = written(pieces(docs, tokenizer, length, end_id, id_col, text_col, with_ids).withColumn(
        "row", F.monotonically_increasing_id()))
    return pack(cut, length).drop("row")
