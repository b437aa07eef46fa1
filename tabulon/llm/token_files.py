"""Token files: ids ranked by frequency, in byte-aligned variable-length code with separate control bytes.

All documents are encoded once into a staging table. The ids are counted (one histogram per task, summed over tasks; as long as the
vocabulary) and ranked, the most frequent id first, so that frequent ids take one byte. The documents are then range partitioned
and sorted by id and written in blocks of bounded length. A block holds the ids of its documents, the length of each
document, a string of control bytes (two bits per id: its number of bytes less one, four ids to a byte) and the data bytes. A
table lookup by control byte gives the offsets of its four ids, so a whole block decodes in a few numpy operations.

A block is a row of a Parquet table, because Spark's writers reach any store and commit only whole tasks; ``part`` and ``block``
give the order, ``before`` the ids of the part before a block, and the ranks are a table beside it.

Defined results: a null or empty text is one end mark. Order is by id, null ids first, rows that repeat an id in the
order of their ids' number and checksum. A document longer than a block makes a block of its own. An empty table gives empty files.
Of the input only the id and text columns are read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.shared import shared_folder, ship, written
from tabulon.llm.tokens import encoded, read_tokenizer

BLOCK_TOKENS = 1 << 18
# What is left of four bytes by the number of those that count.
LOW_BYTES = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


@functools.cache
def control_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each control byte the byte lengths of its four ids, and their sum."""
    control = np.arange(256)
    sizes = np.stack([(control >> shift & 3) + 1 for shift in (0, 2, 4, 6)], axis=1)
    return sizes, sizes.sum(axis=1)


def pack_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values; the last control byte is padded with zeros of one byte."""
    padded = np.zeros(-(-len(values) // 4) * 4, "<u4")
    padded[:len(values)] = values
    extra = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = (extra.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= extra[:, None]
    return control.tobytes(), padded.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of ``pack_ids``."""
    sizes, sums = control_tables()
    codes = np.frombuffer(control, np.uint8)
    size = sizes[codes]
    start = (np.cumsum(sums[codes]) - sums[codes])[:, None] + np.cumsum(size, axis=1) - size
    raw = data + bytes(3)
    words = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))  # the four bytes from each place on
    return words[start.ravel()[:n]] & LOW_BYTES[size.ravel()[:n]]


def _staged(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shipped = read_tokenizer(docs.sparkSession, tokenizer)
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("crc", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, sizes in encoded(batches, shipped.value, end_id):
            ends = np.cumsum(sizes)
            raw = [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                 pa.array([_narrow(x) for x in raw], pa.binary())], schema.names)

    return rows.mapInArrow(encode, schema)


def _narrow(raw: bytes) -> bytes:
    """Ids for the staging table: two bytes each if all fit, else four, told apart by a leading byte."""
    ids = np.frombuffer(raw, "<u4")
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + raw


def _wide(staged: bytes) -> np.ndarray:
    return np.frombuffer(staged, "<u2" if staged[:1] == b"\2" else "<u4", offset=1).astype(np.uint32)


def _frequencies(staged: DataFrame) -> DataFrame:
    """(token, n) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(1, np.int64), [], 0

        def added(total: np.ndarray, waiting: list[np.ndarray]) -> np.ndarray:
            n = np.bincount(np.concatenate([*waiting, np.zeros(0, np.uint32)]).astype(np.int64), minlength=len(total))
            n[:len(total)] += total
            return n

        for batch in batches:
            for row in batch.column("ids").to_pylist():
                waiting.append(_wide(row))
                size += len(waiting[-1])
                if size > BLOCK_TOKENS:
                    total, waiting, size = added(total, waiting), [], 0
        total = added(total, waiting)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    return staged.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
                      text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Write ``folder/ranks`` and ``folder/blocks``."""
    spark = docs.sparkSession
    staged = written(_staged(docs, tokenizer, end_id, id_col, text_col))
    # One row per id of the vocabulary: bounded by the tokenizer, whatever the size of the corpus.
    ranked = _frequencies(staged).orderBy(F.desc("n"), "token").collect()
    spark.createDataFrame([(r, row.token, row.n) for r, row in enumerate(ranked)], "rank long, token long, n long").coalesce(1) \
        .write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max((row.token for row in ranked), default=0) + 1, np.uint32)
    rank_of[[row.token for row in ranked]] = np.arange(len(ranked), dtype=np.uint32)
    shipped = spark.sparkContext.broadcast(rank_of)
    id_type = staged.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("before", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, waiting, tokens = TaskContext.get().partitionId(), 0, 0, [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate([shipped.value[x] for _, x in waiting])
            control, data = pack_ids(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([[d for d, _ in waiting]], pa.list_(ids_type)), pa.array([[len(x) for _, x in waiting]], pa.list_(pa.int64())),
                pa.array([control], pa.binary()), pa.array([data], pa.binary())], schema.names)

        for batch in batches:
            ids_type = batch.schema.field("doc_id").type
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids = _wide(raw)
                if waiting and tokens + len(ids) > block_tokens:
                    yield row()
                    block, before, waiting, tokens = block + 1, before + tokens, [], 0
                waiting.append((doc, ids))
                tokens += len(ids)
        if waiting:
            yield row()

    order = ["doc_id", "n_tokens", "crc"]
    (staged.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
     .mapInArrow(pack, schema).write.option("compression", "zstd").parquet(f"{folder}/blocks"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ``start`` counts the ids before it in the files."""
    ship(spark)
    blocks = spark.read.parquet(f"{folder}/blocks")
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("token").collect()
    token_of = spark.sparkContext.broadcast(np.array([r.token for r in ranks], np.uint32))
    # A block knows the ids before it in its part; the parts' totals, one row per written file, give the rest.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, before = {}, 0
    for row in parts:
        starts[row.part] = before
        before += row.n
    shipped = spark.sparkContext.broadcast(starts)
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, n, doc_ids, lengths, control, data = (batch.column(k)[i] for k in range(7))
                ids = token_of.value[unpack_ids(control.as_py(), data.as_py(), n.as_py())].astype("<u4")
                sizes = lengths.values.to_numpy()
                ends = np.cumsum(sizes)
                first = ends - sizes
                raw = [ids[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(first + shipped.value[part.as_py()] + before.as_py(), pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())], schema.names)

    return blocks.select("part", "before", "n_tokens", "doc_ids", "lengths", "control", "data").mapInArrow(unpack, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write token files of all documents below the shared folder and read them back."""
    folder = shared_folder(docs.sparkSession)
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder)
