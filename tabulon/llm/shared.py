"""What several training-data operators need: shared storage, bounded batches, column names, held-out rows."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that a Python worker turns into arrays at a time; longer texts are taken in windows.
BATCH_CHARS = 1_000_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: sends it along once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp()  # the driver serves the archive from here as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(package, f"{folder}/files/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}-{uuid.uuid4().hex[:8]}", "zip", f"{folder}/files"))
        _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors see.

    Only a local session (tests) may lack the setting; it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"tabulon-{os.getpid()}")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The table written as Parquet and read back: ends its lineage and is computed once."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores added until no column of the table is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True for ids whose CRC-32 (of the id as text) leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def text_slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BATCH_CHARS characters each; a longer text is a range of its own."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > BATCH_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut by the length of their texts, each with its texts (null: empty)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        for start, end in text_slices(texts):
            yield batch.slice(start, end - start), texts[start:end]
