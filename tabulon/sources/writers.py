"""Writers, and the folder for intermediate tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise AnalysisError("no_shared_folder", "set spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tabulon-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written below the shared folder and read back: computed once, whatever is lost later."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with header lines, written by the tasks that hold the rows."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, job: str) -> tuple[dict[str, str], dict[str, int]]:
    """Each table of a job to ``<folder>/data/<job>_table_<i>.csv``; returns the path and the rows, counted on the way, by table name."""
    paths, sizes = {}, {}
    for i, (name, table) in enumerate(tables.items(), start=1):
        seen = Observation()
        paths[name] = f"{folder.rstrip('/')}/data/{job}_table_{i}.csv"
        write_csv(table.observe(seen, F.count(F.lit(1)).alias("n")), paths[name])
        sizes[name] = seen.get["n"]
    return paths, sizes


def write_json_document(spark: SparkSession, document: Any, path: str) -> None:
    """One small JSON document, through Spark so that any file system works."""
    text = json.dumps(document, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> Any:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, whichever it is, and the path in it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, place = _hadoop(spark, path)
    return files.exists(place)


def delete_folder(spark: SparkSession, path: str) -> None:
    files, place = _hadoop(spark, path)
    files.delete(place, True)
