"""Small helpers around DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def small_frame(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A result table whose size is bounded by the number of columns, tests or jobs."""
    return spark.createDataFrame(list(rows), schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until no column of the table is called so; for columns that exist only inside a plan."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def explode_structs(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One row per struct expression: turns a one-row wide aggregate into a long table."""
    return df.select(F.inline(F.array(*structs)))


# Tables up to this size are dealt out over all cores before passes that repeat many times.
SPREAD_ROWS = 5_000_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The rows over all cores, if they are few enough to have been read as fewer partitions.

    A large table has partitions enough and is left alone; the size comes from the caller, because
    asking a DataFrame for its partitions would run its shuffles.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if rows <= SPREAD_ROWS else df


def estimated_tasks(df: DataFrame) -> int:
    """Tasks that reading this plan would take, by the optimizer's size estimate; runs nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 + size // (128 << 20)


def in_batches(items: list, size: int) -> Iterable[list]:
    for start in range(0, len(items), size):
        yield items[start:start + size]
