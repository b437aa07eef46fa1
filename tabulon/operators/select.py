"""Projections, row filters, samples and previews."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.functions.columns import as_label, col, existing, numeric_view
from tabulon.functions.frames import estimated_tasks, unused
from tabulon.operators.quantiles import order_statistics

# Above this size a sample is cut by a threshold instead of a top-n sort.
TOP_N_ROWS = 10_000
# Above this many rows arriving at the last task of a top-n, the tasks' own top-n lists are merged in between.
MERGE_ROWS = 5_000_000
MERGE_GROUPS = 1_000


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The known columns of the list, in order; all columns when none is known."""
    names = existing(df, columns)
    return df.select(*[col(n) for n in names]) if names else df


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in the given order.

    A top-n sends up to n rows of every task to one last task. For very many tasks that is too much,
    so groups of tasks agree on their first n rows before; the result is the same.
    """
    if estimated_tasks(df) * n > MERGE_ROWS:
        group, placed = unused(df, "group", "place")
        place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        df = (df.withColumn(group, F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
              .withColumn(placed, place).where(F.col(placed) <= n).drop(group, placed))
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], *, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if there are fewer), the same ones on every run.

    Rows are chosen by the hash of ``key``. Small samples are a distributed top-n; for large ones
    the n-th smallest hash is found first, and the sample becomes a filter without a sort.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[col(k) for k in key]), 12)
    if n <= TOP_N_ROWS:
        return top_n(df, [hashed, *[col(k) for k in key]], n)
    marks = df.select(hashed.cast("double").alias("h"))
    size = marks.count()
    if size <= n:
        return df
    edge = order_statistics(marks, {"h": [n - 1]}, {"h": size})["h", n - 1]
    under = marks.where(F.col("h") < edge).count()
    at_edge = df.where(hashed.cast("double") == edge).limit(n - under)
    return df.where(hashed.cast("double") < edge).unionAll(at_edge)


COPIES = 100_000


def numbered_copies(df: DataFrame, number: str) -> DataFrame:
    """The rows, with equal rows numbered from 0, so that a hash of all columns tells them apart.

    Equal rows are counted first and then dealt out again in runs of COPIES, so a row that fills a third of the table is neither
    shuffled as such nor dealt out in one task.
    """
    every, start = unused(df, "every", "start")
    runs = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias(every)).select(
        "*", F.explode(F.sequence(F.lit(0), F.col(every) - 1, F.lit(COPIES))).alias(start))
    end = F.least(F.col(start) + COPIES, F.col(every)) - 1
    dealt = runs.repartition(*[col(c) for c in df.columns], F.col(start))
    return dealt.select(*[col(c) for c in df.columns], F.explode(F.sequence(F.col(start), end)).alias(number))


def sample_of_equals(df: DataFrame, n: int, *, seed: int = 42) -> DataFrame:
    """``n`` rows of a table without a key: chosen by their values, equal rows each on their own."""
    (number,) = unused(df, "copy")
    return sample_rows(numbered_copies(df, number), n, [*df.columns, number], seed=seed).drop(number)


def preview(df: DataFrame, order_by: Sequence[str], *, n: int = 2000) -> DataFrame:
    """The first ``n`` rows as text, missing cells blank."""
    rows = top_n(df, [col(c) for c in order_by], n)
    return rows.select(*[as_label(df, c, "").alias(c) for c in df.columns])


def filter_groups(df: DataFrame, group: str, values: Iterable[str]) -> DataFrame:
    """Rows whose group, read as text, is one of the values."""
    return df.where(col(group).cast("string").isin([str(v) for v in values]))


def listwise_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric view of the columns, only rows where every one holds a number."""
    return numeric_view(df, columns).dropna()


def pairwise_complete(df: DataFrame, a: str, b: str) -> DataFrame:
    return listwise_complete(df, [a, b])


def group_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(col(column).isNotNull()).groupBy(col(column).cast("string").alias(column)).agg(
        F.count("*").alias("n"))


def top_groups(df: DataFrame, column: str, k: int = 2) -> DataFrame:
    """The ``k`` most frequent values with their counts; ties go to the smaller value."""
    return group_counts(df, column).orderBy(F.desc("n"), col(column)).limit(k)


def melt(df: DataFrame, columns: Sequence[str], *, variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long, numbers only, missing cells dropped."""
    wide = numeric_view(df, columns)
    return wide.unpivot([], list(columns), variable, value).dropna(subset=[value])


def without_nulls(columns: Iterable[Column]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & c.isNotNull()
    return condition
