"""Frequency tables, cross tables, descriptive statistics and group summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.functions.columns import NULL_LABEL, as_label, col, existing, numeric_columns, to_numeric
from tabulon.functions.frames import explode_structs
from tabulon.functions.rounds import Steps, solve
from tabulon.operators.actions import levels_of
from tabulon.operators.quantiles import exact_quantiles, group_quantiles

# Columns that a wide cross table may have; the long form has no such limit.
MAX_LEVELS = 1000
AGGREGATES = ("mean", "median", "sum", "count")


def frequency(df: DataFrame, column: str, *, top_n: int = 30, null_label: str = NULL_LABEL) -> DataFrame:
    """``value, n, pct`` of the most frequent values; missing cells are a value of their own."""
    counts = df.groupBy(as_label(df, column, null_label).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()  # over the same shuffle
    return (counts.withColumn("pct", F.round(F.col("n") / total * 100, 2))
            .orderBy(F.desc("n"), "value").limit(top_n))


def crosstab_long(df: DataFrame, row: str, column: str, *, null_label: str | None = NULL_LABEL) -> DataFrame:
    """``row, col, n`` of the pairs that occur; fit for any number of levels."""
    return df.groupBy(
        as_label(df, row, null_label).alias("row"), as_label(df, column, null_label).alias("col"),
    ).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, *, max_levels: int = MAX_LEVELS) -> DataFrame:
    """One row per row level, one 0-filled count column per column level."""
    pairs = crosstab_long(df, row, column)
    (levels,) = levels_of(pairs, ["col"], max_levels)
    return (pairs.groupBy(F.col("row").alias(row)).pivot("col", levels).agg(F.sum("n"))
            .na.fill(0).orderBy(col(row)))


def descriptive(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, count, mean, std, min, q25, q50, q75, max, missing_pct, median``."""
    return solve(df, descriptive_steps(df, columns))


def descriptive_steps(df: DataFrame, columns: Sequence[str] | None = None) -> Steps:
    names = existing(df, columns) if columns else numeric_columns(df)
    if not names:
        raise AnalysisError("no_numeric_columns")
    parts = {"rows": F.count("*")}
    for i, n in enumerate(names):
        v = to_numeric(df, n)
        parts |= {f"c{i}": F.count(v), f"a{i}": F.avg(v), f"s{i}": F.stddev_samp(v), f"l{i}": F.min(v), f"h{i}": F.max(v),
                  f"n{i}": F.count(col(n))}
    wide = yield parts
    sizes = {n: wide[f"c{i}"] for i, n in enumerate(names)}
    quartiles = exact_quantiles(df, {n: [0.25, 0.5, 0.75] for n in names}, sizes=sizes)
    number = lambda x: F.lit(x).cast("double")
    rows = []
    for i, n in enumerate(names):
        missing = (wide["rows"] - wide[f"n{i}"]) / wide["rows"] * 100 if wide["rows"] else 0.0
        q25, q50, q75 = quartiles[n]
        rows.append(F.struct(
            F.lit(n).alias("column"), F.lit(wide[f"c{i}"]).cast("long").alias("count"),
            number(wide[f"a{i}"]).alias("mean"), number(wide[f"s{i}"]).alias("std"),
            number(wide[f"l{i}"]).alias("min"), number(q25).alias("q25"), number(q50).alias("q50"),
            number(q75).alias("q75"), number(wide[f"h{i}"]).alias("max"), F.round(number(missing), 2).alias("missing_pct"),
            number(q50).alias("median"),
        ))
    return explode_structs(df.sparkSession.range(1), rows)


def group_summary(df: DataFrame, group_by: str, metric: str, agg: str = "mean") -> DataFrame:
    """``group_by, metric``, highest first. An unknown ``agg`` means the mean."""
    if group_by not in df.columns or metric not in df.columns:
        raise AnalysisError("missing_columns")
    rows = df.select(as_label(df, group_by).alias("g"), to_numeric(df, metric).alias("y"))
    if agg == "median":
        result = group_quantiles(rows, "g", "y", {"result": 0.5})
    else:
        value = {"sum": F.coalesce(F.sum("y"), F.lit(0.0)), "count": F.count("y")}.get(agg, F.avg("y"))
        result = rows.groupBy("g").agg(value.alias("result"))
    return result.orderBy(F.col("result").desc_nulls_last(), "g").select(F.col("g").alias(group_by), F.col("result").alias(metric))
