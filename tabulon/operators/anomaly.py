"""Outliers, rule checks and spikes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col, to_numeric
from tabulon.functions.frames import explode_structs, small_frame
from tabulon.operators.kpi import kpi_dau
from tabulon.operators.quantiles import exact_quantiles

FENCE = 1.5


def iqr_fences(df: DataFrame, columns: Sequence[str], extra: Sequence[float] = ()) -> dict[str, tuple]:
    """``(low, high, *extra quantiles)`` of each column that holds numbers."""
    fences = {}
    for name, (q1, q3, *rest) in exact_quantiles(df, {c: [0.25, 0.75, *extra] for c in columns}).items():
        if q1 is not None:
            fences[name] = (q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1), *rest)
    return fences


def anomaly_iqr(df: DataFrame, columns: Sequence[str], key: Sequence[str], top_n: int = 10) -> DataFrame:
    """``column, <key>, value, distance``: the values farthest outside the quartile fences, per column.

    Spark keeps only the first ``top_n`` rows of each column in every task before the shuffle.
    """
    fences = iqr_fences(df, columns)
    if not fences:
        raise AnalysisError("no_numeric_columns")
    cells = []
    for name, (low, high) in fences.items():
        v = to_numeric(df, name)
        cells.append(F.when(~v.between(low, high), F.struct(
            F.lit(name).alias("column"), v.alias("value"),
            F.greatest(F.lit(low) - v, v - F.lit(high)).alias("distance"))))
    keys = [col(k) for k in key]
    far = df.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*keys, "c.*")
    order = Window.partitionBy("column").orderBy(F.desc("distance"), *keys, "value")
    return far.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top_n).select(
        "column", *keys, "value", "distance")


def anomaly_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """All rows whose value lies more than ``threshold`` sample deviations from the mean, with ``z``."""
    v = to_numeric(df, column)
    r = df.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).first()
    z = (v - F.lit(r["mean"]).cast("double")) / F.lit(r.sd or None).cast("double")
    return df.withColumn("z", z).where(F.abs("z") > threshold)


def rule_conditions(df: DataFrame, columns: dict[str, str]) -> dict[str, Column]:
    """The named checks that the given column roles allow.

    Roles: amount, quantity, ratio, impressions, clicks, conversions, revenue, cost.
    """
    v = {role: to_numeric(df, name) for role, name in columns.items()}
    margin = F.try_divide(v["revenue"] - v["cost"], v["revenue"]) if {"revenue", "cost"} <= v.keys() else None
    checks = {
        "negative_amount": ("amount",), "negative_quantity": ("quantity",),
        "zero_amount_with_quantity": ("amount", "quantity"), "ratio_above_one": ("ratio",),
        "clicks_above_impressions": ("clicks", "impressions"), "conversions_above_clicks": ("conversions", "clicks"),
        "margin_out_of_range": ("revenue", "cost"),
    }
    tests = {
        "negative_amount": lambda: v["amount"] < 0,
        "negative_quantity": lambda: v["quantity"] < 0,
        "zero_amount_with_quantity": lambda: (v["amount"] == 0) & (v["quantity"] > 0),
        "ratio_above_one": lambda: v["ratio"] > 1,
        "clicks_above_impressions": lambda: v["clicks"] > v["impressions"],
        "conversions_above_clicks": lambda: v["conversions"] > v["clicks"],
        "margin_out_of_range": lambda: (margin > 1) | (margin < -1),
    }
    return {name: tests[name]() for name, roles in checks.items() if set(roles) <= v.keys()}


def anomaly_rules(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rule, n_flagged`` of every applicable check, in one pass."""
    rules = rule_conditions(df, columns)
    if not rules:
        raise AnalysisError("missing_columns")
    wide = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return explode_structs(wide, [
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n_flagged")) for i, name in enumerate(rules)])


def flagged_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules in ``rules``."""
    rules = rule_conditions(df, columns)
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.withColumn("rules", broken).where(F.size("rules") > 0)


def anomaly_dau_spike(df: DataFrame, time: str, user_id: str, sigmas: float = 3.0) -> DataFrame:
    """``period, users, low, high``: days whose user count leaves mean ± ``sigmas`` deviations."""
    daily = kpi_dau(df, time, user_id).where(F.col("period").isNotNull())
    r = daily.agg(F.avg("users").alias("mean"), F.stddev_samp("users").alias("sd")).first()
    if r.sd is None:
        return daily.select("period", "users", F.lit(None).cast("double").alias("low"),
                            F.lit(None).cast("double").alias("high")).where(F.lit(False))
    low, high = r["mean"] - sigmas * r.sd, r["mean"] + sigmas * r.sd
    return daily.where(~F.col("users").between(low, high)).select(
        "period", "users", F.lit(low).alias("low"), F.lit(high).alias("high"))


def anomaly_long_tail(df: DataFrame, column: str) -> DataFrame:
    """``column, low, high, p95, p99, n_outside, n_above_p95, n_above_p99``."""
    fences = iqr_fences(df, [column], (0.95, 0.99))
    if not fences:
        raise AnalysisError("no_numeric_columns")
    low, high, p95, p99 = fences[column]
    v = to_numeric(df, column)
    r = df.agg(F.count_if(~v.between(low, high)), F.count_if(v > p95), F.count_if(v > p99)).first()
    return small_frame(df.sparkSession, [(column, low, high, p95, p99, *r)],
                       "column string, low double, high double, p95 double, p99 double, "
                       "n_outside long, n_above_p95 long, n_above_p99 long")
