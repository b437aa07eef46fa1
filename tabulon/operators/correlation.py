"""Pearson, Spearman and Kendall correlation with p-values.

Pearson needs one aggregate for all pairs. Spearman looks ranks up in rank tables of the distinct
values. Kendall counts ordered pairs by digits of the ranks, see :mod:`tabulon.operators.kendall`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col, existing, numeric_columns, numeric_view, to_numeric
from tabulon.functions.distributions import t_two_sided
from tabulon.functions.frames import small_frame
from tabulon.functions.rounds import Steps, solve
from tabulon.operators.kendall import kendall_tau
from tabulon.operators.ranking import mid_rank, running_counts, value_splits

METHODS = ("pearson", "spearman", "kendall")


def correlation_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = existing(df, columns) if columns else numeric_columns(df)
    if len(names) < 2:
        raise AnalysisError("need>=2_columns")
    return names


def pearson_parts(columns: list[tuple[Column, Column]]) -> dict[str, Column]:
    """The aggregates of each pair of columns."""
    parts = {}
    for i, (a, b) in enumerate(columns):
        both = a.isNotNull() & b.isNotNull()
        # Not F.corr: it fails on a column without spread, where r is simply missing.
        spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
        parts |= {f"r{i}": F.try_divide(F.covar_pop(a, b), spread), f"n{i}": F.count_if(both)}
    return parts


def _pearson_steps(columns: list[tuple[Column, Column]]) -> Steps:
    found = yield pearson_parts(columns)
    return [(found[f"r{i}"], found[f"n{i}"]) for i in range(len(columns))]


def _with_ranks(values: DataFrame, columns: list[str], gappy: set[str], splits: dict[str, list[float]]) -> DataFrame:
    """Rank columns of columns ``x0, x1, ...``: ``x0_all`` among all rows that have x0, ``x0_x1`` among those that have both.

    The ranks inside a pair's complete rows come from the same table of distinct values: next to the number of rows with a value it
    counts those of them that have each gappy partner, and sums both along. So each column is ranked, and joined, once. Rows meet
    the table by value; one shared by many rows makes one large join partition, which adaptive execution splits, and rows without a
    value look for a hash, so that they are spread and find nothing.
    """
    ranked = values
    for name in columns:
        partners = [p for p in columns if p in gappy and p != name]
        has = {p: f"{p}_here" for p in partners}
        rows = values.select(name, *[F.when(F.col(p).isNotNull(), 1).otherwise(0).alias(h) for p, h in has.items()])
        counts = running_counts(rows, name, measures=list(has.values()), splits=splits[name])
        table = counts.select(F.col(name).alias("value"), mid_rank().alias(f"{name}_all"),
                              *[(F.col(f"{h}_upto") - (F.col(h) - 1) / 2).alias(f"{name}_{p}") for p, h in has.items()])
        apart = F.xxhash64(*columns).cast("double") + 0.5 if name in gappy else None
        at = F.col(name) if apart is None else F.coalesce(name, apart)
        ranked = ranked.join(table, at == F.col("value"), "inner" if apart is None else "left").drop("value")
    return ranked


def _spearman(values: DataFrame, names: list[str], pairs: list[tuple[str, str]]) -> list[tuple[float | None, int]]:
    short = {c: f"x{i}" for i, c in enumerate(names)}
    values = values.select(*[col(c).alias(s) for c, s in short.items()])
    counts = values.agg(F.count("*").alias("n"), *[F.count(s).alias(s) for s in short.values()]).first()
    gappy = {s for s in short.values() if counts[s] < counts.n}
    columns = list(short.values())
    ranked = _with_ranks(values, columns, gappy, value_splits(values, columns))
    found = []
    for a, b in ((short[a], short[b]) for a, b in pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        found.append([F.when(both, F.col(f"{x}_{y}" if y in gappy else f"{x}_all")) for x, y in ((a, b), (b, a))])
    wide = ranked.select(*[c.alias(f"{side}{i}") for i, pair in enumerate(found) for side, c in zip("ab", pair)])
    return solve(wide, _pearson_steps([(F.col(f"a{i}"), F.col(f"b{i}")) for i in range(len(pairs))]))


def correlation(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """``a, b, r, n, p`` for every pair, highest r first; p is NULL below 3 complete rows."""
    return solve(df, correlation_steps(df, columns, method))


def correlation_steps(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> Steps:
    method = method.lower() if (method or "").lower() in METHODS else "pearson"
    names = correlation_columns(df, columns)
    pairs = list(combinations(names, 2))
    spark = df.sparkSession
    rows = []
    if method == "kendall":
        for a, b in pairs:
            values = df.select(to_numeric(df, a).alias("x"), to_numeric(df, b).alias("y")).dropna()
            r, n, p = kendall_tau(values)
            rows.append((a, b, r, n, p if n >= 3 else None))
    else:
        if method == "pearson":
            found = yield from _pearson_steps([(to_numeric(df, a), to_numeric(df, b)) for a, b in pairs])
        else:
            found = _spearman(numeric_view(df, names), names, pairs)
        for (a, b), (r, n) in zip(pairs, found):
            r = None if r is None or math.isnan(r) else max(-1.0, min(1.0, r))
            p = None
            if r is not None and n >= 3:
                t = math.inf if abs(r) == 1 else abs(r) * math.sqrt((n - 2) / (1 - r * r))
                p = t_two_sided(spark, t, n - 2)
            rows.append((a, b, r, n, p))
    table = small_frame(spark, rows, "a string, b string, r double, n long, p double")
    return table.orderBy(F.col("r").desc_nulls_last(), "a", "b")


def top_pairs(pairs: DataFrame, k: int = 20) -> DataFrame:
    return pairs.orderBy(F.col("r").desc_nulls_last(), "a", "b").limit(k)


def correlation_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long matrix ``a, b, r, p`` with both triangles and a diagonal of 1."""
    diagonal = small_frame(pairs.sparkSession, [(c, c, 1.0, 1.0) for c in columns],
                           "a string, b string, r double, p double")
    upper = pairs.select("a", "b", "r", "p")
    return upper.unionAll(upper.select("b", "a", "r", "p")).unionAll(diagonal)
