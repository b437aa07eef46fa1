"""Mann-Whitney, Kruskal-Wallis and Friedman tests."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col, existing, to_numeric
from tabulon.functions.distributions import chi2_upper, normal_two_sided
from tabulon.functions.frames import small_frame
from tabulon.functions.rounds import Steps, solve
from tabulon.operators.parametric import grouped_values, two_groups
from tabulon.operators.ranking import centred_rank, running_counts
from tabulon.operators.select import without_nulls

EXACT_ROWS = 8


def rank_sums(rows: DataFrame, value: str, group: str) -> DataFrame:
    """``group, n, ranks, tie_term``: size, sum of centred ranks and share of sum(t³ - t) of each group."""
    # Ranks belong to distinct values; the (value, group) pairs meet them in a plain join, which no window holds together.
    ranks = running_counts(rows, value).select(col(value).alias("_ranked"), "ties", "upto", "total")
    pairs = rows.where(col(value).isNotNull()).groupBy(col(value), col(group)).agg(F.count("*").alias("n"))
    ranked = pairs.join(ranks, col(value) == F.col("_ranked"))
    ties = F.col("ties").cast("double")
    return ranked.groupBy(col(group)).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * centred_rank()).alias("ranks"),
        F.sum(F.col("n") * (ties * ties - 1)).alias("tie_term"))


def tail_length(u: float, na: int, nb: int) -> int:
    """Values of U that are at least as far out as this one, on one side."""
    return na * nb - math.ceil(max(u, na * nb - u)) + 1


@functools.cache
def _partition_numerator(parts: int) -> tuple[int, list[int]]:
    """L and the polynomial P with P / (1 - x^L)^(parts + 1) = 1 / ((1 - x) (1 - x) (1 - x^2) ... (1 - x^parts))."""
    period, product = math.lcm(*range(1, parts + 1)), [1]
    for i in (1, *range(1, parts + 1)):
        # (1 - x^L) / (1 - x^i): a running sum with stride i, less itself L places before.
        out = product + [0] * (period - i)
        for k in range(i, len(out)):
            out[k] += out[k - i] - (product[k - period] if 0 <= k - period < len(product) else 0)
        product = out
    return period, product


def _partitions_up_to(most: int, parts: int) -> int:
    """Partitions of all numbers 0..most into at most ``parts`` parts of any size."""
    period, numerator = _partition_numerator(parts)
    return sum(numerator[k] * math.comb((most - k) // period + parts, parts)
               for k in range(most % period, min(most + 1, len(numerator)), period)) if most >= 0 else 0


def exact_u_two_sided(u: float, na: int, nb: int) -> float:
    """Two-sided p of U without ties: twice the share of the arrangements whose U is as far out, in whole numbers.

    The arrangements with U = k are the partitions of k into at most ``small`` parts of at most ``large``, the coefficients of a
    Gaussian binomial. Its numerator, the product of (1 - x^(large + i)), has at most 2^small terms, and the partitions without a bound
    on the parts are polynomials by residue; so the work depends on the smaller group only.
    """
    small, large = sorted((na, nb))
    signs = {0: 1}
    for i in range(1, small + 1):
        for shift, sign in list(signs.items()):
            signs[shift + large + i] = signs.get(shift + large + i, 0) - sign
    last = tail_length(u, na, nb) - 1
    ways = sum(sign * _partitions_up_to(last - shift, small) for shift, sign in signs.items())
    return min(1.0, 2 * ways / math.comb(na + nb, small))


def mann_whitney(df: DataFrame, y: str, group_col: str, group_a: str | None = None, group_b: str | None = None, *,
                 null_group: str | None = None) -> DataFrame:
    """``y, group, group_a, n_a, group_b, n_b, u, p``: U of group A, two-sided p.

    Without ties and with a group of at most EXACT_ROWS values p is exact, however large the other group; else it is the normal form's.
    """
    if y not in df.columns or group_col not in df.columns:
        raise AnalysisError("missing_params")
    rows = grouped_values(df, y, group_col, null_group)
    a, b = two_groups(rows, group_a, group_b)
    sums = {r.g: r for r in rank_sums(rows.where(F.col("g").isin(a, b)), "y", "g").collect()}
    if a not in sums or b not in sums:
        raise AnalysisError("n_too_small", "a group has no values")
    na, nb = sums[a].n, sums[b].n
    n = na + nb
    u = (sums[a].ranks if na <= nb else -sums[b].ranks) + na * nb / 2  # the smaller group's sum stays exact
    tie_term = sums[a].tie_term + sums[b].tie_term
    if min(na, nb) <= EXACT_ROWS and tie_term == 0:
        p = exact_u_two_sided(u, na, nb)
    else:
        variance = na * nb / 12 * (n + 1 - tie_term / (n * (n - 1))) if n > 1 else 0.0
        z = (max(u, na * nb - u) - na * nb / 2 - 0.5) / math.sqrt(variance) if variance > 0 else math.nan
        p = min(1.0, normal_two_sided(z) if z > 0 else 1.0) if not math.isnan(z) else math.nan
    return small_frame(df.sparkSession, [(y, group_col, a, na, b, nb, u, p)],
                       "y string, group string, group_a string, n_a long, group_b string, n_b long, u double, p double")


def kruskal_wallis(df: DataFrame, y: str, group_col: str, *, null_group: str | None = None) -> DataFrame:
    """``y, group, k, n, h, p`` with tie correction, for any number of groups."""
    if y not in df.columns or group_col not in df.columns:
        raise AnalysisError("missing_params")
    rows = grouped_values(df, y, group_col, null_group)
    r = rank_sums(rows, "y", "g").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("tie_term").alias("tie_term"),
        F.sum(F.col("ranks") * F.col("ranks") / F.col("n")).alias("squares"),
    ).first()
    if r.k < 2:
        raise AnalysisError("group_levels<2")
    n = float(r.n)
    correction = 1 - r.tie_term / (n**3 - n)
    h = 12 / (n * (n + 1)) * r.squares / correction if correction > 0 else math.nan
    return small_frame(df.sparkSession, [(y, group_col, r.k, r.n, h, chi2_upper(df.sparkSession, h, r.k - 1))],
                       "y string, group string, k long, n long, h double, p double")


def friedman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``k, n, q, p`` of repeated measures. Ranks are taken inside each row, so nothing is shuffled."""
    return solve(df, friedman_steps(df, columns))


def friedman_steps(df: DataFrame, columns: Sequence[str]) -> Steps:
    names = existing(df, columns or [])
    if len(names) < 3:
        raise AnalysisError("need>=3_columns")
    k = len(names)
    values = [to_numeric(df, c) for c in names]
    complete = without_nulls(values)
    ranks, ties = {}, F.lit(0)
    for i, v in enumerate(values):
        # Mid-rank in the row (values below, plus half of the equal ones), minus the mean rank.
        below = sum((F.when(o < v, 1).otherwise(0) for o in values), F.lit(0))
        equal = sum((F.when(o == v, 1).otherwise(0) for o in values), F.lit(0))
        ranks[f"r{i}"] = F.sum(F.when(complete, below + (equal - k) / 2))
        ties = ties + equal * equal - 1
    r = yield {"n": F.count_if(complete), "tie_term": F.sum(F.when(complete, ties)), **ranks}
    n = r["n"]
    if not n:
        raise AnalysisError("n_too_small", "no complete row")
    squares = math.fsum(r[f"r{i}"] ** 2 for i in range(k))
    correction = 1 - r["tie_term"] / (n * k * (k * k - 1))
    q = 12 / (n * k * (k + 1)) * squares / correction if correction > 0 else math.nan
    return small_frame(df.sparkSession, [(k, n, q, chi2_upper(df.sparkSession, q, k - 1))],
                       "k long, n long, q double, p double")
