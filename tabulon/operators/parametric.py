"""Normality, t, variance and chi-square tests.

Each test reads the table through one or two aggregates; the handful of sufficient statistics
that reaches the driver is turned into a statistic and a p-value there.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.functions.columns import as_label, col, to_numeric
from tabulon.functions.distributions import (
    NORMAL, chi2_upper, f_upper, normal_upper, t_two_sided,
)
from tabulon.functions.frames import small_frame
from tabulon.functions.rounds import Steps, solve
from tabulon.operators.describe import crosstab_long
from tabulon.operators.ranking import running_counts
from tabulon.operators.select import top_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

SHAPIRO_ROWS = 5000
ALPHA = 0.05


def _need(df: DataFrame, columns: Sequence[str], code: str = "missing_column") -> None:
    gone = [c for c in columns if c is None or c not in df.columns]
    if gone:
        raise AnalysisError(code, ", ".join(map(str, gone)))


def jarque_bera(n: int, skew: float, excess: float) -> tuple[float, float]:
    stat = n / 6 * (skew**2 + excess**2 / 4)
    return stat, math.exp(-stat / 2)


def dagostino_pearson(n: int, skew: float, excess: float) -> tuple[float, float]:
    """Omnibus K² of D'Agostino and Pearson from population skewness and excess kurtosis."""
    if n < 8:
        raise AnalysisError("n_too_small", "the omnibus test needs at least 8 values")
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    z_skew = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))

    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (excess + 3 - expected) / math.sqrt(variance)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    ratio = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z_kurt = (1 - 2 / (9 * a) - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(2 / (9 * a))
    stat = z_skew**2 + z_kurt**2
    return stat, math.exp(-stat / 2)


def _horner(coefficients: Sequence[float], x: float) -> float:
    total = 0.0
    for c in coefficients:
        total = total * x + c
    return total


# The rational approximations of the normal quantile, for the middle and for the two depths of the tail, lowest power first.
MIDDLE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
           4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
          (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
           2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
TAIL = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
         1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
         1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
FAR_TAIL = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
             2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
            (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
             7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def normal_score(p: Column) -> Column:
    """The standard normal quantile of a column of probabilities between 0 and 1."""

    def ratio(powers: tuple, x: Column) -> Column:
        top, bottom = (_horner(coefficients[::-1], x) for coefficients in powers)
        return top / bottom

    centred = p - 0.5
    depth = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(depth <= 5, ratio(TAIL, depth - 1.6)).otherwise(ratio(FAR_TAIL, depth - 5.0))
    return F.when(F.abs(centred) <= 0.425, centred * ratio(MIDDLE, 0.180625 - centred * centred)).otherwise(F.signum(centred) * tail)


def normal_scores(p: np.ndarray) -> np.ndarray:
    """``normal_score`` of an array, many times faster than the column's expression."""

    def ratio(powers: tuple, x: np.ndarray) -> np.ndarray:
        top, bottom = (_horner(coefficients[::-1], x) for coefficients in powers)
        return top / bottom

    centred = p - 0.5
    out = centred * ratio(MIDDLE, 0.180625 - centred * centred)
    outside = np.flatnonzero(np.abs(centred) > 0.425)
    depth = np.sqrt(-np.log(np.minimum(p[outside], 1 - p[outside])))
    tail = np.where(depth <= 5, ratio(TAIL, depth - 1.6), ratio(FAR_TAIL, depth - 5.0))
    out[outside] = np.sign(centred[outside]) * tail
    return out


# Ranks that a task scores at a time.
SCORED_RANKS = 65_536


def _sum_of_squares(spark: SparkSession, n: int) -> float:
    """Of the normal scores of the ranks 1 to n: twice that of the lower half, the middle one is 0."""
    half, step = n // 2, SCORED_RANKS

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = 0.0
            for piece in batch.column(0).to_pylist():
                score = normal_scores((np.arange(piece * step + 1, min(half, (piece + 1) * step) + 1) - 0.375) / (n + 0.25))
                total += float((score * score).sum())
            yield pa.RecordBatch.from_pydict({"s": [total]})

    return 2 * (spark.range(-(-half // step)).mapInArrow(squares, "s double").agg(F.sum("s")).first()[0] or 0.0)


def _weighted_sum(counts: DataFrame, n: int, mean: float, inner: float, outer: Sequence[float]) -> float:
    """Sum of weight times value over all ranks of ``x, n, upto``; the ranks of a value that has many are scored piece by piece."""
    step = SCORED_RANKS

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size, upto = (batch.column(c).to_numpy() for c in range(3))
            ends, total = np.cumsum(size), 0.0
            for at in range(0, int(ends[-1]) if len(ends) else 0, step):
                place = np.arange(at, min(at + step, int(ends[-1])))
                row = np.searchsorted(ends, place, side="right")
                rank = upto[row] - (ends[row] - 1 - place)
                weight = normal_scores((rank - 0.375) / (n + 0.25)) * inner
                for k, a in enumerate(outer):
                    weight[rank == n - k], weight[rank == k + 1] = a, -a
                total += float((weight * (x[row] - mean)).sum())
            yield pa.RecordBatch.from_pydict({"s": [total]})

    return counts.select("x", "n", "upto").mapInArrow(summed, "s double").agg(F.sum("s")).first()[0]


def shapiro_wilk(values: DataFrame, n: int, mean: float, variance: float) -> tuple[float, float]:
    """W and p of Royston's 1995 approximation over all values of a column ``x``, which are neither collected nor sorted in one task.

    The weights of the ordered values come from the normal scores of their ranks. Equal values are one row of the running counts.
    """
    if n < 3 or not variance:
        return (1.0, 1.0) if n >= 3 else (math.nan, math.nan)
    spark, spread = values.sparkSession, variance * n
    score = lambda i: NORMAL.inv_cdf((i - 0.375) / (n + 0.25))
    if n == 3:
        inner, outer = 0.0, [math.sqrt(0.5)]
    else:
        squares = _sum_of_squares(spark, n)
        u = 1 / math.sqrt(n)
        # Royston's polynomials for the outermost weights.
        last = _horner((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, score(n) / math.sqrt(squares)), u)
        outer = [last]
        if n > 5:
            outer.append(_horner((-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, score(n - 1) / math.sqrt(squares)), u))
        phi = (squares - 2 * sum(score(n - i) ** 2 for i in range(len(outer)))) / (1 - 2 * sum(a * a for a in outer))
        inner = 1 / math.sqrt(phi)
    total = _weighted_sum(running_counts(values, "x"), n, mean, inner, outer)  # the weights add up to nothing
    w = min(1.0, total ** 2 / spread)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    if w == 1.0:
        return w, 1.0
    # Royston's normalising polynomials.
    if n <= 11:
        gamma = 0.459 * n - 2.273
        log_tail = math.log(1 - w)
        if log_tail >= gamma:
            return w, 0.0
        y = -math.log(gamma - log_tail)
        mu = _horner((-0.0006714, 0.025054, -0.39978, 0.5440), n)
        sigma = math.exp(_horner((-0.0020322, 0.062767, -0.77857, 1.3822), n))
    else:
        size = math.log(n)
        y = math.log(1 - w)
        mu = _horner((0.0038915, -0.083751, -0.31082, -1.5861), size)
        sigma = math.exp(_horner((0.0030302, -0.082676, -0.4803), size))
    return w, normal_upper((y - mu) / sigma)


def normality(df: DataFrame, column: str, method: str = "auto") -> DataFrame:
    """``column, n, n_used, method, stat, p, rejected`` at the 5 % level, from all values.

    ``auto`` takes Shapiro-Wilk up to 5,000 values and the D'Agostino-Pearson test beyond.
    """
    return solve(df, normality_steps(df, column, method))


def normality_steps(df: DataFrame, column: str, method: str = "auto") -> Steps:
    _need(df, [column])
    x = to_numeric(df, column)
    facts = yield {"n": F.count(x), "s": F.skewness(x), "k": F.kurtosis(x), "mean": F.avg(x), "v": F.var_pop(x)}
    n = facts["n"]
    if n < 3:
        raise AnalysisError("n_too_small", "normality needs 3 values")
    method = (method or "auto").lower()
    if method == "auto":
        method = "shapiro" if n <= SHAPIRO_ROWS else "normaltest"
    if method in ("jarque_bera", "normaltest"):
        test = {"jarque_bera": jarque_bera, "normaltest": dagostino_pearson}[method]
        # A column of one value has no skewness, and so no statistic.
        stat, p = test(n, facts["s"], facts["k"]) if facts["s"] is not None else (math.nan, math.nan)
    else:
        method = "shapiro"
        stat, p = shapiro_wilk(df.select(x.alias("x")), n, facts["mean"], facts["v"])
    return small_frame(df.sparkSession, [(column, n, n, method, stat, p, p < ALPHA)],
                       "column string, n long, n_used long, method string, stat double, p double, rejected boolean")


def _t_ratio(difference: float, error: float) -> float:
    if error:
        return difference / error
    return math.nan if not difference else math.copysign(math.inf, difference)


def ttest_one_sample(df: DataFrame, y: str, mu: float = 0.0) -> DataFrame:
    return solve(df, one_sample_steps(df, y, mu))


def one_sample_steps(df: DataFrame, y: str, mu: float = 0.0) -> Steps:
    _need(df, [y], "missing_y")
    v = to_numeric(df, y)
    r = yield {"n": F.count(v), "mean": F.avg(v), "sd": F.stddev_samp(v)}
    n = r["n"]
    t = _t_ratio(r["mean"] - mu, r["sd"] / math.sqrt(n)) if n > 1 else math.nan
    return small_frame(df.sparkSession, [(y, float(mu), n, t, t_two_sided(df.sparkSession, t, n - 1))],
                       "y string, mu double, n long, t double, p double")


def ttest_paired(df: DataFrame, y: str, y2: str) -> DataFrame:
    return solve(df, paired_steps(df, y, y2))


def paired_steps(df: DataFrame, y: str, y2: str) -> Steps:
    _need(df, [y], "missing_y")
    _need(df, [y2], "missing_y2")
    d = to_numeric(df, y) - to_numeric(df, y2)
    r = yield {"n": F.count(d), "mean": F.avg(d), "sd": F.stddev_samp(d)}
    n = r["n"]
    t = _t_ratio(r["mean"], r["sd"] / math.sqrt(n)) if n > 1 else math.nan
    return small_frame(df.sparkSession, [(y, y2, n, t, t_two_sided(df.sparkSession, t, n - 1))],
                       "y string, y2 string, n long, t double, p double")


def grouped_values(df: DataFrame, y: str, group_col: str, null_group: str | None) -> DataFrame:
    """``g, y``: group as text and number; rows without a group go unless ``null_group`` names them."""
    rows = df.select(as_label(df, group_col, null_group).alias("g"), to_numeric(df, y).alias("y"))
    return rows.where(F.col("g").isNotNull())


def two_groups(rows: DataFrame, group_a: str | None, group_b: str | None) -> tuple[str, str]:
    """The named groups, or the two most frequent ones (counted over all rows)."""
    if group_a is None or group_b is None:
        top = [r.g for r in top_groups(rows, "g", 2).collect()]
        if len(top) < 2:
            raise AnalysisError("group_levels<2")
        return top[0], top[1]
    return str(group_a), str(group_b)


def ttest_welch(df: DataFrame, y: str, group_col: str, group_a: str | None = None, group_b: str | None = None, *,
                null_group: str | None = None) -> DataFrame:
    """Welch's t test of two groups, by default the two most frequent."""
    _need(df, [y], "missing_y")
    _need(df, [group_col], "missing_group")
    rows = grouped_values(df, y, group_col, null_group)
    a, b = two_groups(rows, group_a, group_b)
    stats = {r.g: r for r in rows.where(F.col("g").isin(a, b)).groupBy("g").agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("var")).collect()}
    na, ma, va = (stats[a].n, stats[a].mean, stats[a]["var"]) if a in stats else (0, None, None)
    nb, mb, vb = (stats[b].n, stats[b].mean, stats[b]["var"]) if b in stats else (0, None, None)
    t = dof = math.nan
    if va is not None and vb is not None:
        ea, eb = va / na, vb / nb
        t = _t_ratio(ma - mb, math.sqrt(ea + eb))
        if ea + eb:
            dof = (ea + eb) ** 2 / (ea**2 / (na - 1) + eb**2 / (nb - 1))
    spark = df.sparkSession
    return small_frame(spark, [(y, group_col, a, na, ma, b, nb, mb, t, t_two_sided(spark, t, dof))],
                       "y string, group string, group_a string, n_a long, mean_a double, "
                       "group_b string, n_b long, mean_b double, t double, p double")


def anova_oneway(df: DataFrame, y: str, group_col: str, *, null_group: str | None = None) -> DataFrame:
    """``y, group, k, n, f, p``. Group moments are combined by a second aggregate, so any number of groups fits."""
    _need(df, [y, group_col], "missing_columns")
    rows = grouped_values(df, y, group_col, null_group).where(F.col("y").isNotNull())
    groups = rows.groupBy("g").agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    r = groups.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
    ).first()
    if r.k < 2:
        raise AnalysisError("group_levels<2")
    between = groups.agg(F.sum(F.col("n") * (F.col("m") - F.lit(r["mean"])) ** 2)).first()[0]
    d1, d2 = r.k - 1, r.n - r.k
    f = _t_ratio(between / d1, r.within / d2) if d2 > 0 else math.nan
    return small_frame(df.sparkSession, [(y, group_col, r.k, r.n, f, f_upper(df.sparkSession, f, d1, d2))],
                       "y string, group string, k long, n long, f double, p double")


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """``row, col, n, chi2, p, dof`` of the cross table, with the continuity correction at one degree of freedom."""
    _need(df, [row, column], "missing_columns")
    # One job: the sums of rows and columns and their numbers come from the shuffled pairs, the table is read once.
    pairs = crosstab_long(df, row, column)
    row_sums = pairs.groupBy("row").agg(F.sum("n").alias("r"))
    col_sums = pairs.groupBy("col").agg(F.sum("n").alias("c"))
    total = pairs.agg(F.sum("n")).scalar()
    expected = F.col("r").cast("double") * F.col("c") / total
    gap = F.abs(F.col("n") - F.col("e"))
    s = pairs.join(row_sums, "row").join(col_sums, "col").withColumn("e", expected).agg(
        F.sum(gap * gap / F.col("e")).alias("chi2"), F.sum("e").alias("seen"), F.count("*").alias("cells"), F.sum("n").alias("n"),
        F.max(gap).alias("gap"), F.max(row_sums.agg(F.count("*")).scalar()).alias("rows"), F.max(col_sums.agg(F.count("*")).scalar()).alias("columns"),
        F.max(row_sums.agg(F.sum(1 / F.col("r"))).scalar()).alias("by_row"), F.max(col_sums.agg(F.sum(1 / F.col("c"))).scalar()).alias("by_column"),
    ).first()
    if not s.n:
        raise AnalysisError("n_too_small", "the table has no rows")
    dof = (s.rows - 1) * (s.columns - 1)
    if dof == 0:
        chi2 = 0.0
    elif dof == 1:
        # Yates: all four cells are equally far from their expectations, and no count is moved past its own.
        chi2 = (s.gap - min(0.5, s.gap)) ** 2 * s.n * s.by_row * s.by_column
    else:
        # Pairs that never occur add their expected counts, which sum to the rest of the total.
        chi2 = s.chi2 + (s.n - s.seen if s.cells < s.rows * s.columns else 0.0)
    spark = df.sparkSession
    p = 1.0 if dof == 0 else chi2_upper(spark, chi2, dof)
    return small_frame(spark, [(row, column, s.n, chi2, p, dof)],
                       "row string, col string, n long, chi2 double, p double, dof long")
