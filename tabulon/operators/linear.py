"""Ordinary least squares from one aggregate of means and covariances."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col, existing, to_numeric
from tabulon.functions.distributions import t_quantile, t_two_sided
from tabulon.functions.frames import small_frame
from tabulon.functions.rounds import Steps, solve
from tabulon.operators.select import listwise_complete, without_nulls

INTERCEPT = "intercept"
_NEARLY_EXACT = 1e-8


class OlsFit:
    """Coefficients and fit statistics of one least-squares model (driver-side scalars only)."""

    def __init__(self, rows: DataFrame, y: str, x: list[str], n: int, means: np.ndarray, cov: np.ndarray):
        self.y, self.x, self.n = y, x, n
        self._rows, self._spark, self._means, self._cov = rows, rows.sparkSession, means, cov
        self._solve()

    def _solve(self) -> None:
        n, k = self.n, len(self.x)
        sxx, sxy, syy = self._cov[1:, 1:], self._cov[1:, 0], self._cov[0, 0]
        scale = np.sqrt(np.diag(sxx))
        unit = np.where(scale > 0, scale, 1.0)
        r = sxx / np.outer(unit, unit)
        slopes = np.linalg.lstsq(r, sxy / unit, rcond=None)[0] / unit
        self.coef = np.r_[self._means[0] - slopes @ self._means[1:], slopes]
        ss_tot = n * syy
        ss_res = max(0.0, n * (syy - 2 * slopes @ sxy + slopes @ sxx @ slopes))
        if ss_tot > 0 and ss_res / ss_tot < _NEARLY_EXACT:  # cancellation: read the residuals themselves
            ss_res = self._rows.agg(F.sum((col(self.y) - self.predict()) ** 2)).first()[0]
        self.r2 = 1 - ss_res / ss_tot if ss_tot > 0 else 0.0
        self.dof = n - k - 1
        self.adj_r2 = 1 - (1 - self.r2) * (n - 1) / self.dof if self.dof > 0 else self.r2
        mse = ss_res / self.dof if self.dof > 0 else math.nan  # nothing is left over to estimate it from
        if np.linalg.matrix_rank(r) < k:
            self.se = np.full(k + 1, math.nan)
        else:
            inverse = np.linalg.inv(r) / np.outer(unit, unit) / n
            centre = self._means[1:]
            self.se = np.sqrt(mse * np.r_[1 / n + centre @ inverse @ centre, np.diag(inverse)])

    def predict(self):
        """Fitted value as an expression over the numeric columns of x."""
        total = F.lit(float(self.coef[0]))
        for b, name in zip(self.coef[1:], self.x):
            total = total + F.lit(float(b)) * col(name)
        return total

    def fitted(self) -> DataFrame:
        """``actual, predicted`` of every complete row."""
        return self._rows.select(col(self.y).alias("actual"), self.predict().alias("predicted"))

    def coefficients(self) -> DataFrame:
        """``term, coef, se, t, p, ci_low, ci_high``, the intercept first."""
        critical = t_quantile(self._spark, 0.975, self.dof) if self.dof > 0 else math.nan
        rows = []
        for name, b, se in zip([INTERCEPT, *self.x], self.coef.tolist(), self.se.tolist()):
            t = b / se if se else math.copysign(math.inf, b) if b else math.nan
            bounds = (b - critical * se, b + critical * se) if math.isfinite(critical * se) else (None, None)
            rows.append((name, b, se, t, t_two_sided(self._spark, t, self.dof), *bounds))
        return small_frame(self._spark, rows, "term string, coef double, se double, t double, p double, "
                                              "ci_low double, ci_high double")

    def info(self) -> DataFrame:
        return small_frame(self._spark, [(self.y, ", ".join(self.x), self.n, float(self.r2), float(self.adj_r2))],
                           "y string, x string, n long, r2 double, adj_r2 double")


def linear_steps(df: DataFrame, y: str, x: Sequence[str], *, min_rows: int = 5) -> Steps:
    """The fit from means and covariances over the complete rows."""
    if y not in df.columns:
        raise AnalysisError("missing_y")
    x = [c for c in existing(df, x or []) if c != y]
    if not x:
        raise AnalysisError("missing_x")
    names = [y, *x]
    values = [to_numeric(df, c) for c in names]
    complete = without_nulls(values)
    values = [F.when(complete, v) for v in values]
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    found = yield {"n": F.count_if(complete), **{f"m{i}": F.avg(v) for i, v in enumerate(values)},
                   **{f"c{i}_{j}": F.covar_pop(values[i], values[j]) for i, j in pairs}}
    if found["n"] < min_rows:
        raise AnalysisError("n_too_small", f"{min_rows} complete rows are needed")
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = found[f"c{i}_{j}"]
    return OlsFit(listwise_complete(df, names), y, x, found["n"], np.array([found[f"m{i}"] for i in range(len(names))]), cov)


def linear_regression(df: DataFrame, y: str, x: Sequence[str]) -> OlsFit:
    return solve(df, linear_steps(df, y, x))


def fit_linear_regression(df: DataFrame, y: str, x: Sequence[str]) -> OlsFit:
    """The same fit, allowed from two complete rows on."""
    return solve(df, linear_steps(df, y, x, min_rows=2))
