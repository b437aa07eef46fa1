"""Binary logistic regression, and ROC curves of any score column."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col, existing, to_numeric
from tabulon.functions.frames import small_frame, spread
from tabulon.operators.linear import INTERCEPT
from tabulon.operators.ranking import centred_rank, running_counts

MIN_ROWS = 20
_Z95 = 1.959963984540054
MAX_STEPS = 60
TOLERANCE = 1e-9
ROUNDING = 1e-12
DEPENDENT = 1e-10  # the smallest eigenvalue of the correlations of columns that depend on each other
FAR = 8.0  # scaled coefficients from which on separation is looked for


def binary_target(df: DataFrame, y: str) -> tuple[object, list]:
    """0/1 expression and the two classes: numbers 0 and 1, or two labels in ascending order."""
    number = to_numeric(df, y)
    seen = df.agg(F.count(number).alias("n"), F.count_if(~number.isin(0.0, 1.0)).alias("other")).first()
    if seen.n and not seen.other:
        return number.cast("int"), [0, 1]
    label = col(y).cast("string")
    labels = sorted(r[0] for r in df.where(col(y).isNotNull()).select(label).distinct().limit(3).collect())
    if len(labels) != 2:
        raise AnalysisError("y_not_binary", f"first labels of {y}: {labels}")
    return F.when(label == labels[0], 0).when(label == labels[1], 1), labels


class LogitFit:
    """Maximum likelihood by iteratively reweighted least squares, or a ridge fit when that has no solution."""

    def __init__(self, df: DataFrame, y: str, x: Sequence[str]):
        if y not in df.columns:
            raise AnalysisError("missing_y")
        self.y, self.x = y, [c for c in existing(df, x or []) if c != y]
        if not self.x:
            raise AnalysisError("missing_x")
        target, self.classes = binary_target(df, y)
        self._spark = df.sparkSession
        self._rows = df.select(
            target.alias("_label"), *[to_numeric(df, c).alias(f"x{i}") for i, c in enumerate(self.x)]).dropna()
        inputs = [f"x{i}" for i in range(len(self.x))]
        moments = self._rows.agg(
            F.count("*").alias("n"), F.avg("_label").alias("share"), *[F.avg(c).alias(f"m_{c}") for c in inputs],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in inputs]).first()
        self.n = moments.n
        if self.n < MIN_ROWS:
            raise AnalysisError("n_too_small", f"{MIN_ROWS} complete rows are needed")
        self._means = [moments[f"m_{c}"] for c in inputs]
        self._scales = [moments[f"s_{c}"] or 1.0 for c in inputs]
        # Iterations work on scaled columns; the coefficients are scaled back afterwards.
        scaled = self._rows.select("_label", *[
            ((F.col(c) - m) / s).alias(c) for c, m, s in zip(inputs, self._means, self._scales)])
        data = spread(scaled, self.n).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not (0 < moments.share < 1 and self._fit_likelihood(data)):
                self._fit_ridge(data)
        finally:
            data.unpersist()

    def _information(self, data: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, its slope and the information matrix at these coefficients, the intercept first: one aggregate."""
        terms = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(self.x))]]
        z = sum((F.lit(float(b)) * t for b, t in zip(beta[1:], terms[1:])), F.lit(float(beta[0])))
        p, toward = 1 / (1 + F.exp(-z)), F.when(F.col("_label") == 1, z).otherwise(-z)
        parts = [F.sum(F.least(toward, F.lit(0.0)) - F.log1p(F.exp(-F.abs(toward)))).alias("ll")]
        parts += [F.sum((F.col("_label") - p) * t).alias(f"g{i}") for i, t in enumerate(terms)]
        parts += [F.sum(p * (1 - p) * a * b).alias(f"h{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
        row = data.agg(*parts).first()
        k = range(len(terms))
        return row.ll, np.array([row[f"g{i}"] for i in k]), np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in k] for i in k])

    def _separated(self, data: DataFrame, direction: np.ndarray) -> bool:
        """Whether no row lies on the wrong side of this direction, and some row off it: then the likelihood has no maximum."""
        z = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(direction[1:])), F.lit(float(direction[0])))
        toward = F.when(F.col("_label") == 1, z).otherwise(-z)
        slack = ROUNDING * float(np.abs(direction).sum())
        row = data.agg(F.count_if(toward < -slack).alias("wrong"), F.count_if(toward > slack).alias("right")).first()
        return row.wrong == 0 and row.right > 0

    def _fit_likelihood(self, data: DataFrame) -> bool:
        """Newton steps, halved until the likelihood grows; False if the columns are dependent or the classes separated."""
        inputs = range(len(self.x))
        row = data.agg(*[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i in inputs for j in inputs if i <= j]).first()
        correlation = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in inputs] for i in inputs])
        if np.linalg.eigvalsh(correlation).min() < DEPENDENT:
            return False
        beta = np.zeros(len(self.x) + 1)
        ll, slope, information = self._information(data, beta)
        for _ in range(MAX_STEPS):
            step = np.linalg.lstsq(information, slope, rcond=None)[0]
            size = 1.0
            while True:
                after = self._information(data, beta + size * step)
                if after[0] >= ll - ROUNDING * abs(ll) or size < 1e-4:
                    break
                size /= 2
            gain, beta = after[0] - ll, beta + size * step
            ll, slope, information = after
            # Along a direction that separates the classes every step is about as long as the one before.
            if np.abs(beta).max() > FAR and (self._separated(data, beta) or self._separated(data, step)):
                return False
            if np.abs(size * step).max() < TOLERANCE * max(1.0, np.abs(beta).max()) or abs(gain) <= ROUNDING * abs(ll) * 1e-3:
                break
        covariance = np.linalg.inv(information)
        scales, means = np.array(self._scales), np.array(self._means)
        slopes = beta[1:] / scales
        back = np.concatenate([[1.0], -means / scales])  # what the intercept in the columns' own units is made of
        self.used, self.ll = "likelihood", ll
        self.aic = 2 * (len(slopes) + 1) - 2 * ll
        self.slopes, self.slope_se = slopes.tolist(), (np.sqrt(np.diag(covariance)[1:]) / scales).tolist()
        self.intercept, self.intercept_se = float(beta @ back), math.sqrt(back @ covariance @ back)
        self.slope_p = [_normal_p(b / se) for b, se in zip(self.slopes, self.slope_se)]
        self.intercept_p = _normal_p(self.intercept / self.intercept_se)
        return True

    def _fit_ridge(self, data: DataFrame) -> None:
        """Unit-penalty ridge on standardised columns; coefficients stay in standardised units, without p."""
        vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(self.x))], outputCol="_features").transform(data)
        model = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1.0 / self.n,
                                   elasticNetParam=0.0, standardization=False, maxIter=500).fit(vectors)
        self.used, self.ll, self.aic = "ridge", None, None
        self.standardised = model.coefficients.toArray().tolist()
        self.slopes = [b / s for b, s in zip(self.standardised, self._scales)]
        self.standardised_intercept = model.intercept
        self.intercept = model.intercept - sum(b * m for b, m in zip(self.slopes, self._means))

    def probability(self):
        """Probability of class 1 as an expression over ``x0, x1, ...``."""
        z = F.lit(float(self.intercept))
        for i, b in enumerate(self.slopes):
            z = z + F.lit(float(b)) * F.col(f"x{i}")
        return 1 / (1 + F.exp(-z))

    def scores(self) -> DataFrame:
        """``label, score`` of every complete row."""
        return self._rows.select(F.col("_label").alias("label"), self.probability().alias("score"))

    def coefficients(self) -> DataFrame:
        """``term, coef, odds_ratio, p, or_low, or_high``, the intercept first."""
        if self.used == "likelihood":
            terms = zip([INTERCEPT, *self.x], [self.intercept, *self.slopes], [self.intercept_se, *self.slope_se],
                        [self.intercept_p, *self.slope_p])
            rows = [(t, b, _exp(b), p, _exp(b - _Z95 * se), _exp(b + _Z95 * se)) for t, b, se, p in terms]
        else:
            terms = zip([INTERCEPT, *self.x], [self.standardised_intercept, *self.standardised])
            rows = [(t, b, _exp(b), None, None, None) for t, b in terms]
        return small_frame(self._spark, rows,
                           "term string, coef double, odds_ratio double, p double, or_low double, or_high double")

    def info(self) -> DataFrame:
        return small_frame(
            self._spark, [(self.y, ", ".join(self.x), self.n, self.ll, self.aic, self.used)],
            "y string, x string, n long, ll double, aic double, used string")


def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _exp(value: float) -> float:
    return math.exp(value) if value < 709 else math.inf


def logistic_regression(df: DataFrame, y: str, x: Sequence[str]) -> LogitFit:
    return LogitFit(df, y, x)


def _labelled(df: DataFrame, label: str, score: str) -> DataFrame:
    rows = df.select(to_numeric(df, score).alias("score"), to_numeric(df, label).cast("int").alias("positives"))
    return running_counts(rows.where(F.col("positives").isin(0, 1)), "score", measures=["positives"])


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """``n_pos, n_neg, auc``, ties counted half."""
    sums = _labelled(df, label, score).agg(
        F.sum("positives").alias("n_pos"), (F.sum("n") - F.sum("positives")).alias("n_neg"),
        F.sum(F.col("positives") * centred_rank()).alias("ranks"))
    area = 0.5 + F.col("ranks") / (F.col("n_pos").cast("double") * F.col("n_neg"))
    return sums.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), area).alias("auc"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """``threshold, fpr, tpr`` for every distinct score (rows at or above it are called positive)."""
    table = _labelled(df, label, score)
    tp = F.col("positives_total") - (F.col("positives_upto") - F.col("positives"))
    called = F.col("total") - (F.col("upto") - F.col("n"))
    negatives = F.col("total") - F.col("positives_total")
    return table.select(
        F.col("score").alias("threshold"), F.try_divide(called - tp, negatives).alias("fpr"),
        F.try_divide(tp, F.col("positives_total")).alias("tpr"))


def roc_curve(df: DataFrame, label: str, score: str, points: int = 1000) -> DataFrame:
    """``threshold, fpr, tpr`` from (0, 0) to (1, 1): a part of the points of ``roc_points``, however many scores there are.

    The curve's length, fpr + tpr, is cut into ``points`` pieces, and of each piece the first and the last point stay. Between two
    points that follow each other neither rate grows by more than 2 / points that the curve does not show. The first point, above all
    scores, has no threshold.
    """
    table = roc_points(df, label, score)
    piece = F.floor((F.col("fpr") + F.col("tpr")) / 2 * points)
    kept = table.where(F.col("fpr").isNotNull() & F.col("tpr").isNotNull()).groupBy(piece.alias("piece")).agg(
        F.max(F.struct("threshold", "fpr", "tpr")).alias("first"), F.min(F.struct("threshold", "fpr", "tpr")).alias("last"))
    both = kept.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("p")).select("p.*")
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(both)
