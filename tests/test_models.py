import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabulon import AnalysisError
from tabulon.operators import automl, charts
from tabulon.operators.linear import fit_linear_regression, linear_regression
from tabulon.operators.logistic import logistic_regression, roc_auc, roc_curve, roc_points
from tabulon.operators import multivariate
from tabulon.operators.multivariate import kmeans, pca


@pytest.fixture(scope="module")
def line(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        a, b = rng.gauss(50, 10), rng.random()
        rows.append((a, b if i % 17 else None, 3 + 2 * a - 40 * b + rng.gauss(0, 5), 1.0))
    return spark.createDataFrame(rows, "a double, b double, y double, one double")


def test_linear_regression_agrees_with_spark_ml(line):
    fit = linear_regression(line, "y", ["a", "b", "y", "nope"])
    data = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(line.dropna())
    model = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(data)
    rows = fit.coefficients().collect()
    assert [r.term for r in rows] == ["intercept", "a", "b"]
    assert [r.coef for r in rows] == pytest.approx([model.intercept, *model.coefficients])
    assert [r.se for r in rows[1:]] == pytest.approx(model.summary.coefficientStandardErrors[:2])
    assert rows[0].se == pytest.approx(model.summary.coefficientStandardErrors[2])
    assert [r.p for r in rows[1:]] == pytest.approx(model.summary.pValues[:2], abs=1e-12)
    info = fit.info().first()
    assert (info.n, info.r2, info.adj_r2) == (data.count(), pytest.approx(model.summary.r2), pytest.approx(model.summary.r2adj))
    assert rows[1].ci_low < 2 < rows[1].ci_high
    assert fit.fitted().count() == info.n


def test_linear_regression_edges(spark, line):
    exact = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    fit = linear_regression(exact, "y", ["x"])
    assert fit.r2 == pytest.approx(1) and fit.coef.tolist() == pytest.approx([1, 2])
    singular = linear_regression(line, "y", ["a", "one"]).coefficients().collect()
    assert math.isnan(singular[1].se) and math.isnan(singular[1].p)
    with pytest.raises(AnalysisError, match="n_too_small"):
        linear_regression(exact.limit(4), "y", ["x"])
    assert fit_linear_regression(exact.limit(3), "y", ["x"]).n == 3
    with pytest.raises(AnalysisError, match="missing_x"):
        linear_regression(exact, "y", ["y"])
    with pytest.raises(AnalysisError, match="missing_y"):
        linear_regression(exact, "z", ["x"])


@pytest.fixture(scope="module")
def binary(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        a, b = rng.gauss(100, 20), rng.gauss(0, 1)
        p = 1 / (1 + math.exp(-(-5 + 0.05 * a + 0.8 * b)))
        rows.append((a, b, "yes" if rng.random() < p else "no"))
    return spark.createDataFrame(rows, "a double, b double, y string")


def newton(x, y):
    x = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        info = x.T @ (x * (p * (1 - p))[:, None])
        beta += np.linalg.solve(info, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(info))), np.log(np.where(y == 1, p, 1 - p)).sum()


def test_logistic_regression_is_maximum_likelihood(binary):
    fit = logistic_regression(binary, "y", ["a", "b"])
    data = np.array([(r.a, r.b, r.y == "yes") for r in binary.collect()], dtype=float)
    beta, se, ll = newton(data[:, :2], data[:, 2])
    rows, info = fit.coefficients().collect(), fit.info().first()
    assert fit.classes == ["no", "yes"] and info.used == "likelihood" and info.n == 400
    assert [r.coef for r in rows] == pytest.approx(beta, rel=1e-5)
    assert [r.p for r in rows] == pytest.approx([math.erfc(abs(b / s) / math.sqrt(2)) for b, s in zip(beta, se)], rel=1e-3)
    assert [r.odds_ratio for r in rows] == pytest.approx(np.exp(beta), rel=1e-5)
    assert rows[1].or_low == pytest.approx(math.exp(beta[1] - 1.959964 * se[1]), rel=1e-4)
    assert info.ll == pytest.approx(ll, rel=1e-6) and info.aic == pytest.approx(6 - 2 * ll, rel=1e-6)


def test_separated_classes_fall_back_to_ridge(spark):
    df = spark.createDataFrame([(float(i), int(i >= 20)) for i in range(40)], "x double, y int")
    fit = logistic_regression(df, "y", ["x"])
    assert fit.used == "ridge" and fit.info().first().ll is None
    row = fit.coefficients().collect()[1]
    assert row.p is None and 2 < row.coef < 6
    assert roc_auc(fit.scores(), "label", "score").first().auc == 1.0


def test_the_branch_of_a_logistic_fit_is_proved(spark):
    """Separation and dependence are found by counting rows and by eigenvalues, not guessed from sizes."""
    rng = random.Random(8)
    steep = [(x, int(x + rng.gauss(0, 0.02) > 0)) for x in (rng.uniform(-1, 1) for _ in range(300))]
    fit = logistic_regression(spark.createDataFrame(steep, "x double, y int"), "y", ["x"])
    data = np.array(steep)
    assert fit.used == "likelihood" and fit.slopes[0] > 20  # very large, and finite
    assert fit.slopes[0] == pytest.approx(newton(data[:, :1], data[:, 1])[0][1], rel=1e-4)
    # All rows with the mark are of one class, the others mixed: no row contradicts the mark's direction.
    quasi = [(float(i % 4 == 0), rng.gauss(0, 1), int(i % 4 == 0 or i % 3 == 0)) for i in range(200)]
    assert logistic_regression(spark.createDataFrame(quasi, "m double, x double, y int"), "y", ["m", "x"]).used == "ridge"
    twice = [(float(i), 3.0 - 2 * i, i * 7 % 5 > 2) for i in range(60)]
    assert logistic_regression(spark.createDataFrame(twice, "a double, b double, y boolean"), "y", ["a", "b"]).used == "ridge"
    constant = [(float(i), 1.0, i * 7 % 5 > 2) for i in range(60)]
    assert logistic_regression(spark.createDataFrame(constant, "a double, b double, y boolean"), "y", ["a", "b"]).used == "ridge"


def test_a_long_roc_curve_keeps_its_shape(spark):
    rng = random.Random(9)
    rows = [(int(rng.random() < s), s) for s in (rng.random() for _ in range(5000))]
    df = spark.createDataFrame(rows, "y int, s double")
    short = sorted((r.fpr, r.tpr, r.threshold) for r in roc_curve(df, "y", "s", 40).collect())
    assert len(short) <= 2 * 41 + 1 and short[0] == (0.0, 0.0, None) and short[-1][:2] == (1.0, 1.0)
    assert all(b[0] - a[0] <= 2 / 40 and b[1] - a[1] <= 2 / 40 for a, b in zip(short, short[1:]))
    whole = {r.threshold: (r.fpr, r.tpr) for r in roc_points(df, "y", "s").collect()}
    assert all(whole[t] == (f, p) for f, p, t in short[1:])


def test_logistic_guards(spark, binary):
    with pytest.raises(AnalysisError, match="y_not_binary"):
        logistic_regression(binary.withColumn("z", F.col("a").cast("string")), "z", ["b"])
    with pytest.raises(AnalysisError, match="n_too_small"):
        logistic_regression(binary.limit(15), "y", ["b"])
    zero_one = binary.withColumn("y", F.when(F.col("y") == "yes", "1").otherwise("0"))
    assert logistic_regression(zero_one, "y", ["b"]).classes == [0, 1]


def test_roc(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.3), (1, 0.3), (0, 0.1)], "y int, s double")
    assert roc_auc(df, "y", "s").first().auc == pytest.approx((3 + 2.5 + 1.5) / 9)
    points = {r.threshold: (r.fpr, r.tpr) for r in roc_points(df, "y", "s").collect()}
    assert points == {0.9: (0, pytest.approx(1 / 3)), 0.8: (pytest.approx(1 / 3), pytest.approx(2 / 3)),
                      0.3: (pytest.approx(2 / 3), 1), 0.1: (1, 1)}


def test_pca_is_the_eigenbasis_of_the_correlations(line):
    fit = pca(line, ["a", "b", "y"], 9)
    data = np.array([tuple(r) for r in line.select("a", "b", "y").dropna().collect()])
    values, vectors = np.linalg.eigh(np.corrcoef(data.T))
    assert fit.k == 3 and fit.ratio == pytest.approx((values[::-1] / 3).tolist())
    assert np.abs(fit.loading) == pytest.approx(np.abs(vectors[:, ::-1]))
    assert fit.variance().collect()[2].cumulative == pytest.approx(1)
    assert all(col[np.abs(col).argmax()] > 0 for col in fit.loading.T)
    scores = fit.scores().agg(F.var_pop("PC1"), F.avg("PC1")).first()
    assert scores[0] == pytest.approx(values[-1]) and scores[1] == pytest.approx(0, abs=1e-9)
    with pytest.raises(AnalysisError, match="need>=2_columns"):
        pca(line, ["a"])


def test_kmeans_finds_blobs(spark):
    rng = random.Random(9)
    rows = [(c * 10 + rng.gauss(0, 0.5), -c * 5 + rng.gauss(0, 0.5)) for c in range(3) for _ in range(30 + 10 * c)]
    fit = kmeans(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], 3, n_init=3)
    assert [r["size"] for r in fit.sizes().collect()] == [30, 40, 50] and fit.n == 120
    assert fit.assignments().groupBy("cluster").count().count() == 3
    assert fit.centers().columns == ["cluster", "x", "y"] and fit.inertia < 5
    assert charts.chart_cluster_scatter(fit, n=50).count() == 50


def test_automl(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        kind, x = rng.choice("abc"), rng.random() * 10
        rows.append((i, kind, x if i % 20 else None, {"a": 0, "b": 20, "c": 40}[kind] + 3 * x, "high" if x > 5 else "low"))
    df = spark.createDataFrame(rows, "i int, kind string, x double, y double, z string")
    run = automl.ml_regression(df.select("kind", "x", "y"), "y", num_trees=20).metrics().first()
    assert run.r2 > 0.9 and 60 < run.n_test < 180
    classes = automl.ml_classification(df.select("kind", "x", "z"), "z", num_trees=20)
    assert classes.metrics().first().accuracy > 0.9
    table = classes.confusion().collect()
    assert {r.label for r in table} == {"high", "low"} and sum(r.n for r in table) == classes.metrics().first().n_test
    with pytest.raises(AnalysisError, match="too_many_classes"):
        automl.ml_classification(df, "i")
    with pytest.raises(AnalysisError, match="missing_target"):
        automl.ml_regression(df, "nope")
    sizes = automl.ml_clustering(df.select("kind", "y"), 3, n_init=2).sizes().collect()
    assert sum(r["size"] for r in sizes) == 600 and len(sizes) == 3


def test_preprocess_fills_and_codes(spark):
    df = spark.createDataFrame([("b", 1.0, True), ("a", None, True), (None, 4.0, None), ("b", 4.0, False)],
                               "s string, x double, f boolean")
    got = automl.preprocess(df).collect()
    assert sorted(map(tuple, got)) == [(0.0, 3.0, 1.0), (1.0, 1.0, 1.0), (1.0, 4.0, 0.0), (1.0, 4.0, 1.0)]


def test_nearest_centres_take_the_first_of_equals():
    rng = np.random.default_rng(2)
    x, centres = rng.integers(-3, 4, (500, 2)).astype(float), rng.integers(-3, 4, (6, 4, 2)).astype(float)
    centres[2, 3] = centres[2, 0]  # a repeated centre stays empty
    flat = centres.reshape(-1, 2)
    hot = multivariate._nearest(x, flat, (flat * flat).sum(axis=1), 6)
    near = ((x[None, None] - centres[:, :, None]) ** 2).sum(axis=3).argmin(axis=1)
    assert (hot.argmax(axis=1) == near).all() and (hot.sum(axis=1) == 1).all()


def test_kmeans_blocks_are_read_in_place(spark):
    """Blocks are views of the Arrow batch, and summed distances are only asked for at the end."""
    batch = pa.RecordBatch.from_pydict({"place": [0, 1], "data": [np.arange(6.0).tobytes(), np.arange(4.0).tobytes()]})
    parts = list(multivariate._block_rows(batch, 2))
    assert [p.tolist() for p in parts] == [[[0, 1], [2, 3], [4, 5]], [[0, 1], [2, 3]]]
    assert all(not p.flags.owndata and not p.flags.writeable for p in parts)
    rows = [(float(i % 7), float(i % 5)) for i in range(210)]
    blocks = multivariate._blocks(spark.createDataFrame(rows, "x0 double, x1 double").repartition(3))
    centres = np.array([[[0.0, 0.0], [5.0, 3.0]], [[2.0, 2.0], [2.0, 2.0]]])
    x = np.array(rows)
    gaps = ((x[None, None] - centres[:, :, None]) ** 2).sum(axis=3)
    sums = multivariate._cluster_sums(blocks, centres, spread_too=True)
    assert np.allclose(sums[:, :, -1].sum(axis=1), gaps.min(axis=1).sum(axis=1))
    assert sums[1, 1].tolist() == [0, 0, 0, 0] and sums[1, 0, 2] == 210
    assert multivariate._cluster_sums(blocks, centres).shape == (2, 2, 3)
