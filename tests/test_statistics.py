"""Statistics and p-values against worked examples and brute force."""

import itertools
import math
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon import AnalysisError
from tabulon.functions.distributions import chi2_upper, f_upper, t_quantile, t_two_sided
from tabulon.operators import kendall, parametric, ranking
from tabulon.operators.correlation import correlation, correlation_matrix, top_pairs
from tabulon.operators import rank_tests
from tabulon.operators.rank_tests import exact_u_two_sided, friedman, kruskal_wallis, mann_whitney

WEIGHTS = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame([(float(v),) for v in WEIGHTS], "x double")


def grouped(spark, groups):
    return spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, y double")


@pytest.mark.parametrize("method, stat, p", [
    ("shapiro", 0.78881, 0.006704), ("normaltest", 13.034263, 0.0014779), ("jarque_bera", 6.982848, 0.0304575)])
def test_normality(weights, method, stat, p):
    row = parametric.normality(weights, "x", method).first()
    assert row.n == 11 and row.method == method and row.rejected
    assert row.stat == pytest.approx(stat, abs=5e-5) and row.p == pytest.approx(p, rel=2e-3)


def test_normality_dispatch(spark, weights, lineitem):
    assert parametric.normality(weights, "x").first().method == "shapiro"
    assert parametric.normality(lineitem, "l_quantity").first().method == "normaltest"
    whole = parametric.normality(lineitem, "l_extendedprice", "shapiro").first()
    assert whole.method == "shapiro" and 0.9 < whole.stat < 1 and whole.n_used == whole.n == lineitem.count()
    with pytest.raises(AnalysisError, match="n_too_small"):
        parametric.normality(weights.limit(2), "x")
    with pytest.raises(AnalysisError, match="missing_column"):
        parametric.normality(weights, "nope")


def test_normality_of_a_constant(spark):
    df = spark.range(30).select(F.lit(2.0).alias("x"))
    for method in ("jarque_bera", "normaltest"):
        row = parametric.normality(df, "x", method).first()
        assert math.isnan(row.stat) and not row.rejected


def plain_shapiro_w(values):
    """W over a sorted list, with the library's normal quantile."""
    x, n = sorted(values), len(values)
    score = statistics.NormalDist().inv_cdf
    m = [score((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(v * v for v in m), 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        poly = lambda c, last: sum(k * u**(5 - i) for i, k in enumerate(c)) + last
        ends = [poly((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157), m[-1] / math.sqrt(mm))]
        if n > 5:
            ends.append(poly((-3.582633, 5.682633, -1.752461, -0.293762, 0.042981), m[-2] / math.sqrt(mm)))
        phi = (mm - 2 * sum(m[-1 - i] ** 2 for i in range(len(ends)))) / (1 - 2 * sum(e * e for e in ends))
        a = [v / math.sqrt(phi) for v in m]
        for i, e in enumerate(ends):
            a[i], a[-1 - i] = -e, e
    mean = sum(x) / n
    return sum(v * w for v, w in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)


def test_shapiro_equals_the_plain_sum(spark, monkeypatch):
    monkeypatch.setattr(parametric, "SCORED_RANKS", 7)
    rng = random.Random(5)
    for values in ([1.0, 2.0, 4.0], [1, 2, 2, 9], [3, 1, 4, 1, 5], [1, 2, 3, 4, 5, 60], [rng.gauss(10, 2) for _ in range(300)],
                   [float(rng.randrange(6)) for _ in range(2000)], [1e9 + rng.random() for _ in range(50)]):
        row = parametric.normality(spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3), "x", "shapiro").first()
        assert row.stat == pytest.approx(plain_shapiro_w(values), rel=1e-6)
    three = parametric.normality(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), "x", "shapiro").first()
    assert three.stat == pytest.approx(0.9642857) and three.p == pytest.approx(0.6368868, abs=1e-5)
    same = parametric.normality(spark.createDataFrame([(3.0,)] * 5, "x double"), "x", "shapiro").first()
    assert (same.stat, same.p) == (1.0, 1.0)


def test_normal_scores(spark):
    ps = [10.0**-k for k in range(1, 300, 13)] + [i / 97 for i in range(1, 97)] + [1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", parametric.normal_score(F.col("p")).alias("z")).collect()
    assert all(r.z == pytest.approx(statistics.NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-15) for r in rows)


def test_tail_functions(spark):
    assert t_two_sided(spark, 2.228139, 10) == pytest.approx(0.05, rel=1e-5)
    assert t_quantile(spark, 0.975, 10) == pytest.approx(2.228139, rel=1e-6)
    assert f_upper(spark, 4.102821, 2, 10) == pytest.approx(0.05, rel=1e-5)
    assert chi2_upper(spark, 5.991465, 2) == pytest.approx(0.05, rel=1e-6)
    assert 0 < t_two_sided(spark, 40.0, 100) < 1e-60 and t_two_sided(spark, 1.96, 1e12) == pytest.approx(0.0499958, rel=1e-4)


def test_t_tests(spark, weights):
    row = parametric.ttest_one_sample(weights, "x", 160).first()
    mean, sd = np.mean(WEIGHTS), np.std(WEIGHTS, ddof=1)
    assert row.t == pytest.approx((mean - 160) / (sd / math.sqrt(11)))
    jvm = spark._jvm.org.apache.commons.math3.stat.inference.TTest()
    array = spark.sparkContext._gateway.new_array(spark._jvm.double, 11)
    for i, v in enumerate(WEIGHTS):
        array[i] = float(v)
    assert row.p == pytest.approx(jvm.tTest(160.0, array))
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 3.5), (4.0, None)], "a double, b double")
    row = parametric.ttest_paired(pairs, "a", "b").first()
    d = np.array([-1.0, -2.0, -0.5])
    assert row.n == 3 and row.t == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(3)))
    df = grouped(spark, {"a": [1, 2, 3, 4], "b": [2, 4, 9], "c": [5]})
    row = parametric.ttest_welch(df, "y", "g").first()
    assert (row.group_a, row.n_a, row.group_b, row.n_b) == ("a", 4, "b", 3)
    va, vb = np.var([1, 2, 3, 4], ddof=1) / 4, np.var([2, 4, 9], ddof=1) / 3
    assert row.t == pytest.approx((2.5 - 5) / math.sqrt(va + vb))
    assert row.p == pytest.approx(t_two_sided(spark, row.t, (va + vb) ** 2 / (va**2 / 3 + vb**2 / 2)))


def test_null_groups_are_dropped_or_kept(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0), (None, 6.0)], "g string, y double")
    with pytest.raises(AnalysisError, match="group_levels<2"):
        parametric.ttest_welch(df, "y", "g")
    assert parametric.ttest_welch(df, "y", "g", null_group="None").first().group_a == "None"
    with pytest.raises(AnalysisError, match="group_levels<2"):
        parametric.anova_oneway(df, "y", "g")
    assert parametric.anova_oneway(df, "y", "g", null_group="None").first().k == 2


SHELLS = {
    "tillamook": [0.0571, 0.0813, 0.0831, 0.0976, 0.0817, 0.0859, 0.0735, 0.0659, 0.0923, 0.0836],
    "newport": [0.0873, 0.0662, 0.0672, 0.0819, 0.0749, 0.0649, 0.0835, 0.0725],
    "petersburg": [0.0974, 0.1352, 0.0817, 0.1016, 0.0968, 0.1064, 0.105],
    "magadan": [0.1033, 0.0915, 0.0781, 0.0685, 0.0677, 0.0697, 0.0764, 0.0689],
    "tvarminne": [0.0703, 0.1026, 0.0956, 0.0973, 0.1039, 0.1045],
}


def test_anova(spark):
    row = parametric.anova_oneway(grouped(spark, SHELLS), "y", "g").first()
    assert row.k == 5 and row.f == pytest.approx(7.1210194716) and row.p == pytest.approx(0.00028122423)


def chi(spark, table):
    rows = [(f"r{i}", f"c{j}") for i, r in enumerate(table) for j, n in enumerate(r) for _ in range(n)]
    return parametric.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()


def test_chi_square(spark):
    row = chi(spark, [[10, 10, 20], [20, 20, 20]])
    assert row.chi2 == pytest.approx(2.7777777778) and row.p == pytest.approx(0.2493522088) and row.dof == 2
    row = chi(spark, [[12, 5], [3, 9]])
    n, d = 29, 12 * 9 - 5 * 3
    assert row.chi2 == pytest.approx(n * (abs(d) - n / 2) ** 2 / (17 * 12 * 15 * 14)) and row.dof == 1
    table = np.array([[5, 0, 3], [0, 4, 2], [6, 1, 0]])
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    assert chi(spark, table.tolist()).chi2 == pytest.approx(((table - expected) ** 2 / expected).sum())
    zero = np.array([[7, 0], [2, 6]])
    expected = np.outer(zero.sum(1), zero.sum(0)) / zero.sum()
    gap = np.abs(zero - expected)
    assert chi(spark, zero.tolist()).chi2 == pytest.approx(((gap - np.minimum(0.5, gap)) ** 2 / expected).sum())
    assert (chi(spark, [[3, 4]]).chi2, chi(spark, [[3, 4]]).p) == (0.0, 1.0)


def test_mann_whitney_exact(spark):
    df = grouped(spark, {"m": [19, 22, 16, 29, 24], "f": [20, 11, 17, 12]})
    row = mann_whitney(df, "y", "g", "m", "f").first()
    assert (row.u, row.n_a, row.n_b) == (17.0, 5, 4) and row.p == pytest.approx(1 / 9)
    assert mann_whitney(df, "y", "g", "f", "m").first().u == 3.0
    for na, nb in ((2, 3), (3, 4), (1, 5)):
        us = [sum(a > b for a in c for b in set(range(na + nb)) - set(c)) for c in itertools.combinations(range(na + nb), na)]
        for u in set(us):
            top = max(u, na * nb - u)
            assert exact_u_two_sided(u, na, nb) == pytest.approx(min(1, 2 * sum(v >= top for v in us) / len(us)))


@pytest.mark.parametrize("n_large,p", [(20_000_000, 12e6 / 20_000_001), (1_000_000_000, 12e6 / 1_000_000_001)])
def test_mann_whitney_stays_exact_for_large_groups(spark, monkeypatch, n_large, p):
    ranks = n_large / 2 - 6_000_000 + 1  # six million values of U are as far out
    sums = spark.createDataFrame([("a", 1, ranks, 0.0), ("b", n_large, -ranks, 0.0)], "g string, n long, ranks double, tie_term double")
    monkeypatch.setattr(rank_tests, "rank_sums", lambda *_: sums)
    for a, b in ("ab", "ba"):
        assert mann_whitney(grouped(spark, {"a": [1], "b": [2, 3]}), "y", "g", a, b).first().p == pytest.approx(p, rel=1e-12)


def test_mann_whitney_with_ties(spark):
    a, b = [1, 2, 2, 3, 3, 3, 5, 8, 9, 9], [2, 3, 3, 4, 5, 5, 6, 7, 9, 9, 10]
    row = mann_whitney(grouped(spark, {"a": a, "b": b}), "y", "g", "a", "b").first()
    assert row.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n, pooled = len(a) + len(b), a + b
    ties = sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled))
    sigma = math.sqrt(110 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(row.u, 110 - row.u) - 55 - 0.5) / sigma
    assert row.p == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_kruskal_and_friedman(spark):
    row = kruskal_wallis(grouped(spark, {"x": [1, 3, 5, 7, 9], "y": [2, 4, 6, 8, 10]}), "y", "g").first()
    assert row.h == pytest.approx(0.2727272727) and row.p == pytest.approx(0.6015081344)
    row = kruskal_wallis(grouped(spark, {"x": [1, 1, 1], "y": [2, 2, 2], "z": [2, 2]}), "y", "g").first()
    assert row.h == pytest.approx(7.0) and row.p == pytest.approx(0.0301973834)
    pulse = list(zip([72, 96, 88, 92, 74, 76, 82], [120, 120, 132, 120, 101, 96, 112], [76, 95, 104, 96, 84, 72, 76]))
    df = spark.createDataFrame(pulse + [(1, 2, None)], "a int, b int, c int")
    row = friedman(df, ["a", "b", "c"]).first()
    assert (row.k, row.n) == (3, 7) and row.q == pytest.approx(10.5714285714) and row.p == pytest.approx(0.0050634142)
    with pytest.raises(AnalysisError, match="need>=3_columns"):
        friedman(df, ["a", "b"])


def test_correlation_examples(spark):
    df = spark.createDataFrame(list(zip(range(1, 8), [10.0, 9.0, 2.5, 6.0, 4.0, 3.0, 2.0])), "x int, y double")
    row = correlation(df).first()
    assert row.r == pytest.approx(-0.8285038836) and row.p == pytest.approx(0.02128026)
    df = spark.createDataFrame(list(zip([1, 2, 3, 4, 5], [5, 6, 7, 8, 7])), "x int, y int")
    row = correlation(df, method="spearman").first()
    assert row.r == pytest.approx(0.8207826817) and row.p == pytest.approx(0.0885870053)
    df = spark.createDataFrame(list(zip([12, 2, 1, 12, 2], [1, 4, 7, 1, 0])), "x int, y int")
    row = correlation(df, method="kendall").first()
    assert row.r == pytest.approx(-0.4714045208) and row.p == pytest.approx(0.2827454599)


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "x double, y double, c double")
    rows = {(r.a, r.b): r for r in correlation(df).collect()}
    assert rows["x", "y"].r == pytest.approx(1.0) and rows["x", "y"].p == pytest.approx(0.0, abs=1e-6)
    assert rows["x", "c"].r is None and rows["x", "c"].p is None
    assert top_pairs(correlation(df), 1).first().r == pytest.approx(1.0)
    assert correlation_matrix(correlation(df), ["x", "y", "c"]).count() == 9
    assert correlation(df, ["x", "c"], "kendall").first().r is None
    with pytest.raises(AnalysisError, match="need>=2_columns"):
        correlation(df, ["x"])


def pairs_with_gaps(n=300, seed=2):
    rng = random.Random(seed)
    return [(rng.choice([None, 1.0, 1.0, round(rng.random(), 1)]), rng.choice([None, rng.gauss(0, 1)]),
             round(rng.expovariate(1), 1)) for _ in range(n)]


def mid_ranks(x):
    return [sum(v < u for v in x) + (sum(v == u for v in x) + 1) / 2 for u in x]


@pytest.mark.parametrize("bucket_values", [10**6, 20])
def test_spearman_pairwise(spark, monkeypatch, bucket_values):
    monkeypatch.setitem(ranking.value_splits.__kwdefaults__, "bucket_values", bucket_values)
    data = pairs_with_gaps()
    for r in correlation(spark.createDataFrame(data, "a double, b double, c double"), method="spearman").collect():
        i, j = "abc".index(r.a), "abc".index(r.b)
        both = [(t[i], t[j]) for t in data if t[i] is not None and t[j] is not None]
        x, y = zip(*both)
        assert r.n == len(both) and r.r == pytest.approx(np.corrcoef(mid_ranks(x), mid_ranks(y))[0, 1])


def concordance(x, y):
    x, y = np.array(x), np.array(y)
    return (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / 2


@pytest.mark.parametrize("bits, bucket_values", [(8, 10**6), (8, 50), (2, 10**6), (1, 40)])
def test_kendall_against_all_pairs(spark, monkeypatch, bits, bucket_values):
    monkeypatch.setattr(kendall, "DIGIT_BITS", bits)
    monkeypatch.setitem(ranking.value_splits.__kwdefaults__, "bucket_values", bucket_values)
    rng = random.Random(bits)
    x = [0.0 if rng.random() < 0.35 else round(rng.gauss(0, 1), 2) for _ in range(700)]
    y = [round(v + rng.gauss(0, 1), rng.choice((1, 4))) for v in x]
    tau, n, p = kendall.kendall_tau(spark.createDataFrame(list(zip(x, y)), "x double, y double"))
    tied = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    total = n * (n - 1) / 2
    assert n == 700 and 0 <= p < 1e-3
    assert tau == pytest.approx(concordance(x, y) / math.sqrt((total - tied(x)) * (total - tied(y))), abs=1e-12)


def test_kendall_exact_p(spark):
    for y in itertools.permutations(range(4)):
        tau, n, p = kendall.kendall_tau(spark.createDataFrame(
            [(float(i), float(v)) for i, v in enumerate(y)], "x double, y double")) if y[0] == 0 else (None, 4, None)
        if tau is None:
            continue
        s = concordance(range(4), y)
        extreme = [z for z in itertools.permutations(range(4)) if abs(concordance(range(4), z)) >= abs(s)]
        assert p == pytest.approx(len(extreme) / 24)
    assert kendall._exact_p(200, 0) == 0.0 and kendall._exact_p(5, 1) == pytest.approx(2 / 24 * 1.0, rel=1)


def test_kendall_tables_pass_as_rows(spark, monkeypatch):
    """A table of many cells is spread over batches and never one value; whole tables are scored a few cells at a time."""
    monkeypatch.setattr(kendall, "CELLS_AT_A_TIME", 7)
    rng = np.random.default_rng(4)
    cells = np.array(sorted({(0, 0, int(g), 0, int(a), int(b)) for g, a, b in zip(rng.integers(0, 9, 300), rng.integers(0, 9, 300), rng.integers(0, 9, 300))}))
    cells = np.column_stack([cells, rng.integers(1, 5, len(cells))]).astype(np.int64)
    expected = sum(n * m * np.sign(x - u) * np.sign(y - v) for _, _, g, _, x, y, n in cells for _, _, h, _, u, v, m in cells if g == h) / 2
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in cells[i:i + 5].T], ["px", "py", "gx", "gy", "x", "y", "n"]) for i in range(0, len(cells), 5)]
    parts = [b.column("s")[0].as_py() for b in kendall._table_scores(iter(batches))]
    assert len(parts) > 3 and sum(parts) == expected

    x, y = rng.integers(0, 500, 900), rng.integers(0, 500, 900)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        tau, n, _ = kendall.kendall_tau(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tied = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    total = n * (n - 1) / 2
    assert tau == pytest.approx(concordance(x, y) / math.sqrt((total - tied(x)) * (total - tied(y))), abs=1e-12)


def test_normal_scores_and_ranks_by_whole_pieces(spark, monkeypatch):
    """Scores of whole arrays equal the plain quantile, in the middle and in both tails, and pieces split values with many ranks."""
    p = np.concatenate([[1e-300, 1e-13, 1e-5, 0.02, 0.0749, 0.075, 0.3, 0.5], 1 - np.array([1e-13, 1e-5, 0.02, 0.075, 0.3])])
    assert np.allclose(parametric.normal_scores(p), [statistics.NormalDist().inv_cdf(v) for v in p], rtol=1e-12, atol=1e-15)
    monkeypatch.setattr(parametric, "SCORED_RANKS", 9)
    score = lambda i, n: statistics.NormalDist().inv_cdf((i - 0.375) / (n + 0.25))
    for n in (4, 5, 60, 61):
        assert parametric._sum_of_squares(spark, n) == pytest.approx(sum(score(i, n) ** 2 for i in range(1, n + 1)), rel=1e-12)
    counts = spark.createDataFrame([(1.0, 2, 2), (5.0, 50, 52), (7.0, 1, 53), (9.0, 7, 60)], "x double, n long, upto long").coalesce(1)
    x = [1.0] * 2 + [5.0] * 50 + [7.0] + [9.0] * 7
    weight = [score(i, 60) * 0.3 for i in range(1, 61)]
    weight[0], weight[1], weight[-2], weight[-1] = -0.5, -0.4, 0.4, 0.5
    assert parametric._weighted_sum(counts, 60, 5.0, 0.3, [0.5, 0.4]) == pytest.approx(sum(w * (v - 5.0) for w, v in zip(weight, x)), rel=1e-12)
