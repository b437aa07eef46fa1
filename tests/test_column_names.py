"""Every public function gives the same result whatever the user's columns are called."""

import datetime

import pytest

from tabulon import Dataset, run_analysis
from tabulon.operators import (
    actions, anomaly, automl, charts, correlation, describe, kendall, kpi, linear, logistic, multivariate, parametric, profiling, quantiles, rank_tests,
    select,
)

PLAIN = ("number one", "number two", "gaps", "text one", "text two", "day", "flag", "key")
# Names that plans use inside, or once used.
CLASHES = [
    ("n", "_metric", "_value", "_text", "_code", "_group", "_place", "_label"),
    ("value", "y", "g", "v", "row", "period", "label", "i"),
    ("x0", "count", "total", "part", "col", "time", "prediction", "_copy"),
]


def table(spark, names):
    rows = [(float(i * 7 % 40), float(i * i % 23) + i % 3, None if i % 6 == 0 else float(i * 11 % 29), ["red", "green", "blue", None][i % 4],
             f"t{i * 5 % 12}", datetime.date(2024, 1 + i % 12, 1 + i % 28), i * 7 % 40 > i * i % 23, i) for i in range(240)]
    schema = "a double, b double, c double, d string, e string, f date, g boolean, h long"
    return spark.createDataFrame(rows, schema).toDF(*names)


# Each case gets the table and its names in the order of PLAIN.
CASES = {
    "descriptive": lambda t, c: describe.descriptive(t, c[:3]),
    "frequency": lambda t, c: describe.frequency(t, c[3]),
    "crosstab_long": lambda t, c: describe.crosstab_long(t, c[3], c[4]),
    "group_mean": lambda t, c: describe.group_summary(t, c[3], c[0]),
    "group_median": lambda t, c: describe.group_summary(t, c[3], c[0], "median"),
    "group_sum": lambda t, c: describe.group_summary(t, c[4], c[2], "sum"),
    "quantiles": lambda t, c: quantiles.exact_quantiles(t, {n: [0.1, 0.5] for n in c[:3]}),
    "group_quantiles": lambda t, c: quantiles.group_quantiles(t.dropna(subset=[c[3]]), c[3], c[0], {"low": 0.2, "high": 0.9}, few_groups=1),
    "fill_mode": lambda t, c: actions.fillna(t, [c[3]], "mode"),
    "fill_median": lambda t, c: actions.fillna(t, [c[2]], "median"),
    "standardize": lambda t, c: actions.standardize(t, [c[0], c[2]]),
    "winsorize": lambda t, c: actions.winsorize(t, [c[0], c[2]], 0.1, 0.9),
    "one_hot": lambda t, c: [tuple(r)[-7:] for r in actions.one_hot_encode(t, [c[3], c[4]]).collect()],
    "deduplicate": lambda t, c: actions.deduplicate(t, [c[3]], "last", [c[7]]),
    "pearson": lambda t, c: correlation.correlation(t, c[:3]),
    "spearman": lambda t, c: correlation.correlation(t, c[:3], "spearman"),
    "kendall": lambda t, c: correlation.correlation(t, c[:3], "kendall"),
    "welch": lambda t, c: parametric.ttest_welch(t, c[0], c[3]),
    "one_sample": lambda t, c: parametric.ttest_one_sample(t, c[0], 3.0),
    "paired": lambda t, c: parametric.ttest_paired(t, c[0], c[2]),
    "anova": lambda t, c: parametric.anova_oneway(t, c[0], c[3]),
    "chi_square": lambda t, c: parametric.chi_square(t, c[3], c[4]),
    "normality": lambda t, c: parametric.normality(t, c[0]),
    "mann_whitney": lambda t, c: rank_tests.mann_whitney(t, c[0], c[3], "red", "blue"),
    "kruskal": lambda t, c: rank_tests.kruskal_wallis(t, c[0], c[3]),
    "friedman": lambda t, c: rank_tests.friedman(t, c[:3]),
    "linear": lambda t, c: linear.linear_regression(t, c[0], [c[1], c[2]]).coefficients(),
    "logistic": lambda t, c: logistic.logistic_regression(t, c[6], [c[1]]).coefficients(),
    "pca": lambda t, c: multivariate.pca(t, c[:2]).variance(),
    "kmeans": lambda t, c: multivariate.kmeans(t, c[:2], 2, n_init=2).sizes(),
    "preprocess": lambda t, c: automl.preprocess(t),
    "forest": lambda t, c: automl.ml_regression(t, c[0], num_trees=2, key=[c[7]]).metrics(),
    "forest_classes": lambda t, c: automl.ml_classification(t.dropna(), c[3], num_trees=2, key=[c[7]]).confusion(),
    "clustering": lambda t, c: automl.ml_clustering(t.select(*[f"`{n}`" for n in c[:4]]), 2, n_init=2).sizes(),
    "confusion": lambda t, c: automl.confusion_matrix(t, c[3], c[6]),
    "missing": lambda t, c: charts.chart_missing(t),
    "boxplot": lambda t, c: charts.chart_boxplot(t, c[:3]),
    "boxplot_by": lambda t, c: charts.chart_boxplot_by(t, c[0], c[3]),
    "histogram": lambda t, c: charts.chart_histogram(t, c[0], 5),
    "qq": lambda t, c: charts.chart_qq(t, c[0], 5),
    "scatter": lambda t, c: charts.chart_scatter(t, c[0], c[2], n=10, key=[c[7]]),
    "preview": lambda t, c: select.preview(t, [c[7]], n=5),
    "sample": lambda t, c: select.sample_rows(t, 7, [c[7]]),
    "sample_of_equals": lambda t, c: select.sample_of_equals(t.select(f"`{c[0]}`", f"`{c[3]}`"), 5),
    "top_groups": lambda t, c: select.top_groups(t, c[3]),
    "overview": lambda t, c: profiling.overview(t),
    "duplicates": lambda t, c: profiling.duplicate_rows(t),
    "sales": lambda t, c: kpi.kpi_sales(t, c[5], c[0], c[7], c[4], "month"),
    "retention": lambda t, c: kpi.kpi_retention(t, c[5], c[4]),
    "trend": lambda t, c: kpi.trend_change(t, c[5], c[0]),
    "contribution": lambda t, c: kpi.trend_contribution(t, c[4], c[0]),
    "new_returning": lambda t, c: kpi.trend_new_vs_returning(t, c[5], c[4]),
    "iqr": lambda t, c: anomaly.anomaly_iqr(t, c[:3], [c[7]]),
    "zscore": lambda t, c: [tuple(r)[:8] for r in anomaly.anomaly_zscore(t, c[0], 1.5).collect()],
    "spikes": lambda t, c: anomaly.anomaly_dau_spike(t, c[5], c[4]),
    "long_tail": lambda t, c: anomaly.anomaly_long_tail(t, c[0]),
    "column_profile": lambda t, c: profiling.column_profile(t, c[:5]),
    "column_head": lambda t, c: profiling.column_head(t, c[:5], [c[7]]),
    "column_stats": lambda t, c: profiling.column_stats(t, c[0]),
    "profile_numeric": lambda t, c: profiling.profile_numeric(t, c[:3]),
    "health": lambda t, c: profiling.health_summary(t),
}


def shown(result, names):
    """Rows as text with the names replaced by the plain ones, in order."""
    if not hasattr(result, "collect"):
        if isinstance(result, dict):
            return [result[n] for n in names if n in result]
        return sorted(map(str, result)) if result is not None else None
    back = dict(zip(names, PLAIN))
    rows = [tuple(back.get(v, v) if isinstance(v, str) and v in back else (round(v, 9) if isinstance(v, float) else v) for v in r)
            for r in result.collect()]
    return sorted(map(str, rows))


@pytest.fixture(scope="module")
def expected(spark):
    plain = table(spark, PLAIN).cache()
    return {name: shown(case(plain, PLAIN), PLAIN) for name, case in CASES.items()}


@pytest.mark.parametrize("names", CLASHES, ids=lambda names: names[0])
def test_any_column_names(spark, expected, names):
    clash = table(spark, names).cache()
    # Results that depend on the names: samples without a key hash nothing else, texts of one column only.
    wrong = {}
    for name, case in CASES.items():
        try:
            found = shown(case(clash, names), names)
        except Exception as problem:  # collected, so that one run shows all of them
            wrong[name] = f"{type(problem).__name__}: {str(problem)[:150]}"
            continue
        if found != expected[name] and name not in ("overview", "missing", "health"):
            wrong[name] = f"{found[:2]} against {expected[name][:2]}"
    assert not wrong


def test_named_analyses_with_clashing_columns(spark):
    names = CLASHES[0]
    t = table(spark, names)
    for analysis, params in [("group_summary", {"group_by": names[3], "metric": names[0], "agg": "median"}), ("overview", {}),
                             ("frequency", {"column": names[4]}), ("correlation", {"columns": list(names[:3]), "method": "spearman"})]:
        assert all(f.count() for f in run_analysis(t, analysis, params).tables.values())
    data = Dataset(t, order_by=[names[7]]).apply({"type": "fillna", "params": {"columns": [names[3]], "strategy": "mode"}})
    assert data.df.where(f"`{names[3]}` is null").count() == 0
