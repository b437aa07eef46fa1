"""One entry point for all named analyses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tabulon.errors import AnalysisError
from tabulon.functions.rounds import Steps, finished, solve
from tabulon.operators import charts, describe, profiling
from tabulon.operators.correlation import correlation_columns, correlation_matrix, correlation_steps, top_pairs
from tabulon.operators.linear import linear_steps
from tabulon.operators.logistic import logistic_regression, roc_auc, roc_curve
from tabulon.operators.multivariate import kmeans, pca
from tabulon.operators.parametric import anova_oneway, chi_square, normality_steps, one_sample_steps, paired_steps, ttest_welch
from tabulon.operators.rank_tests import friedman_steps, kruskal_wallis, mann_whitney


@dataclass
class AnalysisResult:
    """Result tables by name; charts are computed only when their function is called."""

    title: str
    tables: dict[str, DataFrame]
    charts: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)


def _column(df: DataFrame, params: dict, name: str, code: str = "missing_column") -> str:
    value = params.get(name)
    if not value or value not in df.columns:
        raise AnalysisError(code, f"{name}={value!r}")
    return value


def _names(params: dict, name: str) -> list[str]:
    value = params.get(name) or []
    return [value] if isinstance(value, str) else list(value)


# Each analysis is a generator: what it asks for while it runs may be read in one round with what others ask for.


def _overview(df, p):
    shape = yield from profiling.shape_steps(df)
    return {"overview": profiling.overview(df), "shape": shape}, {"missing": lambda: charts.chart_missing(df)}


def _frequency(df, p):
    table = describe.frequency(df, _column(df, p, "column"), top_n=int(p.get("top_n", 30)))
    return (yield from finished(({"frequency": table}, {})))


def _crosstab(df, p):
    row, column = (_column(df, p, n, "missing_columns") for n in ("row", "col"))
    pairs = describe.crosstab_long(df, row, column)
    try:
        cross = describe.crosstab(df, row, column, max_levels=int(p.get("max_levels", describe.MAX_LEVELS)))
    except AnalysisError as problem:
        if problem.code != "too_many_levels":
            raise
        cross = pairs  # too wide for columns: the same counts, one row per pair
    return (yield from finished(({"crosstab": cross, "test": chi_square(df, row, column)}, {"heatmap": lambda: pairs})))


def _descriptive(df, p):
    names = _names(p, "columns")
    table = yield from describe.descriptive_steps(df, names)
    return {"descriptive": table}, {"boxplot": lambda: charts.chart_boxplot(df, names)}


def _group_summary(df, p):
    args = (str(p.get("group_by")), str(p.get("metric")), str(p.get("agg", "mean")))
    return (yield from finished(({"summary": describe.group_summary(df, *args)}, {"bars": lambda: charts.chart_group_top(df, *args)})))


def _normality(df, p):
    name = _column(df, p, "column")
    test = yield from normality_steps(df, name, str(p.get("method", "auto")))
    return {"test": test}, {"histogram": lambda: charts.chart_histogram(df, name), "qq": lambda: charts.chart_qq(df, name)}


def _ttest(df, p):
    y, kind = str(p.get("y")), str(p.get("ttype", "independent")).lower()
    if kind == "one_sample":
        test = yield from one_sample_steps(df, y, float(p.get("mu", 0.0)))
        return {"test": test}, {"histogram": lambda: charts.chart_histogram(df, y)}
    if kind == "paired":
        test = yield from paired_steps(df, y, p.get("y2"))
        return {"test": test}, {"scatter": lambda: charts.chart_scatter(df, y, p["y2"], key=_names(p, "key"))}
    result = ttest_welch(df, y, p.get("group_col"), p.get("group_a"), p.get("group_b"), null_group=p.get("null_group"))
    return {"test": result}, {"boxplot": lambda: charts.chart_boxplot_by(df, y, p["group_col"])}


def _anova(df, p):
    y, group = str(p.get("y")), str(p.get("group_col"))
    test = anova_oneway(df, y, group, null_group=p.get("null_group"))
    return (yield from finished(({"test": test}, {"boxplot": lambda: charts.chart_boxplot_by(df, y, group)})))


def _nonparam(df, p):
    test = str(p.get("test") or "").lower()
    y, group, null_group = p.get("y"), p.get("group_col"), p.get("null_group")
    box = {"boxplot": lambda: charts.chart_boxplot_by(df, y, group)}
    if test in ("mann_whitney", "mannwhitney"):
        return {"test": mann_whitney(df, y, group, p.get("group_a"), p.get("group_b"), null_group=null_group)}, box
    if test in ("kruskal", "kruskal_wallis"):
        return {"test": kruskal_wallis(df, y, group, null_group=null_group)}, box
    if test == "friedman":
        names = _names(p, "columns")
        table = yield from friedman_steps(df, names)
        return {"test": table}, {"boxplot": lambda: charts.chart_boxplot(df, names)}
    raise AnalysisError("unsupported_test", test)


def _correlation(df, p):
    names = correlation_columns(df, _names(p, "columns"))
    pairs = yield from correlation_steps(df, names, str(p.get("method", "pearson")))
    matrix = correlation_matrix(pairs, names)
    return {"matrix": matrix, "top_pairs": top_pairs(pairs)}, {"heatmap": lambda: matrix}


def _linear(df, p):
    fit = yield from linear_steps(df, str(p.get("y")), _names(p, "x"))
    return {"info": fit.info(), "coefficients": fit.coefficients()}, \
        {"scatter": lambda: charts.chart_scatter(fit.fitted(), "actual", "predicted")}


def _logistic(df, p):
    fit = logistic_regression(df, str(p.get("y")), _names(p, "x"))
    tables = {"info": fit.info(), "coefficients": fit.coefficients(), "auc": roc_auc(fit.scores(), "label", "score")}
    return (yield from finished((tables, {"roc": lambda: roc_curve(fit.scores(), "label", "score")})))


def _pca(df, p):
    fit = pca(df, _names(p, "columns"), int(p.get("n_components", 2)))
    return (yield from finished(({"variance": fit.variance(), "loadings": fit.loadings()},
                                 {"scree": fit.variance, "scatter": lambda: charts.chart_pca_scatter(fit)})))


def _kmeans(df, p):
    fit = kmeans(df, _names(p, "columns"), int(p.get("k", 3)), seed=int(p.get("seed", 42)))
    return (yield from finished(({"info": fit.info(), "sizes": fit.sizes(), "centers": fit.centers()},
                                 {"scatter": lambda: charts.chart_cluster_scatter(fit)})))


ANALYSES: dict[str, Callable] = {
    "overview": _overview, "descriptive": _descriptive, "frequency": _frequency, "crosstab": _crosstab,
    "group_summary": _group_summary, "normality": _normality, "correlation": _correlation,
    "linear_regression": _linear, "logistic_regression": _logistic, "pca": _pca, "kmeans": _kmeans,
    "ttest": _ttest, "anova": _anova, "chi_square": _crosstab, "nonparam": _nonparam,
}
# Other names of the analyses.
ALIASES = {
    "data_overview": "overview", "freq": "frequency", "contingency": "crosstab", "describe": "descriptive",
    "groupby": "group_summary", "normal_test": "normality", "t_test": "ttest", "anova_oneway": "anova",
    "chi2": "chi_square", "non_param": "nonparam", "corr": "correlation", "linreg": "linear_regression",
    "ols": "linear_regression", "k_means": "kmeans", "logit": "logistic_regression",
}


def steps_of(df: DataFrame, analysis: str, params: dict[str, Any] | None = None) -> Steps:
    """The named analysis as steps that end in an AnalysisResult."""
    name = (analysis or "").strip().lower()
    name = ALIASES.get(name, name)
    if name not in ANALYSES:
        raise AnalysisError("unsupported_analysis", analysis)
    tables, drawings = yield from ANALYSES[name](df, dict(params or {}))
    return AnalysisResult(name, tables, drawings)


def run_analysis(df: DataFrame, analysis: str, params: dict[str, Any] | None = None) -> AnalysisResult:
    return solve(df, steps_of(df, analysis, params))
