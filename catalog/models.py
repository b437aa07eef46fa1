"""Regressions, ROC curves, principal components, clusters and forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import GAPPY_CUSTOMER, gappy_customer, query, rounded, table
from tabulon.operators import automl, charts
from tabulon.operators.linear import fit_linear_regression, linear_regression
from tabulon.operators.logistic import logistic_regression, roc_auc, roc_curve, roc_points
from tabulon.operators.multivariate import kmeans, pca

# Normal equations of l_extendedprice on l_quantity and l_discount, by covariances.
_OLS = """
    WITH c AS (SELECT count(*)::DOUBLE AS n, covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_discount) AS s12,
                      covar_pop(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_extendedprice) AS s1y,
                      covar_pop(l_discount, l_extendedprice) AS s2y, var_pop(l_extendedprice) AS syy,
                      avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem),
         b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
                      (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c),
         e AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, 1 - (syy - b1 * s1y - b2 * s2y) / syy AS r2,
                      n * (syy - b1 * s1y - b2 * s2y) / (n - 3) AS mse FROM b)"""


def _ols(spark, sf, fit=linear_regression):
    return fit(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])


@query("linreg_coef", _OLS + """
    SELECT 'intercept' AS term, round(b0, 4) AS coef FROM e UNION ALL SELECT 'l_quantity', round(b1, 4) FROM e
    UNION ALL SELECT 'l_discount', round(b2, 4) FROM e""")
def _linreg_coef(spark, sf):
    return rounded(_ols(spark, sf).coefficients(), 4, "coef").select("term", "coef")


@query("linreg_info", _OLS + """
    SELECT 'l_extendedprice' AS y, 'l_quantity, l_discount' AS x, n::BIGINT AS n, round(r2, 8) AS r2,
           round(1 - (1 - r2) * (n - 1) / (n - 3), 8) AS adj_r2 FROM e""")
def _linreg_info(spark, sf):
    return rounded(_ols(spark, sf).info(), 8, "r2", "adj_r2")


@query("linreg_ci", _OLS + """
    SELECT 'l_quantity' AS term, round(b1, 4) AS coef, round(sqrt(mse * s22 / (s11 * s22 - s12 * s12) / n), 5) AS se,
           round(b1 / sqrt(mse * s22 / (s11 * s22 - s12 * s12) / n), 3) AS t FROM e
    UNION ALL
    SELECT 'l_discount', round(b2, 4), round(sqrt(mse * s11 / (s11 * s22 - s12 * s12) / n), 5),
           round(b2 / sqrt(mse * s11 / (s11 * s22 - s12 * s12) / n), 3) FROM e""")
def _linreg_ci(spark, sf):
    df = _ols(spark, sf, fit_linear_regression).coefficients().where("term <> 'intercept'")
    return rounded(rounded(rounded(df, 4, "coef"), 5, "se"), 3, "t").select("term", "coef", "se", "t")


@query("linreg_intervals")
def _linreg_intervals(spark, sf):
    return _ols(spark, sf, fit_linear_regression).coefficients()


@query("linreg_predicted", _OLS + """
    SELECT l_extendedprice AS actual, round(b0 + b1 * l_quantity + b2 * l_discount, 3) AS predicted FROM lineitem, e""")
def _linreg_predicted(spark, sf):
    return rounded(_ols(spark, sf).fitted(), 3, "predicted")


_LABELLED = "(SELECT quality, toxic, n_chars FROM labels JOIN documents USING (doc_id))"


def _labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")


@query("logit_coef")
def _logit_coef(spark, sf):
    return logistic_regression(_labelled(spark, sf), "quality", ["n_chars", "toxic"]).coefficients()


@query("logit_info")
def _logit_info(spark, sf):
    return logistic_regression(_labelled(spark, sf), "quality", ["n_chars", "toxic"]).info()


@query("roc_auc", f"""
    WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS mid
               FROM {_LABELLED}),
         s AS (SELECT sum(quality)::BIGINT AS n_pos, sum(1 - quality)::BIGINT AS n_neg, sum(quality * mid) AS ranks FROM r)
    SELECT n_pos, n_neg, round((ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 8) AS auc FROM s""")
def _roc_auc(spark, sf):
    return rounded(roc_auc(_labelled(spark, sf), "quality", "n_chars"), 8, "auc")


@query("roc_points", f"""
    WITH d AS (SELECT n_chars AS s, sum(quality) AS p, sum(1 - quality) AS n FROM {_LABELLED} GROUP BY 1)
    SELECT s::DOUBLE AS threshold, round(sum(n) OVER w / sum(n) OVER (), 8) AS fpr,
           round(sum(p) OVER w / sum(p) OVER (), 8) AS tpr FROM d WINDOW w AS (ORDER BY s DESC)""")
def _roc_points(spark, sf):
    return rounded(roc_points(_labelled(spark, sf), "quality", "n_chars"), 8, "fpr", "tpr")


@query("roc_curve", f"""
    WITH d AS (SELECT n_chars AS s, sum(quality) AS p, sum(1 - quality) AS n FROM {_LABELLED} GROUP BY 1),
         c AS (SELECT s::DOUBLE AS threshold, sum(n) OVER w / sum(n) OVER () AS fpr, sum(p) OVER w / sum(p) OVER () AS tpr
               FROM d WINDOW w AS (ORDER BY s DESC)),
         k AS (SELECT *, row_number() OVER (PARTITION BY floor((fpr + tpr) / 2 * 50) ORDER BY threshold) AS up,
                      row_number() OVER (PARTITION BY floor((fpr + tpr) / 2 * 50) ORDER BY threshold DESC) AS down FROM c)
    SELECT threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM k WHERE up = 1 OR down = 1
    UNION ALL SELECT NULL, 0.0, 0.0""")
def _roc_curve(spark, sf):
    return rounded(roc_curve(_labelled(spark, sf), "quality", "n_chars", 50), 8, "fpr", "tpr")


# With one 0/1 column the likelihood is largest at the log odds of the four counts.
@query("logit_two_by_two", """
    WITH c AS (SELECT count_if(quality = 1 AND toxic = 1)::DOUBLE AS a, count_if(quality = 0 AND toxic = 1)::DOUBLE AS b,
                      count_if(quality = 1 AND toxic = 0)::DOUBLE AS c, count_if(quality = 0 AND toxic = 0)::DOUBLE AS d FROM labels),
         t AS (SELECT 'intercept' AS term, ln(c / d) AS coef, sqrt(1 / c + 1 / d) AS se FROM c
               UNION ALL SELECT 'toxic', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM c)
    SELECT term, round(coef, 6) AS coef, round(exp(coef), 6) AS odds_ratio, round(exp(coef - 1.959963984540054 * se), 6) AS or_low,
           round(exp(coef + 1.959963984540054 * se), 6) AS or_high FROM t""")
def _logit_two_by_two(spark, sf):
    fit = logistic_regression(table(spark, sf, "labels"), "quality", ["toxic"])
    return rounded(fit.coefficients().drop("p"), 6, "coef", "odds_ratio", "or_low", "or_high")


@query("pca_variance", """
    WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
    SELECT 'PC1' AS component, round((1 + r) / 2, 6) AS ratio, round((1 + r) / 2, 6) AS cumulative FROM c
    UNION ALL SELECT 'PC2', round((1 - r) / 2, 6), 1.0 FROM c""")
def _pca_variance(spark, sf):
    return rounded(pca(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).variance(), 6,
                   "ratio", "cumulative")


def _vectors(spark, sf, width: int = 64):
    df = table(spark, sf, "embeddings")
    return df.select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)])


@query("pca_loadings")
def _pca_loadings(spark, sf):
    return pca(_vectors(spark, sf), [f"e{i}" for i in range(64)], 5).loadings()


@query("pca_scatter")
def _pca_scatter(spark, sf):
    fit = pca(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return charts.chart_pca_scatter(fit, n=1000)


def _clusters(spark, sf):
    return kmeans(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 3)


@query("kmeans_sizes")
def _kmeans_sizes(spark, sf):
    return _clusters(spark, sf).sizes()


@query("kmeans_info")
def _kmeans_info(spark, sf):
    return _clusters(spark, sf).info()


@query("kmeans_centers")
def _kmeans_centers(spark, sf):
    return kmeans(_vectors(spark, sf), [f"e{i}" for i in range(64)], 4).centers()


@query("kmeans_scatter")
def _kmeans_scatter(spark, sf):
    return charts.chart_cluster_scatter(_clusters(spark, sf), n=1000)


@query("ml_preprocess", f"""
    WITH f AS (SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey,
                      coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {GAPPY_CUSTOMER})) AS c_acctbal,
                      coalesce(c_mktsegment, (SELECT c_mktsegment FROM {GAPPY_CUSTOMER} WHERE c_mktsegment IS NOT NULL
                               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM {GAPPY_CUSTOMER})
    SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::DOUBLE AS c_name, c_nationkey,
           round(c_acctbal, 4) AS c_acctbal, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c_mktsegment FROM f""")
def _preprocess(spark, sf):
    return rounded(automl.preprocess(gappy_customer(spark, sf)), 4, "c_acctbal")


@query("ml_regression_metrics")
def _ml_regression(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    return automl.ml_regression(df, "l_extendedprice").metrics()


@query("ml_classification_metrics")
def _ml_classification(spark, sf):
    df = table(spark, sf, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    return automl.ml_classification(df, "c_mktsegment").metrics()


@query("ml_confusion")
def _ml_confusion(spark, sf):
    df = table(spark, sf, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    return automl.ml_classification(df, "c_mktsegment").confusion()


@query("confusion_matrix", """
    SELECT quality::VARCHAR AS label, (n_chars > 500)::INT::VARCHAR AS prediction, count(*) AS n
    FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
def _confusion(spark, sf):
    df = _labelled(spark, sf).withColumn("called", (F.col("n_chars") > 500).cast("int"))
    return automl.confusion_matrix(df, "quality", "called")


@query("ml_clustering_sizes")
def _ml_clustering(spark, sf):
    return automl.ml_clustering(table(spark, sf, "supplier").drop("s_name"), 3).sizes()
