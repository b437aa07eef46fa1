"""Hypothesis tests and correlations. The SQL states the statistic; p-values are checked in the tests."""

from __future__ import annotations

from catalog.base import GAPPY_LINEITEM, gappy_lineitem, query, rounded, table
from tabulon.operators import parametric, rank_tests
from tabulon.operators.correlation import correlation, correlation_matrix
from pyspark.sql import functions as F

_MOMENTS = """
    SELECT n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS k FROM (
        SELECT count(*) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4
        FROM (SELECT o_totalprice AS x, (SELECT avg(o_totalprice) FROM orders) AS m FROM orders))"""


@query("normality_jb", f"""
    SELECT 'o_totalprice' AS "column", n, 'jarque_bera' AS method, round(n / 6.0 * (s * s + k * k / 4), 4) AS stat,
           round(exp(-n / 12.0 * (s * s + k * k / 4)), 8) AS p, exp(-n / 12.0 * (s * s + k * k / 4)) < 0.05 AS rejected
    FROM ({_MOMENTS})""")
def _jb(spark, sf):
    return rounded(parametric.normality(table(spark, sf, "orders"), "o_totalprice", "jarque_bera"), 4, "stat").drop("n_used").withColumn(
        "p", F.round("p", 8))


@query("normality_dagostino", f"""
    WITH m AS ({_MOMENTS}),
    a AS (SELECT n::DOUBLE AS n, k + 3 AS b2, s * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y FROM m),
    b AS (SELECT *, 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS be,
                 (b2 - 3 * (n - 1) / (n + 1))
                 / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
                 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
                 * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM a),
    c AS (SELECT *, sqrt(2 * (be - 1)) - 1 AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM b),
    d AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) AS z1,
                 (1 - 2 / (9 * aa) - cbrt((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS z2 FROM c)
    SELECT 'o_totalprice' AS "column", n::BIGINT AS n, 'normaltest' AS method, round(z1 * z1 + z2 * z2, 4) AS stat,
           round(exp(-(z1 * z1 + z2 * z2) / 2), 8) AS p, exp(-(z1 * z1 + z2 * z2) / 2) < 0.05 AS rejected FROM d""")
def _dagostino(spark, sf):
    return rounded(parametric.normality(table(spark, sf, "orders"), "o_totalprice", "normaltest"), 4, "stat").drop("n_used").withColumn(
        "p", F.round("p", 8))


@query("kruskal_many_groups", """
    WITH c AS (SELECT l_quantity AS v, l_suppkey AS g, count(*) AS n FROM lineitem GROUP BY 1, 2),
         v AS (SELECT v, sum(n)::DOUBLE AS t FROM c GROUP BY 1),
         r AS (SELECT v, t, sum(t) OVER (ORDER BY v) - (t - 1) / 2 AS r FROM v),
         s AS (SELECT g, sum(n)::DOUBLE AS n, sum(n * (r - ((SELECT count(*) FROM lineitem) + 1) / 2.0)) AS ranks
               FROM c JOIN r USING (v) GROUP BY 1),
         x AS (SELECT count(*) AS k, sum(n) AS n, sum(ranks * ranks / n) AS q FROM s),
         y AS (SELECT sum(t * t * t - t) AS ties FROM v)
    SELECT 'l_quantity' AS y, 'l_suppkey' AS "group", k, n::BIGINT AS n,
           round(12 / (n * (n + 1)) * q / (1 - ties / (n * n * n - n)), 6) AS h FROM x, y""")
def _kruskal_many(spark, sf):
    return rounded(rank_tests.kruskal_wallis(table(spark, sf, "lineitem"), "l_quantity", "l_suppkey"), 6, "h").drop("p")


@query("normality_shapiro")
def _shapiro(spark, sf):
    return parametric.normality(table(spark, sf, "lineitem"), "l_extendedprice", "shapiro")


@query("normality_auto")
def _normality_auto(spark, sf):
    return parametric.normality(table(spark, sf, "customer"), "c_acctbal", "auto")


@query("ttest_one_sample", """
    SELECT 'c_acctbal' AS y, 4500.0::DOUBLE AS mu, count(*) AS n,
           round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(*))), 6) AS t FROM customer""")
def _one_sample(spark, sf):
    return rounded(parametric.ttest_one_sample(table(spark, sf, "customer"), "c_acctbal", 4500.0), 6, "t").drop("p")


@query("ttest_paired", f"""
    SELECT 'l_discount' AS y, 'l_tax' AS y2, count(*) AS n,
           round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS t
    FROM {GAPPY_LINEITEM} WHERE l_discount IS NOT NULL""")
def _paired(spark, sf):
    return rounded(parametric.ttest_paired(gappy_lineitem(spark, sf), "l_discount", "l_tax"), 6, "t").drop("p")


@query("ttest_welch", f"""
    WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v,
                      row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS place
               FROM {GAPPY_LINEITEM} WHERE l_returnflag IS NOT NULL GROUP BY 1)
    SELECT 'l_extendedprice' AS y, 'l_returnflag' AS "group", a.g AS group_a, a.n AS n_a, round(a.m, 4) AS mean_a,
           b.g AS group_b, b.n AS n_b, round(b.m, 4) AS mean_b,
           round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t
    FROM g a, g b WHERE a.place = 1 AND b.place = 2""")
def _welch(spark, sf):
    result = parametric.ttest_welch(gappy_lineitem(spark, sf), "l_extendedprice", "l_returnflag").drop("p")
    return rounded(rounded(result, 4, "mean_a", "mean_b"), 6, "t")


@query("anova_oneway", """
    WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v
               FROM orders GROUP BY 1),
         s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * v) AS w, sum(n * m) / sum(n) AS m FROM g)
    SELECT 'o_totalprice' AS y, 'o_orderpriority' AS "group", any_value(s.k) AS k, any_value(s.n)::BIGINT AS n,
           round((sum(g.n * pow(g.m - s.m, 2)) / (any_value(s.k) - 1))
                 / (any_value(s.w) / (any_value(s.n) - any_value(s.k))), 6) AS f
    FROM g, s""")
def _anova(spark, sf):
    return rounded(parametric.anova_oneway(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 6, "f").drop("p")


@query("chi_square", """
    WITH c AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY 1, 2),
         r AS (SELECT r, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT c, sum(n) AS cn FROM c GROUP BY 1),
         x AS (SELECT sum(pow(coalesce(c.n, 0) - e, 2) / e) AS chi2 FROM (
                   SELECT r.r, k.c, rn * cn / (SELECT sum(n) FROM c)::DOUBLE AS e FROM r, k) LEFT JOIN c USING (r, c))
    SELECT 'l_returnflag' AS "row", 'l_linestatus' AS col, (SELECT count(*) FROM lineitem) AS n,
           round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 8) AS p, 2::BIGINT AS dof FROM x""")
def _chi_square(spark, sf):
    result = parametric.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(rounded(result, 6, "chi2"), 8, "p")


@query("chi_square_2x2", """
    WITH c AS (SELECT quality AS r, toxic AS c, count(*) AS n FROM labels GROUP BY 1, 2),
         r AS (SELECT r, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT c, sum(n) AS cn FROM c GROUP BY 1),
         e AS (SELECT r.r, k.c, rn * cn / (SELECT sum(n) FROM c)::DOUBLE AS e FROM r, k),
         d AS (SELECT e, abs(coalesce(c.n, 0) - e) AS gap FROM e LEFT JOIN c USING (r, c))
    SELECT 'quality' AS "row", 'toxic' AS col, (SELECT count(*) FROM labels) AS n,
           round(sum(pow(gap - least(0.5, gap), 2) / e), 6) AS chi2, 1::BIGINT AS dof FROM d""")
def _chi_square_2x2(spark, sf):
    return rounded(parametric.chi_square(table(spark, sf, "labels"), "quality", "toxic"), 6, "chi2").drop("p")


def _mid_ranks(source: str, value: str, where: str) -> str:
    return f"""SELECT *, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS mid,
                      count(*) OVER (PARTITION BY {value}) AS ties FROM {source} WHERE {where}"""


@query("mann_whitney", f"""
    WITH r AS ({_mid_ranks("lineitem", "l_extendedprice", "l_returnflag IN ('A', 'R')")})
    SELECT 'l_extendedprice' AS y, 'l_returnflag' AS "group", 'A' AS group_a, count(*) FILTER (l_returnflag = 'A') AS n_a,
           'R' AS group_b, count(*) FILTER (l_returnflag = 'R') AS n_b,
           sum(mid) FILTER (l_returnflag = 'A') - count(*) FILTER (l_returnflag = 'A')
               * (count(*) FILTER (l_returnflag = 'A') + 1) / 2.0 AS u FROM r""")
def _mann_whitney(spark, sf):
    return rank_tests.mann_whitney(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R").drop("p")


@query("kruskal_wallis", f"""
    WITH r AS ({_mid_ranks("lineitem", "l_quantity", "true")}),
         g AS (SELECT l_returnflag, count(*)::DOUBLE AS n, sum(mid) AS s FROM r GROUP BY 1),
         t AS (SELECT count(*)::DOUBLE AS n, sum(ties::DOUBLE * ties - 1) AS tie FROM r),
         h AS (SELECT count(*) AS k, any_value(t.n) AS n,
                      (12 / (any_value(t.n) * (any_value(t.n) + 1)) * sum(s * s / g.n) - 3 * (any_value(t.n) + 1))
                      / (1 - any_value(tie) / (pow(any_value(t.n), 3) - any_value(t.n))) AS h FROM g, t)
    SELECT 'l_quantity' AS y, 'l_returnflag' AS "group", k, n::BIGINT AS n, round(h, 5) AS h,
           round(exp(-h / 2), 6) AS p FROM h""")
def _kruskal(spark, sf):
    result = rank_tests.kruskal_wallis(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag")
    return rounded(rounded(result, 5, "h"), 6, "p")


@query("friedman", """
    WITH v AS (SELECT l_quantity AS a, l_discount * 500 AS b, l_tax * 600 AS c FROM lineitem),
         r AS (SELECT (b < a)::INT + (c < a)::INT + ((b = a)::INT + (c = a)::INT) / 2.0 + 1 AS ra,
                      (a < b)::INT + (c < b)::INT + ((a = b)::INT + (c = b)::INT) / 2.0 + 1 AS rb,
                      (a < c)::INT + (b < c)::INT + ((a = c)::INT + (b = c)::INT) / 2.0 + 1 AS rc,
                      CASE WHEN a = b AND b = c THEN 24 WHEN a = b OR b = c OR a = c THEN 6 ELSE 0 END AS tie FROM v),
         q AS (SELECT count(*)::DOUBLE AS n, pow(sum(ra), 2) + pow(sum(rb), 2) + pow(sum(rc), 2) AS s, sum(tie) AS tie FROM r)
    SELECT 3::BIGINT AS k, n::BIGINT AS n, round(q, 5) AS q, round(exp(-q / 2), 6) AS p FROM (
        SELECT n, (12 / (n * 12) * s - 12 * n) / (1 - tie / (n * 24)) AS q FROM q)""")
def _friedman(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"), (F.col("l_tax") * 600).alias("c"))
    return rounded(rounded(rank_tests.friedman(df, ["a", "b", "c"]), 5, "q"), 6, "p")


_PAIRS = (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
_NAMES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("corr_pearson", " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r,
        count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {GAPPY_LINEITEM}""" for a, b in _PAIRS))
def _pearson(spark, sf):
    return rounded(correlation(gappy_lineitem(spark, sf), _NAMES), 6, "r").drop("p")


@query("corr_spearman", " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) + 0.0 AS r, count(*) AS n FROM (
        SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
               rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
        FROM {GAPPY_LINEITEM} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in _PAIRS))
def _spearman(spark, sf):
    return rounded(correlation(gappy_lineitem(spark, sf), _NAMES, "spearman"), 6, "r").drop("p")


@query("corr_spearman_complete", """
    SELECT 'o_custkey' AS a, 'o_totalprice' AS b, round(corr(ra, rb), 6) + 0.0 AS r, count(*) AS n FROM (
        SELECT rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS ra,
               rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rb
        FROM orders)""")
def _spearman_complete(spark, sf):
    return rounded(correlation(table(spark, sf, "orders"), ["o_custkey", "o_totalprice"], "spearman"), 6, "r").drop("p")


@query("corr_kendall", """
    WITH p AS (SELECT sign(a.c_acctbal - b.c_acctbal) AS x, sign(a.c_nationkey - b.c_nationkey) AS y
               FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey)
    SELECT 'c_acctbal' AS a, 'c_nationkey' AS b,
           round(sum(x * y) / sqrt(sum(x * x)::DOUBLE * sum(y * y)), 6) AS r, (SELECT count(*) FROM customer) AS n FROM p""")
def _kendall(spark, sf):
    return rounded(correlation(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "kendall"), 6, "r").drop("p")


@query("corr_kendall_lineitem")
def _kendall_lineitem(spark, sf):
    return correlation(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], "kendall")


@query("corr_matrix", """
    WITH c AS (SELECT round(corr(p_size, p_retailprice), 6) AS r FROM part)
    SELECT 'p_size' AS a, 'p_size' AS b, 1.0::DOUBLE AS r UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1.0
    UNION ALL SELECT 'p_size', 'p_retailprice', r FROM c UNION ALL SELECT 'p_retailprice', 'p_size', r FROM c""")
def _matrix(spark, sf):
    names = ["p_size", "p_retailprice"]
    return rounded(correlation_matrix(correlation(table(spark, sf, "part"), names), names), 6, "r").drop("p")
