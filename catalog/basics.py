"""Sources, projections, samples, profiles and descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    GAPPY_CUSTOMER, GAPPY_LINEITEM, gappy_customer, gappy_lineitem, query, rounded, table,
)
from tabulon.functions.columns import normalize_missing, to_numeric
from tabulon.operators import charts, describe, profiling, select
from tabulon.plans.analyses import run_analysis
from tabulon.plans.dataset import Dataset
from tabulon.plans.report import run_report
from tabulon.sources.readers import read_csv, read_json, read_parquet
from tabulon.sources.writers import shared_folder, write_csv

# ---------------------------------------------------------------------------- sources


@query("read_csv", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _read_csv(spark, sf):
    path = shared_folder(spark)
    write_csv(table(spark, sf, "customer"), path)
    df = read_csv(spark, path)
    return df.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("long"), "c_acctbal",
                     "c_mktsegment")


@query("read_json", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def _read_json(spark, sf):
    path = shared_folder(spark)
    table(spark, sf, "supplier").write.json(path)
    return read_json(spark, path, lines=True).select(
        "s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("double"))


@query("read_parquet", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
    FROM orders""")
def _read_parquet(spark, sf):
    return read_parquet(spark, f"{sf}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@query("normalize_missing", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_discount <> 0 THEN l_discount END AS a, CASE WHEN l_tax <> 0 THEN l_tax END AS b,
           CASE WHEN l_quantity <> 1 THEN l_quantity END AS c
    FROM lineitem""")
def _normalize_missing(spark, sf):
    bad = lambda c, at, value: F.when(F.col(c) == at, F.lit(value)).otherwise(F.col(c))
    return normalize_missing(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        bad("l_discount", 0, float("nan")).alias("a"), bad("l_tax", 0, float("inf")).alias("b"),
        bad("l_quantity", 1, float("-inf")).alias("c")))


# ---------------------------------------------------------------------------- selection


@query("select_columns", "SELECT o_totalprice, o_orderkey FROM orders")
def _select_columns(spark, sf):
    return select.select_columns(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey", "nope", "o_totalprice"])


@query("sample_rows")
def _sample_rows(spark, sf):
    return select.sample_rows(table(spark, sf, "events"), 500, ["event_id"])


@query("preview", f"""
    SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey,
           coalesce(c_mktsegment, '') AS c_mktsegment
    FROM {GAPPY_CUSTOMER} ORDER BY c_custkey::BIGINT LIMIT 2000""")
def _preview(spark, sf):
    return select.preview(gappy_customer(spark, sf).drop("c_acctbal"), ["c_custkey"])


@query("to_numeric", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE l_linenumber WHEN 1 THEN l_extendedprice WHEN 2 THEN NULL WHEN 3 THEN 1000 WHEN 4 THEN NULL
                             WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE l_quantity END AS x
    FROM lineitem""")
def _to_numeric(spark, sf):
    df = table(spark, sf, "lineitem")
    text = (F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice").cast("string"))
            .when(F.col("l_linenumber") == 2, "1d").when(F.col("l_linenumber") == 3, "\t1e3 ")
            .when(F.col("l_linenumber") == 4, "1,000").when(F.col("l_linenumber") == 5, "inf")
            .when(F.col("l_linenumber") == 6, "NaN").otherwise(F.col("l_quantity").cast("string")))
    df = df.withColumn("t", text)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", to_numeric(df, "t").alias("x"))


@query("filter_groups", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _filter_groups(spark, sf):
    return select.filter_groups(table(spark, sf, "orders"), "o_orderstatus", ["F", "P"]).select(
        "o_orderkey", "o_orderstatus")


@query("listwise_complete", f"""
    SELECT c_custkey::DOUBLE AS c_custkey, c_acctbal FROM {GAPPY_CUSTOMER} WHERE c_acctbal IS NOT NULL""")
def _listwise(spark, sf):
    return select.listwise_complete(gappy_customer(spark, sf), ["c_custkey", "c_acctbal"])


@query("pairwise_complete", f"""
    SELECT l_discount, l_tax FROM {GAPPY_LINEITEM} WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def _pairwise(spark, sf):
    return select.pairwise_complete(gappy_lineitem(spark, sf), "l_discount", "l_tax")


@query("top_groups", """
    SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 2""")
def _top_groups(spark, sf):
    return select.top_groups(table(spark, sf, "events"), "event_type")


@query("melt", f"""
    SELECT 'l_quantity' AS variable, l_quantity AS value FROM {GAPPY_LINEITEM}
    UNION ALL SELECT 'l_discount', l_discount FROM {GAPPY_LINEITEM} WHERE l_discount IS NOT NULL""")
def _melt(spark, sf):
    return select.melt(gappy_lineitem(spark, sf), ["l_quantity", "l_discount"])


# ---------------------------------------------------------------------------- profiles

_CUSTOMER_TYPES = (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                   ("c_mktsegment", "string"))


def _per_column(expression: str, source: str = GAPPY_CUSTOMER) -> str:
    """One SELECT per column, where {c} is the column and {t} its type."""
    return " UNION ALL ".join(
        f"SELECT {expression.format(c=c, t=t)} FROM {source}" for c, t in _CUSTOMER_TYPES)


_MISSING = "100.0 * (count(*) - count({c})) / count(*)"


@query("overview", _per_column(
    "'{c}' AS \"column\", '{t}' AS dtype, round(" + _MISSING + ", 2) AS missing_pct, count(DISTINCT {c}) AS n_distinct"))
def _overview(spark, sf):
    return profiling.overview(gappy_customer(spark, sf))


@query("profile_columns", _per_column(
    "'{c}' AS \"column\", '{t}' AS dtype, round(" + _MISSING + ", 6) AS missing_pct, count(DISTINCT {c}) AS n_distinct, "
    "array_to_string([left(x, 30) FOR x IN list_slice(list_sort(list(DISTINCT {c}::VARCHAR) "
    "FILTER ({c} IS NOT NULL)), 1, 3)], '|') AS examples"))
def _profile_columns(spark, sf):
    df = rounded(profiling.profile_columns(gappy_customer(spark, sf)), 6, "missing_pct")
    return df.withColumn("examples", F.array_join("examples", "|"))


@query("profile_numeric", """
    SELECT 'l_quantity' AS "column", round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std,
           min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
    UNION ALL
    SELECT 'l_extendedprice', round(avg(l_extendedprice), 4), round(stddev_samp(l_extendedprice), 4),
           min(l_extendedprice), max(l_extendedprice) FROM lineitem""")
def _profile_numeric(spark, sf):
    df = profiling.profile_numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(df, 4, "mean", "std")


# Documents without their id hold exact copies.
_COPIES = "(SELECT text, lang FROM documents)"


@query("duplicate_rows", f"""
    SELECT (SELECT count(*) FROM documents) AS n_rows, sum(n - 1)::BIGINT AS n_duplicates,
           round(100.0 * sum(n - 1) / sum(n), 2) AS dup_pct
    FROM (SELECT count(*) AS n FROM {_COPIES} GROUP BY text, lang)""")
def _duplicate_rows(spark, sf):
    return profiling.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


@query("health_summary", f"""
    WITH d AS ({_per_column("'{c}' AS c, count(DISTINCT {c}) AS nd, count(*) AS n")}),
         o AS (SELECT * FROM d)
    SELECT max(n) AS n_rows, 5::BIGINT AS n_cols, 0.0::DOUBLE AS dup_pct, 3::BIGINT AS n_numeric,
           2::BIGINT AS n_categorical, 0::BIGINT AS n_datetime, 0::BIGINT AS n_bool, 0::BIGINT AS n_other,
           'c_custkey|c_nationkey|c_acctbal' AS numeric_cols,
           'c_name|c_mktsegment' AS categorical_cols,
           '' AS binary_cols,
           string_agg(c, '|' ORDER BY c DESC) FILTER (nd >= greatest(20, floor(n * 0.9))) AS id_like_cols,
           '' AS constant_cols, '' AS datetime_like_cols
    FROM o""")
def _health(spark, sf):
    df = profiling.health_summary(gappy_customer(spark, sf))
    lists = [c for c in df.columns if c.endswith("_cols") and c != "n_cols"]
    return df.withColumns({c: F.array_join(F.reverse(F.array_sort(c)) if c == "id_like_cols" else F.col(c), "|")
                           for c in lists})


@query("column_profile", """
    SELECT 'o_totalprice' AS "column", 'double' AS dtype, 0.0::DOUBLE AS missing_pct,
           count(DISTINCT o_totalprice) AS n_distinct, round(avg(o_totalprice), 3) AS mean,
           round(stddev_samp(o_totalprice), 3) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders
    UNION ALL
    SELECT 'o_orderstatus', 'string', 0.0, count(DISTINCT o_orderstatus), NULL, NULL, NULL, NULL FROM orders""")
def _column_profile(spark, sf):
    return rounded(profiling.column_profile(table(spark, sf, "orders"), ["o_totalprice", "o_orderstatus"]), 3,
                   "mean", "std")


@query("column_head", """
    SELECT o_totalprice::VARCHAR AS o_totalprice, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 8""")
def _column_head(spark, sf):
    return profiling.column_head(table(spark, sf, "orders"), ["o_totalprice", "o_orderstatus"], ["o_orderkey"])


@query("table_shape", "SELECT count(*) AS n_rows, 11::BIGINT AS n_cols FROM lineitem")
def _table_shape(spark, sf):
    return profiling.table_shape(table(spark, sf, "lineitem"))


@query("column_stats", """
    SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 3) AS median,
           max(o_totalprice) AS max, min(o_totalprice) AS min, round(stddev_samp(o_totalprice), 3) AS std,
           round(var_samp(o_totalprice) / 1e6, 3) AS var FROM orders""")
def _column_stats(spark, sf):
    df = profiling.column_stats(table(spark, sf, "orders"), "o_totalprice").withColumn("var", F.col("var") / 1e6)
    return rounded(df, 3, "mean", "median", "std", "var").select("n", "mean", "median", "max", "min", "std", "var")


# ---------------------------------------------------------------------------- description


@query("frequency", f"""
    SELECT coalesce(c_mktsegment, '缺失') AS value, count(*) AS n,
           round(100.0 * count(*) / (SELECT count(*) FROM customer), 2) AS pct
    FROM {GAPPY_CUSTOMER} GROUP BY 1 ORDER BY n DESC, value LIMIT 30""")
def _frequency(spark, sf):
    return describe.frequency(gappy_customer(spark, sf), "c_mktsegment")


@query("crosstab", f"""
    SELECT coalesce(l_returnflag, '缺失') AS l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F",
           count(*) FILTER (l_linestatus = 'O') AS "O"
    FROM {GAPPY_LINEITEM} GROUP BY 1""")
def _crosstab(spark, sf):
    return describe.crosstab(gappy_lineitem(spark, sf), "l_returnflag", "l_linestatus")


@query("crosstab_long", """
    SELECT lang AS "row", source AS col, count(*) AS n FROM documents GROUP BY 1, 2""")
def _crosstab_long(spark, sf):
    return describe.crosstab_long(table(spark, sf, "documents"), "lang", "source")


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
        round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max,
        round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, round(median({c}), 4) AS median
        FROM {GAPPY_LINEITEM}"""


@query("descriptive", " UNION ALL ".join(_describe_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _descriptive(spark, sf):
    df = describe.descriptive(gappy_lineitem(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(df, 4, "mean", "std", "q25", "q50", "q75", "median")


def _register_group_summary(agg: str, expression: str) -> None:
    @query(f"group_summary_{agg}", f"""
        SELECT coalesce(l_returnflag, '缺失') AS l_returnflag, {expression} AS l_extendedprice
        FROM {GAPPY_LINEITEM} GROUP BY 1""")
    def _run(spark, sf):
        df = describe.group_summary(gappy_lineitem(spark, sf), "l_returnflag", "l_extendedprice", agg)
        return df if agg == "count" else rounded(df, 4 if agg == "median" else 2, "l_extendedprice")


for _agg, _sql in (("mean", "round(avg(l_extendedprice), 2)"), ("median", "round(median(l_extendedprice), 4)"),
                   ("sum", "round(sum(l_extendedprice), 2)"), ("count", "count(l_extendedprice)")):
    _register_group_summary(_agg, _sql)


# ---------------------------------------------------------------------------- chart data


@query("chart_missing", _per_column("'{c}' AS \"column\", round(" + _MISSING + ", 2) AS missing_pct"))
def _chart_missing(spark, sf):
    return charts.chart_missing(gappy_customer(spark, sf))


def _box_sql(source: str, variable: str, c: str, group: str = "") -> str:
    keys = f"{group} AS grp" if group else "1 AS grp"
    return f"""
    SELECT {variable}, count(*) AS n, round(any_value(q[1]), 4) AS q1, round(any_value(q[2]), 4) AS median,
           round(any_value(q[3]), 4) AS q3,
           min({c}) FILTER ({c} BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS whisker_low,
           max({c}) FILTER ({c} BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS whisker_high,
           count(*) FILTER (NOT {c} BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS n_outliers
    FROM (SELECT {keys}, {c} FROM {source} WHERE {c} IS NOT NULL)
    JOIN (SELECT {keys}, quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM {source} GROUP BY 1) USING (grp)
    GROUP BY grp"""


@query("chart_boxplot", " UNION ALL ".join(
    _box_sql(GAPPY_LINEITEM, f"'{c}' AS variable", c) for c in ("l_extendedprice", "l_discount")))
def _chart_boxplot(spark, sf):
    df = charts.chart_boxplot(gappy_lineitem(spark, sf), ["l_extendedprice", "l_discount"])
    return rounded(df, 4, "q1", "median", "q3")


@query("chart_boxplot_by", _box_sql("orders", "grp AS \"group\"", "o_totalprice", "o_orderpriority"))
def _chart_boxplot_by(spark, sf):
    df = charts.chart_boxplot_by(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return rounded(df, 4, "q1", "median", "q3")


@query("chart_histogram", """
    WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
         b AS (SELECT least(floor((o_totalprice - lo) * 30 / (hi - lo)), 29)::INT AS bin, count(*) AS n
               FROM orders, s GROUP BY 1)
    SELECT range::INT AS bin, round(lo + range * (hi - lo) / 30, 4) AS low,
           round(lo + (range + 1) * (hi - lo) / 30, 4) AS high, coalesce(n, 0)::BIGINT AS n
    FROM range(30) CROSS JOIN s LEFT JOIN b ON b.bin = range""")
def _chart_histogram(spark, sf):
    return rounded(charts.chart_histogram(table(spark, sf, "orders"), "o_totalprice"), 4, "low", "high")


_PERCENTS = ", ".join(str(i / 100) for i in range(1, 100))


@query("chart_qq", f"""
    SELECT round(i / 100.0, 2) AS p, round(q[i], 6) AS sample
    FROM (SELECT quantile_cont(o_totalprice, [{_PERCENTS}]) AS q FROM orders), range(1, 100) t(i)""")
def _chart_qq(spark, sf):
    return rounded(charts.chart_qq(table(spark, sf, "orders"), "o_totalprice"), 6, "sample").select(
        F.round("p", 2).alias("p"), "sample")


@query("chart_scatter")
def _chart_scatter(spark, sf):
    return charts.chart_scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", n=1000)


@query("chart_group_top20", """
    SELECT source, round(avg(n_chars), 4) AS n_chars FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _chart_group_top(spark, sf):
    return rounded(charts.chart_group_top(table(spark, sf, "documents"), "source", "n_chars"), 4, "n_chars")


# ---------------------------------------------------------------------------- datasets and reports


@query("custom_transform", """
    SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent
    FROM orders GROUP BY o_custkey""")
def _custom_transform(spark, sf):
    per_customer = lambda df: df.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return Dataset(table(spark, sf, "orders")).transform(per_customer).df


@query("run_analysis_alias", """
    SELECT o_orderstatus AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 2) AS pct
    FROM orders GROUP BY 1""")
def _run_analysis(spark, sf):
    return run_analysis(table(spark, sf, "orders"), "freq", {"column": "o_orderstatus"}).tables["frequency"]


@query("report_batch", """
    SELECT * FROM (VALUES
        ('job1_overview', 'overview', 'done', 'overview', 6), ('job1_overview', 'overview', 'done', 'shape', 1),
        ('job2_frequency', 'frequency', 'done', 'frequency', (SELECT count(DISTINCT o_orderpriority) FROM orders)),
        ('job3_anova', 'anova', 'done', 'test', 1),
        ('job4_ttest', 'ttest', 'failed: missing_y', NULL, NULL::DOUBLE),
        ('job5_correlation', 'correlation', 'done', 'matrix', 9),
        ('job5_correlation', 'correlation', 'done', 'top_pairs', 3)) t(job, analysis, status, "table", n_rows)""")
def _report(spark, sf):
    return run_report(table(spark, sf, "orders"), [
        {"analysis": "overview"},
        {"analysis": "frequency", "params": {"column": "o_orderpriority"}},
        {"analysis": "anova", "params": {"y": "o_totalprice", "group_col": "o_orderpriority"}},
        {"analysis": "not_an_analysis"},
        {"analysis": "ttest", "params": {"y": "no_such_column", "ttype": "one_sample"}},
        {"analysis": "correlation", "params": {"columns": ["o_orderkey", "o_custkey", "o_totalprice"]}},
    ]).withColumn("n_rows", F.col("n_rows").cast("double"))
