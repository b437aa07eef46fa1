"""Indicators, trends and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import GAPPY_CUSTOMER, as_text, gappy_customer, query, rounded, table
from tabulon.operators import anomaly, kpi


@query("kpi_data_quality", f"""
    SELECT 'n_rows' AS metric, NULL AS "column", count(*)::DOUBLE AS value FROM customer
    UNION ALL SELECT 'n_duplicates', NULL, 0
    UNION ALL SELECT 'missing_pct', c, round(v, 6) FROM (
        SELECT 100.0 * (count(*) - count(c_custkey)) / count(*) AS c_custkey,
               100.0 * (count(*) - count(c_name)) / count(*) AS c_name,
               100.0 * (count(*) - count(c_nationkey)) / count(*) AS c_nationkey,
               100.0 * (count(*) - count(c_acctbal)) / count(*) AS c_acctbal,
               100.0 * (count(*) - count(c_mktsegment)) / count(*) AS c_mktsegment FROM {GAPPY_CUSTOMER})
    UNPIVOT (v FOR c IN (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment))""")
def _quality(spark, sf):
    return rounded(kpi.kpi_data_quality(gappy_customer(spark, sf)), 6, "value")


@query("kpi_sales_daily", """
    SELECT o_orderdate::DATE::VARCHAR AS period, round(sum(o_totalprice), 2) AS gmv, count(DISTINCT o_orderkey) AS orders,
           round(sum(o_totalprice) / count(DISTINCT o_orderkey) + 1.3e-7, 4) AS aov, count(DISTINCT o_custkey) AS users,
           round(sum(o_totalprice) / count(DISTINCT o_custkey) + 1.3e-7, 4) AS arpu FROM orders GROUP BY 1""")
def _sales(spark, sf):
    df = kpi.kpi_sales(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderkey", "o_custkey")
    # Division by 8 or 16 ends exactly halfway between two roundings; a nudge takes the ratios off that edge.
    df = df.withColumns({c: F.col(c) + 1.3e-7 for c in ("aov", "arpu")})
    return as_text(rounded(rounded(df, 2, "gmv"), 4, "aov", "arpu"), "period")


@query("kpi_finance_monthly", """
    SELECT date_trunc('month', l_shipdate)::DATE::VARCHAR AS period, round(sum(l_extendedprice), 2) AS revenue,
           round(sum(l_extendedprice * (l_discount + l_tax)), 2) AS cost,
           round(sum(l_extendedprice) - sum(l_extendedprice * (l_discount + l_tax)), 2) AS profit,
           round(1 - sum(l_extendedprice * (l_discount + l_tax)) / sum(l_extendedprice), 6) AS margin
    FROM lineitem GROUP BY 1""")
def _finance(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_shipdate", "l_extendedprice",
        (F.col("l_extendedprice") * (F.col("l_discount") + F.col("l_tax"))).alias("cost"))
    result = kpi.kpi_finance(df, "l_shipdate", "l_extendedprice", "cost")
    return as_text(rounded(rounded(result, 2, "revenue", "cost", "profit"), 6, "margin"), "period")


def _funnel(spark, sf):
    one = lambda kind: F.when(F.col("event_type") == kind, 1).otherwise(0)
    return table(spark, sf, "events").select(
        "ts", one("view").alias("views"), one("click").alias("clicks"), one("purchase").alias("purchases"),
        F.when(F.col("event_type") == "signup", F.col("value")).otherwise(0.0).alias("spent"))


@query("kpi_marketing_daily", """
    SELECT ts::DATE::VARCHAR AS period, v AS impressions, c AS clicks, round(c / nullif(v, 0), 6) AS ctr,
           p AS conversions, round(p / nullif(c, 0), 6) AS cvr, round(s, 2) AS cost, round(s / nullif(p, 0), 4) AS cpa
    FROM (SELECT ts::DATE AS ts, count(*) FILTER (event_type = 'view')::DOUBLE AS v,
                 count(*) FILTER (event_type = 'click')::DOUBLE AS c, count(*) FILTER (event_type = 'purchase')::DOUBLE AS p,
                 sum(CASE WHEN event_type = 'signup' THEN value ELSE 0 END) AS s FROM events GROUP BY 1)""")
def _marketing(spark, sf):
    df = kpi.kpi_marketing(_funnel(spark, sf), "ts", "views", "clicks", "purchases", "spent")
    return as_text(rounded(rounded(rounded(df, 6, "ctr", "cvr"), 2, "cost"), 4, "cpa"), "period")


@query("kpi_dau", "SELECT ts::DATE::VARCHAR AS period, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _dau(spark, sf):
    return as_text(kpi.kpi_dau(table(spark, sf, "events"), "ts", "user_id"), "period")


@query("kpi_retention", """
    WITH a AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events)
    SELECT a.d::VARCHAR AS period, count(*) AS users, count(b.user_id) AS returned_1,
           round(count(b.user_id) / count(*), 6) AS retention_1, count(c.user_id) AS returned_7,
           round(count(c.user_id) / count(*), 6) AS retention_7
    FROM a LEFT JOIN a b ON b.user_id = a.user_id AND b.d = a.d + 1
           LEFT JOIN a c ON c.user_id = a.user_id AND c.d = a.d + 7 GROUP BY a.d""")
def _retention(spark, sf):
    df = kpi.kpi_retention(table(spark, sf, "events"), "ts", "user_id")
    return as_text(rounded(df, 6, "retention_1", "retention_7"), "period")


@query("kpi_ops_daily", """
    SELECT ts::DATE::VARCHAR AS period, count(DISTINCT event_id) AS tickets, round(avg(value), 5) AS mean_duration
    FROM events WHERE event_type = 'error' GROUP BY 1""")
def _ops(spark, sf):
    errors = table(spark, sf, "events").where("event_type = 'error'")
    return as_text(rounded(kpi.kpi_ops(errors, "ts", "value", "event_id"), 5, "mean_duration"), "period")


@query("trend_mom_yoy", """
    WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS total FROM orders GROUP BY 1)
    SELECT a.period::VARCHAR AS period, round(a.total, 2) AS total, round(lag(a.total) OVER (ORDER BY a.period), 2) AS previous,
           round((a.total - lag(a.total) OVER (ORDER BY a.period)) / lag(a.total) OVER (ORDER BY a.period), 6) AS change,
           round(b.total, 2) AS last_year, round((a.total - b.total) / b.total, 6) AS yoy
    FROM m a LEFT JOIN m b ON b.period = (a.period - INTERVAL 1 YEAR)::DATE""")
def _trend(spark, sf):
    df = kpi.trend_change(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return as_text(rounded(rounded(df, 2, "total", "previous", "last_year"), 6, "change", "yoy"), "period")


def _trend_sql(grain: str, back: str) -> str:
    return f"""
    WITH m AS (SELECT date_trunc('{grain}', o_orderdate)::DATE AS period, sum(o_totalprice) AS total FROM orders GROUP BY 1),
         l AS (SELECT *, lag(total) OVER (ORDER BY period) AS previous FROM m)
    SELECT a.period::VARCHAR AS period, round(a.total, 2) AS total, round(a.previous, 2) AS previous,
           round((a.total - a.previous) / a.previous, 6) AS change,
           round(b.total, 2) AS last_year, round((a.total - b.total) / b.total, 6) AS yoy
    FROM l a LEFT JOIN m b ON b.period = (a.period - INTERVAL {back})::DATE"""


@query("trend_day_yoy", _trend_sql("day", "1 YEAR"))
def _trend_day(spark, sf):
    df = kpi.trend_change(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "day")
    return as_text(rounded(rounded(df, 2, "total", "previous", "last_year"), 6, "change", "yoy"), "period")


@query("trend_week_yoy", _trend_sql("week", "364 DAY"))
def _trend_week(spark, sf):
    df = kpi.trend_change(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "week")
    return as_text(rounded(rounded(df, 2, "total", "previous", "last_year"), 6, "change", "yoy"), "period")


@query("trend_contribution", """
    SELECT o_orderpriority AS dimension, round(sum(o_totalprice), 2) AS total,
           round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share
    FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 3""")
def _contribution(spark, sf):
    df = kpi.trend_contribution(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", 3)
    return rounded(rounded(df, 2, "total"), 6, "share")


@query("trend_new_vs_returning", """
    WITH a AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events),
         f AS (SELECT *, min(d) OVER (PARTITION BY user_id) AS first FROM a)
    SELECT d::VARCHAR AS period, count(*) FILTER (d = first) AS new_users, count(*) FILTER (d > first) AS returning_users
    FROM f GROUP BY 1""")
def _new_vs_returning(spark, sf):
    return as_text(kpi.trend_new_vs_returning(table(spark, sf, "events"), "ts", "user_id"), "period")


@query("trend_peaks", """
    SELECT o_orderdate::DATE::VARCHAR AS period, round(sum(o_totalprice), 2) AS total FROM orders
    GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10""")
def _peaks(spark, sf):
    return as_text(rounded(kpi.trend_peaks(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"), 2, "total"), "period")


def _fence_sql(source: str, key: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", {key}, {c}::DOUBLE AS value,
        round(greatest(q[1] - 1.5 * (q[2] - q[1]) - {c}, {c} - q[2] - 1.5 * (q[2] - q[1])), 4) AS distance
        FROM {source}, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM {source}) t
        WHERE {c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])"""


@query("anomaly_iqr", f"""
    SELECT * FROM (({_fence_sql("documents", "doc_id", "n_chars")}
                    ORDER BY 4 DESC, doc_id LIMIT 10)
                   UNION ALL ({_fence_sql("documents", "doc_id", "doc_id")} ORDER BY 4 DESC, doc_id LIMIT 10))""")
def _iqr(spark, sf):
    return rounded(anomaly.anomaly_iqr(table(spark, sf, "documents"), ["n_chars", "doc_id"], ["doc_id"]), 4, "distance")


@query("anomaly_zscore", """
    SELECT doc_id, n_chars, round((n_chars - m) / s, 6) AS z
    FROM documents, (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents) WHERE abs((n_chars - m) / s) > 3""")
def _zscore(spark, sf):
    return rounded(anomaly.anomaly_zscore(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars"), 6, "z")


_ROLES = {"amount": "balance", "quantity": "l_quantity", "ratio": "l_ratio", "impressions": "l_linenumber",
          "clicks": "l_quantity", "conversions": "l_linenumber", "revenue": "l_quantity", "cost": "balance"}
_RULED = """(SELECT l_orderkey, l_linenumber, l_quantity, l_discount * 12 AS l_ratio,
                    CASE WHEN l_linenumber = 2 THEN 0.0 ELSE l_extendedprice / 1000 - 20 END AS balance FROM lineitem)"""


def _ruled(spark, sf):
    balance = F.when(F.col("l_linenumber") == 2, 0.0).otherwise(F.col("l_extendedprice") / 1000 - 20)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 12).alias("l_ratio"), balance.alias("balance"))


_RULE_SQL = {
    "negative_amount": "balance < 0", "negative_quantity": "l_quantity < 0",
    "zero_amount_with_quantity": "balance = 0 AND l_quantity > 0", "ratio_above_one": "l_ratio > 1",
    "clicks_above_impressions": "l_quantity > l_linenumber", "conversions_above_clicks": "l_linenumber > l_quantity",
    "margin_out_of_range": "(l_quantity - balance) / l_quantity > 1 OR (l_quantity - balance) / l_quantity < -1",
}


@query("anomaly_rules", " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER ({test}) AS n_flagged FROM {_RULED}" for name, test in _RULE_SQL.items()))
def _rules(spark, sf):
    return anomaly.anomaly_rules(_ruled(spark, sf), _ROLES)


@query("anomaly_flagged", f"""
    SELECT l_orderkey, l_linenumber, round(balance, 6) AS balance, 'negative_amount' AS rules FROM {_RULED}
    WHERE balance < 0""")
def _flagged(spark, sf):
    df = anomaly.flagged_rows(_ruled(spark, sf), {"amount": "balance"})
    return df.select("l_orderkey", "l_linenumber", F.round("balance", 6).alias("balance"),
                     F.array_join("rules", "|").alias("rules"))


@query("anomaly_dau_spike", """
    WITH d AS (SELECT ts::DATE AS d, count(DISTINCT user_id) AS users FROM events GROUP BY 1),
         s AS (SELECT avg(users) AS m, stddev_samp(users) AS s FROM d)
    SELECT d::VARCHAR AS period, users, round(m - 1.5 * s, 4) AS low, round(m + 1.5 * s, 4) AS high FROM d, s
    WHERE users NOT BETWEEN m - 1.5 * s AND m + 1.5 * s""")
def _spike(spark, sf):
    df = anomaly.anomaly_dau_spike(table(spark, sf, "events"), "ts", "user_id", sigmas=1.5)
    return as_text(rounded(df, 4, "low", "high"), "period")


@query("anomaly_long_tail", """
    WITH q AS (SELECT quantile_cont(value, [0.25, 0.75, 0.95, 0.99]) AS q FROM events),
         f AS (SELECT q[1] - 1.5 * (q[2] - q[1]) AS low, q[2] + 1.5 * (q[2] - q[1]) AS high, q[3] AS p95, q[4] AS p99 FROM q)
    SELECT 'value' AS "column", round(any_value(low), 6) AS low, round(any_value(high), 6) AS high,
           round(any_value(p95), 6) AS p95, round(any_value(p99), 6) AS p99,
           count(*) FILTER (value < low OR value > high) AS n_outside, count(*) FILTER (value > p95) AS n_above_p95,
           count(*) FILTER (value > p99) AS n_above_p99 FROM events, f""")
def _long_tail(spark, sf):
    return rounded(anomaly.anomaly_long_tail(table(spark, sf, "events"), "value"), 6, "low", "high", "p95", "p99")
