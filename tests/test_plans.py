"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from tabulon.functions.columns import to_numeric
from tabulon.operators import anomaly, describe, kpi, profiling, ranking, select
from tabulon.operators.ranking import running_counts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lazy_operators(spark, lineitem, orders, events):
    return {
        "group_summary": describe.group_summary(lineitem, "l_returnflag", "l_tax"),
        "overview": profiling.overview(lineitem),
        "duplicate_rows": profiling.duplicate_rows(lineitem),
        "frequency": describe.frequency(lineitem, "l_returnflag"),
        "crosstab_long": describe.crosstab_long(lineitem, "l_returnflag", "l_linestatus"),
        "running_counts": running_counts(lineitem.select(to_numeric(lineitem, "l_extendedprice").alias("v")), "v",
                                         bucket_values=500),
        "sales": kpi.kpi_sales(orders, "o_orderdate", "o_totalprice", "o_orderkey", "o_custkey"),
        "retention": kpi.kpi_retention(events, "ts", "user_id"),
        "new_users": kpi.trend_new_vs_returning(events, "ts", "user_id"),
        "anomaly_iqr": anomaly.anomaly_iqr(lineitem, ["l_tax", "l_extendedprice"], ["l_orderkey"]),
        "rules": anomaly.anomaly_rules(lineitem, {"amount": "l_extendedprice"}),
        "sample": select.sample_rows(lineitem, 100, ["l_orderkey"]),
    }


@pytest.fixture(scope="module")
def plans(spark, sf, lineitem, orders):
    return {k: plan(v) for k, v in lazy_operators(
        spark, lineitem, orders, spark.read.parquet(f"{sf}/events.parquet")).items()}


def test_no_python_and_no_cross_join(plans):
    for name, text in plans.items():
        for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "NestedLoopJoin", "CartesianProduct"):
            assert operator not in text, (name, operator)


def test_only_needed_columns_are_read(plans):
    def read(name):
        return {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plans[name])
                for c in schema.split(",") if c}
    assert read("group_summary") == {"l_returnflag", "l_tax"}
    assert read("crosstab_long") == {"l_returnflag", "l_linestatus"}
    assert read("retention") == {"ts", "user_id"} and read("rules") == {"l_extendedprice"}


def test_filters_reach_the_scan(lineitem):
    text = plan(select.filter_groups(lineitem, "l_returnflag", ["A", "R"]))
    assert re.search(r"PushedFilters: \[[^\]]*In\(l_returnflag, \[A,R\]\)", text)


def test_running_counts_never_sort_the_table_in_one_task(spark, lineitem):
    df = lineitem.select(to_numeric(lineitem, "l_extendedprice").alias("v"))
    table = running_counts(df, "v", bucket_values=500)
    text = plan(table)
    # The distinct values are spread over buckets; only the per-bucket totals meet in one place.
    assert re.search(r"Exchange hashpartitioning\(_bucket", text)
    table.collect()
    final = table._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final or final.count("FileScan") <= 2


def test_row_numbers_are_limited_in_every_task(plans):
    assert plans["anomaly_iqr"].count("WindowGroupLimit") == 2


def test_partial_aggregation_precedes_each_shuffle(plans):
    for name in ("group_summary", "crosstab_long", "sales", "retention", "duplicate_rows"):
        lines = plans[name].splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                assert "partial_" in lines[i + 1] or "HashAggregate" in lines[i + 1], (name, lines[i + 1])
