import math

import pytest

from tabulon.errors import AnalysisError
from tabulon.functions.columns import normalize_missing, resolve_columns, strip, to_numeric
from tabulon.operators import profiling, select
from pyspark.sql import functions as F


def test_resolve_columns():
    names = ["Order ID", "amount_usd", "Amount"]
    assert resolve_columns(["orderid", "AMOUNT", "usd", "amount", "nope", ""], names) == ["Order ID", "Amount", "amount_usd"]
    assert resolve_columns(["order-id"], names) == []
    assert resolve_columns(["order-id", "amountusd"], names, loose=True) == ["Order ID", "amount_usd"]


def test_to_numeric(spark):
    df = spark.createDataFrame([(x,) for x in (
        "1", " 2.5 ", "1e3", "1d", "2F", "inf", "-Infinity", "NaN", "1,000", "", None, "-.5", "0x1")], "x string")
    got = [r.v for r in df.select(to_numeric(df, "x").alias("v")).collect()]
    assert got == [1.0, 2.5, 1000.0, None, None, None, None, None, None, None, None, -0.5, None]


def test_to_numeric_of_other_types(spark):
    df = spark.createDataFrame([(True, 3, float("inf"))], "b boolean, i int, d double")
    row = df.select(*[to_numeric(df, c).alias(c) for c in df.columns]).first()
    assert (row.b, row.i, row.d) == (1.0, 3.0, None)


def test_normalize_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), "NaN"), (2, float("inf"), "x"), (3, -math.inf, None), (4, 0.0, "")],
                               "id int, n double, s string")
    assert [(r.n, r.s) for r in normalize_missing(df).orderBy("id").collect()] == [
        (None, "NaN"), (None, "x"), (None, None), (0.0, "")]


def test_strip_takes_every_white_space(spark):
    df = spark.createDataFrame([("\t a b　\n",), (None,)], "s string")
    assert [r.s for r in df.select(strip(F.col("s")).alias("s")).collect()] == ["a b", None]


def test_sample_rows_is_exact_and_repeatable(spark, lineitem, monkeypatch):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    small = select.sample_rows(lineitem, 700, key)
    assert small.count() == 700
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, select.sample_rows(lineitem, 700, key).collect()))
    # The threshold way gives the same rows as the top-n way.
    monkeypatch.setattr(select, "TOP_N_ROWS", 100)
    large = select.sample_rows(lineitem, 700, key)
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
    assert select.sample_rows(lineitem, 10**6, key).count() == lineitem.count()
    monkeypatch.setattr(select, "TOP_N_ROWS", 10_000)
    monkeypatch.setattr(select, "MERGE_ROWS", 100)
    merged = select.sample_rows(lineitem.repartition(9), 700, key)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, small.collect()))
    monkeypatch.setattr(select, "TOP_N_ROWS", 100)
    # A key shared by all rows still gives the asked number.
    assert select.sample_rows(lineitem.withColumn("k", F.lit(1)), 700, ["k"]).count() == 700


def test_health_classifies(spark):
    df = spark.createDataFrame([(i, float(i % 3), "a", i % 2 == 0, None if i % 2 else "x") for i in range(40)],
                               "row_id long, level double, same string, flag boolean, gap string")
    row = profiling.health_summary(df).first()
    assert (row.n_rows, row.n_cols, row.dup_pct) == (40, 5, 0.0)
    assert (row.n_numeric, row.n_categorical, row.n_bool) == (2, 2, 1)
    assert row.numeric_cols == ["row_id", "level"] and row.categorical_cols == ["level", "same", "gap"]
    assert row.binary_cols == ["flag"] and row.id_like_cols == ["row_id"] and row.constant_cols == ["same", "gap"]


def test_profile_examples_are_smallest_values(spark):
    df = spark.createDataFrame([("b" * 40,), ("a",), ("a",), ("c",), ("d",), (None,)], "s string")
    row = profiling.profile_columns(df).first()
    assert row.examples == ["a", "b" * 30, "c"] and row.n_distinct == 4


def test_distinct_counts_tell_long_texts_apart(spark):
    df = spark.createDataFrame([("x" * 100 + "1",), ("x" * 100 + "2",), ("x" * 100 + "1",)], "s string")
    assert profiling.overview(df).first().n_distinct == 2
    assert profiling.duplicate_rows(df).first().n_duplicates == 1


def test_column_stats_and_empty_table(spark):
    df = spark.createDataFrame([("1",), ("3",), ("x",)], "s string")
    row = profiling.column_stats(df, "s").first()
    assert (row.n, row["mean"], row["median"], row["var"]) == (2, 2.0, 2.0, 2.0)
    empty = profiling.column_stats(df.where("s = 'q'"), "s").first()
    assert empty.n == 0 and empty["median"] is None
    assert profiling.overview(df.where("s = 'q'")).first().missing_pct == 0.0


def test_missing_columns_raise(spark, lineitem):
    from tabulon.operators.describe import group_summary
    with pytest.raises(AnalysisError, match="missing_columns"):
        group_summary(lineitem, "nope", "l_tax")
