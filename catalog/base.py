"""Registration and the inputs that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir)`` under a name, with the SQL of its result if there is one."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


# Customers with missing balances and segments, and padded names.
GAPPY_CUSTOMER = """(
    SELECT c_custkey, '  ' || c_name || chr(9) AS c_name, c_nationkey,
           CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
    FROM customer)"""


def gappy_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return df.select(
        "c_custkey", F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("c_name"), "c_nationkey",
        F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


# Line items with a missing discount and with groups that are missing too.
GAPPY_LINEITEM = """(
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_tax, l_linestatus, l_shipdate,
           CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount,
           CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag
    FROM lineitem)"""


def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_linestatus", "l_shipdate",
        F.when(F.col("l_partkey") % 11 == 0, None).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"))
