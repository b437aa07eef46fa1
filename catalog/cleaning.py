"""Cleaning actions, recipes and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import GAPPY_CUSTOMER, GAPPY_LINEITEM, gappy_customer, gappy_lineitem, query, rounded, table
from tabulon.operators.actions import apply_action
from tabulon.plans.dataset import Dataset


def _act(df, kind: str, order_by=(), **params):
    return apply_action(df, {"type": kind, "params": params}, order_by=order_by)


@query("act_replace_missing", """
    SELECT c_custkey, c_name, CASE WHEN c_nationkey IN (3, 7) THEN NULL ELSE c_nationkey END::DOUBLE AS c_nationkey,
           c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer""")
def _replace_missing(spark, sf):
    return _act(table(spark, sf, "customer"), "replace_missing", columns=["c_nationkey", "C_MktSegment"],
                values=["3", 7, "BUILDING"]).withColumn("c_nationkey", F.col("c_nationkey").cast("double"))


@query("act_dropna_any", f"""
    SELECT * FROM {GAPPY_CUSTOMER} WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def _dropna_any(spark, sf):
    return _act(gappy_customer(spark, sf), "dropna_rows")


@query("act_dropna_all", f"""
    SELECT * FROM {GAPPY_CUSTOMER} WHERE c_acctbal IS NOT NULL OR c_mktsegment IS NOT NULL""")
def _dropna_all(spark, sf):
    return _act(gappy_customer(spark, sf), "dropna_rows", columns=["c_acctbal", "c_mktsegment"], how="all")


def _filled(acctbal: str, segment: str = "c_mktsegment") -> str:
    return f"""SELECT c_custkey, c_name, c_nationkey, {acctbal} AS c_acctbal, {segment} AS c_mktsegment
               FROM {GAPPY_CUSTOMER}"""


@query("act_fillna_value", _filled("c_acctbal", "coalesce(c_mktsegment, 'UNKNOWN')"))
def _fillna_value(spark, sf):
    return _act(gappy_customer(spark, sf), "fillna", columns=["c_mktsegment"], strategy="value", value="UNKNOWN")


@query("act_fillna_zero", _filled("coalesce(c_acctbal, 0.0)"))
def _fillna_zero(spark, sf):
    return _act(gappy_customer(spark, sf), "fillna", columns=["c_acctbal"], strategy="zero")


@query("act_fillna_mean", _filled(f"round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {GAPPY_CUSTOMER})), 4)"))
def _fillna_mean(spark, sf):
    return rounded(_act(gappy_customer(spark, sf), "fillna", columns=["c_acctbal"], strategy="mean"), 4, "c_acctbal")


@query("act_fillna_median", _filled(
    f"round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM {GAPPY_CUSTOMER})), 4)"))
def _fillna_median(spark, sf):
    return rounded(_act(gappy_customer(spark, sf), "fillna", columns=["c_acctbal"], strategy="median"), 4, "c_acctbal")


@query("act_fillna_mode", _filled(
    "c_acctbal", f"""coalesce(c_mktsegment, (SELECT c_mktsegment FROM {GAPPY_CUSTOMER} WHERE c_mktsegment IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"""))
def _fillna_mode(spark, sf):
    return _act(gappy_customer(spark, sf), "fillna", columns=["c_mktsegment"], strategy="mode")


@query("act_cast_float", """
    SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_totalprice END AS t FROM orders""")
def _cast_float(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("t"))
    return _act(df, "cast_type", column="t", to="float")


@query("act_cast_int", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS l_quantity FROM lineitem")
def _cast_int(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return _act(df, "cast_type", column="l_quantity", to="int")


@query("act_cast_int_text", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL ELSE 9007199254740993 + o_orderkey END AS t FROM orders""")
def _cast_int_text(spark, sf):
    number = (F.lit(9007199254740993) + F.col("o_orderkey")).cast("string")
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "x").otherwise(number).alias("t"))
    return _act(df, "cast_type", column="t", to="int")


@query("act_fillna_all_zero", _filled("coalesce(c_acctbal, 0.0)"))
def _fillna_all_zero(spark, sf):
    return _act(gappy_customer(spark, sf), "fillna", columns=[], strategy="zero")


@query("act_cast_string", "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def _cast_string(spark, sf):
    return _act(table(spark, sf, "customer").select("c_custkey", "c_name"), "cast_type", column="custkey", to="str")


@query("act_cast_datetime", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL ELSE strftime(o_orderdate, '%Y%m%d') END AS d FROM orders""")
def _cast_datetime(spark, sf):
    shape = {"F": "yyyy-MM-dd HH:mm:ss", "O": "yyyy/MM/dd"}
    text = F.lit("soon")
    for status, layout in shape.items():
        text = F.when(F.col("o_orderstatus") == status, F.date_format("o_orderdate", layout)).otherwise(text)
    df = _act(table(spark, sf, "orders").select("o_orderkey", text.alias("d")), "cast_type", column="d", to="datetime")
    return df.withColumn("d", F.date_format("d", "yyyyMMdd"))


@query("act_standardize", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6)
               + 0.0 AS l_quantity,
           round((l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem), 6) + 0.0 AS l_tax
    FROM lineitem""")
def _standardize(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    return rounded(_act(df, "standardize", columns=["l_quantity", "l_tax"]), 6, "l_quantity", "l_tax")


@query("act_winsorize", f"""
    WITH q AS (SELECT quantile_cont(l_extendedprice, [0.05, 0.95]) AS p, quantile_cont(l_discount, [0.05, 0.95]) AS d
               FROM {GAPPY_LINEITEM})
    SELECT l_orderkey, l_linenumber, l_partkey,
           round(least(greatest(l_extendedprice, p[1]), p[2]), 4) AS l_extendedprice,
           CASE WHEN l_discount IS NOT NULL THEN round(least(greatest(l_discount, d[1]), d[2]), 4) END AS l_discount
    FROM {GAPPY_LINEITEM}, q""")
def _winsorize(spark, sf):
    df = gappy_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
    df = _act(df, "winsorize", columns=["l_extendedprice", "l_discount"], lower=0.05, upper=0.95)
    return rounded(df, 4, "l_extendedprice", "l_discount")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _flags(levels) -> str:
    return ", ".join(f"coalesce(c_mktsegment = '{s}', false) AS \"c_mktsegment={s}\"" for s in levels)


@query("act_one_hot", f"SELECT c_custkey, {_flags(_SEGMENTS)} FROM {GAPPY_CUSTOMER}")
def _one_hot(spark, sf):
    return _act(gappy_customer(spark, sf).select("c_custkey", "c_mktsegment"), "one_hot_encode", columns=["c_mktsegment"])


@query("act_one_hot_drop_first", f"SELECT c_custkey, {_flags(_SEGMENTS[1:])} FROM {GAPPY_CUSTOMER}")
def _one_hot_drop_first(spark, sf):
    return _act(gappy_customer(spark, sf).select("c_mktsegment", "c_custkey"), "one_hot_encode",
                columns=["c_mktsegment"], drop_first=True)


@query("act_rename", "SELECT c_custkey AS id, c_acctbal AS balance, c_name FROM customer")
def _rename(spark, sf):
    return _act(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name"), "rename_columns",
                mapping={"C_CUSTKEY": "id", "acctbal": "balance", "c_name": "", "nothing": "x"})


@query("act_drop", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _drop(spark, sf):
    return _act(table(spark, sf, "customer"), "drop_columns", columns=[" C_NAME", "unknown"])


@query("act_dedup_all", "SELECT DISTINCT text, lang, source FROM documents")
def _dedup_all(spark, sf):
    return _act(table(spark, sf, "documents").select("text", "lang", "source"), "deduplicate")


def _dedup_sql(direction: str) -> str:
    return f"""SELECT doc_id, lang, source, n_chars FROM (
        SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id {direction}) AS rn FROM documents) WHERE rn = 1"""


@query("act_dedup_first", _dedup_sql("ASC"))
def _dedup_first(spark, sf):
    return _act(table(spark, sf, "documents"), "deduplicate", subset=["text"], keep="first",
                order_by=["doc_id"]).drop("text")


@query("act_dedup_last", _dedup_sql("DESC"))
def _dedup_last(spark, sf):
    return _act(table(spark, sf, "documents"), "deduplicate", subset=["text"], keep="last",
                order_by=["doc_id"]).drop("text")


@query("act_trim", "SELECT c_custkey, c_name FROM customer")
def _trim(spark, sf):
    return _act(gappy_customer(spark, sf).select("c_custkey", "c_name"), "trim_whitespace")


_RECIPE = (
    {"type": "trim_whitespace", "params": {"columns": ["c_name"]}},
    {"type": "fillna", "params": {"columns": ["c_acctbal"], "strategy": "zero"}},
    {"type": "dropna_rows", "params": {"columns": ["c_mktsegment"]}},
    {"type": "rename_columns", "params": {"mapping": {"c_mktsegment": "segment"}}},
    {"type": "drop_columns", "params": {"columns": ["c_nationkey"]}},
)


@query("recipe_apply", f"""
    SELECT c_custkey, trim(c_name, chr(9) || ' ') AS c_name, coalesce(c_acctbal, 0.0) AS c_acctbal,
           c_mktsegment AS segment FROM {GAPPY_CUSTOMER} WHERE c_mktsegment IS NOT NULL""")
def _recipe_apply(spark, sf):
    return Dataset(gappy_customer(spark, sf)).apply(*_RECIPE).df


@query("recipe_replay", f"""
    SELECT c_custkey, trim(c_name, chr(9) || ' ') AS c_name, c_nationkey, coalesce(c_acctbal, 0.0) AS c_acctbal,
           c_mktsegment FROM {GAPPY_CUSTOMER} WHERE c_mktsegment IS NOT NULL""")
def _recipe_replay(spark, sf):
    return Dataset(gappy_customer(spark, sf)).apply(*_RECIPE).jump(1).redo().redo().redo().undo().df


@query("act_missing_codes", """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders""")
def _missing_codes(spark, sf):
    data = Dataset(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))
    data = data.set_column_meta("o_orderstatus", label="Order status", measure="nominal", missing_codes=["P"])
    rename = {"type": "rename_columns", "params": {"mapping": {"o_orderstatus": "status"}}}
    return data.apply(rename).apply_missing_codes().df
