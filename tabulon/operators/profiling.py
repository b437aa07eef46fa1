"""Column profiles, data-health summary and quick statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import (
    as_label, col, distinct_key, existing, is_numeric, numeric_columns, to_numeric,
)
from tabulon.functions.frames import explode_structs, small_frame
from tabulon.functions.rounds import Steps
from tabulon.operators.quantiles import exact_quantiles
from tabulon.operators.select import top_n

# Name parts that mark a column as time-like.
TIME_WORDS = ("date", "time", "datetime", "timestamp", "日期", "时间", "年月", "日", "月", "年")


def _distinct(df: DataFrame, name: str, approximate: bool):
    key = distinct_key(df, name)
    return F.approx_count_distinct(key, 0.02) if approximate else F.count_distinct(key)


def _column_aggregate(df: DataFrame, names: Sequence[str], approximate: bool) -> DataFrame:
    """One row: ``rows``, and for column i ``n<i>`` values and ``d<i>`` distinct values."""
    parts = [F.count("*").alias("rows")]
    for i, name in enumerate(names):
        parts += [F.count(col(name)).alias(f"n{i}"), _distinct(df, name, approximate).alias(f"d{i}")]
    return df.agg(*parts)


def overview(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """``column, dtype, missing_pct, n_distinct`` by falling share of missing cells."""
    return _columns_table(df, df.columns, approximate, 2).orderBy(F.desc("missing_pct"), "column")


def _columns_table(df: DataFrame, names: Sequence[str], approximate: bool, digits: int | None) -> DataFrame:
    wide = _column_aggregate(df, names, approximate)
    rows = []
    for i, name in enumerate(names):
        missing = F.when(F.col("rows") > 0, (F.col("rows") - F.col(f"n{i}")) / F.col("rows") * 100).otherwise(0.0)
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("column"),
            F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
            (missing if digits is None else F.round(missing, digits)).alias("missing_pct"),
            F.col(f"d{i}").alias("n_distinct"),
        ))
    table = explode_structs(wide, rows)
    return table.drop("position") if digits is not None else table


def missing_top(df: DataFrame, k: int = 15) -> DataFrame:
    """``column, missing_pct``: the columns with most missing cells (no distinct counting)."""
    wide = df.agg(F.count("*").alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    share = lambda i: F.when(F.col("rows") > 0, (F.col("rows") - F.col(f"n{i}")) / F.col("rows") * 100).otherwise(0.0)
    rows = [F.struct(F.lit(c).alias("column"), share(i).alias("missing_pct")) for i, c in enumerate(df.columns)]
    return explode_structs(wide, rows).orderBy(F.desc("missing_pct"), "column").limit(k)


def _smallest_values(df: DataFrame, names: Sequence[str], k: int) -> dict[str, list[str]]:
    """The ``k`` smallest distinct values of each column as text: k plain aggregates, no shuffle of rows."""
    found: dict[str, list[str]] = {n: [] for n in names}
    last: dict[str, str | None] = {n: None for n in names}
    live = list(names)
    for _ in range(k):
        if not live:
            break
        parts = []
        for i, n in enumerate(live):
            text = col(n).cast("string")
            rest = text if last[n] is None else F.when(text > F.lit(last[n]), text)
            parts.append(F.min(rest).alias(f"m{i}"))
        row = df.agg(*parts).first()
        for i, n in enumerate(list(live)):
            if row[i] is None:
                live.remove(n)
            else:
                last[n] = row[i]
                found[n].append(row[i])
    return found


def profile_columns(df: DataFrame, *, max_cols: int | None = None, examples: int = 3, approximate: bool = False) -> DataFrame:
    """``column, dtype, missing_pct, n_distinct, examples``; examples are the smallest values as text."""
    names = df.columns[:max_cols]
    samples = _smallest_values(df, names, examples)
    shown = F.create_map(*[x for n in names for x in (
        F.lit(n), F.array(*[F.lit(v[:30]) for v in samples[n]]).cast("array<string>"))])
    table = _columns_table(df, names, approximate, None)
    return table.withColumn("examples", shown[F.col("column")]).orderBy("position").drop("position")


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None, *, max_cols: int | None = None) -> DataFrame:
    """``column, mean, std, min, max`` of the numeric columns (of the first ``max_cols``, if given)."""
    names = list(columns) if columns is not None else numeric_columns(df)[:max_cols]
    parts, rows = [], []
    for i, n in enumerate(names):
        v = to_numeric(df, n)
        parts += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
        rows.append(F.struct(F.lit(n).alias("column"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                             F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")))
    return explode_structs(df.agg(*parts), rows)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"))


def shape_steps(df: DataFrame) -> Steps:
    """``table_shape`` in a round with other analyses."""
    r = yield {"n": F.count("*")}
    return small_frame(df.sparkSession, [(r["n"], len(df.columns))], "n_rows long, n_cols long")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``n_rows, n_duplicates, dup_pct``: rows equal to another, earlier row."""
    keys = [distinct_key(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    totals = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
    share = F.when(F.col("n_rows") > 0, F.col("n_duplicates") / F.col("n_rows") * 100).otherwise(0.0)
    return totals.withColumn("dup_pct", F.round(share, 2))


# What makes a column a candidate for a list of the health summary.
FEW_LEVELS, MOST_MISSING_PCT = 12, 80
ID_SHARE, ID_LEVELS = 0.9, 20


def _kind(data_type: T.DataType) -> str:
    kinds = (("bool", T.BooleanType), ("datetime", T.DatetimeType), ("categorical", T.StringType))
    return "numeric" if is_numeric(data_type) else next((k for k, t in kinds if isinstance(data_type, t)), "other")


def health_summary(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """One row: shape, duplicate share, number of columns of each kind, and lists of candidate columns."""
    shape = duplicate_rows(df)
    about = small_frame(df.sparkSession, [
        (i, _kind(f.dataType), any(w in f.name.lower() for w in TIME_WORDS)) for i, f in enumerate(df.schema.fields)
    ], "position int, kind string, time_named boolean")
    facts = _columns_table(df, df.columns, approximate, None).join(about, "position").crossJoin(F.broadcast(shape))  # one row
    kind, levels = F.col("kind"), F.col("n_distinct")
    few_numbers = (kind == "numeric") & (levels <= FEW_LEVELS) & (F.col("missing_pct") <= MOST_MISSING_PCT)
    lists = {
        "numeric": kind == "numeric",
        "categorical": (kind == "categorical") | few_numbers,
        "binary": levels == 2,
        "id_like": (F.col("n_rows") > 0) & (levels >= F.greatest(F.lit(ID_LEVELS), F.floor(F.col("n_rows") * ID_SHARE))),
        "constant": levels == 1,
        "datetime_like": (kind == "datetime") | F.col("time_named"),
    }

    def members(test):
        return F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("position", "column")))), lambda x: x["column"])

    counts = [F.count_if(kind == k).alias(f"n_{k}") for k in ("numeric", "categorical", "datetime", "bool", "other")]
    return facts.groupBy().agg(
        F.max("n_rows").alias("n_rows"), F.count("*").alias("n_cols"), F.max("dup_pct").alias("dup_pct"), *counts,
        *[members(test).alias(f"{name}_cols") for name, test in lists.items()])


def column_profile(df: DataFrame, columns: Sequence[str], *, approximate: bool = False) -> DataFrame:
    """Named columns: type, missing %, distinct count, and numeric summary from 3 numbers on."""
    names = existing(df, columns)
    parts = []
    for i, n in enumerate(names):
        v = to_numeric(df, n)
        parts += [F.count(v).alias(f"c{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                  F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"),
                  F.count(col(n)).alias(f"n{i}"), _distinct(df, n, approximate).alias(f"d{i}")]
    rows = []
    for i, n in enumerate(names):
        enough = F.col(f"c{i}") >= 3
        rows.append(F.struct(
            F.lit(n).alias("column"), F.lit(df.schema[n].dataType.simpleString()).alias("dtype"),
            F.when(F.col("rows") > 0, F.round((F.col("rows") - F.col(f"n{i}")) / F.col("rows") * 100, 2))
            .otherwise(0.0).alias("missing_pct"),
            F.col(f"d{i}").alias("n_distinct"),
            *[F.when(enough, F.col(f"{k}{i}")).alias(label)
              for k, label in (("a", "mean"), ("s", "std"), ("l", "min"), ("h", "max"))],
        ))
    return explode_structs(df.agg(F.count("*").alias("rows"), *parts), rows)


def column_head(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], *, rows: int = 8) -> DataFrame:
    """The first rows of the named columns as text, in ``order_by`` order."""
    names = existing(df, columns)
    first = top_n(df, [col(c) for c in order_by], rows)
    return first.select(*[as_label(df, c, "").alias(c) for c in names])


STATS = ("mean", "median", "max", "min", "std", "var")


def column_stats(df: DataFrame, column: str, stats: Sequence[str] = STATS) -> DataFrame:
    """``n`` and the asked statistics of the numbers of one column (ddof 1)."""
    v = to_numeric(df, column)
    simple = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp, "var": F.var_samp}
    wide = df.agg(F.count(v).alias("n"), *[simple[s](v).alias(s) for s in stats if s in simple])
    if "median" in stats:
        wide = wide.withColumn("median", F.lit(exact_quantiles(df, {column: [0.5]})[column][0]).cast("double"))
    return wide.select("n", *[s for s in stats if s in STATS])
