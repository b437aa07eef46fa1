"""Business indicators and trends by time grain.

Every operator aggregates rows to periods first; whatever compares periods afterwards works on
the short series. Distinct counts are two-phase, so a period with a third of the rows is spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.errors import AnalysisError
from tabulon.functions.columns import NULL_LABEL, as_label, col, to_numeric
from tabulon.functions.frames import explode_structs
from tabulon.operators.profiling import duplicate_rows, missing_top


GRAINS = ("day", "week", "month", "quarter", "year")


def _period(time: str, grain: str):
    if grain.lower() not in GRAINS:
        raise AnalysisError("unknown_grain", f"{grain!r} is none of {', '.join(GRAINS)}")
    return F.to_date(F.date_trunc(grain, col(time))).alias("period")


def kpi_data_quality(df: DataFrame, k: int = 15) -> DataFrame:
    """``metric, column, value``: row count, duplicate rows, and the columns with most missing cells."""
    facts = duplicate_rows(df)
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("column"),
                     F.col(m).cast("double").alias("value")) for m in ("n_rows", "n_duplicates")]
    gaps = missing_top(df, k).select(F.lit("missing_pct").alias("metric"), "column", F.col("missing_pct").alias("value"))
    return explode_structs(facts, rows).unionAll(gaps)


def kpi_sales(df: DataFrame, time: str, amount: str, order_id: str, user_id: str, grain: str = "day") -> DataFrame:
    """``period, gmv, orders, aov, users, arpu``."""
    sums = df.groupBy(_period(time, grain)).agg(
        F.sum(to_numeric(df, amount)).alias("gmv"), F.count_distinct(col(order_id)).alias("orders"),
        F.count_distinct(col(user_id)).alias("users"))
    return sums.select("period", "gmv", "orders", F.try_divide("gmv", "orders").alias("aov"), "users",
                       F.try_divide("gmv", "users").alias("arpu"))


def kpi_finance(df: DataFrame, time: str, revenue: str, cost: str, grain: str = "month", *,
                profit: str | None = None) -> DataFrame:
    """``period, revenue, cost, profit, margin``; a profit column is used where there is one."""
    parts = [F.sum(to_numeric(df, revenue)).alias("revenue"), F.sum(to_numeric(df, cost)).alias("cost")]
    if profit:
        parts.append(F.sum(to_numeric(df, profit)).alias("profit"))
    sums = df.groupBy(_period(time, grain)).agg(*parts)
    gain = F.col("profit") if profit else F.col("revenue") - F.col("cost")
    return sums.select("period", "revenue", "cost", gain.alias("profit"), F.try_divide(gain, F.col("revenue")).alias("margin"))


def kpi_marketing(df: DataFrame, time: str, impressions: str, clicks: str, conversions: str, cost: str,
                  grain: str = "day") -> DataFrame:
    """``period, impressions, clicks, ctr, conversions, cvr, cost, cpa``: ratios of the sums."""
    sums = df.groupBy(_period(time, grain)).agg(*[
        F.sum(to_numeric(df, c)).alias(name) for name, c in
        (("impressions", impressions), ("clicks", clicks), ("conversions", conversions), ("cost", cost))])
    return sums.select(
        "period", "impressions", "clicks", F.try_divide("clicks", "impressions").alias("ctr"),
        "conversions", F.try_divide("conversions", "clicks").alias("cvr"),
        "cost", F.try_divide("cost", "conversions").alias("cpa"))


def kpi_dau(df: DataFrame, time: str, user_id: str, grain: str = "day") -> DataFrame:
    """``period, users``."""
    return df.groupBy(_period(time, grain)).agg(F.count_distinct(col(user_id)).alias("users"))


def kpi_retention(df: DataFrame, time: str, user_id: str, days: Sequence[int] = (1, 7)) -> DataFrame:
    """``period, users, returned_<d>, retention_<d>``: users of a day who are back exactly d days later.

    Each active day of a user also votes for the days d earlier, so one aggregation by (user, day)
    answers all lags without a self-join.
    """
    active = df.where(col(user_id).isNotNull()).select(
        col(user_id).alias("user"), F.to_date(col(time)).alias("day")).where(F.col("day").isNotNull()).distinct()
    votes = active.select("user", F.explode(F.array(
        F.struct(F.col("day").alias("period"), F.lit(0).alias("lag")),
        *[F.struct(F.date_sub("day", d).alias("period"), F.lit(d).alias("lag")) for d in days])).alias("v"))
    per_user = votes.groupBy("user", "v.period").agg(*[
        F.max(F.when(F.col("v.lag") == d, 1).otherwise(0)).alias(f"d{d}") for d in (0, *days)]).where("d0 = 1")
    sums = per_user.groupBy("period").agg(
        F.count("*").alias("users"), *[F.sum(f"d{d}").alias(f"returned_{d}") for d in days])
    return sums.select("period", "users", *[x for d in days for x in (
        F.col(f"returned_{d}"), F.try_divide(f"returned_{d}", "users").alias(f"retention_{d}"))])


def kpi_ops(df: DataFrame, time: str, duration: str, ticket_id: str | None = None, grain: str = "day") -> DataFrame:
    """``period, tickets, mean_duration``; tickets are counted once each if they carry an id."""
    tickets = F.count_distinct(col(ticket_id)) if ticket_id else F.count("*")
    return df.groupBy(_period(time, grain)).agg(tickets.alias("tickets"), F.avg(to_numeric(df, duration)).alias("mean_duration"))


def trend_change(df: DataFrame, time: str, value: str, grain: str = "month") -> DataFrame:
    """``period, total, previous, change, last_year, yoy``: against the previous period and a year before."""
    series = df.where(col(time).isNotNull()).groupBy(_period(time, grain)).agg(F.sum(to_numeric(df, value)).alias("total"))
    line = Window.partitionBy(F.lit(0)).orderBy("period")  # one row per period
    # Each period looks back to one earlier period: never two of them to the same row twice. Weeks go back
    # 52 weeks, which is again a Monday; 29 February looks back to 28 February.
    back = F.date_sub("period", 364) if grain.lower() == "week" else F.add_months("period", -12)
    earlier = series.select(F.col("period").alias("back"), F.col("total").alias("last_year"))
    change = lambda base: F.try_divide(F.col("total") - F.col(base), F.col(base))
    return (series.withColumn("previous", F.lag("total").over(line)).withColumn("back", back).join(earlier, "back", "left")
            .select("period", "total", "previous", change("previous").alias("change"),
                    "last_year", change("last_year").alias("yoy")))


def trend_contribution(df: DataFrame, dimension: str, value: str, top_n: int = 10) -> DataFrame:
    """``dimension, total, share`` of the largest contributors."""
    v = to_numeric(df, value)
    sums = df.groupBy(as_label(df, dimension, NULL_LABEL).alias("dimension")).agg(F.sum(v).alias("total"))
    whole = sums.agg(F.sum("total")).scalar()  # over the same shuffle
    return (sums.withColumn("share", F.try_divide(F.col("total"), whole))
            .orderBy(F.col("total").desc_nulls_last(), "dimension").limit(top_n))


def trend_new_vs_returning(df: DataFrame, time: str, user_id: str) -> DataFrame:
    """``period, new_users, returning_users``. A user's rows are reduced to days before they meet."""
    active = df.where(col(user_id).isNotNull()).select(
        col(user_id).alias("user"), F.to_date(col(time)).alias("day")).where(F.col("day").isNotNull()).distinct()
    first = active.withColumn("first", F.min("day").over(Window.partitionBy("user")))
    return first.groupBy(F.col("day").alias("period")).agg(
        F.count_if(F.col("day") == F.col("first")).alias("new_users"),
        F.count_if(F.col("day") > F.col("first")).alias("returning_users"))


def trend_peaks(df: DataFrame, time: str, value: str, k: int = 10, grain: str = "day") -> DataFrame:
    """``period, total`` of the k highest periods."""
    series = df.where(col(time).isNotNull()).groupBy(_period(time, grain)).agg(F.sum(to_numeric(df, value)).alias("total"))
    return series.orderBy(F.col("total").desc_nulls_last(), "period").limit(k)
