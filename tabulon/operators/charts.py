"""The numbers behind each chart: bounded tables, ready to draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.functions.columns import as_label, col, existing, numeric_columns, numeric_view, to_numeric
from tabulon.functions.distributions import NORMAL
from tabulon.functions.frames import explode_structs, small_frame
from tabulon.operators.describe import MAX_LEVELS, group_summary
from tabulon.operators.multivariate import KMeansFit, PcaFit
from tabulon.operators.profiling import missing_top
from tabulon.operators.quantiles import exact_quantiles, group_quantiles
from tabulon.operators.select import sample_of_equals, sample_rows

SCATTER_ROWS = 5000
WHISKER = 1.5


def chart_missing(df: DataFrame, k: int = 15) -> DataFrame:
    return missing_top(df, k).withColumn("missing_pct", F.round("missing_pct", 2))


def chart_boxplot(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``variable, n, q1, median, q3, whisker_low, whisker_high, n_outliers`` of the columns, all numeric ones by default."""
    names = existing(df, columns) if columns else numeric_columns(df)
    if not names:
        raise AnalysisError("no_numeric_columns")
    boxes = exact_quantiles(df, {n: [0.25, 0.5, 0.75] for n in names})
    names = [n for n in names if boxes[n][0] is not None]
    parts, rows = [], []
    number = lambda x: F.lit(x).cast("double")
    for i, n in enumerate(names):
        q1, q2, q3 = boxes[n]
        v, low, high = to_numeric(df, n), q1 - WHISKER * (q3 - q1), q3 + WHISKER * (q3 - q1)
        inside = F.when(v.between(low, high), v)
        parts += [F.count(v).alias(f"n{i}"), F.min(inside).alias(f"l{i}"), F.max(inside).alias(f"h{i}"),
                  F.count_if(~v.between(low, high)).alias(f"o{i}")]
        rows.append(F.struct(
            F.lit(n).alias("variable"), F.col(f"n{i}").alias("n"), number(q1).alias("q1"), number(q2).alias("median"),
            number(q3).alias("q3"), F.col(f"l{i}").alias("whisker_low"), F.col(f"h{i}").alias("whisker_high"),
            F.col(f"o{i}").alias("n_outliers")))
    return explode_structs(df.agg(*parts), rows)


def chart_boxplot_by(df: DataFrame, y: str, group_col: str) -> DataFrame:
    """The same per group: ``group, n, q1, median, q3, whisker_low, whisker_high, n_outliers``."""
    rows = df.select(as_label(df, group_col).alias("group"), to_numeric(df, y).alias("y")).where(F.col("y").isNotNull())
    boxes = group_quantiles(rows, "group", "y", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    # A bounded number of boxes is read once and goes to every task, so the rows stay where they are.
    few = boxes.limit(MAX_LEVELS + 1).collect()
    if len(few) <= MAX_LEVELS:
        boxes = F.broadcast(df.sparkSession.createDataFrame(few, boxes.schema))
    fenced = rows.join(boxes, "group")
    inside = F.col("y").between(F.col("q1") - WHISKER * spread, F.col("q3") + WHISKER * spread)
    # The box of a group is the same on all of its rows, so any of them will do.
    return fenced.groupBy("group").agg(
        F.max("n").alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("y"))).alias("whisker_low"), F.max(F.when(inside, F.col("y"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def chart_histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, low, high, n``: equal-width bins from minimum to maximum, empty ones included."""
    v = to_numeric(df, column)
    span = df.agg(F.min(v).alias("low"), F.max(v).alias("high")).first()
    if span.low is None:
        raise AnalysisError("n_too_small", f"{column} has no numbers")
    low, high = (span.low, span.high) if span.high > span.low else (span.low - 0.5, span.high + 0.5)
    width = (high - low) / bins
    place = F.least(F.floor((v - F.lit(low)) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def chart_qq(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """``p, theoretical, sample``: evenly spaced quantiles of the column against the normal law."""
    at = [(i + 1) / (points + 1) for i in range(points)]
    found = exact_quantiles(df, {column: at})[column]
    return small_frame(df.sparkSession, [(p, NORMAL.inv_cdf(p), q) for p, q in zip(at, found)],
                       "p double, theoretical double, sample double")


def chart_scatter(df: DataFrame, x: str, y: str, *, n: int = SCATTER_ROWS, key: Sequence[str] = ()) -> DataFrame:
    """``x, y`` of a repeatable sample of complete rows."""
    rows = df.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(key)],
                     to_numeric(df, x).alias("x"), to_numeric(df, y).alias("y")).dropna(subset=["x", "y"])
    return (sample_rows(rows, n, [f"_k{i}" for i in range(len(key))]) if key else sample_of_equals(rows, n)).select("x", "y")


def chart_pca_scatter(fit: PcaFit, *, n: int = SCATTER_ROWS) -> DataFrame:
    return sample_of_equals(fit.scores().select("PC1", "PC2"), n)


def chart_cluster_scatter(fit: KMeansFit, *, n: int = SCATTER_ROWS) -> DataFrame:
    """``PC1, PC2, cluster`` of a sample of clustered rows, in the plane of all rows."""
    placed = fit.assignments()
    inputs = [c for c in placed.columns if c != "cluster"]
    sample = sample_of_equals(placed, n)
    plane = PcaFit(placed.select(*inputs), inputs, 2)
    centre = numeric_view(placed, inputs).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(inputs)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(inputs)]
    ).first()
    axes = []
    for j in range(2):
        terms = [(F.col(c) - F.lit(centre[f"m{i}"])) / F.lit(centre[f"s{i}"] or 1.0) * F.lit(float(plane.loading[i, j]))
                 for i, c in enumerate(inputs)]
        axes.append(sum(terms[1:], terms[0]).alias(f"PC{j + 1}"))
    return sample.select(*axes, "cluster")


def chart_group_top(df: DataFrame, group_by: str, metric: str, agg: str = "mean", k: int = 20) -> DataFrame:
    return group_summary(df, group_by, metric, agg).limit(k)
