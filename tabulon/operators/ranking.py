"""Running counts and ranks over a whole table without a single-task sort.

Rows are first reduced to distinct values with counts (map-side combine, so a value that holds a
third of the table is one row). Values are cut into buckets of about ``BUCKET_VALUES`` distinct
values each, at literal boundaries read from a hash-thinned sample of the *distinct* values; the
running sum inside a bucket plus the offset of the bucket is the running count of the table.
Literal boundaries keep the result the same when a task is retried.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.functions.columns import col
from tabulon.sources.writers import stored

BUCKET_VALUES = 50_000
MAX_BUCKETS = 4096
SAMPLE_VALUES = 20_000
SAMPLE_PER_BUCKET = 100


def value_splits(
    df: DataFrame, values: Sequence[str], *, bucket_values: int = BUCKET_VALUES, max_buckets: int = MAX_BUCKETS
) -> dict[str, list[float]]:
    """Inner boundaries that share out the distinct values of each double column evenly.

    One aggregate counts the distinct values roughly; a second one reads the boundaries of the
    columns that need any from the distinct values whose hash falls into a thin slice.
    """
    values = list(dict.fromkeys(values))
    distinct = df.agg(*[F.approx_count_distinct(col(v)) for v in values]).first()
    splits: dict[str, list[float]] = {v: [] for v in values}
    slices, buckets = [], {}
    for v, count in zip(values, distinct):
        buckets[v] = min(max_buckets, math.ceil(count / bucket_values))
        if buckets[v] > 1:
            thin = max(1, count // max(SAMPLE_VALUES, SAMPLE_PER_BUCKET * buckets[v]))
            slices.append(F.when(F.pmod(F.xxhash64(col(v)), F.lit(thin)) == 0, F.struct(
                F.lit(v).alias("c"), col(v).alias("v"))))
    if not slices:
        return splits
    sample = df.select(F.explode(F.array_compact(F.array(*slices))).alias("s")).select("s.*").distinct()
    wanted = [v for v in values if buckets[v] > 1]
    bounds = sample.agg(*[
        F.percentile_approx(F.when(F.col("c") == v, F.col("v")), [i / buckets[v] for i in range(1, buckets[v])],
                            max(10_000, 10 * buckets[v])) for v in wanted]).first()
    for v, found in zip(wanted, bounds):
        splits[v] = sorted(set(found or []))
    return splits


def running_counts(
    df: DataFrame, value: str, *, by: Sequence[str] = (), tag: Sequence[str] = (),
    measures: Sequence[str] = (), splits: Sequence[float] | None = None, bucket_values: int = BUCKET_VALUES,
) -> DataFrame:
    """``by, tag, value, n, ties, upto, dense, total``: one row per distinct (by, value, tag).

    ``upto`` counts the rows with the same ``by`` and a value not above this one, ``ties`` those
    with exactly this value, ``dense`` the distinct values not above it, ``total`` all rows of
    ``by``. ``tag`` columns split the rows without taking part in the ordering. The columns in
    ``by`` must not be NULL; rows without a value are left out. Each numeric ``measures`` column m is
    summed along: ``m, m_upto, m_total``. ``splits`` may carry boundaries read before.
    """
    by, tag, measures = list(by), list(tag), list(measures)
    rows = df.select(*[col(c) for c in [*by, *tag, value, *measures]]).where(col(value).isNotNull())
    if splits is None:
        splits = value_splits(rows, [value], bucket_values=bucket_values)[value]
    counts = rows.groupBy(*[col(c) for c in [*by, value, *tag]]).agg(
        F.count("*").alias("n"), *[F.sum(col(m)).alias(m) for m in measures])
    if splits:
        edges = [-math.inf, *splits, math.inf]
        counts = Bucketizer(splits=edges, inputCol=value, outputCol="_place").transform(counts)
        # Never NULL, so that the join below filters neither side and both share one aggregation.
        counts = counts.withColumn("_bucket", F.coalesce(F.col("_place").cast("int"), F.lit(0))).drop("_place")
        home = [*by, "_bucket"]
    else:
        counts = counts.withColumn("_bucket", F.lit(0))
        home = by or ["_bucket"]
    home_cols = [col(c) for c in home]
    # Peers share the default RANGE frame, so running sums cover every tag of the same value.
    ordered = Window.partitionBy(*home_cols).orderBy(col(value))
    same_value = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    inside = counts.select(
        "*",
        (F.sum("n").over(same_value) if tag else F.col("n")).alias("ties"),
        F.sum("n").over(ordered).alias("_upto"),
        F.dense_rank().over(ordered).alias("_dense"),
        *[F.sum(col(m)).over(ordered).alias(f"_{m}") for m in measures],
    )
    keep = [col(c) for c in [*by, *tag, value, *measures]]
    if not splits:
        whole = Window.partitionBy(*home_cols)
        return inside.select(
            *keep, "n", "ties", F.col("_upto").alias("upto"), F.col("_dense").cast("long").alias("dense"),
            F.sum("n").over(whole).alias("total"),
            *[x for m in measures for x in (
                F.col(f"_{m}").alias(f"{m}_upto"), F.sum(col(m)).over(whole).alias(f"{m}_total"))])
    # Without tags each row is a distinct value, so no distinct counting is needed.
    distinct = F.count_distinct(col(value)) if tag else F.count("*")
    per_bucket = counts.groupBy(*home_cols).agg(
        F.sum("n").alias("_n"), distinct.alias("_d"), *[F.sum(col(m)).alias(m) for m in measures])
    # At most MAX_BUCKETS rows for each value of ``by``.
    line = Window.partitionBy(*([col(c) for c in by] or [F.lit(0)]))
    before = line.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *home_cols,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_doffset"),
        F.sum("_n").over(line).alias("total"),
        *[x for m in measures for x in (
            F.coalesce(F.sum(col(m)).over(before), F.lit(0)).alias(f"_offset_{m}"),
            F.sum(col(m)).over(line).alias(f"{m}_total"))],
    )
    if not by:
        offsets = F.broadcast(offsets)  # never more than MAX_BUCKETS rows
    return inside.join(offsets, home).select(
        *keep, "n", "ties",
        (F.col("_upto") + F.col("_offset")).alias("upto"),
        (F.col("_dense") + F.col("_doffset")).cast("long").alias("dense"),
        "total",
        *[x for m in measures for x in (
            (F.col(f"_{m}") + F.col(f"_offset_{m}")).alias(f"{m}_upto"), F.col(f"{m}_total"))])


def mid_rank():
    """Average rank of a value, over the columns of :func:`running_counts`."""
    return F.col("upto") - (F.col("ties") - 1) / 2


def centred_rank():
    """Mid-rank minus the mean rank: sums of it do not lose digits on long columns."""
    return mid_rank() - (F.col("total") + 1) / 2


def text_codes(df: DataFrame, name: str, *, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """``name, code``: position of each distinct text in ascending order, from 0."""
    values = df.select(F.lit(0).alias("i"), col(name).alias("v")).where(F.col("v").isNotNull()).distinct()
    return text_positions(values, bucket_values=bucket_values).select(F.col("v").alias(name), "code")


def text_positions(values: DataFrame, *, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """``i, v, code`` of distinct pairs ``i, v``: position of v among the values with this i, from 0.

    Many values are put in order by ranges and stored. A value's position is its place in its range, plus the sizes of the
    ranges before it, less the sizes of the smaller i: one row per range and one per i.
    """
    values = stored(values.select("i", "v"))
    count = values.count()
    if count <= bucket_values:
        order = Window.partitionBy("i").orderBy("v")  # at most bucket_values rows
        return values.select("i", "v", (F.row_number().over(order) - 1).cast("long").alias("code"))
    ranges = math.ceil(count / bucket_values)
    # Numbers given after the sort are the range's number in the high bits and the place in the range in the low 33.
    ordered = stored(values.repartitionByRange(ranges, "i", "v").sortWithinPartitions("i", "v").withColumn("at", F.monotonically_increasing_id()))
    line = Window.partitionBy(F.lit(0))
    part = F.shiftright("at", 33).alias("part")
    before = F.coalesce(F.sum("n").over(line.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges_before = ordered.groupBy(part).agg(F.count("*").alias("n")).select(F.col("part").alias("r"), before.alias("before"))
    smaller = F.coalesce(F.sum("n").over(line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    smaller_i = ordered.groupBy("i").agg(F.count("*").alias("n")).select(F.col("i").alias("j"), smaller.alias("smaller"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(ranges_before, part == F.col("r")).join(smaller_i, F.col("i") == F.col("j")).select(
        "i", "v", (place + F.col("before") - F.col("smaller")).cast("long").alias("code"))
