"""Exact quantiles without ever gathering a column in one place.

Global quantiles come from selection by narrowing: a sketch of a thinned sample brackets each wanted
order statistic, one counting pass over all rows verifies the bracket, and only the values strictly
inside it go on. The sample has about ``SAMPLE_ROWS`` values however many there are, so what reaches
the task that merges the sketches does not grow with the table; a poor bracket costs a round, never a
wrong value. A bracket holds about 1/200 of the rows, so a trillion rows need four rounds; values are
read out once a band holds at most ``band_rows`` rows. Only literals pass between the rounds, so
the lineage does not grow, and no row is shuffled before the last, small step.

Quantiles of a few groups are found the same way; those of many groups use the bucketed running
counts of :mod:`tabulon.operators.ranking`.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabulon.functions.columns import col, numeric_view
from tabulon.operators.ranking import running_counts

BAND_ROWS = 100_000
SKETCH_ACCURACY = 10_000
SAMPLE_ROWS = 1_000_000
SAMPLE_SEED = 17
FEW_GROUPS = 32


@dataclass(frozen=True)
class _Band:
    """The values of one column strictly between two bounds, and the positions wanted in it."""

    column: str
    low: float | None
    high: float | None
    start: int
    size: int
    positions: tuple[int, ...]

    def holds(self) -> Column:
        inside = col(self.column).isNotNull()
        if self.low is not None:
            inside = inside & (col(self.column) > self.low)
        if self.high is not None:
            inside = inside & (col(self.column) < self.high)
        return inside


def _read_out(values: DataFrame, bands: list[_Band]) -> dict[tuple[str, int], float]:
    """Order statistics of bands that hold a bounded number of rows, all in one job."""
    entries = [
        F.when(b.holds(), F.struct(F.lit(i).alias("band"), col(b.column).alias("v"))) for i, b in enumerate(bands)
    ]
    wanted = F.array(*[F.array(*[F.lit(p - b.start).cast("long") for p in b.positions]) for b in bands])
    upto = Window.partitionBy("band").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        # Rows of no band give an empty array. A filter before would repeat the columns' own expressions.
        values.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.band", "e.v").agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("hit", F.filter(
            F.element_at(wanted, F.col("band") + 1),
            lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n"))))
        .where(F.size("hit") > 0)
        .select("band", "v", "hit")
    )
    found = {}
    for row in hits.collect():
        band = bands[row.band]
        for position in row.hit:
            found[band.column, band.start + position] = row.v
    return found


def _narrow(values: DataFrame, bands: list[_Band], accuracy: int, sample: int, found: dict) -> list[_Band]:
    """Bracket every wanted position of large bands and keep only what lies inside the brackets."""
    thinned = any(b.size > sample for b in bands)
    chance = "_chance"
    while chance in values.columns:
        chance += "_"
    drawn = values.withColumn(chance, F.rand(SAMPLE_SEED)) if thinned else values
    targets, sketches = [], []
    for i, band in enumerate(bands):
        # A position read from a sample is off by its standard error, at most 1 / (2 sqrt(n)); five of them hold it.
        margin = 2.0 / accuracy + (2.5 / math.sqrt(sample) if band.size > sample else 0.0)
        taken = band.holds() & (col(chance) < sample / band.size) if band.size > sample else band.holds()
        near: list[list[int]] = []
        for position in sorted(band.positions):
            if near and position - near[-1][0] <= 1:
                near[-1].append(position)
            else:
                near.append([position])
        at = []
        for group in near:
            at += [max(0.0, (group[0] - band.start) / band.size - margin),
                   min(1.0, (group[-1] + 1 - band.start) / band.size + margin)]
        # One sketch per band answers all of its brackets.
        sketches.append(F.percentile_approx(F.when(taken, col(band.column)), at, accuracy).alias(f"s{i}"))
        targets += [(i, j, band, group) for j, group in enumerate(near)]
    sketched = drawn.agg(*sketches).first()
    brackets = [(sketched[i][2 * j], sketched[i][2 * j + 1]) for i, j, _, _ in targets]
    targets = [(band, group) for _, _, band, group in targets]

    tallies = []
    for i, (band, _) in enumerate(targets):
        low, high = brackets[i]
        value = F.when(band.holds(), col(band.column))
        tallies += [F.count_if(value < low), F.count_if(value <= low), F.count_if(value < high), F.count_if(value <= high)]
    counts = values.agg(*[t.alias(f"n{i}") for i, t in enumerate(tallies)]).first()

    rest: dict[tuple, list[int]] = {}
    for i, (band, group) in enumerate(targets):
        low, high = brackets[i]
        under, upto_low, before_high, upto_high = (band.start + counts[4 * i + j] for j in range(4))
        for position in group:
            if position < under:
                key = (band.column, band.low, low, band.start, under)
            elif position < upto_low:
                found[band.column, position] = low
                continue
            elif position < before_high:
                key = (band.column, low, high, upto_low, before_high)
            elif position < upto_high:
                found[band.column, position] = high
                continue
            else:
                key = (band.column, high, band.high, upto_high, band.start + band.size)
            rest.setdefault(key, []).append(position)
    return [_Band(c, lo, hi, start, end - start, tuple(p)) for (c, lo, hi, start, end), p in rest.items()]


def order_statistics(
    values: DataFrame, wanted: Mapping[str, Sequence[int]], sizes: Mapping[str, int], *,
    band_rows: int = BAND_ROWS, accuracy: int = SKETCH_ACCURACY, sample: int = SAMPLE_ROWS,
) -> dict[tuple[str, int], float]:
    """Values at 0-based positions of the ascending order of double columns (NULL left out)."""
    found: dict[tuple[str, int], float] = {}
    bands = [_Band(c, None, None, 0, sizes[c], tuple(sorted(set(p)))) for c, p in wanted.items() if p]
    while bands:
        small = [b for b in bands if b.size <= band_rows]
        large = [b for b in bands if b.size > band_rows]
        if small:
            found.update(_read_out(values, small))
        bands = _narrow(values, large, accuracy, sample, found) if large else []
    return found


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], *, sizes: Mapping[str, int] | None = None,
    band_rows: int = BAND_ROWS, accuracy: int = SKETCH_ACCURACY, sample: int = SAMPLE_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each named column; ``[None, ...]`` where it has no number."""
    values = numeric_view(df, wanted)
    if sizes is None:
        row = values.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(wanted)]).first()
        sizes = {c: row[i] for i, c in enumerate(wanted)}
    positions: dict[str, set[int]] = {}
    for c, probabilities in wanted.items():
        if sizes[c]:
            spots = [p * (sizes[c] - 1) for p in probabilities]
            positions[c] = {math.floor(s) for s in spots} | {math.ceil(s) for s in spots}
    found = order_statistics(values, {c: sorted(p) for c, p in positions.items()}, sizes,
                             band_rows=band_rows, accuracy=accuracy, sample=sample)
    result: dict[str, list[float | None]] = {}
    for c, probabilities in wanted.items():
        result[c] = []
        for p in probabilities:
            if not sizes[c]:
                result[c].append(None)
                continue
            spot = p * (sizes[c] - 1)
            low, high = found[c, math.floor(spot)], found[c, math.ceil(spot)]
            result[c].append(low + (high - low) * (spot - math.floor(spot)))
    return result


def group_quantiles(df: DataFrame, group: str, value: str, names: Mapping[str, float], *,
                    few_groups: int = FEW_GROUPS) -> DataFrame:
    """Exact quantiles of a double column per group: ``group, n, <one column per name>``.

    A few groups are narrowed side by side, each like a column of its own, so no row is shuffled.
    Many groups go through running counts, which spread a group of any size over the value buckets.
    Groups must not be NULL; one without any number keeps its row.
    """
    rows = df.select(col(group).alias("g"), col(value).alias("y"))  # whatever the columns are called
    sizes = rows.groupBy("g").agg(F.count("y").alias("n"))
    first = sizes.limit(few_groups + 1).collect()
    if len(first) <= few_groups:
        wide = rows.select(*[F.when(F.col("g") == F.lit(r[0]), F.col("y")).alias(f"c{i}") for i, r in enumerate(first)])
        found = exact_quantiles(wide, {f"c{i}": list(names.values()) for i in range(len(first))},
                                sizes={f"c{i}": r.n for i, r in enumerate(first)}) if first else {}
        schema = T.StructType([
            T.StructField(group, df.schema[group].dataType), T.StructField("n", T.LongType()),
            *[T.StructField(name, T.DoubleType()) for name in names]])
        return df.sparkSession.createDataFrame([(r[0], r.n, *found[f"c{i}"]) for i, r in enumerate(first)], schema)

    counts = running_counts(rows, "y", by=["g"])
    parts = []
    for i, p in enumerate(names.values()):
        spot = F.lit(float(p)) * (F.col("total") - 1)
        floor, ceil = F.floor(spot), F.ceil(spot)
        here = lambda position: (position < F.col("upto")) & (position >= F.col("upto") - F.col("n"))
        weight = F.when(here(floor), 1 - (spot - floor)).otherwise(0.0) + \
            F.when(here(ceil), spot - floor).otherwise(0.0)
        parts.append(F.sum(F.when(weight > 0, F.col("y") * weight)).alias(f"q{i}"))
    return sizes.join(counts.groupBy("g").agg(*parts), "g", "left").select(
        F.col("g").alias(group), "n", *[F.col(f"q{i}").alias(name) for i, name in enumerate(names)])
