"""Kendall's tau-b of two columns, exact for any number of rows.

Both columns are replaced by dense ranks, written in base 256. Two rows that differ in both
columns have a first differing digit on the x side and one on the y side. For each combination of
the two digit places the rows are grouped by the digits before them, which leaves a table of at
most 256 x 256 counts per group; the concordance of all pairs whose first differing digits are
there is the concordance of that small table. Every pair is counted in exactly one table, so the
sum over all of them is the numerator of tau. The counts are pre-aggregated before the shuffle,
the number of places grows with the logarithm of the number of distinct values, and no group
can grow with the data.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.distributions import normal_two_sided
from tabulon.operators.ranking import running_counts, value_splits

# The pair counting runs in Python workers: ship it with the job instead of asking every node to have it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGIT_BITS = 8
# Cells that a task scores together, besides a table that is not whole yet (at most 65,536).
CELLS_AT_A_TIME = 100_000
_EXACT_ROWS = 33


def _ordered_pairs(table: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per row: weight of rows of the same table with smaller x and smaller y, minus smaller x and larger y.

    Bit by bit on y: at each bit, rows of a table that agree on the higher bits form a block, and
    those with the bit set meet those without it. Cumulated weights in (block, x) order give the
    weight of the other half with smaller x. All tables of a batch are worked at once.
    """
    score = np.zeros(len(n))
    for bit in range(DIGIT_BITS):
        block = table * (1 << (DIGIT_BITS - bit)) + (y >> (bit + 1))
        order = np.lexsort((x, block))
        b, xs, high = block[order], x[order], ((y >> bit) & 1)[order].astype(bool)
        new_block = np.r_[True, b[1:] != b[:-1]]
        new_run = new_block | np.r_[True, xs[1:] != xs[:-1]]
        run_start = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
        block_start = np.flatnonzero(new_block)[np.cumsum(new_block) - 1]
        for upper, sign in ((True, 1.0), (False, -1.0)):
            other = np.where(high != upper, n[order], 0.0)
            before = np.r_[0.0, np.cumsum(other)]
            weight = before[run_start] - before[block_start]
            score[order] += np.where(high == upper, sign * weight, 0.0)
    return score


def _scores(cells: np.ndarray) -> float:
    """Weighted sum of ``_ordered_pairs`` over whole tables; ``cells`` has the rows px, py, gx, gy, x, y, n, tables in a row."""
    table = np.cumsum(np.r_[False, (cells[:4, 1:] != cells[:4, :-1]).any(axis=0)])
    some = np.bincount(table)[table] > 1  # one cell alone holds no pair that counts here
    x, y, n = cells[4:, some]
    n = n.astype(np.float64)
    return float((_ordered_pairs(table[some], x, y, n) * n).sum()) if len(n) else 0.0


def _table_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each run of cells, which come sorted by table; a table that goes on in the next batch waits for its end."""
    waiting, rows = [], 0

    def scored(cells: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"s": [_scores(cells)]})

    for batch in batches:
        waiting.append(np.stack([c.to_numpy() for c in batch.columns]).astype(np.int64))
        rows += batch.num_rows
        if rows < CELLS_AT_A_TIME:
            continue
        cells = np.concatenate(waiting, axis=1)
        new = np.flatnonzero((cells[:4, 1:] != cells[:4, :-1]).any(axis=0))
        ready = int(new[-1]) + 1 if len(new) else 0
        if ready:
            yield scored(cells[:, :ready])
        waiting, rows = [cells[:, ready:].copy()], cells.shape[1] - ready
    if rows:
        yield scored(np.concatenate(waiting, axis=1))


def _places(distinct: int) -> int:
    return max(1, math.ceil(max(1, (distinct - 1).bit_length()) / DIGIT_BITS))


def _digit(code: Column, place: Column) -> Column:
    return F.call_function("shiftright", code, place * DIGIT_BITS).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))


def concordance(ranked: DataFrame, x_places: int, y_places: int) -> float:
    """Sum of sign(dx)·sign(dy) over all pairs of rows of ``x, y, n`` (dense ranks and weights)."""
    spots = F.array(*[
        F.struct(F.lit(i).alias("px"), F.lit(j).alias("py")) for i in range(x_places) for j in range(y_places)])
    rest = lambda code, place: F.call_function("shiftright", code, (place + 1) * DIGIT_BITS)
    cells = (
        ranked.select("x", "y", "n", F.explode(spots).alias("p"))
        .select(
            F.col("p.px").alias("px"), F.col("p.py").alias("py"),
            rest(F.col("x"), F.col("p.px")).alias("gx"), rest(F.col("y"), F.col("p.py")).alias("gy"),
            _digit(F.col("x"), F.col("p.px")).cast("int").alias("x"),
            _digit(F.col("y"), F.col("p.py")).cast("int").alias("y"), "n")
        .groupBy("px", "py", "gx", "gy", "x", "y").agg(F.sum("n").alias("n"))
    )
    # The tables pass as plain rows, never as one value each: a task holds a few batches of them.
    table = ["px", "py", "gx", "gy"]
    sorted_cells = cells.repartition(*table).sortWithinPartitions(*table)
    return sorted_cells.mapInArrow(_table_scores, "s double").agg(F.sum("s")).first()[0] or 0.0


def _exact_p(n: int, discordant: int) -> float:
    """Two-sided p without ties: share of permutations with at most so many inversions."""
    total = n * (n - 1) // 2
    fewer = min(discordant, total - discordant)
    if 2 * fewer == total:
        return 1.0
    if fewer <= 1:
        return 2.0 / math.factorial(n - fewer) if n - fewer <= 170 else 0.0
    ways = [1]
    for size in range(2, n + 1):
        longer = [0] * min(fewer + 1, len(ways) + size - 1)
        for k in range(len(longer)):
            longer[k] = sum(ways[max(0, k - size + 1):k + 1])
        ways = longer
    return min(1.0, 2 * sum(ways[:fewer + 1]) / math.factorial(n))


def kendall_tau(xy: DataFrame) -> tuple[float | None, int, float | None]:
    """``tau, n, p`` of the complete rows ``x, y``: exact p for few rows without ties, normal beyond."""
    facts = {}
    for name in ("x", "y"):
        t = F.col("n").cast("double")
        facts[name] = xy.groupBy(name).agg(F.count("*").alias("n")).agg(
            F.sum("n").alias("n"), F.count("*").alias("distinct"),
            F.sum(t * (t - 1)).alias("pairs"), F.sum(t * (t - 1) * (2 * t + 5)).alias("five"),
            F.sum(t * (t - 1) * (t - 2)).alias("triples")).first()
    fx, fy = facts["x"], facts["y"]
    n = fx.n or 0
    total = n * (n - 1) / 2
    tied_x, tied_y = (fx.pairs or 0.0) / 2, (fy.pairs or 0.0) / 2
    if n < 2 or tied_x == total or tied_y == total:
        return None, n, None
    splits = value_splits(xy, ["x", "y"])
    sides = {c: running_counts(xy, c, splits=splits[c]).select(c, F.col("dense").alias(f"_{c}")) for c in splits}
    # A value shared by many rows is one row here before it meets its rank.
    counted = xy.groupBy("x", "y").agg(F.count("*").alias("n"))
    ranked = counted.join(sides["x"], "x").join(sides["y"], "y").select(
        (F.col("_x") - 1).alias("x"), (F.col("_y") - 1).alias("y"), "n")
    s = concordance(ranked, _places(fx.distinct), _places(fy.distinct))
    tau = max(-1.0, min(1.0, s / math.sqrt((total - tied_x) * (total - tied_y))))
    if tied_x == tied_y == 0:
        discordant = round((total - s) / 2)
        if n <= _EXACT_ROWS or min(discordant, total - discordant) <= 1:
            return tau, n, _exact_p(n, discordant)
    m = n * (n - 1.0)
    variance = (m * (2 * n + 5) - fx.five - fy.five) / 18 + fx.pairs * fy.pairs / (2 * m)
    if n > 2:
        variance += fx.triples * fy.triples / (9 * m * (n - 2))
    return tau, n, normal_two_sided(s / math.sqrt(variance)) if variance > 0 else None
