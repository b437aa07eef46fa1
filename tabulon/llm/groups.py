"""Pairs of rows that share a key, where one key may hold any part of all rows.

Rows are shuffled by key and compared key by key. A key with more than ``limit`` rows is not compared where it arrives: its rows go out
again unchanged, are dealt by a hash into tiles of about half that size, and every pair of tiles becomes a group of its own, so every
pair still meets once, no task holds more than a group of ``limit`` rows, and the work of a hot key is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabulon.llm.shared import unused, written

# Compares rows with equal keys (ascending); with sides only rows of different sides. Results come in pieces that fit into memory.
Compare = Callable[[np.ndarray, pa.Table, np.ndarray | None], Iterator[dict[str, np.ndarray]]]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int | None) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by key as (rows of whole groups, False) or, above the limit, as (some rows of one group, True)."""
    held: list[pa.RecordBatch] = []  # rows of the last key, which may go on
    large = None

    def cut(table: pa.Table) -> Iterator[tuple[pa.Table, bool]]:
        keys = table.column(key).to_numpy()
        opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(opens, len(keys)))
        for at in np.flatnonzero(sizes > (limit or len(keys))).tolist():
            yield table.slice(int(opens[at]), int(sizes[at])), True
        small = np.repeat(sizes <= (limit or len(keys)), sizes)
        if small.any():
            yield (table if small.all() else table.filter(pa.array(small))), False

    for batch in batches:
        keys = batch.column(key).to_numpy()
        if large is not None and len(keys):
            n = int(np.searchsorted(keys, large, side="right"))
            if n:
                yield pa.Table.from_batches([batch.slice(0, n)]), True
            batch, keys = batch.slice(n), keys[n:]
        if not len(keys):
            continue
        large = None
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[-1].column(key)[0].as_py() != keys[0]):
            yield from cut(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
        if limit and sum(b.num_rows for b in held) > limit:
            yield pa.Table.from_batches(held), True
            held, large = [], keys[-1]
    if held:
        yield from cut(pa.Table.from_batches(held))


def pairs_in_groups(rows: DataFrame, key: str, order: str, found: T.StructType, compare: Compare, limit: int,
                    salt: int | None = None) -> DataFrame:
    """All that ``compare`` finds between rows with equal keys (a long or int column); ``order`` is a column that differs inside a key.

    With a salt, the rows of a hot key meet only those of their own tile, which the salt chooses: a look at part of the pairs.
    """
    kept, (given,) = rows.columns, unused(rows, "given")
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in found), T.StructField(given, rows.schema)])
    arrow, plain = to_arrow_schema(out), to_arrow_schema(found)

    def result(values: dict[str, np.ndarray], schema: pa.Schema) -> list[pa.Array]:
        return [pa.array(values[f.name], f.type) for f in schema]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, large in whole_groups(batches, key, limit):
            if large:
                for batch in table.to_batches():
                    columns = [pa.nulls(batch.num_rows, f.type) for f in plain]
                    again = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow.field(given).type)],
                                                       fields=list(arrow.field(given).type))
                    yield pa.RecordBatch.from_arrays([*columns, again], schema=arrow)
            else:
                for values in compare(table.column(key).to_numpy(), table, None):
                    columns = result(values, plain)
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), arrow.field(given).type)], schema=arrow)

    first = written(rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(compared, out))
    links = first.where(F.col(given).isNull()).drop(given)
    hot = first.where(F.col(given).isNotNull()).select(f"{given}.*")
    if hot.isEmpty():
        return links

    n, tile, other, cell, side = unused(hot, "n", "tile", "other", "cell", "side")
    tiles = F.ceil(F.col(n) / (limit / 2))
    sizes = written(hot.groupBy(key).agg(F.count(F.lit(1)).alias(n)))
    dealt = hot.join(sizes, key).withColumn(tile, F.pmod(F.xxhash64(order, F.lit(salt or 0)), tiles)).withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)) if salt is None else F.col(tile))
    # Cells that a hash takes together are compared together, which adds pairs of other keys to those that are checked anyway.
    dealt = dealt.withColumns({
        cell: F.xxhash64(key, F.least(tile, other), F.greatest(tile, other)),
        side: F.when(F.col(tile) == F.col(other), 0).when(F.col(tile) < F.col(other), 1).otherwise(2)}).select(*kept, cell, side)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, cell, None):
            sides = table.column(side).to_numpy()
            for mask, given_sides in ((sides == 0, None), (sides > 0, sides[sides > 0])):
                if mask.any():
                    part = table.filter(pa.array(mask))
                    for values in compare(part.column(cell).to_numpy(), part, given_sides):
                        yield pa.RecordBatch.from_arrays(result(values, plain), schema=plain)

    return links.unionByName(dealt.repartition(cell).sortWithinPartitions(cell, side).mapInArrow(crossed, found))
