"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors are compared only within their label. Equal vectors are merged first, so a vector that fills a third of the table is one row. A vector
x of length one is quantised to whole numbers of -127..127 times a scale; with x' the quantised vector, |x.y - x'.y'| is at
most |x - x'| + |x'| |y - y'|. Products of whole numbers below 2^24 are exact in single precision, so a matrix product of two
tiles gives x'.y' exactly, and only pairs whose upper bound reaches the threshold are computed again in double precision. No
pair at or above the threshold can be lost.

Tiles: each vector belongs to the nearest of some pivots (a bounded sample; it changes speed only). Vectors at a distance of at most d
whose nearest pivots are p and q both lie within d of the plane between p and q, so a vector goes to the cells it can reach, not to all.
A cell with more vectors than a tile is dealt to several tiles by hash; each task gets two tiles. A tile returns a number of links per
vector and a spanning set of links, never all pairs.

Defined results: vectors that are null, zero or hold null or non-finite numbers, and those without a label, link with
nothing. Vectors of different lengths are not compared. Repeated rows are other vectors. Ids may be null; the component id is
the smallest id reached, nulls aside. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.graph import components, local_roots
from tabulon.llm.shared import ship, written

TILE = 1024
MAX_PIVOTS = 1024
SLACK = 1e-9  # more than the rounding of double precision, in all bounds


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, scales, error norms |x - x'| and norms |x'| of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    back = whole * scale[:, None]
    return whole, scale, np.linalg.norm(unit - back, axis=1), np.linalg.norm(back, axis=1)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. They are first scaled by a power of two, which changes no digit and keeps squares within range."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    scaled = np.ldexp(vectors, -exponent)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors of two tiles whose cosine reaches the threshold."""
    (a, scale_a, error_a, norm_a), (b, scale_b, error_b, _) = quantised(left), quantised(right)
    a, b = a.astype(np.float32), b.astype(np.float32)  # whole numbers: their products and sums stay exact
    rows, columns = [], []
    for at in range(0, len(a), 256):
        here = slice(at, at + 256)
        bound = (a[here] @ b.T) * scale_a[here, None] * scale_b + error_a[here, None] + norm_a[here, None] * error_b
        possible = bound >= threshold - SLACK
        i, j = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
        if len(i):
            exact = left[here][i] @ right[j].T
            x, y = np.nonzero(possible[np.ix_(i, j)] & (exact >= threshold))
            rows.append(i[x] + at)
            columns.append(j[y])
    none = np.zeros(0, np.int64)
    return np.concatenate([*rows, none]), np.concatenate([*columns, none])


def _compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of tiles: (node, links, other) with counts (other null) and spanning links."""
    own = rows["side"].to_numpy() == 0
    vectors = unit_vectors(np.stack(rows["vector"].to_numpy()).astype(np.float64))
    node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
    first = np.flatnonzero(own)
    if rows["same"].iloc[0]:
        a, b = tile_links(vectors, vectors, threshold)
        a, b = a[a < b], b[a < b]
    elif len(first) in (0, len(rows)):
        a = b = first[:0]
    else:
        second = np.flatnonzero(~own)
        a, b = tile_links(vectors[first], vectors[second], threshold)
        a, b = first[a], second[b]
    count = np.bincount(a, n[b], len(rows)) + np.bincount(b, n[a], len(rows))
    root = local_roots(len(rows), a, b)
    linked, moved = np.flatnonzero(count > 0), np.flatnonzero(root != np.arange(len(rows)))
    return pd.DataFrame({
        "node": np.concatenate([node[linked], node[moved]]),
        "links": np.concatenate([count[linked].astype(np.int64), np.zeros(len(moved), np.int64)]),
        "other": pd.array([*[pd.NA] * len(linked), *node[root[moved]].tolist()], dtype="Int64")})


def _pivots(groups: DataFrame, per_cell: int) -> list[np.ndarray]:
    """Pivots by vector length: as many as make cells of about a tile in the largest label, from a bounded sample."""
    largest = groups.groupBy("label", F.size("vector").alias("width")).count().groupBy("width").agg(F.max("count").alias("n"))
    out = []
    for row in largest.orderBy(F.desc("n")).limit(64).collect():
        wanted = min(MAX_PIVOTS, math.ceil(row.n / per_cell))
        sample = groups.where(F.size("vector") == row.width).orderBy(F.xxhash64("node")).limit(wanted).select("vector").collect()
        out.append(unit_vectors(np.array([r.vector for r in sample], np.float64)))
    return out


def _celled(groups: DataFrame, pivots: list[np.ndarray], threshold: float) -> DataFrame:
    """Each group with its cell and the cells that it can have links in (its own among them)."""
    shipped = groups.sparkSession.sparkContext.broadcast({p.shape[1]: p for p in pivots})
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    schema = T.StructType([*groups.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, cells = np.zeros(batch.num_rows, np.int32), [[0]] * batch.num_rows
            vectors = batch.column("vector")
            widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                pivot = shipped.value.get(width)
                if pivot is None:
                    continue
                at = np.flatnonzero(widths == width)
                unit = unit_vectors(vectors.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, width))
                dot = unit @ pivot.T
                near = dot.argmax(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * pivot @ pivot.T))
                # Twice the distance to the plane between two pivots, times their distance, is a difference of two dots.
                within = dot[np.arange(len(at)), near][:, None] - dot <= reach * apart[near] + SLACK
                within[np.arange(len(at)), near] = True
                home[at] = near
                for i, row in zip(at.tolist(), within):
                    cells[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(cells, pa.list_(pa.int32()))], schema.names)

    return groups.mapInArrow(assign, schema)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    ship(vectors.sparkSession)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    limit = F.lit(float("inf"))
    sound = (F.col("label").isNotNull() & F.col("vector").isNotNull()
             & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("vector", lambda x: x != 0))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), vector.alias("vector"))
    rows = rows.withColumn("digest", F.when(sound, F.unhex(F.sha2(F.to_json(F.struct("label", "vector")), 256))))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))

    groups = written(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("row").alias("node"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"),
        F.first("label").alias("label"), F.first("vector").alias("vector")))
    celled = written(_celled(groups.select("node", "n", "label", "vector"), _pivots(groups, tile), threshold).withColumn(
        "width", F.size("vector")))
    place = ["label", "width"]
    tiles = celled.groupBy(*place, "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    placed = celled.join(tiles, [*place, "cell"]).withColumn(
        "tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).drop("tiles").withColumn("other", F.explode("cells"))
    met = placed.join(tiles.withColumnRenamed("cell", "other"), [*place, "other"]).withColumn(
        "other_tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    mine, theirs = F.struct("cell", "tile"), F.struct(F.col("other").alias("cell"), F.col("other_tile").alias("tile"))
    dealt = met.select(
        *place, F.least(mine, theirs).alias("lo"), F.greatest(mine, theirs).alias("hi"),
        (mine > theirs).cast("int").alias("side"), (mine == theirs).alias("same"), "node", "n", "vector")

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        return _compare(pair, threshold)

    found = written(dealt.groupBy(*place, "lo.cell", "lo.tile", "hi.cell", "hi.tile").applyInPandas(
        compare, "node long, links long, other long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = written(components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))))
    lows = member.join(groups.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component_low"))
    member = member.join(lows, "root").select("node", "component_low", F.lit(True).alias("linked"))
    resolved = written(groups.join(counts, "node", "left").join(member, "node", "left").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.when(F.col("linked"), F.col("component_low")).otherwise(F.col("low")).alias("component_id")))
    joined = rows.select("vec_id", "digest").where(F.col("digest").isNotNull()).join(resolved, "digest").select(
        "vec_id", "n_links", "component_id")
    alone = rows.where(F.col("digest").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
