"""Random forests whose trees grow until their leaves are pure, in two phases.

Phase one grows the upper levels of all trees together. While a node holds more than ``node_rows`` rows, two passes over the table per
level find the range of each of its columns and histograms over that range, which are added up across tasks; the driver sees one row per
node and chooses nothing but what the tasks already found. A histogram cell keeps its smallest and largest value, so a split lies
half-way between two values of the table, and a column that varies can always be split. Phase two sends the rows of every other
node to one task, by (tree, node), and finishes the subtree there: columns are sorted once, and one step splits all nodes of a level
with exact running sums. A table with at most ``node_rows`` different rows of features needs no phase one, its trees are exact from the root.

Rows are stored in the order of their features. Equal ones lie side by side, and no split tells them apart: a block sends one entry for
them, with the sums of their labels and the smallest and largest one, and asks for one prediction.

Rows are weighted by a Poisson draw with mean one from a hash of their number and the tree, so a retried task draws the same. Which
columns a node tries follows from the node's path, so both phases grow the same tree. Subtrees are rows of a stored table
(flat arrays in chunks of a bounded number of nodes, so that no row of the table is large), upper trees stay small: fewer nodes than trees
times rows / node_rows. To predict, rows are routed through the upper trees and meet their subtrees in a shuffle by (tree, node); whole
subtrees are applied to blocks of rows at a time.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import col
from tabulon.sources.writers import shared_folder, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

NODE_ROWS = 200_000
BINS = 256
BLOCK_ROWS = 16_384
# Rows of a stored part, about; nodes in a row of the table of subtrees.
PART_ROWS = 1_000_000
CHUNK_NODES = 4_096
# Numbers of histograms that a task keeps at a time; the nodes of a level are taken in parts of that size.
HISTOGRAM_CELLS = 8_000_000

POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(*parts, begun: np.ndarray | None = None) -> np.ndarray:
    """A hash of all parts in turn; ``begun`` may carry that of the parts before them."""
    out = np.uint64(0x9E3779B97F4A7C15) if begun is None else begun
    with np.errstate(over="ignore"):
        for part in parts:
            out = _mixed(out + np.asarray(part).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return out


def bootstrap_weights(rows: np.ndarray, tree: int, seed: int, begun: np.ndarray | None = None) -> np.ndarray:
    """How often each numbered row is drawn for a tree; ``begun`` may carry ``_hash(rows)``."""
    uniform = (_hash(tree, seed, begun=_hash(rows) if begun is None else begun) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    drawn = np.zeros(len(uniform), np.uint8)
    for bound in POISSON[:8]:
        drawn += uniform >= bound
    rare = np.flatnonzero(drawn == 8)
    drawn[rare] = np.searchsorted(POISSON, uniform[rare], side="right")
    return drawn.astype(np.float64)


def tried_columns(keys: np.ndarray, varies: np.ndarray, tried: int) -> np.ndarray:
    """(nodes, columns): the first ``tried`` columns that vary, in the order that the node's key gives them."""
    columns = varies.shape[1]
    if tried >= columns:
        return varies
    order = np.argsort(_hash(keys[:, None], np.arange(columns)[None, :]), axis=1)
    allowed = np.take_along_axis(varies, order, axis=1)
    allowed &= np.cumsum(allowed, axis=1) <= tried
    out = np.zeros_like(varies)
    np.put_along_axis(out, order, allowed, axis=1)
    return out


def _halfway(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle = low + (high - low) / 2
    return np.where(middle < high, middle, low)


@dataclass
class Tree:
    """Flat arrays of a (sub)tree; ``left`` is -1 in a leaf, and values go left if they are at most the threshold."""

    column: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # (nodes, targets)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.left[at] >= 0)
        while len(open_):
            node = at[open_]
            at[open_] = np.where(x[open_, self.column[node]] <= self.threshold[node], self.left[node], self.right[node])
            open_ = open_[self.left[at[open_]] >= 0]
        return at


def targets_of(y: np.ndarray, classes: int) -> np.ndarray:
    """One column of numbers, or one indicator column per class."""
    return y[:, None] if not classes else (y[:, None] == np.arange(classes)).astype(np.float64)


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, key: int, tried: int, classes: int) -> Tree:
    """The tree of all rows with a weight, down to pure leaves: squared error for numbers, Gini impurity for classes."""
    return grow_entries(x, weight, targets_of(y, classes) * weight[:, None], y, y, key, tried)


def grow_entries(x: np.ndarray, weight: np.ndarray, weighted: np.ndarray, least: np.ndarray, most: np.ndarray, key: int, tried: int) -> Tree:
    """The tree of entries that stand for rows of equal features: their weight, their weighted targets' sums, their smallest and largest label."""
    n, columns = x.shape
    targets = weighted.shape[1]
    node = np.zeros(n, np.int64)  # place in the current level
    orders = [np.argsort(x[:, f], kind="stable") for f in range(columns)]
    keys = np.array([key], np.uint64)
    level = np.zeros(1, np.int64)  # number of each node of the level in the tree
    out: dict[str, list] = {"column": [np.zeros(1, np.int32)], "threshold": [np.zeros(1)], "left": [np.full(1, -1)], "right": [np.full(1, -1)],
                            "value": [np.zeros((1, targets))]}
    made = 1
    while len(level):
        rows = orders[0]
        starts = np.searchsorted(node[rows], np.arange(len(level)))
        total_w = np.add.reduceat(weight[rows], starts)
        total = np.add.reduceat(weighted[rows], starts, axis=0)
        _put(out["value"], level, total / total_w[:, None])
        pure = np.minimum.reduceat(least[rows], starts) == np.maximum.reduceat(most[rows], starts)
        varies = np.empty((len(level), columns), bool)
        for f, order in enumerate(orders):
            own = x[order, f]
            varies[:, f] = own[starts] < own[np.append(starts[1:], len(order)) - 1]
        allowed = tried_columns(keys, varies, tried) & ~pure[:, None]
        score = np.full((len(level), columns), -np.inf)
        threshold = np.zeros((len(level), columns))
        for f in np.flatnonzero(allowed.any(axis=0)).tolist():
            score[:, f], threshold[:, f] = _best_splits(x[:, f], orders[f], node, weight, weighted, starts, total_w, total, allowed[:, f])
        best = score.argmax(axis=1)
        split = np.isfinite(score[np.arange(len(level)), best])
        if not split.any():
            break
        chosen = np.flatnonzero(split)
        cut = threshold[chosen, best[chosen]]
        left = made + 2 * np.arange(len(chosen))
        for name, values in (("column", best[chosen]), ("threshold", cut), ("left", left), ("right", left + 1)):
            _put(out[name], level[chosen], values)
        made += 2 * len(chosen)
        for name, fill in (("column", 0), ("threshold", 0.0), ("left", -1), ("right", -1)):
            out[name].append(np.full(2 * len(chosen), fill, out[name][0].dtype))
        out["value"].append(np.zeros((2 * len(chosen), targets)))
        place = np.full(len(level), -1)
        place[chosen] = np.arange(len(chosen))
        goes_on = place[node] >= 0
        row_cut, row_column = np.zeros(len(level)), best
        row_cut[chosen] = cut
        right = x[np.arange(n), row_column[node]] > row_cut[node]
        node = np.where(goes_on, 2 * place[node] + right, -1)
        orders = [kept[np.argsort(node[kept], kind="stable")] for kept in (o[goes_on[o]] for o in orders)]
        keys = _hash(np.repeat(keys[chosen], 2), np.tile([0, 1], len(chosen)))
        level = np.stack([left, left + 1], axis=1).ravel()
    flat = {name: np.concatenate(parts) for name, parts in out.items()}
    return Tree(**flat)


def _put(parts: list[np.ndarray], at: np.ndarray, values: np.ndarray) -> None:
    """Set values of the part made last, whose numbers are the last ones."""
    before = sum(len(p) for p in parts[:-1])
    parts[-1][at - before] = values


def _best_splits(x, order, node, weight, weighted, starts, total_w, total, allowed) -> tuple[np.ndarray, np.ndarray]:
    """For every node of a level its best score along one column, the first of equals, and the threshold there."""
    here, value = node[order], x[order]
    ends = np.append(starts[1:], len(order)) - 1
    before_w = np.append(0, np.cumsum(weight[order]))
    before = np.vstack([np.zeros(weighted.shape[1]), np.cumsum(weighted[order], axis=0)])
    at = np.flatnonzero((value[1:] > value[:-1]) & (here[1:] == here[:-1]) & allowed[here[1:]])
    out, threshold = np.full(len(starts), -np.inf), np.zeros(len(starts))
    if not len(at):
        return out, threshold
    own = here[at]
    left_w = before_w[at + 1] - before_w[starts[own]]
    left = before[at + 1] - before[starts[own]]
    right_w, right = total_w[own] - left_w, total[own] - left
    score = (left ** 2).sum(axis=1) / left_w + (right ** 2).sum(axis=1) / right_w
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    best = np.maximum.reduceat(score, first)
    hit = np.flatnonzero(score == np.repeat(best, np.diff(np.append(first, len(own)))))
    hit = hit[np.append(True, own[hit][1:] != own[hit][:-1])]
    out[own[hit]] = best
    threshold[own[hit]] = _halfway(value[at[hit]], value[at[hit] + 1])
    return out, threshold


# ---- phase one ----------------------------------------------------------------------------------------------------------


@dataclass
class UpperTree:
    """The upper levels of a tree while they grow; a leaf that is not ``open`` any more is handed to phase two."""

    column: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    key: list[int] = field(default_factory=list)
    open: list[int] = field(default_factory=list)
    settled: dict[int, list[float]] = field(default_factory=dict)  # large leaves: their targets

    def flat(self) -> Tree:
        return Tree(np.array(self.column), np.array(self.threshold), np.array(self.left), np.array(self.right), np.zeros((len(self.left), 0)))

    def split(self, node: int, column: int, threshold: float) -> tuple[int, int]:
        self.column[node], self.threshold[node] = column, threshold
        self.left[node], self.right[node] = len(self.left), len(self.left) + 1
        for side in (0, 1):
            self.column.append(0)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.key.append(int(_hash(np.uint64(self.key[node]), side)))
        return self.left[node], self.right[node]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, values and labels of the stored blocks."""
    for batch in batches:
        for rows, x, y, n in zip(*(batch.column(c).to_pylist() for c in ("rows", "x", "y", "n"))):
            yield np.frombuffer(rows, "<i8"), np.frombuffer(x, "<f8").reshape(n, -1), np.frombuffer(y, "<f8")


def stored_blocks(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """The rows of double columns in numbered blocks, in the order of the features, kept for the passes to come: ``n, rows, x, y``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            numbers, *columns, y = (c.to_numpy() for c in table.columns)
            x = np.column_stack([np.asarray(c, float) for c in columns])
            return pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int32()), "rows": [numbers.astype("<i8").tobytes()],
                                               "x": [x.astype("<f8").tobytes()], "y": [np.asarray(y, float).astype("<f8").tobytes()]})

        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            while held >= BLOCK_ROWS:
                table = pa.Table.from_batches(waiting)
                yield block(table.slice(0, BLOCK_ROWS))
                waiting = table.slice(BLOCK_ROWS).to_batches()
                held -= BLOCK_ROWS
        if held:
            yield block(pa.Table.from_batches(waiting))

    spark, names = df.sparkSession, [f"c{i}" for i in range(len(features) + 1)]
    numbered = stored(df.select(F.monotonically_increasing_id().alias("row"), *[  # numbers of two readings may differ
        col(c).cast("double").alias(name) for c, name in zip([*features, label], names)]))
    parts = max(spark.sparkContext.defaultParallelism, -(-numbered.count() // PART_ROWS))
    order = [*names[:-1], "row"]
    folder = shared_folder(spark)
    (numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
     .mapInArrow(pack, "n int, rows binary, x binary, y binary").write.parquet(folder))
    return spark.read.schema("n int, rows binary, x binary, y binary").parquet(folder)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin."""
    return np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1)))


def entries(blocks: DataFrame) -> int:
    """The number of runs of equal features in the stored blocks, at least that of different rows of features."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(_runs(x)) for _, x, _ in _blocks(batches))], pa.int64())})

    return blocks.mapInArrow(counted, "n long").agg(F.sum("n")).first()[0] or 0


class Forest:
    """A fitted forest: ``upper`` trees on the driver, and a stored table of subtrees."""

    def __init__(self, upper: list[Tree], subtrees: DataFrame, targets: int):
        self.upper, self.subtrees, self.targets = upper, subtrees, targets

    def node_table(self) -> DataFrame:
        """``tree, root, chunk, column, threshold, left, right, value``: arrays of each chunk of a subtree; ``root`` is its node in the upper tree."""
        return self.subtrees

    def predicted(self, blocks: DataFrame) -> DataFrame:
        """``row, label, mean``: the targets of each row of stored blocks, averaged over the trees."""
        upper, targets = self.upper, self.targets

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, x, _ in _blocks(batches):
                yield from _by_node(upper, rows, x)

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, x, y in _blocks(batches):
                first = _runs(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows[first], np.diff(np.append(first, len(x))))), pa.array(rows), pa.array(y)],
                                                 ["number", "row", "label"])

        def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, chunks, tree = None, [], None
            for r in _single_rows(batches):
                if (r["tree"], r["root"]) != current:
                    current, chunks, tree = (r["tree"], r["root"]), [], None
                if r["column"] is not None:
                    chunks.append(r)
                    continue
                if chunks:
                    chunks, tree = [], _unpacked(chunks, targets)
                if tree is None:  # no row was drawn for it
                    continue
                x = np.frombuffer(r["x"], "<f8").reshape(r["n"], -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["number"], "<i8")),
                     pa.FixedSizeListArray.from_arrays(pa.array(tree.value[tree.leaf_of(x)].ravel()), targets).cast(pa.list_(pa.float64()))],
                    ["number", "value"])

        empty = [F.lit(None).cast("binary").alias(c) for c in ("column", "threshold", "left", "right", "value")]
        rows = blocks.mapInArrow(dealt, "tree int, root int, n int, number binary, x binary, sums binary").select(
            "tree", "root", F.lit(0).alias("chunk"), "n", "number", "x", *empty, F.lit(1).alias("kind"))
        trees = self.subtrees.select("tree", "root", "chunk", F.lit(0).alias("n"), *[F.lit(None).cast("binary").alias(c) for c in ("number", "x")],
                                     "column", "threshold", "left", "right", "value", F.lit(0).alias("kind"))
        met = trees.unionByName(rows).repartition("tree", "root").sortWithinPartitions("tree", "root", "kind", "chunk")
        votes = met.mapInArrow(applied, "number long, value array<double>")
        means = votes.groupBy("number").agg(F.array(*[F.avg(F.col("value")[i]) for i in range(targets)]).alias("mean"))
        return blocks.mapInArrow(members, "number long, row long, label double").join(means, "number").select("row", "label", "mean")


def _single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches, one copied at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _by_node(upper: list[Tree], rows: np.ndarray, x: np.ndarray, settled: list[list[int]] | None = None,
             sums_of: Callable[[int, np.ndarray], np.ndarray] | None = None, merge: bool = True) -> Iterator[pa.RecordBatch]:
    """The different rows of a block by (tree, node of its upper tree), each with the number of its first row; with ``sums_of`` only those
    that were drawn for the tree and lie in no settled node, each with its sums. Without ``merge`` every row counts as different."""
    first = _runs(x) if merge else np.arange(len(x))
    numbers, x = rows[first], x[first]
    for t, tree in enumerate(upper):
        node = tree.leaf_of(x)
        sums = np.zeros((len(x), 0)) if sums_of is None else sums_of(t, first)
        kept = np.arange(len(x)) if sums_of is None else np.flatnonzero(sums[:, 0])
        if settled and settled[t]:
            kept = kept[~np.isin(node[kept], settled[t])]
        kept = kept[np.argsort(node[kept], kind="stable")]
        found, start = np.unique(node[kept], return_index=True)
        out: dict[str, list] = {c: [] for c in ("tree", "root", "n", "number", "x", "sums")}
        for root, some in zip(found.tolist(), np.split(kept, start[1:])):
            for c, value in zip(out, (t, root, len(some), numbers[some].astype("<i8").tobytes(), x[some].astype("<f8").tobytes(),
                                      sums[some].astype("<f8").tobytes())):
                out[c].append(value)
        if out["tree"]:
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), types)], list(out))


NODE_COLUMNS = ["tree", "root", "chunk", "column", "threshold", "left", "right", "value"]


def _packed(tree: int, root: int, grown: Tree) -> Iterator[tuple]:
    """A row per chunk of the nodes."""
    for chunk, at in enumerate(range(0, len(grown.left), CHUNK_NODES)):
        here = slice(at, at + CHUNK_NODES)
        yield (tree, root, chunk, grown.column[here].astype("<i4").tobytes(), grown.threshold[here].astype("<f8").tobytes(),
               grown.left[here].astype("<i4").tobytes(), grown.right[here].astype("<i4").tobytes(), grown.value[here].astype("<f8").tobytes())


def _unpacked(chunks: list[dict], targets: int) -> Tree:
    column, threshold, left, right, value = (np.frombuffer(b"".join(r[c] for r in chunks), kind) for c, kind in (
        ("column", "<i4"), ("threshold", "<f8"), ("left", "<i4"), ("right", "<i4"), ("value", "<f8")))
    return Tree(column, threshold, left, right, value.reshape(-1, targets))


def fit_forest(blocks: DataFrame, columns: int, rows: int, *, trees: int, tried: int, classes: int = 0, seed: int = 42,
               node_rows: int = NODE_ROWS, merge: bool = True) -> Forest:
    """Grow a forest on stored blocks of ``rows`` rows, or of as many ``entries``; ``classes`` 0 means a number as label.

    Without ``merge`` rows of equal features are added up one by one; the last digits of a sum may decide between equally good splits.
    """
    upper = [UpperTree(key=[int(_hash(t, seed))], open=[0] if rows > node_rows else []) for t in range(trees)]
    while any(tree.open for tree in upper):
        _grow_level(blocks, upper, columns, tried, classes, seed, node_rows)
    flat = [tree.flat() for tree in upper]
    keys, settled = [tree.key for tree in upper], [list(tree.settled) for tree in upper]
    targets = classes or 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, x, y in _blocks(batches):
            begun, target = _hash(numbers), targets_of(y, classes)

            def sums_of(t: int, first: np.ndarray, begun=begun, target=target, y=y, numbers=numbers) -> np.ndarray:
                weight = bootstrap_weights(numbers, t, seed, begun)
                return np.column_stack([
                    np.add.reduceat(weight, first), np.add.reduceat(target * weight[:, None], first, axis=0),
                    np.minimum.reduceat(np.where(weight > 0, y, np.inf), first), np.maximum.reduceat(np.where(weight > 0, y, -np.inf), first)])

            yield from _by_node(flat, numbers, x, settled, sums_of, merge)

    def finish(tree: int, root: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        numbers, x, sums = (np.concatenate([np.frombuffer(r[c], kind).reshape(r["n"], -1) for r in held]) for c, kind in (
            ("number", "<i8"), ("x", "<f8"), ("sums", "<f8")))
        held.clear()
        order = np.argsort(numbers[:, 0])  # whatever the order of arrival
        x, sums = x[order], sums[order]
        grown = grow_entries(x, sums[:, 0], sums[:, 1:-2], sums[:, -2], sums[:, -1], keys[tree][root], tried)
        for row in _packed(tree, root, grown):
            yield pa.RecordBatch.from_arrays([pa.array([v]).cast(t) for v, t in zip(row, [pa.int32()] * 3 + [pa.binary()] * 5)], NODE_COLUMNS)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for r in _single_rows(batches):
            if (r["tree"], r["root"]) != current and held:
                yield from finish(*current, held)
                held = []
            current = r["tree"], r["root"]
            held.append(r)
        if held:
            yield from finish(*current, held)

    parts = blocks.mapInArrow(dealt, "tree int, root int, n int, number binary, x binary, sums binary")
    schema = "tree int, root int, chunk int, column binary, threshold binary, left binary, right binary, value binary"
    spark, folder = blocks.sparkSession, shared_folder(blocks.sparkSession)
    (parts.repartition("tree", "root").sortWithinPartitions("tree", "root").mapInArrow(finished, schema)
     .write.option("compression", "zstd").parquet(folder))
    leaves = [row for t, tree in enumerate(upper) for node, value in tree.settled.items()
              for row in _packed(t, node, Tree(np.zeros(1), np.zeros(1), np.array([-1]), np.array([-1]), np.array([value])))]
    if leaves:
        spark.createDataFrame(leaves, schema).write.mode("append").option("compression", "zstd").parquet(folder)
    return Forest(flat, spark.read.schema(schema).parquet(folder), targets)


def _grow_level(blocks: DataFrame, upper: list[UpperTree], columns: int, tried: int, classes: int, seed: int, node_rows: int) -> None:
    """Split the open nodes of all trees once."""
    nodes = [(t, node) for t, tree in enumerate(upper) for node in tree.open]
    for tree in upper:
        tree.open = []
    per_node = columns * BINS * ((classes or 1) + 3)
    part = max(1, HISTOGRAM_CELLS // per_node)
    for at in range(0, len(nodes), part):
        here = nodes[at:at + part]
        flat = [tree.flat() for tree in upper]
        ranges = _ranges(blocks, flat, here, columns, classes, seed)
        for t, node in here:  # a large node that is pure, or whose columns do not vary, is a leaf already
            if ranges[t, node]["pure"] or not (ranges[t, node]["low"] < ranges[t, node]["high"]).any():
                upper[t].settled[node] = ranges[t, node]["value"]
        here = [(t, node) for t, node in here if node not in upper[t].settled]
        if not here:
            continue
        keys = {k: upper[k[0]].key[k[1]] for k in here}
        for k, column, threshold, left, right in _splits(blocks, flat, here, ranges, keys, columns, tried, classes, seed):
            ends = upper[k[0]].split(k[1], column, threshold)
            upper[k[0]].open += [end for end, n in zip(ends, (left, right)) if n > node_rows]


def _members(flat: list[Tree], wanted: dict[int, np.ndarray], rows: np.ndarray, x: np.ndarray, seed: int):
    """For each tree with wanted nodes: its number, the rows of the block that lie in one, their weights and the node's place in the list."""
    for t, listed in wanted.items():
        node = flat[t].leaf_of(x)
        place = np.searchsorted(listed, node)
        place[place == len(listed)] = 0
        weight = bootstrap_weights(rows, t, seed)
        some = np.flatnonzero((listed[place] == node) & (weight > 0))
        yield t, some, weight[some], place[some]


def _wanted(nodes: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    found: dict[int, list[int]] = {}
    for t, node in nodes:
        found.setdefault(t, []).append(node)
    return {t: np.sort(n) for t, n in found.items()}


def _ranges(blocks: DataFrame, flat: list[Tree], nodes: list[tuple[int, int]], columns: int, classes: int, seed: int) -> dict:
    """For each node the smallest and largest value of each column, whether its labels are all equal, and their mean."""
    wanted, targets = _wanted(nodes), classes or 1

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = {t: np.full((len(n), columns + 1), np.inf) for t, n in wanted.items()}
        high = {t: np.full((len(n), columns + 1), -np.inf) for t, n in wanted.items()}
        sums = {t: np.zeros((len(n), targets + 1)) for t, n in wanted.items()}
        for rows, x, y in _blocks(batches):
            both, target = np.column_stack([x, y]), targets_of(y, classes)
            for t, some, weight, place in _members(flat, wanted, rows, x, seed):
                np.minimum.at(low[t], place, both[some])
                np.maximum.at(high[t], place, both[some])
                np.add.at(sums[t], place, np.column_stack([weight, target[some] * weight[:, None]]))
        for t, listed in wanted.items():
            used = np.flatnonzero(sums[t][:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), t), pa.int32()), pa.array(listed[used], pa.int32()),
                 *(pa.array(list(v[used]), pa.list_(pa.float64())) for v in (low[t], high[t], sums[t]))], ["tree", "node", "low", "high", "sums"])

    found = blocks.mapInArrow(seen, "tree int, node int, low array<double>, high array<double>, sums array<double>").groupBy("tree", "node").agg(
        F.array(*[F.min(F.col("low")[i]) for i in range(columns + 1)]).alias("low"),
        F.array(*[F.max(F.col("high")[i]) for i in range(columns + 1)]).alias("high"),
        F.array(*[F.sum(F.col("sums")[i]) for i in range(targets + 1)]).alias("sums"))
    out = {}
    for r in found.collect():  # a row per open node
        low, high = np.array(r.low), np.array(r.high)
        out[r.tree, r.node] = {"low": low[:-1], "high": high[:-1], "pure": low[-1] == high[-1], "value": [v / r.sums[0] for v in r.sums[1:]]}
    return out


def _splits(blocks, flat, nodes, ranges, keys, columns, tried, classes, seed):
    """(node, column, threshold, weight left, weight right) of the best split of each node."""
    wanted, targets = _wanted(nodes), classes or 1
    low = {t: np.stack([ranges[t, n]["low"] for n in listed.tolist()]) for t, listed in wanted.items()}
    high = {t: np.stack([ranges[t, n]["high"] for n in listed.tolist()]) for t, listed in wanted.items()}
    shape = (columns, BINS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((len(n), *shape, targets + 1)) for t, n in wanted.items()}
        edges = {t: np.stack([np.full((len(n), *shape), np.inf), np.full((len(n), *shape), -np.inf)]) for t, n in wanted.items()}
        for rows, x, y in _blocks(batches):
            target = targets_of(y, classes)
            for t, some, weight, place in _members(flat, wanted, rows, x, seed):
                amounts = np.column_stack([weight, target[some] * weight[:, None]])
                for f in range(columns):
                    value, start, width = x[some, f], low[t][place, f], high[t][place, f] - low[t][place, f]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cell = np.where(width > 0, np.minimum((value - start) / width * BINS, BINS - 1), 0).astype(np.int64)
                    np.add.at(sums[t], (place, f, cell), amounts)
                    np.minimum.at(edges[t][0], (place, f, cell), value)
                    np.maximum.at(edges[t][1], (place, f, cell), value)
        for t, listed in wanted.items():
            for i, node in enumerate(listed.tolist()):
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()),
                                                  "sums": [sums[t][i].tobytes()], "edges": [edges[t][:, i].tobytes()]})

    def best(tree: int, node: int, sums: np.ndarray, least: np.ndarray, most: np.ndarray) -> pa.RecordBatch | None:
        varies = (np.isfinite(least).sum(axis=1) > 1)[None, :]
        allowed = tried_columns(np.array([keys[tree, node]], np.uint64), varies, tried)[0]
        found = None
        for f in np.flatnonzero(allowed).tolist():
            cells = np.flatnonzero(np.isfinite(least[f]))
            left = np.cumsum(sums[f, cells], axis=0)
            total, left = left[-1], left[:-1]
            right = total - left
            score = (left[:, 1:] ** 2).sum(axis=1) / left[:, 0] + (right[:, 1:] ** 2).sum(axis=1) / right[:, 0]
            i = int(score.argmax())
            if found is None or score[i] > found[0]:
                found = score[i], f, float(_halfway(most[f, cells[i]], least[f, cells[i + 1]])), left[i, 0], right[i, 0]
        if found is None:
            return None
        return pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                                           "column": pa.array([found[1]], pa.int32()), "threshold": [found[2]],
                                           "left": [float(found[3])], "right": [float(found[4])]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            for r in batch.to_pylist():
                sums = np.frombuffer(r["sums"]).reshape(*shape, targets + 1)
                least, most = np.frombuffer(r["edges"]).reshape(2, *shape)
                if current is not None and current[:2] == (r["tree"], r["node"]):
                    current = (*current[:2], current[2] + sums, np.minimum(current[3], least), np.maximum(current[4], most))
                    continue
                if current is not None and (done := best(*current)) is not None:
                    yield done
                current = r["tree"], r["node"], sums, least, most
        if current is not None and (done := best(*current)) is not None:
            yield done

    partial = blocks.mapInArrow(counted, "tree int, node int, sums binary, edges binary")
    found = partial.repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(
        added, "tree int, node int, column int, threshold double, left double, right double")
    return [((r.tree, r.node), r.column, r.threshold, r.left, r.right) for r in found.collect()]  # a row per open node
