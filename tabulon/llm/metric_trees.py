"""Vector code compression: product codes whose codebooks are learnt by k-means over metric trees.

Vectors are cut into equal consecutive parts, and each part position has a codebook. The parts of a block of vectors are put into
a metric tree by the anchors hierarchy: about the square root of the parts become anchors, each new one the part farthest
from its own anchor; an anchor's list is sorted by distance, so that only parts which the triangle inequality lets a new anchor win are
measured. The anchors' balls are then joined middle-out, the pair with the smallest common ball first, up to the root, and every
anchor's parts are treated alike below, down to leaves. Each ball caches its pivot, radius, sum and count.

One round of k-means walks the tree with a list of candidate entries. A ball drops every entry that is farther from all its points
than the entry closest to its pivot; children inherit what is left. A ball with one entry left is owned as a whole: its cached sum and
count are added and its points are never looked at. Only leaves compare points with the entries left. Entries that equal one of a
lower index own nothing, so they are left out from the start. All values are integers and every drop leaves a margin above the rounding
of the distances, so the result is that of comparing everything.

Trees are built once, a stored row for each block of vectors, and serve all rounds; a round moves one partial sum per block, position and
entry, and the codebook (``entries`` times the vector's length) travels to the driver and back. No row is shuffled.

Defined results: vectors that are null or empty or hold a null or non-finite component are left out; null ids count as the largest;
equal ids are ordered by their vectors; repeated rows are coded alike; an empty table gives an empty table. Fewer vectors than
entries give as many entries as vectors. Vectors of different lengths, lengths that the number of parts does not divide, and components
beyond +-LARGEST after scaling (whose squared distances may not fit a long) raise an error. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.shared import ship, written

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
BLOCK = 8_192  # vectors of a block: one row of the table of trees
LEAF = 64  # points up to which a ball is not divided
LARGEST = 1 << 27
MARGIN = 1e-6  # above the relative rounding of a distance in double precision


@dataclass
class Tree:
    """Balls in the order of their making, children before parents; points of a ball are ``order[first:first + count]``."""

    pivots: np.ndarray  # (balls, d)
    radius: np.ndarray
    sums: np.ndarray  # (balls, d), integers
    first: np.ndarray
    count: np.ndarray
    left: np.ndarray  # -1: a leaf
    right: np.ndarray
    order: np.ndarray  # the points, so that each ball's lie together
    root: int


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def anchors(points: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Cut the points into at most ``wanted`` groups, each around an anchor; every group is sorted, the farthest point first."""
    everything = np.arange(len(points))
    distance = _distances(points, points[0])
    far = np.argsort(-distance, kind="stable")
    members, reach, centre = [everything[far]], [distance[far]], [points[0]]
    while len(members) < wanted:
        widest = max(range(len(members)), key=lambda k: reach[k][0])
        if reach[widest][0] == 0:
            break  # only repeated points are left
        new = points[members[widest][0]]
        to_centres = _distances(np.array(centre), new)
        won, won_distance = [], []
        for k, between in enumerate(to_centres.tolist()):
            # A point nearer to its anchor than half the way to the new one stays; the list is sorted, so the rest need not be seen.
            seen = int(np.searchsorted(-reach[k], -between / 2, side="right"))
            if not seen:
                continue
            here = members[k][:seen]
            own = _distances(points[here], new)
            moves = own < reach[k][:seen]
            if moves.any():
                won.append(here[moves])
                won_distance.append(own[moves])
                stays = np.ones(len(members[k]), bool)
                stays[:seen] = ~moves
                members[k], reach[k] = members[k][stays], reach[k][stays]
        taken, distance = np.concatenate(won), np.concatenate(won_distance)
        far = np.argsort(-distance, kind="stable")
        members.append(taken[far])
        reach.append(distance[far])
        centre.append(new)
    return members


class _Builder:
    def __init__(self, points: np.ndarray):
        self.whole, self.points = points, points.astype(np.float64)
        self.balls: list[tuple] = []  # (sum, members, left, right)

    def leaf(self, members: np.ndarray) -> int:
        self.balls.append((self.whole[members].sum(axis=0), members, -1, -1))
        return len(self.balls) - 1

    def joined(self, a: int, b: int) -> int:
        (x, some, *_), (y, others, *_) = self.balls[a], self.balls[b]
        self.balls.append((x + y, np.concatenate([some, others]), a, b))
        return len(self.balls) - 1

    def build(self, members: np.ndarray) -> int:
        """The ball of these points with everything below it."""
        here = self.points[members]
        groups = anchors(here, max(2, int(np.sqrt(len(members))))) if len(members) > LEAF else []
        if len(groups) < 2:
            return self.leaf(members)
        return self.middle_out([self.build(members[g]) for g in groups])

    def middle_out(self, balls: list[int]) -> int:
        """Join balls, the pair with the smallest common ball first."""
        n, room = len(balls), 2 * len(balls) - 1
        node = np.array(balls + [-1] * (n - 1))
        centre, radius = np.zeros((room, self.points.shape[1])), np.zeros(room)
        alive, both = np.zeros(room, bool), np.full((room, room), np.inf)

        def place(k: int) -> None:
            total, members, *_ = self.balls[node[k]]
            centre[k] = total / len(members)
            radius[k] = _distances(self.points[members], centre[k]).max()
            others = np.flatnonzero(alive)
            between = _distances(centre[others], centre[k])
            span = np.maximum(np.maximum(radius[others], radius[k]), (between + radius[others] + radius[k]) / 2)
            both[others, k] = span  # an older place in front of a newer one
            alive[k] = True

        for k in range(n):
            place(k)
        nearest = both.min(axis=1)
        for k in range(n, room):
            a = int(nearest.argmin())
            b = int(both[a].argmin())
            node[k] = self.joined(int(node[a]), int(node[b]))
            for gone in (a, b):
                alive[gone] = False
                both[gone, :] = both[:, gone] = np.inf
            place(k)
            nearest = both.min(axis=1)
        return int(node[room - 1])


def build_tree(points: np.ndarray) -> Tree:
    """The anchors hierarchy over integer points."""
    builder = _Builder(points)
    root = builder.build(np.arange(len(points)))
    balls = builder.balls
    first, count = np.zeros(len(balls), np.int64), np.array([len(b[1]) for b in balls])
    pending = [(root, 0)]
    while pending:
        ball, at = pending.pop()
        first[ball] = at
        _, _, left, right = balls[ball]
        if left >= 0:
            pending += [(left, at), (right, at + int(count[left]))]
    order = np.empty(len(points), np.int64)
    for ball, (_, members, left, _) in enumerate(balls):
        if left < 0:
            order[first[ball]:first[ball] + len(members)] = members
    sums = np.array([b[0] for b in balls])
    pivots = sums / count[:, None]
    radius = np.array([_distances(builder.points[b[1]], pivots[k]).max() for k, b in enumerate(balls)])
    return Tree(pivots, radius, sums, first, count, np.array([b[2] for b in balls]), np.array([b[3] for b in balls]), order, root)


def owners(tree: Tree, codebook: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Balls that cover the points once each, with the entries that may own a part of them; one entry owns its ball as a whole."""
    _, lowest = np.unique(codebook, axis=0, return_index=True)
    entries = codebook.astype(np.float64)
    found, pending = [], [(tree.root, np.sort(lowest))]
    while pending:
        ball, candidates = pending.pop()
        if len(candidates) > 1:
            distance = _distances(entries[candidates], tree.pivots[ball])
            reach = (distance.min() + 2 * tree.radius[ball]) * (1 + MARGIN) + MARGIN
            candidates = candidates[distance <= reach]
        if len(candidates) == 1 or tree.left[ball] < 0:
            found.append((ball, candidates))
        else:
            pending += [(int(tree.left[ball]), candidates), (int(tree.right[ball]), candidates)]
    return found


def nearest_entries(points: np.ndarray, codebook: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Of ascending candidates the nearest to each point, the lower index of equals; exact, whatever the way of computing."""
    entries = codebook[candidates]
    largest = int(max(np.abs(points).max(), np.abs(entries).max()))
    if 4 * points.shape[1] * largest ** 2 < 1 << 53:  # then sums of products are whole numbers in double precision
        near = entries.astype(np.float64)
        squares = (near ** 2).sum(axis=1) - 2 * (points.astype(np.float64) @ near.T)  # less the point's own square
    else:
        squares = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return candidates[squares.argmin(axis=1)]


def _covered(tree: Tree, codebook: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Rows, entries and balls, balls with the same entries taken together."""
    groups: dict[bytes, tuple[np.ndarray, list[int]]] = {}
    for ball, candidates in owners(tree, codebook):
        groups.setdefault(candidates.tobytes(), (candidates, []))[1].append(ball)
    for candidates, balls in groups.values():
        yield np.concatenate([tree.order[tree.first[b]:tree.first[b] + tree.count[b]] for b in balls]), candidates, balls


def round_sums(tree: Tree, points: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the points that each entry owns."""
    counts, sums = np.zeros(len(codebook), np.int64), np.zeros(codebook.shape, np.int64)
    for rows, candidates, balls in _covered(tree, codebook):
        if len(candidates) == 1:
            counts[candidates[0]] += tree.count[balls].sum()
            sums[candidates[0]] += tree.sums[balls].sum(axis=0)
        else:
            chosen = nearest_entries(points[rows], codebook, candidates)
            counts += np.bincount(chosen, minlength=len(codebook))
            np.add.at(sums, chosen, points[rows])
    return counts, sums


def assigned(tree: Tree, points: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """The entry of each point."""
    out = np.empty(len(points), np.int64)
    for rows, candidates, _ in _covered(tree, codebook):
        out[rows] = candidates[0] if len(candidates) == 1 else nearest_entries(points[rows], codebook, candidates)
    return out


# ---- stored trees -------------------------------------------------------------------------------------------------------

FLOATS, INTEGERS = ("pivots", "radius"), ("sums", "first", "count", "left", "right", "order")


def _packed(tree: Tree) -> dict[str, bytes]:
    out = {name: getattr(tree, name).astype("<f8").tobytes() for name in FLOATS}
    return out | {name: getattr(tree, name).astype("<i8").tobytes() for name in INTEGERS} | {"root": int(tree.root).to_bytes(8, "little")}


def _unpacked(row: dict, width: int) -> Tree:
    values = {name: np.frombuffer(row[name], "<f8") for name in FLOATS} | {name: np.frombuffer(row[name], "<i8") for name in INTEGERS}
    for name in ("pivots", "sums"):
        values[name] = values[name].reshape(-1, width)
    return Tree(**values, root=int.from_bytes(row["root"], "little"))


TREE = T.StructType([T.StructField(name, T.BinaryType()) for name in (*FLOATS, *INTEGERS, "root")])


def usable(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """(vec_id, label, x): the vectors without missing or non-finite components, scaled to integers."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    unfit = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    rows = embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), label.alias("label"), vector.alias("x")).where(
        F.col("x").isNotNull() & (F.size("x") > 0) & ~unfit)
    tall = F.exists("x", lambda x: F.abs(x * scale) >= float(LARGEST))
    fitting = F.when(tall, F.raise_error(F.lit(f"a component is too large: beyond {LARGEST} after scaling"))).otherwise(
        F.transform("x", lambda x: F.floor(x * scale).cast("long")))
    return rows.withColumn("x", fitting)


def _first_codebook(rows: DataFrame, entries: int, parts: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    lengths = {len(r.x) for r in first}
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    length = lengths.pop() if lengths else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    start = np.array([r.x for r in first], np.int64).reshape(len(first), parts, length // parts if first else 1)
    return np.ascontiguousarray(start.transpose(1, 0, 2))


@dataclass
class Codes:
    """``rows``: (vec_id, label, codes, errors) of every usable vector, lists in part order; ``codebooks``: (parts, entries, width)."""

    rows: DataFrame
    codebooks: np.ndarray

    @property
    def digest(self) -> str:
        """SHA-256 of all entries' components as decimal numbers, by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Learn the codebooks on all vectors and code every vector."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = usable(embeddings, id_col, vector_col, label_col, scale)
    codebooks = _first_codebook(rows, entries, parts)
    width = codebooks.shape[2]
    out = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("codes", T.ArrayType(T.IntegerType())),
                        T.StructField("errors", T.ArrayType(T.LongType()))])
    if not codebooks.size:
        return Codes(spark.createDataFrame([], out), codebooks)
    stored = _blocks(rows, parts, width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shipped.value
        for points, trees, _ in _read_blocks(batches, parts, width):
            for part, tree in enumerate(trees):
                counts, sums = round_sums(tree, points[:, part], books[part])
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), part), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()),
                     pa.array(list(sums[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(codebooks)
        found = stored.mapInArrow(partial, "part int, entry int, n long, sums array<long>")
        totals = found.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width))).collect()
        codebooks = codebooks.copy()
        for row in totals:  # as many as there are entries
            codebooks[row.part, row.entry] = [int(row[f"s{i}"]) // row.n for i in range(width)]
        shipped.unpersist()
    final = spark.sparkContext.broadcast(codebooks)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = final.value
        for points, trees, block in _read_blocks(batches, parts, width):
            codes = np.stack([assigned(tree, points[:, part], books[part]) for part, tree in enumerate(trees)], axis=1)
            errors = ((points - books[np.arange(parts), codes]) ** 2).sum(axis=2)
            ids, labels = block.column("ids")[0].values, block.column("labels")[0].values
            for at in range(0, len(points), 4_096):
                cut = slice(at, at + 4_096)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 4_096), labels.slice(at, 4_096), pa.array(list(codes[cut].astype(np.int32)), pa.list_(pa.int32())),
                     pa.array(list(errors[cut]), pa.list_(pa.int64()))], out.names)

    return Codes(stored.mapInArrow(code, out), codebooks)


def _blocks(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """Blocks of vectors with a tree per part position, stored."""
    types = {name: rows.schema[name].dataType for name in ("vec_id", "label")}
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(types["vec_id"])), T.StructField("labels", T.ArrayType(types["label"])),
        T.StructField("points", T.BinaryType()), T.StructField("trees", T.ArrayType(TREE))])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for table in _gathered(batches, BLOCK):
            vectors = table.column("x").combine_chunks()
            if set(np.diff(vectors.offsets.to_numpy()).tolist()) != {parts * width}:
                raise ValueError(f"vectors of other lengths than {parts * width}")
            points = vectors.flatten().to_numpy().reshape(-1, parts, width)
            trees = [_packed(build_tree(np.ascontiguousarray(points[:, part]))) for part in range(parts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([table.column(c).to_pylist()], arrow.field(f).type) for c, f in (("vec_id", "ids"), ("label", "labels"))]
                + [pa.array([points.astype("<i4").tobytes()], pa.binary()), pa.array([trees], arrow.field("trees").type)], schema=arrow)

    return written(rows.mapInArrow(built, schema))


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows of a task in tables of ``size`` rows; the last one may be smaller."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            here = batch.slice(0, size - n)
            held.append(here)
            n += here.num_rows
            batch = batch.slice(here.num_rows)
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _read_blocks(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[np.ndarray, list[Tree], pa.RecordBatch]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.slice(i, 1)
            points = np.frombuffer(block.column("points")[0].as_buffer(), "<i4").astype(np.int64).reshape(-1, parts, width)
            yield points, [_unpacked(t, width) for t in block.column("trees")[0].as_py()], block


def vector_codes(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector.

    ``code`` has two hex digits per part, ``error`` is the squared distance to the coded vector, ``label_error`` its sum over all vectors of
    the label, those without one taken together.
    """
    found = compress(embeddings, id_col, vector_col, label_col, **settings)
    digits = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))))
    rows = written(found.rows.select("vec_id", "label", digits.alias("code"),
                                     F.aggregate("errors", F.lit(0).cast("long"), lambda a, b: a + b).alias("error")))
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = rows.alias("r").join(labels.alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(found.digest).alias("codebooks_sha256"))
