"""Principal components and k-means on standardised columns."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col, existing
from tabulon.functions.frames import small_frame, spread
from tabulon.operators.select import listwise_complete

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

# Rows travel to the k-means passes in blocks of about this size.
BLOCK_BYTES = 64 << 10


def _columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    names = existing(df, columns or [])
    if len(names) < 2:
        raise AnalysisError("need>=2_columns")
    return names


def standardised(df: DataFrame, names: Sequence[str], min_rows: int) -> tuple[DataFrame, int]:
    """Complete rows as ``x0, x1, ...`` with mean 0 and population deviation 1, and their number."""
    rows = listwise_complete(df, names)
    parts = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        parts += [F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}")]
    r = rows.agg(*parts).first()
    if r.n < min_rows:
        raise AnalysisError("n_too_small", f"{min_rows} complete rows are needed")
    scaled = rows.select(*[
        ((col(c) - F.lit(r[f"m{i}"])) / F.lit(r[f"s{i}"] or 1.0)).alias(f"x{i}") for i, c in enumerate(names)])
    return scaled, r.n


def vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=rows.columns, outputCol="features").transform(rows)


class PcaFit:
    def __init__(self, df: DataFrame, columns: Sequence[str], n_components: int = 2):
        self.columns = _columns(df, columns)
        self.k = max(2, min(int(n_components or 2), len(self.columns)))
        self._scaled, self.n = standardised(df, self.columns, 5)
        self._spark = df.sparkSession
        model = PCA(k=self.k, inputCol="features", outputCol="scores").fit(vectors(self._scaled))
        self.ratio = model.explainedVariance.toArray().tolist()
        loadings = model.pc.toArray()
        # The sign of a component is free: the loading of largest size is made positive.
        signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(self.k)])
        self.loading = loadings * np.where(signs == 0, 1.0, signs)

    def variance(self) -> DataFrame:
        """``component, ratio, cumulative``."""
        total = np.cumsum(self.ratio).tolist()
        return small_frame(self._spark, [(f"PC{i + 1}", r, c) for i, (r, c) in enumerate(zip(self.ratio, total))],
                           "component string, ratio double, cumulative double")

    def loadings(self) -> DataFrame:
        """``variable, PC1, PC2, ...``."""
        schema = "variable string, " + ", ".join(f"PC{i + 1} double" for i in range(self.k))
        return small_frame(self._spark, [(c, *row) for c, row in zip(self.columns, self.loading.tolist())], schema)

    def scores(self) -> DataFrame:
        """``PC1, PC2, ...`` of every complete row, as plain column arithmetic."""
        sums = []
        for j in range(self.k):
            terms = [F.col(f"x{i}") * F.lit(float(v)) for i, v in enumerate(self.loading[:, j])]
            sums.append(sum(terms[1:], terms[0]).alias(f"PC{j + 1}"))
        return self._scaled.select(*sums)


def pca(df: DataFrame, columns: Sequence[str], n_components: int = 2) -> PcaFit:
    return PcaFit(df, columns, n_components)


class KMeansFit:
    """Best of several k-means runs; clusters are numbered by ascending centre.

    All runs move together: one job draws the next starting centre of every run (k-means++ over all rows), and one job per
    iteration moves the centres of every run that has not settled. A run settles when its centres move by at most ``tol``
    times the mean variance of the columns, in squares, or after ``max_iter`` moves (``converged`` tells which).
    """

    def __init__(self, rows: DataFrame, columns: Sequence[str], k: int, n: int, *, n_init: int, seed: int, max_iter: int,
                 tol: float = 1e-4):
        self.columns, self.k, self.n = list(columns), k, n
        self._rows, self._spark = rows, rows.sparkSession
        facts = rows.agg(*[f(c) for c in rows.columns for f in (F.avg, F.var_pop)]).first()
        middle = np.array([facts[2 * i] or 0.0 for i in range(len(rows.columns))])
        limit = tol * float(np.mean([facts[2 * i + 1] or 0.0 for i in range(len(rows.columns))]))
        # Around the mean, products of far-off columns keep their digits.
        moved = rows.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(rows.columns, middle)])
        blocks = _blocks(spread(moved, n)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            centres = np.empty((n_init, 0, len(rows.columns)))
            for _ in range(k):
                centres = _with_next_start(blocks, centres, seed)
            iterations, moving = np.zeros(n_init, int), np.arange(n_init)
            while len(moving) and iterations[moving[0]] < max_iter:
                sums = _cluster_sums(blocks, centres[moving])
                sizes = sums[:, :, -1, None]
                after = np.where(sizes > 0, sums[:, :, :-1] / np.maximum(sizes, 1), centres[moving])
                shift = ((after - centres[moving]) ** 2).sum(axis=(1, 2))
                centres[moving] = after
                iterations[moving] += 1
                moving = moving[shift > limit]
            final = _cluster_sums(blocks, centres, spread_too=True)
        finally:
            blocks.unpersist()
        inertia = final[:, :, -1].sum(axis=1)
        best = int(inertia.argmin())
        self.inertia, self.iterations = float(inertia[best]), int(iterations[best])
        self.converged = best not in moving
        found = [((c + middle).tolist(), int(size)) for c, size in zip(centres[best], final[best, :, -2]) if size > 0]
        self.centre_rows, self.size_list = map(list, zip(*sorted(found)))

    def info(self) -> DataFrame:
        """``n, k, inertia, iterations, converged`` of the best run."""
        row = (self.n, len(self.size_list), self.inertia, self.iterations, self.converged)
        return small_frame(self._spark, [row], "n long, k int, inertia double, iterations int, converged boolean")

    def sizes(self) -> DataFrame:
        return small_frame(self._spark, list(enumerate(self.size_list)), "cluster int, size long")

    def centers(self) -> DataFrame:
        """``cluster`` and one column per variable, in the space the model was fitted in."""
        schema = "cluster int, " + ", ".join(f"`{c}` double" for c in self.columns)
        return small_frame(self._spark, [(i, *c) for i, c in enumerate(self.centre_rows)], schema)

    def assignments(self) -> DataFrame:
        """``x0, x1, ..., cluster`` of every row: the nearest centre, the first of equally near ones."""
        reach = []
        for i, centre in enumerate(self.centre_rows):
            squares = [(F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(self._rows.columns, centre)]
            reach.append(F.struct(sum(squares[1:], squares[0]).alias("d"), F.lit(i).alias("i")))
        return self._rows.select("*", F.array_min(F.array(*reach))["i"].alias("cluster"))


def _blocks(rows: DataFrame) -> DataFrame:
    """``place, data``: the rows as blocks of doubles, numbered. Sorted before, they are the same in a second reading."""
    width = len(rows.columns)
    step = max(1, BLOCK_BYTES // (8 * width))

    def pack(batches):
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns])
            for start in range(0, len(x), step):
                yield pa.RecordBatch.from_pydict({"place": [place], "data": [x[start:start + step].tobytes()]})
                place += 1

    return rows.sortWithinPartitions(*rows.columns).mapInArrow(pack, "place long, data binary")


def _block_rows(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The rows of each block of an Arrow batch, which are not copied."""
    data = batch.column(1)
    return (np.frombuffer(data[i].as_buffer()).reshape(-1, width) for i in range(len(data)))


def _with_next_start(blocks: DataFrame, centres: np.ndarray, seed: int) -> np.ndarray:
    """One more centre for every run, drawn with a chance in proportion to the squared distance to the nearest one.

    The row with the smallest exponential variate over its weight is such a draw, and a minimum needs no second pass.
    """
    runs, count, width = centres.shape

    def draw(batches):
        best = {}
        for batch in batches:
            for place, x in zip(batch.column(0).to_pylist(), _block_rows(batch, width)):
                noise = np.random.default_rng([seed, count, place]).standard_exponential((runs, len(x)))
                for run in range(runs):
                    weight = np.ones(len(x))
                    if count:
                        weight = np.min([((x - c) ** 2).sum(axis=1) for c in centres[run]], axis=0)
                    with np.errstate(divide="ignore"):
                        key = noise[run] / weight
                    at = int(key.argmin())
                    if key[at] < best.get(run, (np.inf,))[0]:
                        best[run] = (float(key[at]), x[at].tolist())
        yield pa.RecordBatch.from_pydict({"run": pa.array(list(best), pa.int32()), "key": pa.array([b[0] for b in best.values()], pa.float64()),
                                          "x": pa.array([b[1] for b in best.values()], pa.list_(pa.float64()))})

    drawn = blocks.mapInArrow(draw, "run int, key double, x array<double>")
    found = {r.run: r.x for r in drawn.groupBy("run").agg(F.min_by("x", "key").alias("x")).collect()}  # a row per run
    # Without a row off the centres there are fewer clusters than asked for: the repeated centre stays empty.
    return np.stack([np.vstack([c, found.get(run, c[:1])]) for run, c in enumerate(centres)])


def _nearest(x: np.ndarray, flat: np.ndarray, offsets: np.ndarray, runs: int) -> np.ndarray:
    """(runs, centres, rows): 1 where the centre is the nearest one of its run, the first of equally near ones."""
    reach = flat @ x.T
    reach *= -2
    reach += offsets[:, None]
    reach = reach.reshape(runs, -1, len(x))
    hot = (reach == reach.min(axis=1)[:, None]).astype(float)
    for run in np.flatnonzero(hot.sum(axis=(1, 2)) != len(x)).tolist():
        hot[run] = np.arange(reach.shape[1])[:, None] == reach[run].argmin(axis=0)
    return hot


def _cluster_sums(blocks: DataFrame, centres: np.ndarray, spread_too: bool = False) -> np.ndarray:
    """For every run and centre: column sums and number of the rows nearest to it, and at will their summed squared distance."""
    runs, k, width = centres.shape
    flat = centres.reshape(-1, width)
    offsets, wide = (flat * flat).sum(axis=1), width + 1 + spread_too

    def add_up(batches):
        total = np.zeros((runs * k, wide))
        for batch in batches:
            for x in _block_rows(batch, width):
                hot = _nearest(x, flat, offsets, runs).reshape(runs * k, -1)
                total[:, :width] += hot @ x
                total[:, width] += hot.sum(axis=1)
                for c in range(runs * k if spread_too else 0):
                    gap = x[hot[c] > 0] - flat[c]
                    total[c, -1] += (gap * gap).sum()
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int32()), "value": pa.array(total.ravel()[slot])})

    result = np.zeros(runs * k * wide)
    for r in blocks.mapInArrow(add_up, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        result[r.slot] = r.value
    return result.reshape(runs, k, wide)


def kmeans(df: DataFrame, columns: Sequence[str], k: int = 3, *, n_init: int = 10, seed: int = 42,
           max_iter: int = 300) -> KMeansFit:
    names = _columns(df, columns)
    scaled, n = standardised(df, names, 10)
    return KMeansFit(scaled, names, max(2, min(int(k or 3), 10)), n, n_init=n_init, seed=seed, max_iter=max_iter)
