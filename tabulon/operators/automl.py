"""Automatic preparation and random-forest / k-means helpers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col, is_numeric, to_numeric
from tabulon.functions.frames import spread, unused
from tabulon.operators.forest import NODE_ROWS, entries, fit_forest, stored_blocks
from tabulon.operators.multivariate import KMeansFit
from tabulon.operators.ranking import text_positions
from tabulon.sources.writers import stored

MAX_CLASSES = 20


# Columns with at most so many texts get their codes from a literal map, the others from a join.
MAP_LEVELS = 1_000


def preprocess(df: DataFrame) -> DataFrame:
    """Every column as a double: numbers with missing cells set to the mean, other values (as text, missing
    cells set to the most frequent, the smallest of equals) as their position among the sorted distinct values.

    All texts are counted in one reading of the table, as one dictionary of (column, text); it gives the most frequent text of each column and,
    ranked once, all positions. Columns of few texts are coded by literal maps. The cells of all others meet the dictionary in one join,
    unpivoted, and are brought together again by row.
    """
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    others = [c for c in df.columns if c not in numbers]
    means = df.agg(*[F.avg(to_numeric(df, c)).alias(f"m{i}") for i, c in enumerate(numbers)]).first() if numbers else ()
    place = {c: i for i, c in enumerate(df.columns)}
    plain = {c: F.coalesce(to_numeric(df, c), F.lit(m).cast("double")).alias(f"x{place[c]}") for c, m in zip(numbers, means)}
    if not others:
        return df.select(*[plain[c].alias(c) for c in df.columns])

    texts = {c: col(c).cast("string") for c in others}
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(place[c]).alias("i"), texts[c].alias("v")) for c in others])))
    dictionary = stored(cells.where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count("*").alias("n")))
    facts = {r.i: r for r in dictionary.groupBy("i").agg(
        F.count("*").alias("levels"), F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("top")).collect()}
    # A column without any value is all of one, empty, text.
    filled = {c: F.coalesce(texts[c], F.lit(facts[place[c]].top.v)) if place[c] in facts else F.lit("") for c in others}
    few = [c for c in others if place[c] in facts and facts[place[c]].levels <= MAP_LEVELS]
    many = [c for c in others if place[c] in facts and facts[place[c]].levels > MAP_LEVELS]
    plain |= {c: F.lit(0.0).alias(f"x{place[c]}") for c in others if place[c] not in facts}
    listed: dict[int, list[str]] = {}
    if few:
        for r in dictionary.where(F.col("i").isin([place[c] for c in few])).select("i", "v").collect():  # at most MAP_LEVELS per column
            listed.setdefault(r.i, []).append(r.v)
    for c in few:
        levels = sorted(listed[place[c]], key=lambda v: v.encode())  # as Spark orders texts
        codes = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(float(i)))])
        plain[c] = codes[filled[c]].alias(f"x{place[c]}")
    if not many:
        return df.select(*[plain[c].alias(c) for c in df.columns])

    codes = text_positions(dictionary.where(F.col("i").isin([place[c] for c in many])))
    # The rows are stored with their numbers, since two readings may number them differently.
    rows = stored(df.select(F.monotonically_increasing_id().alias("row"), *plain.values(), *[filled[c].alias(f"t{place[c]}") for c in many]))
    unpivoted = rows.select("row", F.inline(F.array(*[F.struct(F.lit(place[c]).alias("i"), F.col(f"t{place[c]}").alias("v")) for c in many])))
    coded = unpivoted.join(codes, ["i", "v"]).groupBy("row").agg(
        *[F.max(F.when(F.col("i") == place[c], F.col("code").cast("double"))).alias(f"x{place[c]}") for c in many])
    return rows.join(coded, "row").select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(df.columns)])


def _split(df: DataFrame, key: Sequence[str], seed: int, test_tenths: int) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the hash of ``key``: the same rows on every run and retry."""
    side = F.pmod(F.xxhash64(F.lit(seed), *[col(k) for k in key]), F.lit(10))
    return df.where(side >= test_tenths), df.where(side < test_tenths)


class ForestRun:
    """A random forest fitted on 80 % of the prepared rows and applied to the rest. Its trees end in pure leaves, whatever their depth."""

    def __init__(self, df: DataFrame, target: str, task: str, *, key: Sequence[str] | None, seed: int,
                 num_trees: int, max_classes: int = MAX_CLASSES, node_rows: int = NODE_ROWS):
        if target not in df.columns:
            raise AnalysisError("missing_target", target)
        self.target, self._spark = target, df.sparkSession
        prepared = preprocess(df)
        features = [c for c in prepared.columns if c != target]
        if not features:
            raise AnalysisError("missing_x")
        self.class_names: dict[float, str] = {}
        if task == "classification":
            levels = [r[0] for r in prepared.select(col(target)).distinct().limit(max_classes + 1).collect()]
            if len(levels) > max_classes:
                raise AnalysisError("too_many_classes", f"{target} has more than {max_classes} values")
            self.class_names = self._names(df, target, levels, max_classes)
        (label,) = unused(prepared, "label")
        self._order = sorted(self.class_names)
        value = col(target)
        if self._order:
            value = F.create_map(*[x for i, v in enumerate(self._order) for x in (F.lit(v), F.lit(float(i)))])[value]
        prepared = prepared.withColumn(label, value)
        train, test = _split(prepared, key or df.columns, seed, 2)
        sides = []
        for side in (train, test):
            rows = spread(side, side.count())
            sides.append(stored_blocks(rows, features, label))
        n = sides[0].agg(F.sum("n")).first()[0] or 0
        if not n:
            raise AnalysisError("n_too_small", "no row to learn from")
        # All columns are tried for numbers, the square root of their number for classes.
        tried = max(1, math.isqrt(len(features))) if self._order else len(features)
        merge = n > node_rows  # a node need be no smaller than the different rows that one task can hold
        self.model = fit_forest(sides[0], len(features), entries(sides[0]) if merge else n, trees=num_trees, tried=tried, classes=len(self._order),
                                seed=seed, node_rows=node_rows, merge=merge)
        scored = self.model.predicted(sides[1])
        mean = F.col("mean")
        guess = (F.array_position(mean, F.array_max(mean)) - 1).cast("double") if self._order else mean[0]
        self.predictions = scored.select("label", guess.alias("prediction"))

    @staticmethod
    def _names(df: DataFrame, target: str, levels: list[float], max_classes: int) -> dict[float, str]:
        if is_numeric(df.schema[target].dataType):
            return {v: f"{v:g}" for v in levels}
        texts = sorted(r[0] for r in df.where(col(target).isNotNull()).select(
            col(target).cast("string")).distinct().limit(max_classes + 1).collect())
        return {float(i): t for i, t in enumerate(texts)}


class RegressionRun(ForestRun):
    def metrics(self) -> DataFrame:
        """``target, n_test, r2, mse``."""
        gap = F.col("label") - F.col("prediction")
        sums = self.predictions.agg(F.count("*").alias("n_test"), F.avg(gap * gap).alias("mse"),
                                    F.var_pop("label").alias("v"))
        r2 = F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v"))
        return sums.select(F.lit(self.target).alias("target"), "n_test", r2.alias("r2"), "mse")


class ClassificationRun(ForestRun):
    def metrics(self) -> DataFrame:
        """``target, n_test, accuracy``."""
        hit = F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)
        return self.predictions.agg(F.count("*").alias("n_test"), F.avg(hit).alias("accuracy")).select(
            F.lit(self.target).alias("target"), "n_test", "accuracy")

    def confusion(self) -> DataFrame:
        names = F.array(*[F.lit(self.class_names[v]) for v in self._order])
        text = lambda c: F.element_at(names, F.col(c).cast("int") + 1)
        named = self.predictions.select(text("label").alias("label"), text("prediction").alias("prediction"))
        return confusion_matrix(named, "label", "prediction")


def ml_regression(df: DataFrame, target: str, *, key: Sequence[str] | None = None, seed: int = 42, num_trees: int = 100,
                  node_rows: int = NODE_ROWS) -> RegressionRun:
    return RegressionRun(df, target, "regression", key=key, seed=seed, num_trees=num_trees, node_rows=node_rows)


def ml_classification(df: DataFrame, target: str, *, key: Sequence[str] | None = None, seed: int = 42, num_trees: int = 100,
                      max_classes: int = MAX_CLASSES, node_rows: int = NODE_ROWS) -> ClassificationRun:
    return ClassificationRun(df, target, "classification", key=key, seed=seed, num_trees=num_trees, max_classes=max_classes,
                             node_rows=node_rows)


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``label, prediction, n`` for the pairs that occur."""
    return df.groupBy(col(label).cast("string").alias("label"), col(prediction).cast("string").alias("prediction")).agg(
        F.count("*").alias("n"))


def ml_clustering(df: DataFrame, k: int = 3, *, n_init: int = 10, seed: int = 42, max_iter: int = 300) -> KMeansFit:
    """k-means on the prepared columns in their own units."""
    prepared = preprocess(df)
    rows = prepared.select(*[col(c).alias(f"x{i}") for i, c in enumerate(prepared.columns)])
    return KMeansFit(rows, df.columns, k, df.count(), n_init=n_init, seed=seed, max_iter=max_iter)
