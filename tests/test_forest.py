"""Forests: both phases against a plain recursive grower, and whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import automl, forest


def plain_tree(x, y, weight, key, tried, classes):
    """Nested tuples (column, threshold, left, right) or leaf values, by trying every split of every node."""
    target = forest.targets_of(y, classes)
    varies = (x.min(axis=0) < x.max(axis=0))[None, :]
    allowed = forest.tried_columns(np.array([key], np.uint64), varies, tried)[0]
    best = None
    if y.min() < y.max():
        for f in np.flatnonzero(allowed):
            values = np.unique(x[:, f])
            for a, b in zip(values, values[1:]):
                left = x[:, f] <= a
                score = 0.0
                for side in (left, ~left):
                    score += ((target[side] * weight[side, None]).sum(axis=0) ** 2).sum() / weight[side].sum()
                if best is None or score > best[0]:
                    best = score, int(f), a + (b - a) / 2, left
    if best is None:
        return (target * weight[:, None]).sum(axis=0) / weight.sum()
    _, f, threshold, left = best
    ends = [plain_tree(x[s], y[s], weight[s], int(forest._hash(np.uint64(key), side)), tried, classes) for side, s in ((0, left), (1, ~left))]
    return f, threshold, *ends


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def sample(classes, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.integers(-40, 40, n), np.full(n, 3)]).astype(float)
    y = (x[:, 0] * 3 + x[:, 1] ** 2 + rng.integers(0, 5, n)).astype(float)
    return x, (y % 3 if classes else y)


@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("tried", [1, 2, 4])
def test_levels_equal_plain_recursion(classes, tried):
    x, y = sample(classes)
    weight = forest.bootstrap_weights(np.arange(len(x)), 5, 1)
    some = weight > 0
    grown = forest.grow(x[some], y[some], weight[some], 77, tried, classes)
    plain = plain_tree(x[some], y[some], weight[some], 77, tried, classes)
    assert np.allclose(grown.value[grown.leaf_of(x)], [plain_value(plain, row) for row in x])


@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("node_rows", [10, 60, 1000])
def test_both_phases_equal_plain_recursion(spark, classes, node_rows, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 50)
    monkeypatch.setattr(forest, "HISTOGRAM_CELLS", 30_000)  # the nodes of a level in several parts
    x, y = sample(classes)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double, `the y` double").repartition(4)
    blocks = forest.stored_blocks(table, ["a", "b", "c", "d"], "the y")
    stored = [t for t in forest._blocks(blocks.select("rows", "x", "y", "n").toArrow().to_batches())]
    numbers, x, y = (np.concatenate([s[i] for s in stored]) for i in range(3))
    fitted = forest.fit_forest(blocks, 4, 300, trees=3, tried=2, classes=classes, seed=9, node_rows=node_rows)
    expected = np.zeros((len(x), classes or 1))
    for t in range(3):
        weight = forest.bootstrap_weights(numbers, t, 9)
        some = weight > 0
        plain = plain_tree(x[some], y[some], weight[some], int(forest._hash(t, 9)), 2, classes)
        expected += np.array([plain_value(plain, row) for row in x]) / 3
    found = {r.row: r for r in fitted.predicted(blocks).collect()}
    assert np.allclose([found[n]["mean"] for n in numbers.tolist()], expected)
    assert [found[n].label for n in numbers.tolist()] == y.tolist()
    if node_rows == 10:
        assert len(fitted.upper[0].left) > 10  # phase one has grown the upper levels


def test_large_leaves_and_repeated_rows(spark):
    """Nodes that no column can split are leaves, however many rows they hold, and none of these rows is shuffled."""
    rows = [(1.0, 1.0, float(i % 2)) for i in range(400)] + [(2.0, 1.0, 5.0)] * 200
    blocks = forest.stored_blocks(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    fitted = forest.fit_forest(blocks, 2, 600, trees=2, tried=2, node_rows=20)
    assert all(len(t.left) == 3 for t in fitted.upper)
    assert fitted.node_table().count() == 4
    votes = {round(r["mean"][0], 1) for r in fitted.predicted(blocks).collect() if r.label == 5.0}
    assert votes == {5.0}


def test_deep_trees_fit_what_shallow_ones_cannot(spark):
    """A staircase of 2,000 steps needs more leaves than a tree of depth 8 has."""
    table = spark.range(12_000).select((F.col("id") % 2000).cast("double").alias("n"), F.lit("t").alias("_text"),
                                       ((F.col("id") % 2000) * 7 % 1999).cast("double").alias("label"))
    run = automl.ml_regression(table, "label", num_trees=10, key=["n", "label"]).metrics().first()
    assert run.n_test > 0
    again = automl.ml_regression(table.withColumn("row", F.xxhash64("n") % 1000), "label", num_trees=10).metrics().first()
    assert again.r2 is not None
    whole = automl.ml_regression(spark.range(12_000).select((F.col("id") % 2000).alias("n"), (F.col("id") % 7).alias("copy"),
                                                            ((F.col("id") % 2000) * 7 % 1999).alias("label")), "label", num_trees=20)
    assert whole.metrics().first().r2 > 0.99


def test_classes_of_text(spark):
    table = spark.range(900).select(F.col("id").alias("_label"), F.when(F.col("id") % 3 == 0, "low").when(F.col("id") % 3 == 1, "mid").otherwise(
        "high").alias("class"), (F.col("id") % 3 * 10 + F.col("id") % 2).alias("x"))
    run = automl.ml_classification(table, "class", num_trees=10)
    assert run.metrics().first().accuracy == 1.0
    assert {(r.label, r.prediction) for r in run.confusion().collect()} == {(c, c) for c in ("low", "mid", "high")}
    with pytest.raises(automl.AnalysisError, match="too_many_classes"):
        automl.ml_classification(table, "class", max_classes=2)


@pytest.mark.parametrize("classes", [0, 3])
def test_subtrees_are_stored_in_chunks(spark, classes, monkeypatch):
    """No row of the table of subtrees grows with the tree, and the chunks give the tree again."""
    x, y = sample(classes)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    blocks = forest.stored_blocks(spark.createDataFrame(rows, "a double, b double, c double, d double, y double"), ["a", "b", "c", "d"], "y")
    whole = {r.row: r["mean"] for r in forest.fit_forest(blocks, 4, 300, trees=3, tried=2, classes=classes, seed=9).predicted(blocks).collect()}
    monkeypatch.setattr(forest, "CHUNK_NODES", 16)
    fitted = forest.fit_forest(blocks, 4, 300, trees=3, tried=2, classes=classes, seed=9)
    table = fitted.node_table()
    assert table.groupBy("tree").count().agg(F.min("count")).first()[0] > 3
    assert table.agg(F.max(F.length("left"))).first()[0] == 64
    assert {r.row: r["mean"] for r in fitted.predicted(blocks).collect()} == whole


def test_rows_of_equal_features_are_one_entry(spark):
    """Twelve kinds of rows, many times each: what is grown and asked for goes with the kinds, and every row gets its prediction."""
    table = spark.range(24_000).select((F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"),
                                       (F.col("id") % 12 * 10 + F.col("id") % 7).cast("double").alias("y")).repartition(6)
    blocks = forest.stored_blocks(table, ["a", "b"], "y")
    assert 12 <= forest.entries(blocks) <= 12 + blocks.count()
    fitted = forest.fit_forest(blocks, 2, forest.entries(blocks), trees=4, tried=2, node_rows=200)
    assert all(len(t.left) == 1 for t in fitted.upper)  # exact from the root, though there are more rows than a node may hold
    rows = np.concatenate([np.column_stack([n, x, y]) for n, x, y in forest._blocks(blocks.select("rows", "x", "y", "n").toArrow().to_batches())])
    found = {r.row: r for r in fitted.predicted(blocks).collect()}
    assert len(found) == 24_000
    expected = np.zeros(len(rows))
    for t in range(4):
        weight = forest.bootstrap_weights(rows[:, 0].astype(np.int64), t, 42)
        for kind in np.unique(rows[:, 1:3], axis=0):
            here = (rows[:, 1:3] == kind).all(axis=1)
            expected[here] += np.average(rows[here, 3], weights=weight[here]) / 4
    assert np.allclose([found[n]["mean"][0] for n in rows[:, 0].astype(int).tolist()], expected)


def test_small_tables_add_up_row_by_row(spark, monkeypatch):
    """A table whose rows fit a node is grown from its rows, one larger from its entries."""
    seen = []
    plain = automl.fit_forest
    monkeypatch.setattr(automl, "fit_forest", lambda blocks, columns, rows, **more: seen.append((rows, more["merge"])) or plain(blocks, columns, rows, **more))
    table = spark.range(600).select((F.col("id") % 5).alias("a"), (F.col("id") % 7).alias("label"), F.col("id"))
    runs = [automl.ml_regression(table.drop("id"), "label", key=["a", "label"], num_trees=5, node_rows=rows) for rows in (1000, 100)]
    assert all(run.metrics().first().n_test > 0 for run in runs)
    (rows, whole), (entries, merged) = seen
    assert rows > 100 and not whole and merged and 5 <= entries < rows
