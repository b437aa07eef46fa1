import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import ranking
from tabulon.operators.quantiles import exact_quantiles, group_quantiles
from tabulon.operators.ranking import mid_rank, running_counts, text_codes, value_splits

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def skewed(n=4000, seed=3):
    """A third of the rows share one value; the rest has ties and a long tail."""
    rng = random.Random(seed)
    return [7.0 if rng.random() < 0.34 else round(rng.expovariate(0.01), rng.choice((0, 3))) for _ in range(n)]


@pytest.mark.parametrize("band_rows, accuracy, sample", [
    (10**6, 10_000, 10**6), (50, 10_000, 10**6), (50, 40, 10**6), (1, 100, 10**6), (50, 10_000, 1_000), (50, 40, 200), (200, 1_000, 50)])
def test_quantiles_by_every_route(spark, band_rows, accuracy, sample):
    x, y = skewed(), [float(i) for i in range(3999)] + [None]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    got = exact_quantiles(df, {"x": PROBABILITIES, "y": [0.5]}, band_rows=band_rows, accuracy=accuracy, sample=sample)
    assert got["x"] == pytest.approx(np.quantile(x, PROBABILITIES).tolist())
    assert got["y"] == [1999.0]


def test_a_thinned_column_called_like_the_draw(spark):
    df = spark.createDataFrame([(float(i * 37 % 3001),) for i in range(3001)], "_chance double").repartition(8)
    assert exact_quantiles(df, {"_chance": [0.0, 0.5, 0.999, 1.0]}, band_rows=20, sample=300) == {"_chance": [0.0, 1500.0, 2997.0, 3000.0]}


def test_quantiles_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(None, 2.0, "z"), (None, 2.0, "z")], "a double, b double, c string")
    assert exact_quantiles(df, {"a": [0.5], "b": [0.1, 0.9], "c": [0.5]}, band_rows=1) == {
        "a": [None], "b": [2.0, 2.0], "c": [None]}


@pytest.mark.parametrize("bucket_values, few_groups", [(10**6, 32), (10**6, 3), (60, 3)])
def test_group_quantiles_with_a_hot_group(spark, monkeypatch, bucket_values, few_groups):
    monkeypatch.setattr(ranking.value_splits, "__kwdefaults__", {
        "bucket_values": bucket_values, "max_buckets": ranking.MAX_BUCKETS})
    monkeypatch.setitem(ranking.running_counts.__kwdefaults__, "bucket_values", bucket_values)
    x = skewed()
    rows = [("hot" if i % 3 else f"g{i % 7}", v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [("none", None)], "g string, v double")
    found = group_quantiles(df, "g", "v", {"a": 0.1, "b": 0.5}, few_groups=few_groups)
    got = {r.g: (r.n, r.a, r.b) for r in found.collect()}
    assert got["none"] == (0, None, None)
    for g in {g for g, _ in rows}:
        values = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx((len(values), *np.quantile(values, [0.1, 0.5])))


@pytest.mark.parametrize("bucket_values", [10**6, 50])
def test_running_counts_and_ranks(spark, bucket_values):
    x = skewed(2000)
    df = spark.createDataFrame([(v, "ab"[i % 2], i % 5) for i, v in enumerate(x)], "v double, t string, m int")
    table = running_counts(df, "v", tag=["t"], bucket_values=bucket_values)
    assert table.select(F.sum("n")).first()[0] == 2000
    for r in table.select("v", "t", "n", "ties", "upto", "dense", "total", mid_rank().alias("mid")).collect():
        below = sum(v < r.v for v in x)
        same = sum(v == r.v for v in x)
        assert (r.ties, r.upto, r.total) == (same, below + same, 2000)
        assert r.dense == len({v for v in x if v <= r.v})
        assert r.mid == below + (same + 1) / 2
        assert r.n == sum(v == r.v and "ab"[i % 2] == r.t for i, v in enumerate(x))
    measured = running_counts(df, "v", measures=["m"], bucket_values=bucket_values)
    for r in measured.collect():
        assert r.m_upto == sum(i % 5 for i, v in enumerate(x) if v <= r.v)
        assert r.m_total == sum(i % 5 for i in range(2000))


def test_splits_share_out_distinct_values(spark):
    # Nearly all rows are zero, so boundaries by row count would leave one bucket with everything else.
    df = spark.range(40_000).select(F.when(F.col("id") < 36_000, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    splits = value_splits(df, ["v"], bucket_values=400)["v"]
    assert len(splits) >= 8
    sizes = np.histogram(np.r_[0.0, np.arange(36_000, 40_000)], bins=[-np.inf, *splits, np.inf])[0]
    assert sizes.max() < 3 * 400


@pytest.mark.parametrize("bucket_values", [10**6, 30])
def test_text_codes(spark, bucket_values):
    words = sorted({f"w{(i * 7919) % 997}" for i in range(400)})
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "s string")
    got = {r.s: r.code for r in text_codes(df, "s", bucket_values=bucket_values).collect()}
    assert got == {w: i for i, w in enumerate(words)}
