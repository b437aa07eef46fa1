"""Connected components of link tables, on the cluster and inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import written

MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a table of links (a, b); the root is the smallest node of the component.

    Alternates large-star and small-star steps, each a minimum per node (pre-aggregated) and a join; the table never gets
    longer, is written after each round, and the number of rounds grows with the logarithm of its length. No group of rows is
    collected, neither in a task nor on the driver.
    """
    def ordered(a: str, b: str):
        return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")

    def with_minimum(edges: DataFrame) -> DataFrame:
        least = edges.groupBy("u").agg(F.min("v").alias("low"))
        return edges.join(least, "u")

    def state(edges: DataFrame) -> tuple:
        mark = F.xxhash64("u", "v")
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(mark % 1_000_003)).first())

    edges = written(links.where(F.col("a") != F.col("b")).select(*ordered("a", "b")).distinct())
    now = state(edges)
    for _ in range(MAX_ROUNDS):
        if not now[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_minimum(both).where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()
        paired = with_minimum(large)
        small = paired.select(F.explode(F.array(
            F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        edges = written(small.select("e.*").where(F.col("u") != F.col("v")).distinct())
        before, now = now, state(edges)
        if now == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b the smallest node that each one reaches; by minimum labels and pointer jumping."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label
