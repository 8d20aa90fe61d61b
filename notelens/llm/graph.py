"""Connected components of an edge table, without gathering a component anywhere.

Alternating large-star and small-star steps: each turn links neighbours to the least node
around, until every node hangs on its component's least node. Each turn is written to the
shared folder, so lineage stays short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelens.llm.scratch import Scratch


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of n nodes that each reaches over the edges a - b, within one task."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least.select(F.col("a").alias("c"), "m"), F.col("a") == F.col("c")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``node, root`` for each node of ``edges`` (longs a, b) that is not its component's least node."""
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    seen, turn = None, 0
    while True:
        print_ = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_ == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, turn = print_, turn + 1
        following = scratch.write(_small_star(_large_star(now)).distinct(), f"{tag}-{turn}")
        scratch.drop(f"{tag}-{turn - 1}")
        now = following
