"""Connected components of a table of edges between strings or numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """``root, path`` of every node of edges (a, b); the root is the least node reached.

    Least labels travel along edges and along labels' own labels, so the turns grow with the
    logarithm of a component's reach. Each turn is checkpointed where a folder is set.
    """
    spark = edges.sparkSession
    # each edge and its reverse from one row, so edges are made once
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = edges.select(ways).select("way.a", "way.b").distinct().persist()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("path"), F.least("a", "m").alias("root"))
    shared = not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty()

    def keep(df: DataFrame) -> DataFrame:
        return df.checkpoint() if shared else df.persist()

    labels = keep(labels)
    labels.count()
    while True:
        near = both.join(labels.select(F.col("path").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near, labels["path"] == near["a"]).select("path", F.least("root", "m").alias("root"))
        jump = lower.join(lower.select(F.col("path").alias("p"), F.col("root").alias("further")), F.col("root") == F.col("p"), "left")
        following = keep(jump.select("path", F.least("root", F.coalesce("further", "root")).alias("root")))
        changed = following.join(labels.withColumnRenamed("root", "was"), "path").filter("root <> was").count()
        labels.unpersist()
        labels = following
        if not changed:
            both.unpersist()
            return labels.select("root", "path")
