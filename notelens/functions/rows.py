"""Rows of a DataFrame: on enough tasks, and with columns that are made once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` on all cores where their scan has less than a split for each; larger ones stay as they are read.

    Small files often have one row group, which is one task however many cores there are. Rows that were dealt out
    before, such as chunks of notes, stay where they are.
    """
    spark = rows.sparkSession
    plan = rows._jdf.queryExecution().optimizedPlan()
    if "Repartition" in plan.toString():
        return rows
    cores = spark.sparkContext.defaultParallelism
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    size = int(plan.stats().sizeInBytes())
    return rows.repartition(cores, *keys) if size < cores * split else rows


def made_once(rows: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns; as a generator's output these are made once, however often they are used."""
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("made")
    return rows.select(*keep, made).select(*keep, *[f"made.{name}" for name in columns])
