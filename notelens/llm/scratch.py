"""Scratch tables, and filters that keep rows away from joins they have no part in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.functions.scratch import BATCH_BYTES, BATCH_ROWS, Scratch, shared_root, sliced, small_batches

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "Scratch", "filter_bits", "read_table", "shared_root", "sliced", "small_batches", "split_by"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a filter: its least and its most (32 MB), and how many there are for each key in between.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 12, 28, 8


def filter_bits(keys: int) -> int:
    """The logarithm of the size of a filter of that many keys."""
    return min(max((BITS_A_KEY * keys).bit_length(), LEAST_BITS), MOST_BITS)


def _cells(keys: DataFrame, bits: int) -> DataFrame:
    """``__cell, __bits``: 4096 bits of the filter in 64 longs, for each cell that has one set."""
    name = keys.columns[0]
    words = keys.select(F.pmod(name, F.lit(1 << bits)).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))

    def pack(table: pa.Table) -> pa.Table:
        out = np.zeros(64, np.int64)
        out[table.column("word").to_numpy() & 63] = table.column("bits").to_numpy()
        return pa.table([table.column("__cell")[:1], pa.array([out])], names=["__cell", "__bits"])

    return words.withColumn("__cell", F.shiftright("word", 6)).groupBy("__cell").applyInArrow(pack, "__cell long, __bits array<long>")


def split_by(df: DataFrame, hashed: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` as rows that no key of ``keys`` (one column of hashed longs) can meet, and the others.

    The broadcast filter grows with the keys up to ``MOST_BITS``; so a join that few rows have a
    part in moves only these. With more keys than some 30 million it fills up, and the join moves
    up to all rows, once: the plan is the same, and nothing depends on what the filter lets through.
    """
    bits = filter_bits(keys.count())
    placed = df.withColumn("__bit", F.pmod(hashed, F.lit(1 << bits)))
    met = placed.join(F.broadcast(_cells(keys, bits)), F.shiftright("__bit", 12) == F.col("__cell"), "left")
    may = F.coalesce(F.expr("shiftrightunsigned(get(__bits, cast(shiftright(__bit, 6) & 63 as int)), cast(__bit & 63 as int)) & 1L") == 1, F.lit(False))
    return met.filter(~may).select(*df.columns), met.filter(may).select(*df.columns)
