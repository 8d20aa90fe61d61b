"""Tables that cut lineage: written as Parquet under the folder the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in one Arrow batch; a batch is what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this process (local mode) or the warehouse."""
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if _own_root is None:
        if spark.sparkContext.master.startswith("local["):
            _own_root = "file://" + tempfile.mkdtemp(prefix="notelens-")
        else:
            _own_root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_notelens"
    return _own_root


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of few rows for the jobs within; the session's own settings come back afterwards."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, for what runs under whatever settings the session has."""
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, max(1, len(batch)), rows))


class Scratch:
    """A folder for one run of an operator; ``drop`` frees tables early, the rest goes when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/notelens/{name}-{uuid.uuid4().hex}"
        self.tags: set[str] = set()
        atexit.register(self._remove, self.path)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.path}/{tag}"
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        self.tags.add(tag)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self.tags.discard(tag)
            self._remove(f"{self.path}/{tag}")

    def keep(self, *tags: str) -> None:
        """Drops all tables but these."""
        self.drop(*(self.tags - set(tags)))

    def _remove(self, path: str) -> None:
        if path.startswith("file:") or path.startswith("/"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            return
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the store's own expiry has to remove it
            return
