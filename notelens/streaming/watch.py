"""Keeping an index current. The manifest diff stays the source of truth: a file stream reports
neither deletions nor edits in place, so a trigger only says when to look."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def on_new_files(spark: SparkSession, folder: str, reindex: Callable[[], object], checkpoint: str, glob: str = "*.md") -> StreamingQuery:
    """Runs ``reindex`` once for each micro-batch that has new files; ends when all that is there has been seen."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            reindex()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Maintainer:
    """Calls ``reindex`` every ``period`` seconds until stopped."""

    def __init__(self, reindex: Callable[[], object], period: float):
        self.reindex, self.period = reindex, period
        self.failure: Exception | None = None
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self._stop.wait(self.period):
            try:
                self.reindex()
                self.failure = None
            except Exception as e:  # the next period tries again; the last failure can be asked for
                self.failure = e

    def start(self) -> Maintainer:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()
