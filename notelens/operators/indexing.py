"""A versioned index of notes: what changed, what is carried over, and one commit at the end.

``<index>/v=<n>/`` holds Parquet tables and the settings; the file ``CURRENT`` names the
version that counts and is replaced last, so a failed run leaves the old index as it was.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.functions.text import embed_text
from notelens.operators.chunking import Limits, chunks_of, parents_of
from notelens.operators.fusion import note_features, unit_share
from notelens.operators.lexical import corpus_stats, postings, term_stats
from notelens.sources.locks import file_lock

FORMAT = 1
TABLES = ["manifest", "chunks", "parents", "vectors", "postings", "term_stats", "corpus_stats", "notes", "unit_share"]


@dataclass(frozen=True)
class Stats:
    notes: int
    changed: int
    deleted: int
    chunks: int
    full: bool
    written: bool
    seconds: float


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: changed (new or different) and deleted; what is the same is left out."""
    o, n = old.alias("o"), new.alias("n")
    same = F.col("o.mtime_ns").eqNullSafe(F.col("n.mtime_ns")) & F.col("o.size").eqNullSafe(F.col("n.size"))
    change = F.when(F.col("n.path").isNull(), "deleted").when(F.col("o.path").isNull() | ~same, "changed")
    return o.join(n, F.col("o.path") == F.col("n.path"), "full_outer").select(F.coalesce("n.path", "o.path").alias("path"), change.alias("change")).filter("change is not null")


def carry_over(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of notes that neither changed nor went."""
    return rows.join(changes.select("path"), "path", "left_anti").select(*rows.columns)


class Index:
    """The version of an index that counts, or none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def version(self) -> int | None:
        try:
            with open(os.path.join(self.folder, "CURRENT"), encoding="utf-8") as f:
                n = int(f.read())
        except (OSError, ValueError):
            return None
        return n if all(os.path.isdir(os.path.join(self.folder, f"v={n}", t)) for t in TABLES) else None

    def settings(self) -> dict:
        try:
            with open(os.path.join(self.folder, f"v={self.version()}", "settings.json"), encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return {}

    def table(self, name: str) -> DataFrame:
        n = self.version()
        if n is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        return self.spark.read.parquet(os.path.join(self.folder, f"v={n}", name))

    def commit(self, tables: dict[str, DataFrame], settings: dict) -> None:
        old = self.version()
        n = max([old or 0, *(int(d[2:]) for d in os.listdir(self.folder) if d.startswith("v=") and d[2:].isdigit())]) + 1
        target = os.path.join(self.folder, f"v={n}")
        try:
            for name in TABLES:
                tables[name].write.parquet(os.path.join(target, name))
            with open(os.path.join(target, "settings.json"), "w", encoding="utf-8") as f:
                json.dump(settings, f)
        except BaseException:
            shutil.rmtree(target, ignore_errors=True)
            raise
        pointer = os.path.join(self.folder, "CURRENT")
        with open(pointer + ".new", "w", encoding="utf-8") as f:
            f.write(str(n))
        os.replace(pointer + ".new", pointer)
        for d in os.listdir(self.folder):
            if d.startswith("v=") and d not in (f"v={n}", f"v={old}"):
                shutil.rmtree(os.path.join(self.folder, d), ignore_errors=True)


def update(
    spark: SparkSession,
    folder: str,
    manifest: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    embed: Callable[[DataFrame], DataFrame],
    model: str = "hash",
    limits: Limits | None = None,
    full: bool = False,
) -> Stats:
    """Brings the index up to ``manifest`` (path, mtime_ns, size).

    ``read`` turns paths to read into ``path, text`` and may leave some out; those are left out
    of the manifest too, and tried again next time. ``embed`` turns ``path, index, embed_text``
    into ``path, index, embedding``.
    """
    began, limits = time.time(), limits or Limits()
    os.makedirs(folder, exist_ok=True)
    with file_lock(os.path.join(folder, "lock")):
        index = Index(spark, folder)
        settings = {"format": FORMAT, "model": model, "most": limits.most, "overlap": limits.overlap, "least": limits.least}
        full = full or index.version() is None or index.settings() != settings
        old = spark.createDataFrame([], "path string, mtime_ns long, size long") if full else index.table("manifest")
        changes = manifest_diff(old, manifest.select("path", "mtime_ns", "size")).persist()
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        if not full and not counts:
            return Stats(manifest.count(), 0, 0, index.table("chunks").count(), False, False, time.time() - began)
        notes = read(changes.filter("change = 'changed'").select("path")).persist()
        chunks, parents = chunks_of(notes, limits).persist(), parents_of(notes, limits)
        texted = chunks.withColumn("embed_text", embed_text(F.col("path"), F.col("tags"), F.col("heading_path"), F.col("text")))
        vectors = embed(texted.select("path", "index", "embed_text"))
        posted = postings(texted, ["path", "index"], "embed_text")
        if not full:
            chunks = carry_over(index.table("chunks"), changes).unionByName(texted)
            parents = carry_over(index.table("parents"), changes).unionByName(parents)
            vectors = carry_over(index.table("vectors"), changes).unionByName(vectors)
            posted = carry_over(index.table("postings"), changes).unionByName(posted)
        else:
            chunks = texted
        stats = corpus_stats(chunks, "embed_text")
        features = note_features(chunks)
        unread = changes.filter("change = 'changed'").select("path").join(notes.select("path"), "path", "left_anti")
        index.commit(
            {
                "manifest": manifest.join(unread, "path", "left_anti").select("path", "mtime_ns", "size"),
                "chunks": chunks,
                "parents": parents,
                "vectors": vectors,
                "postings": posted,
                "term_stats": term_stats(posted, stats),
                "corpus_stats": stats,
                "notes": features,
                "unit_share": unit_share(features),
            },
            settings,
        )
        for df in (changes, notes):
            df.unpersist()
        n = index.table("manifest").count()
        return Stats(n, counts.get("changed", 0), counts.get("deleted", 0), index.table("chunks").count(), full, True, time.time() - began)
