"""What a search answers: clipped texts, extra hits, the section a hit stands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.functions.recency import note_date
from notelens.functions.text import around, clip, note_title

SNIPPET, EXTRAS, MOST, MIN_GAIN, PARENT_CHARS = 600, 2, 20, 200, 3000


def clamp_k(k: int) -> int:
    return max(1, min(k, MOST))


def parent_text(parent: Column, chunk: Column, limit: int = PARENT_CHARS) -> Column:
    """The section around a chunk, if it says much more than the chunk."""
    return F.when(F.length(parent) > F.length(chunk) + MIN_GAIN, around(parent, chunk, limit))


def search_response(notes: DataFrame, chunks: DataFrame, parents: DataFrame | None = None, limit: int = PARENT_CHARS) -> DataFrame:
    """``qid, rank, path, title, date, score, text, heading_path, extras, matched_chunks, parent`` from grouped notes."""
    hits = notes.select("qid", "rank", "path", "score", F.size("hits").alias("matched_chunks"), F.posexplode(F.slice("hits", 1, 1 + EXTRAS)).alias("place", "hit"))
    texts = hits.join(chunks.select("path", F.col("index").alias("i"), "heading_path", "text", "parent_id"), (hits["path"] == chunks["path"]) & (F.col("hit.index") == F.col("i"))).drop(chunks["path"])
    if parents is not None:
        whole = parents.select(F.col("path").alias("pp"), F.col("id").alias("pid"), F.col("text").alias("whole"))
        texts = texts.join(whole, (F.col("path") == F.col("pp")) & (F.col("parent_id") == F.col("pid")), "left")
        parent = parent_text(F.col("whole"), F.col("text"), limit)
    else:
        parent = F.lit(None).cast("string")
    first = F.col("place") == 0
    extras = F.transform(F.sort_array(F.collect_list(F.when(~first, F.struct("place", clip(F.col("text"), SNIPPET).alias("text"))))), lambda e: e["text"])
    return texts.withColumn("parent", parent).groupBy("qid", "rank", "path", "score", "matched_chunks").agg(
        F.max(F.when(first, clip(F.col("text"), SNIPPET))).alias("text"),
        F.max(F.when(first, F.col("heading_path"))).alias("heading_path"),
        F.max(F.when(first, F.col("parent"))).alias("parent"),
        extras.alias("extras"),
    ).select("qid", "rank", "path", note_title(F.col("path")).alias("title"), F.date_format(note_date(F.col("path")), "yyyy-MM-dd").alias("date"), F.bround("score", 4).alias("score"), "text", "heading_path", "extras", "matched_chunks", "parent")


def read_section(text: Column, start: int = 0, limit: int = PARENT_CHARS) -> Column:
    """``text, truncated`` from ``start``, at most ``limit`` characters."""
    rest = F.substr(text, F.lit(start + 1))
    cut = F.length(rest) > limit
    return F.struct(F.when(cut, F.concat(F.left(rest, F.lit(limit)), F.lit("…"))).otherwise(rest).alias("text"), cut.alias("truncated"))


def read_note(notes: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """The note's text if it is indexed."""
    return notes.filter(F.col("path") == path).join(manifest.select("path"), "path", "left_semi")
