"""Notes from folders of Markdown files, and from tables that stand in for them."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_excludes(entries: list[str]) -> tuple[set[str], set[str]]:
    """Names that are left out anywhere, and paths from the root (those with a slash)."""
    names, paths = set(), set()
    for entry in entries:
        clean = entry.strip().replace("\\", "/")
        bare = clean.strip("/")
        if bare:
            (paths if "/" in bare else names).add(bare)
    return names, paths


def excluded(rel: str, names: set[str], paths: set[str]) -> bool:
    return any(step in names for step in rel.split("/")) or any(rel == p or rel.startswith(p + "/") for p in paths)


def list_files(roots: list[str], excludes: dict[str, list[str]] | None = None, endings: tuple[str, ...] = (".md",)) -> list[dict]:
    """Files of all roots with key, mtime_ns and size; hidden names are kept, excluded folders aren't entered.

    Keys are paths from the root, with the root's name before them if there are several.
    """
    found = []
    for root in roots:
        names, paths = split_excludes((excludes or {}).get(root, []))
        prefix = os.path.basename(os.path.normpath(root)) + "/" if len(roots) > 1 else ""
        for folder, inner, files in os.walk(root):
            rel = os.path.relpath(folder, root).replace(os.sep, "/")
            base = "" if rel == "." else rel + "/"
            inner[:] = sorted(d for d in inner if not excluded(base + d, names, paths))
            for f in files:
                if f.lower().endswith(endings) and not excluded(base + f, names, paths):
                    full = os.path.join(folder, f)
                    try:
                        stat = os.stat(full)
                    except OSError:
                        continue  # gone since it was listed
                    found.append({"path": prefix + base + f, "file": full, "mtime_ns": stat.st_mtime_ns, "size": stat.st_size})
    return sorted(found, key=lambda x: x["path"])


def listing(spark: SparkSession, roots: list[str], excludes: dict[str, list[str]] | None = None, endings: tuple[str, ...] = (".md",)) -> DataFrame:
    return spark.createDataFrame(list_files(roots, excludes, endings), "path string, file string, mtime_ns long, size long")


def read_texts(files: DataFrame) -> DataFrame:
    """``path, text`` of listed files; bad bytes are replaced, files that can't be read are left out."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, file in zip(frame["path"], frame["file"], strict=True):
                try:
                    with open(file, "rb") as f:
                        rows.append((path, f.read().decode("utf-8", "replace")))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "text"])

    return files.select("path", "file").mapInPandas(read, "path string, text string")


def document_path() -> Column:
    """The note path that stands for a row of ``documents``."""
    return F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")))


def notes_of_documents(docs: DataFrame) -> DataFrame:
    return docs.select(document_path().alias("path"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")


def notes_of_conversations(turns: DataFrame) -> DataFrame:
    """A note for each conversation with a ``##`` section for each turn."""
    section = F.struct("turn", F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("s"))
    joined = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(section)).alias("all"))
    return joined.select(F.format_string("conversations/conv_%d.md", "conv_id").alias("path"), F.array_join(F.transform("all", lambda x: x["s"]), "\n\n").alias("text"))
