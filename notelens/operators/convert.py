"""Converted files beside their sources: what is new, stale, current or not ours, and writing them."""

from __future__ import annotations

import contextlib
import datetime
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelens.sources import notes, readers

PRODUCER = "notelens"
STATUSES = ["new", "refresh", "foreign", "current"]
MAX_BYTES, MAX_LISTED, PREVIEW = 200 * 1024 * 1024, 200, 300
BLOCK = re.compile(r"﻿?---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", re.S)


FIELD = re.compile(r"^(?P<key>[^ \t\n:-][^:\n]*):(?P<value>.*)$", re.M)


class ConvertError(RuntimeError):
    pass


def sidecar_path(source: str) -> str:
    return source + ".md"


def source_version(mtime_ns: int, size: int) -> str:
    """The UTC time in microseconds and the size."""
    at = datetime.datetime.fromtimestamp(0, datetime.UTC) + datetime.timedelta(microseconds=mtime_ns // 1000)
    return f"{at.strftime('%Y-%m-%dT%H:%M:%S.%fZ')} {size}"


def render(source: str, version: str, extracted: readers.Extracted) -> str:
    fields = {"producer": PRODUCER, "source": os.path.basename(source), "source_version": version, "kind": extracted.kind}
    if extracted.pages is not None:
        fields["pages"] = str(extracted.pages)
    return "\n".join(["---", *(f"{k}: {v}" for k, v in fields.items()), "---", "", extracted.markdown])


def read_header(text: str) -> dict[str, str]:
    """Keys and values of the block at the start; indented lines and list items are skipped."""
    block = BLOCK.match(text.replace("\r\n", "\n"))
    return {m["key"].strip(): m["value"].strip() for m in FIELD.finditer(block[1])} if block else {}


def is_ours(header: dict[str, str]) -> bool:
    return header.get("producer") == PRODUCER


def plan(sources: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``path, kind, status``: sources (path, kind, version) against sidecars (path, producer, source_version)."""
    s = sidecars.select(F.col("path").alias("sidecar"), "producer", F.col("source_version").alias("held"))
    status = F.when(F.col("sidecar").isNull(), "new").when(~F.col("producer").eqNullSafe(F.lit(PRODUCER)), "foreign").when(F.col("held").eqNullSafe(F.col("version")), "current").otherwise("refresh")
    return sources.join(s, F.concat("path", F.lit(".md")) == F.col("sidecar"), "left").select("path", "kind", status.alias("status"))


def status_counts(planned: DataFrame) -> DataFrame:
    """``status, kind, n``: by status (kind null), by kind (status null)."""
    return planned.groupingSets([["status"], ["kind"]], "status", "kind").agg(F.count("*").alias("n"))


def listed(planned: DataFrame, limit: int = MAX_LISTED) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return planned.orderBy(order, "path").limit(min(limit, MAX_LISTED))


def inspect(path: str) -> dict:
    stat = os.stat(path)
    with open(path, "rb") as f:
        extracted = readers.extract(path, f.read())
    return {"path": path, "kind": extracted.kind, "size": stat.st_size, "pages": extracted.pages, "hard": extracted.hard, "reason": extracted.reason, "preview": extracted.markdown[:PREVIEW]}


def convert_file(path: str, root: str, excludes: list[str] | None = None) -> str:
    """Writes the sidecar of one file under ``root`` and returns its path; a note that isn't ours is never replaced."""
    full, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([full, base]) != base:
        raise ConvertError(f"{path} is outside {root}")
    if notes.excluded(os.path.relpath(full, base).replace(os.sep, "/"), *notes.split_excludes(excludes or [])):
        raise ConvertError(f"{path} is in an excluded folder")
    if readers.kind_of(full) is None:
        raise ConvertError(f"{path}: no reader for this kind of file")
    stat = os.stat(full)
    if stat.st_size > MAX_BYTES:
        raise ConvertError(f"{path} is larger than {MAX_BYTES} bytes")
    target, fresh = sidecar_path(full), True
    with contextlib.suppress(FileNotFoundError), open(target, encoding="utf-8", errors="replace") as f:
        header, fresh = read_header(f.read()), False
        if not is_ours(header):
            raise ConvertError(f"{target} is a note of another origin")
    version = source_version(stat.st_mtime_ns, stat.st_size)  # as of before the reading
    with open(full, "rb") as f:
        extracted = readers.extract(full, f.read())
    if extracted.hard:
        raise ConvertError(f"{path}: {extracted.reason}")
    text = render(full, version, extracted)
    if fresh:
        with open(target, "x", encoding="utf-8") as f:
            f.write(text)
    else:
        with open(target + ".new", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(target + ".new", target)
    return target
