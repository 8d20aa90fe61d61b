"""Byte-level BPE encoding and decoding with a lexicon of frequent words.

A text is cut into units before every blank that follows a character which is no white
space; the vocabulary's own splitting always has a word start there, so a text's ids are its
units' ids in turn. Units that are frequent in the corpus are compiled with their ids into a
minimal acyclic transducer, written once to the shared folder and memory-mapped by workers;
all other units are split by the vocabulary's pattern and merged exactly. A worker remembers
what it has looked up or merged, up to a bound.

Which units are frequent is counted over all documents; a task leaves out units it met once,
so a total is short by at most one for each task. The lexicon decides speed alone, never ids.

Defined results: null and empty texts have no ids; a special token's string in a text is that
token; repeated rows are encoded each; an empty table gives no rows; a null ``doc_id`` is
kept; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.llm import bpe
from notelens.llm.lexicon import Lexicon, compile_words
from notelens.llm.scratch import Scratch, sliced
from notelens.llm.spans import BLANK, SpanTable, parts_of, text_bytes

#: Words of the lexicon.
LEXICON_WORDS = 20_000
MEMO_UNITS = 600_000

_TAIL_LEADS = np.zeros(256, bool)
_TAIL_LEADS[[0xC2, 0x80, 0x81, 0x9A]] = True


def units_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of rows laid end to end.

    A byte above 0x7F may end a white-space character only after 0xC2, 0x80, 0x81 or 0x9A; no
    unit starts after such a pair, white space or not.
    """
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blank = BLANK[raw]
    space = blank.copy()  # may be the end of a white-space character
    space[(raw >= 0x1C) & (raw <= 0x1F)] = True
    space[1:] |= (raw[1:] >= 0x80) & _TAIL_LEADS[raw[:-1]]
    start = np.zeros(len(raw) + 1, bool)
    start[1:-1] = (raw[1:] == 0x20) & ~space[:-1]
    start[offsets] = True
    at = np.flatnonzero(start[:-1])
    return at, np.concatenate([at[1:], [len(raw)]])


class Codec:
    """Ids of units, and text from ids."""

    def __init__(self, path: str, pattern: str, lexicon: Lexicon | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.bpe = bpe.Bpe(path)
        self.pattern = regex.compile(pattern)
        self.lexicon = lexicon
        self.bytes_of = dict(self.bpe.bytes_of)
        for i, token in self.library.get_added_tokens_decoder().items():
            self.bytes_of[i] = token.content.encode()

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in one array, and the n + 1 starts."""
        found: list[np.ndarray | None] = [None] * len(units)
        if self.lexicon is not None:
            numbers = self.lexicon.numbers(units)
            starts, ids = self.lexicon.starts, self.lexicon.ids
            for i in np.flatnonzero(numbers >= 0).tolist():
                found[i] = ids[starts[numbers[i]] : starts[numbers[i] + 1]]
        parts: list[bytes] = []
        spans: list[tuple[int, int, int]] = []
        for i, unit in enumerate(units):
            if found[i] is not None:
                continue
            text = unit.decode()
            if bpe.UNUSUAL.search(text):
                found[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
                continue
            before = len(parts)
            parts += [p.encode() for p in self.pattern.findall(text)]
            spans.append((i, before, len(parts)))
        flat, at = self.bpe.encode_words(parts)
        for i, a, b in spans:
            found[i] = flat[at[a] : at[b]]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.empty(0, np.int32), *found]).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])

    def learn(self, units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pools: ids; ids in decimal, each with a comma; the bytes that the ids decode to."""
        ids, starts = self.encode_units(units)
        names = [b"%d," % i for i in range(len(self.bytes_of))] if not hasattr(self, "_names") else self._names
        self._names = names
        listed, edges = ids.tolist(), starts.tolist()
        said = [b"".join([names[i] for i in listed[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        back = [b"".join([self.bytes_of[i] for i in listed[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

        def pool(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))])

        return [(ids, starts), pool(said), pool(back)]


def encode(table: SpanTable, column: pa.Array) -> Iterator[tuple[np.ndarray, bytes, bytes]]:
    """For each text: its ids, the ids in decimal with commas between, the bytes they decode to."""
    raw, offsets = text_bytes(column)
    for i, j in parts_of(offsets):
        part, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = units_of(part, rows)
        entries = table.entries(part, starts, ends)
        edges = np.searchsorted(starts, rows)
        pools = []
        for p in range(3):
            values, at = table.gather(p, entries)
            pools.append((values, at[edges].tolist()))
        (ids, a), (said, b), (back, c) = pools
        said, back = said.tobytes(), back.tobytes()
        for k in range(j - i):
            yield ids[a[k] : a[k + 1]], said[b[k] : max(b[k], b[k + 1] - 1)], back[c[k] : c[k + 1]]


def frequent_units(docs: DataFrame, most: int, scratch: Scratch) -> list[bytes]:
    """The units counted most often over all documents, ``most`` at most.

    A histogram of the counts (some 8 classes for each power of two) gives the least count that
    leaves ``most`` units or fewer, so only these leave the executors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def keep(units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
            held.extend(units)
            return [(np.empty(0, np.uint8), np.zeros(len(units) + 1, np.int64))]

        def told() -> pa.RecordBatch:
            often = np.flatnonzero(counts[: len(held)] > 1)
            return pa.RecordBatch.from_arrays([pa.array([held[i] for i in often], pa.binary()), pa.array(counts[often])], ["unit", "n"])

        table, counts = SpanTable(keep, 1 << 62), np.zeros(0, np.int64)
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for i, j in parts_of(offsets):
                if len(held) > MEMO_UNITS:
                    yield told()
                    held.clear()
                    table.clear()
                    counts = np.zeros(0, np.int64)
                part = raw[offsets[i] : offsets[j]]
                entries = table.entries(part, *units_of(part, offsets[i : j + 1] - offsets[i]))
                counts = np.concatenate([counts, np.zeros(max(0, len(held) - len(counts)), np.int64)])
                counts += np.bincount(entries, minlength=len(counts))
        yield told()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counted = scratch.write(counted.withColumn("class", F.floor(F.log2("n") * 8).cast("int")), "units")
    held, least = 0, None
    for r in counted.groupBy("class").count().orderBy(F.desc("class")).collect():  # a few hundred classes
        held += r["count"]
        if held > most:
            break
        least = r["class"]
    rows = counted.filter(F.col("class") >= least).select("unit").collect() if least is not None else []
    scratch.drop("units")
    return sorted(bytes(r["unit"]) for r in rows)


def write_lexicon(spark: SparkSession, folder: str, data: bytes) -> str:
    """Writes the lexicon to the shared folder; where workers can't map a file there, Spark hands each a copy."""
    store, inner = fs.FileSystem.from_uri(folder)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    store.create_dir(inner, recursive=True)
    with store.open_output_stream(f"{inner}/{name}", compression=None) as f:
        f.write(data)
    if isinstance(store, fs.LocalFileSystem):
        return f"{inner}/{name}"
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def open_lexicon(path: str) -> Lexicon:
    """Memory-mapped: a path where the shared folder is mounted, else the name of the worker's copy."""
    return Lexicon(np.memmap(path if os.path.isabs(path) else SparkFiles.get(path), np.uint8, "r"))


def codec_digests(docs: DataFrame, vocabulary: str, pattern: str, words: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, encoded and decoded."""
    scratch = Scratch(docs.sparkSession, "bpe")
    units = frequent_units(docs, words, scratch)
    ids, starts = Codec(vocabulary, pattern).encode_units(units)
    lexicon = {u: ids[a:b].tolist() for u, a, b in zip(units, starts[:-1], starts[1:], strict=True)}
    path = write_lexicon(docs.sparkSession, scratch.path, compile_words(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, pattern, open_lexicon(path))
        table = SpanTable(codec.learn, MEMO_UNITS)
        for batch in sliced(batches):
            sizes, told, decoded = [], [], []
            for ids, said, back in encode(table, batch.column("text")):
                sizes.append(len(ids))
                told.append(hashlib.sha256(said).hexdigest())
                decoded.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(told, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
