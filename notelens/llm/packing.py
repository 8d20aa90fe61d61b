"""Best-fit packing of tokenised documents into sequences of a fixed length.

The plan is made from the histogram of piece lengths alone, which has at most ``limit``
entries however large the corpus is. Lengths are taken from the largest down; gaps are
filled exactly by one, two or three lengths found in an index of their sums, many sequences
at a time under the counts that are left. What no exact combination fills goes best-fit into
the smallest gap that takes it. The plan is a table of rank intervals for
each length; every piece gets its rank within its length by salted counting and looks its
place up, so no task ever holds a length's whole group.

Defined results: null and empty texts are one piece holding the end id alone; rows that
repeat are packed each; an empty table gives no rows; a null ``doc_id`` is carried as it
is. Extra columns of the input play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelens.llm import bpe
from notelens.llm.scratch import Scratch
from notelens.llm.spans import SpanTable, parts_of, text_bytes, words_of

LIMIT = 4096
END_ID = 1
#: Words a worker remembers the ids of, before it starts anew.
MEMO_WORDS = 1_000_000
#: A plan is good enough if it has this share of sequences more than its tokens ask for.
CLOSE = 0.0005
#: Pieces of one salt bucket, about; ranks are counted within buckets.
BUCKET_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: The pre-tokeniser's pattern of the word vocabulary.
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """Ids of whole texts as the library gives them, by remembered words between ASCII blanks.

    White space is dropped and never crossed by this vocabulary, so a text's ids are those of
    its words in turn. Words with characters outside the Latin blocks, or with special tokens,
    are encoded by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.bpe = bpe.Bpe(path)
        self.table = SpanTable(self._learn, MEMO_WORDS)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        raw, offsets = text_bytes(column)
        for i, j in parts_of(offsets):
            part, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends = words_of(part, rows)
            ids, at = self.table.gather(0, self.table.entries(part, starts, ends))
            edges = at[np.searchsorted(starts, rows)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield ids[a:b]

    def _learn(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        parts: list[bytes] = []
        firsts, odd = [0], {}
        for i, raw in enumerate(words):
            word = raw.decode()
            if bpe.UNUSUAL.search(word):
                odd[i] = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4")
            elif (low := word.lower()).isalpha():
                parts.append(low.encode())
            else:
                parts += [p.encode() for p in WORD_PATTERN.findall(low)]
            firsts.append(len(parts))
        flat, starts = self.bpe.encode_words(parts)
        flat, edges = flat.astype("<u4"), starts[firsts]
        if odd:
            pieces = [odd.get(i, flat[edges[i] : edges[i + 1]]) for i in range(len(words))]
            flat, edges = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return [(flat, edges)]


def pieces_of(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row for each piece of at most ``limit`` ids of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids = found.astype("<u4").tobytes() + end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Sums:
    """Pieces left of each length, with an index of the sums of one, two and three of them.

    ``left`` is the index of single lengths. ``pairs[s]`` counts the pairs of lengths with sum s
    that the pieces left allow; it is updated whenever a length's count passes 2, 1 or 0. A triple
    is a length and a pair sum, looked up for all first lengths at once. Nothing is capped: a
    gap that one, two or three pieces fill is always found.
    """

    def __init__(self, counts: np.ndarray, limit: int):
        self.limit, self.left = limit, np.zeros(limit + 1, np.int64)
        self.pairs = np.zeros(2 * limit + 1, np.int64)
        for length in np.flatnonzero(counts):
            if length:
                self.set(int(length), int(counts[length]))

    def set(self, length: int, count: int) -> None:
        """Changes a length's count, and the pairs that this adds or takes away."""
        before = min(int(self.left[length]), 2)
        self.left[length] = count
        after = min(count, 2)
        if (before > 0) != (after > 0):
            others = np.flatnonzero(self.left)
            self.pairs[length + others[others != length]] += 1 if after else -1
        if (before > 1) != (after > 1):
            self.pairs[2 * length] += 1 if after > 1 else -1

    def take(self, parts: list[int], times: int = 1) -> None:
        for p in parts:
            self.set(p, int(self.left[p]) - times)

    def pair(self, total: int) -> list[int]:
        """Two lengths of that sum, the larger one as large as can be; empty if there are none."""
        if total < 2 or not self.pairs[total]:
            return []
        a = np.arange(min(total - 1, self.limit), (total + 1) // 2 - 1, -1)
        fit = (self.left[a] > 0) & (self.left[total - a] > (2 * a == total))
        large = int(a[np.argmax(fit)])
        return [large, total - large]

    def triple(self, total: int) -> list[int]:
        """Three lengths of that sum, the first as large as can be; empty if there are none."""
        a = np.arange(1, min(total - 2, self.limit) + 1)
        a = a[self.left[a] > 0]
        if not len(a):
            return []
        rest = total - a
        # pairs that the first length itself is needed for, once it is taken
        other = rest - a
        there = (other > 0) & (other <= self.limit)
        others = self.left[np.where(there, other, 0)] * there
        lost = np.where(other == a, self.left[a] == 2, (self.left[a] == 1) & (others > 0))
        fit = self.pairs[rest] - lost > 0
        if not fit.any():
            return []
        first = int(a[fit][-1])
        self.take([first])
        found = self.pair(total - first)
        self.take([first], -1)
        return [first, *found]

    def filling(self, gap: int, most: int = 3) -> list[int]:
        """One, two or three lengths (``most`` at most) of sum ``gap``; empty if there are none."""
        if not gap or not most:
            return []
        if self.left[gap]:
            return [gap]
        return (self.pair(gap) if most > 1 else []) or (self.triple(gap) if most > 2 else [])


def plan(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """From pieces per length (index 0 to ``limit``) to (lengths of a sequence, sequences made so).

    Triples may use up short lengths that long residuals need: where a plan with them is not
    within ``CLOSE`` of what the sum of lengths asks for, plans of fewer parts are made as well,
    and the one of fewest sequences counts.
    """
    lengths = np.arange(limit + 1)
    least = max(-(-int((counts * lengths).sum()) // limit), int(counts[lengths * 2 > limit].sum()))
    best, fewest = [], None
    for most in (3, 2, 1, 0):
        made = _plan(counts, limit, most)
        n = sum(times for _, times in made)
        if fewest is None or n < fewest:
            best, fewest = made, n
        if fewest <= least * (1 + CLOSE) + 1:
            break
    return best


def _plan(counts: np.ndarray, limit: int, most: int) -> list[tuple[list[int], int]]:
    """The plan whose gaps are filled by ``most`` lengths at most."""
    sums = Sums(counts, limit)
    made: list[tuple[list[int], int]] = []
    open_: list[tuple[list[int], int]] = []  # sequences that no combination filled
    for large in range(limit, 0, -1):
        while sums.left[large]:
            sums.take([large])
            parts = sums.filling(limit - large, most)
            sums.take([large], -1)
            if large < limit and not parts:
                open_.append(([large], int(sums.left[large])))
                sums.set(large, 0)
                break
            parts = [large, *parts]
            need = np.bincount(parts, minlength=limit + 1)
            times = int((sums.left[need > 0] // need[need > 0]).min())
            sums.take(parts, times)
            made.append((parts, times))
    return made + _best_fit(open_, limit)


def _best_fit(open_: list[tuple[list[int], int]], limit: int) -> list[tuple[list[int], int]]:
    """Lengths that filled nothing exactly, largest first into the smallest gap that takes them."""
    bins: dict[int, list[tuple[list[int], int]]] = {}
    for (length,), count in sorted(open_, reverse=True):
        while count:
            gap = next((g for g in range(length, limit) if bins.get(g)), None)
            if gap is None:
                each = limit // length
                whole, rest = divmod(count, each)
                for parts, n in (([length] * each, whole), ([length] * rest, int(rest > 0))):
                    if n:
                        bins.setdefault(limit - sum(parts), []).append((parts, n))
                break
            parts, n = bins[gap].pop()
            take = min(n, count)
            if take < n:
                bins[gap].append((parts, n - take))
            bins.setdefault(gap - length, []).append(([*parts, length], take))
            count -= take
    return [x for group in bins.values() for x in group]


def slots_of(made: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, offset), sorted by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for parts, times in made:
        offset = 0
        for p in parts:
            rows.append((p, ranks.get(p, 0), times, sequence, offset))
            ranks[p] = ranks.get(p, 0) + times
            offset += p
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Every piece with the sequence and the offset it is packed at."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(pieces_of(docs, tokenizer, limit), "pieces")
    counts = np.zeros(limit + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `limit` rows
        counts[r["length"]] = r["count"]
    slots = slots_of(plan(counts, limit))
    buckets = int(counts.sum()) // BUCKET_ROWS + 1

    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    each = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = each.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    shared = spark.sparkContext.broadcast(slots)  # a few rows for each length, at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        step = np.int64(1) << np.int64(48)
        keys = table[:, 0] * step + table[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() * step + rank, side="right") - 1
            found = table[at] if len(rank) else np.empty((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
