"""Removal of repeated passages by level-wise doubling.

A window of 35 words that stands in two places has the same words of every shorter length in
the same places of both. The first level looks at windows of 9 words, at one place of each
long window only: the leftmost least hash among the 27 that it holds, which two equal long
windows choose alike. Places whose 9 words stand nowhere else are done with; the others are
extended to 18 words, to the right or to the left as each long window has room, and where
those stand nowhere else they are done with too. Long windows that still have a candidate are
compared as a whole; the words of those that stand elsewhere as well are removed.

What stands twice within one task is settled there, and one of its places alone goes on to
meet those of other tasks; so a passage that a third of all rows hold brings a bucket one
place for each task. A row is named by a hash of its id and text: repeated rows share the
name, count as several places, and lose the same words.

Windows are compared by 64-bit hashes within buckets that the anchor's hash deals, so by 64
bits and those of the bucket's number.

Defined results: null and empty texts have no words; a null ``doc_id`` is kept; an empty
table gives no rows; extra columns are passed through by ``removed`` and play no part, but
for those named as its results, which give way to them. The kept text is put together by Spark
expressions, row by row: the caller's own Arrow settings make no batches of texts of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelens.llm.scratch import Scratch, split_by
from notelens.llm.spans import hashed_words, mix, random_words

WINDOW = 35
LEVELS = (9, 18, WINDOW)
#: Anchors of one bucket, about; rows that a task holds before it hands them on.
BUCKET_ANCHORS, HELD_ANCHORS = 200_000, 400_000
#: Bytes of text in one partition of a join, about.
JOIN_BYTES = 32 << 20
#: Only sets the number of buckets.
BYTES_A_WORD = 6

_LEFT, _RIGHT = random_words(2, 11)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hashes of two runs as the hash of both; mixed at each step, so nothing stays linear."""
    return mix(left * _LEFT + mix(right + _RIGHT))


class Windows:
    """Hashes of windows of word hashes: runs of 9 words by doubling, longer ones from two that they begin and end with."""

    def __init__(self, words: np.ndarray):
        run = words
        for width in (1, 2, 4):
            run = _joined(run[:-width], run[width:]) if len(run) > width else run[:0]
        self.short = _joined(run[:-1], words[8:]) if len(words) >= LEVELS[0] else run[:0]

    def doubled(self, starts: np.ndarray) -> np.ndarray:
        return _joined(self.short[starts], self.short[starts + LEVELS[0]])

    def whole(self, starts: np.ndarray) -> np.ndarray:
        return _joined(self.doubled(starts), self.doubled(starts + WINDOW - LEVELS[1]))


def anchors_of(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Windows]:
    """Starts of the long windows of all rows, the anchor of each, the anchors' hashes by place, and the windows."""
    windows = Windows(words)
    n = len(words)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if n < WINDOW:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), windows)
    h = windows.short
    value, place, width, choices = h, np.arange(len(h)), 1, WINDOW - LEVELS[0] + 1
    while width < choices:  # the least of 1, 2, 4, ... and at last 27 places, leftmost first
        step = min(width, choices - width)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])
        width += step
    starts = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    return starts, place[starts], h, windows


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their words' hashes and the rows' offsets among them."""
    words, offsets = hashed_words(batch.column("text"))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 18), side="right")) - 1)
        yield i, min(j, n), words[offsets[i] : offsets[min(j, n)]], offsets[i : min(j, n) + 1] - offsets[i]
        i = min(j, n)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many rows have its keys, and whether it is the first of them."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1])
    new = np.ones(n, bool)
    for_all = np.ones(max(0, n - 1), bool)
    for k in keys:
        for_all &= k[order][1:] == k[order][:-1]
    new[1:] = ~for_all
    edges = np.append(np.flatnonzero(new), n)
    count, first = np.zeros(n, np.int64), np.zeros(n, bool)
    count[order] = np.repeat(np.diff(edges), np.diff(edges))
    first[order[new]] = True
    return count, first


def _ranges(name: np.ndarray, start: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (name, start, side) as (name, first start, how many follow each other, side)."""
    order = np.lexsort((start, side, name))
    name, start, side = name[order], start[order], side[order]
    new = np.ones(len(name), bool)
    same = (name[1:] == name[:-1]) & (side[1:] == side[:-1])
    new[1:] = ~(same & (start[1:] == start[:-1]))
    name, start, side = name[new], start[new], side[new]
    cut = np.ones(len(name), bool)
    cut[1:] = ~((name[1:] == name[:-1]) & (side[1:] == side[:-1]) & (start[1:] == start[:-1] + 1))
    first = np.flatnonzero(cut)
    return name[first], start[first], np.diff(np.append(first, len(name))).astype(np.int32), side[first]


class _Held:
    """What a task has found: keys and places, handed on in packed arrays by bucket of the anchor.

    Places whose keys another place of this task has are settled: they go on as ranges
    (kind 1), with one place without a name (start -1) to stand for them in their bucket.
    """

    NAMES = ["bucket", "kind", "keys", "rights", "lefts", "names", "starts", "counts", "sides"]
    SCHEMA = "bucket int, kind int, keys binary, rights binary, lefts binary, names binary, starts binary, counts binary, sides binary"

    def __init__(self, buckets: int, doubled: bool):
        self.buckets, self.doubled = buckets, doubled
        self.parts, self.rows, self.turn = [], 0, 0

    def add(self, anchors: np.ndarray, keys: np.ndarray, rights: np.ndarray, lefts: np.ndarray, names: np.ndarray, starts: np.ndarray) -> None:
        if len(keys):
            self.parts.append((anchors, keys, rights, lefts, names, starts))
            self.rows += len(keys)

    def take(self) -> pa.RecordBatch:
        out: list[tuple] = []
        if self.parts:
            anchors, keys, rights, lefts, names, starts = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            self.parts, self.rows = [], 0
            count, first = _groups(keys, rights, lefts)
            settled = count > 1
            sides = np.maximum((rights > 0).astype(np.uint8) | (lefts > 0).astype(np.uint8) << 1, 1)
            ranges = _ranges(names[settled], starts[settled], sides[settled])
            if len(ranges[0]):
                self.turn += 1
                out.append((hash((int(keys[0]), self.turn)) % self.buckets, 1, b"", b"", b"", *(c.tobytes() for c in ranges)))
            starts = np.where(settled, np.int32(-1), starts)
            go = np.flatnonzero(~settled | first)
            bucket = ((anchors[go] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int32)
            go = go[order := np.argsort(bucket, kind="stable")]
            bucket = bucket[order]
            for b in np.unique(bucket).tolist():
                i = go[np.searchsorted(bucket, b) : np.searchsorted(bucket, b, side="right")]
                out.append((b, 0, keys[i].tobytes(), *(c[i].tobytes() if self.doubled else b"" for c in (rights, lefts)), names[i].tobytes(), starts[i].tobytes(), b"", b""))
        columns = list(zip(*out, strict=True)) if out else [[]] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns[:2]] + [pa.array(c, pa.binary()) for c in columns[2:]], self.NAMES)


def _match(table: pa.Table, key_type) -> pa.Table:
    """``name, span`` of one bucket's places that stand elsewhere as well, a row for each run of places."""
    kind = np.array(table.column("kind").to_pylist())

    def column(name: str, want: int, of) -> np.ndarray:
        parts = [np.frombuffer(x, of) for x, k in zip(table.column(name).to_pylist(), kind, strict=True) if k == want]
        return np.concatenate([np.empty(0, of), *parts])

    keys, rights, lefts = column("keys", 0, key_type), column("rights", 0, np.uint32), column("lefts", 0, np.uint32)
    names, starts = column("names", 0, np.int64), column("starts", 0, np.int32)
    sides = np.zeros(len(keys), np.uint8)
    if not len(rights) and not len(lefts) and len(keys):
        sides[_groups(keys)[0] > 1] = 1
    for bit, doubled in ((1, rights), (2, lefts)):
        there = np.flatnonzero(doubled)
        if len(there):
            sides[there[_groups(keys[there], doubled[there])[0] > 1]] |= bit
    keep = (sides > 0) & (starts >= 0)
    ranges = _ranges(names[keep], starts[keep], sides[keep])
    known = [column("names", 1, np.int64), column("starts", 1, np.int32), column("counts", 1, np.int32), column("sides", 1, np.uint8)]
    name, start, n, side = (np.concatenate(c) for c in zip(ranges, known, strict=True))
    return pa.table([pa.array(name), pa.array(start.astype(np.int64) << 32 | n.astype(np.int64) << 2 | side)], names=["name", "span"])


def _places(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places, numbers of places that follow each other, and sides of packed runs."""
    return spans >> 32, spans >> 2 & ((1 << 30) - 1), spans & 3


FOUND = "name long, span long"


def _first_levels(rows: DataFrame, buckets: int) -> DataFrame:
    """Places whose 9 words, and the 18 to a side (1: right, 2: left), stand elsewhere as well."""
    short, double = LEVELS[0], LEVELS[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(buckets, True)
        for batch in batches:
            name = batch.column("name").to_numpy()
            for i, j, words, offsets in _batches(batch):
                starts, chosen, h, windows = anchors_of(words, offsets)
                places, at = np.unique(chosen, return_inverse=True)
                # some window has room for the doubled words to the right of the anchor, or to its left
                right, left = np.zeros(len(places), bool), np.zeros(len(places), bool)
                right_room = chosen - starts + double <= WINDOW
                right[at[right_room]], left[at[~right_room]] = True, True
                rights, lefts = np.zeros(len(places), np.uint32), np.zeros(len(places), np.uint32)
                rights[right] = windows.doubled(places[right]).astype(np.uint32) | np.uint32(1)
                lefts[left] = windows.doubled(places[left] - (double - short)).astype(np.uint32) | np.uint32(1)
                row = np.searchsorted(offsets, places, side="right") - 1
                held.add(h[places], h[places], rights, lefts, name[i:j][row], (places - offsets[row]).astype(np.int32))
            if held.rows >= HELD_ANCHORS:
                yield held.take()
        yield held.take()

    packed = rows.mapInArrow(scan, _Held.SCHEMA)
    return packed.groupBy("bucket").applyInArrow(lambda t: _match(t, np.uint64), FOUND)


def _last_level(candidates: DataFrame, buckets: int) -> DataFrame:
    """Long windows that stand elsewhere as well, from rows ``name, text, found``."""
    double = LEVELS[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(buckets, False)
        for batch in batches:
            name, found = batch.column("name").to_numpy(), batch.column("found").flatten().to_numpy()
            edges = np.concatenate([[0], np.cumsum(batch.column("found").value_lengths().to_numpy())])
            for i, j, words, offsets in _batches(batch):
                starts, chosen, h, windows = anchors_of(words, offsets)
                open_ = np.zeros((2, len(words)), bool)
                part = slice(edges[i], edges[j])
                first, n, sides = _places(found[part])
                first = first + np.repeat(offsets[:-1], np.diff(edges[i : j + 1]))
                places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                sides = np.repeat(sides, n)
                open_[0, places[sides & 1 > 0]] = True
                open_[1, places[sides & 2 > 0]] = True
                keep = np.where(chosen - starts + double <= WINDOW, open_[0, chosen], open_[1, chosen]) if len(starts) else np.empty(0, bool)
                starts, chosen = starts[keep], chosen[keep]
                row = np.searchsorted(offsets, starts, side="right") - 1
                none = np.zeros(len(starts), np.uint32)  # the window itself is the key
                held.add(h[chosen], windows.whole(starts), none, none, name[i:j][row], (starts - offsets[row]).astype(np.int32))
            if held.rows >= HELD_ANCHORS:
                yield held.take()
        yield held.take()

    return candidates.mapInArrow(scan, _Held.SCHEMA).groupBy("bucket").applyInArrow(lambda t: _match(t, np.uint64), FOUND)


def _stretches(again: DataFrame) -> DataFrame:
    """Of each name: ``__gaps`` (at, n), the words that stay before the last window that goes, in order; ``__end`` of that one; ``__gone`` words."""
    first, n = F.shiftright("span", 32), F.shiftright("span", 2).bitwiseAND(F.lit((1 << 30) - 1))
    spans = again.select(F.col("name").alias("__name"), first.cast("int").alias("at"), (first + n - 1 + WINDOW).cast("int").alias("end"))
    spans = spans.groupBy("__name", "at").agg(F.max("end").alias("end"))
    before = Window.partitionBy("__name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("so_far", F.coalesce(F.max("end").over(before), F.lit(0)))
    gap = F.when(F.col("at") > F.col("so_far"), F.struct(F.col("so_far").alias("at"), (F.col("at") - F.col("so_far")).alias("n")))
    gone = F.greatest(F.col("end") - F.greatest("at", "so_far"), F.lit(0))
    return spans.groupBy("__name").agg(F.array_sort(F.collect_list(gap)).alias("__gaps"), F.max("end").alias("__end"), F.sum(gone).alias("__gone"))


def removed(docs: DataFrame, results: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """``docs`` with three ``results``: words, words removed, and what is kept with one space between words."""
    scratch = Scratch(docs.sparkSession, "substring")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in {*map(str.lower, results), "__name", "__gaps", "__end", "__gone", "__flat", "__total", "__stays"}])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // BYTES_A_WORD * 2 // (WINDOW - LEVELS[0] + 2) // BUCKET_ANCHORS + 1
    named = docs.withColumn("__name", F.xxhash64("doc_id", text))
    thin = named.select(F.col("__name").alias("name"), text.alias("text"))

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // JOIN_BYTES)

    found = scratch.write(_first_levels(thin, buckets), "found")
    by_name = found.groupBy("name").agg(F.collect_set("span").alias("found"))
    candidates = thin.repartition(tasks, "name").join(by_name, "name").select("name", "text", "found")
    again = scratch.write(_last_level(candidates, 3 * buckets), "again")
    scratch.drop("found")
    clear, rest = split_by(named, F.col("__name"), again.select("name"))
    cut = _stretches(again)
    more = [F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in cut.columns[1:]]
    joined = clear.select("*", *more).unionByName(rest.repartition(tasks, "__name").join(cut, "__name", "left"))

    flat = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    # an array of one, so that the lambda's variable holds the words: they are split once, not for each stretch
    parts = F.transform(F.array(F.split("__flat", " ")), lambda words: F.array_join(F.transform("__stays", lambda s: F.array_join(F.slice(words, s["at"] + 1, s["n"]), " ")), " "))[0]
    total = F.when(F.col("__flat") == "", 0).otherwise(F.octet_length("__flat") - F.octet_length(F.replace(F.col("__flat"), F.lit(" "), F.lit(""))) + 1).cast("long")
    n_words, n_removed, kept = results
    counted = joined.withColumn("__flat", flat).withColumn("__total", total)
    # what stands behind the last window that goes
    stays = F.when(F.col("__end") < F.col("__total"), F.concat("__gaps", F.array(F.struct(F.col("__end").alias("at"), (F.col("__total") - F.col("__end")).cast("int").alias("n"))))).otherwise(F.col("__gaps"))
    whole = counted.withColumn("__stays", stays)
    return whole.select(*docs.columns, F.col("__total").alias(n_words), F.coalesce("__gone", F.lit(0)).cast("long").alias(n_removed), F.when(F.col("__end").isNull(), F.col("__flat")).otherwise(parts).alias(kept))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    kept = removed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
