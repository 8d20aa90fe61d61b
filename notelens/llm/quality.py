"""Quality scores by nearest-neighbour voting in a latent semantic space.

A text's terms are its words, their shapes (letter case, digits and marks, repeats of a class
as one) and words said again at once, hashed into a fixed number of columns and weighted by their frequency in the
text and their rarity over all documents. The space is the leading right singular vectors of
the labelled rows that the classifier is fitted on. Labelled vectors, bounded in number, are
broadcast; each batch of documents is one block product with them, every cosine computed
exactly in double precision, and the nearest vote with their similarity as weight.

Defined results: null and empty texts have no terms and get the share of label 1 among the
fitted rows; ties between neighbours go to the row that was fitted first (by hash of the id,
then id); without labelled rows every score is 0.5; a row labelled more than once takes part
with each label; of rows that repeat an id one is learnt from (the least hash of the text); a
label other than 0 and 1 is an error; repeated rows are scored each; an empty table gives no
rows; extra columns are passed through by ``score`` and play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.scratch import sliced
from notelens.llm.spans import LOWER, parts_of, span_hashes, text_bytes, words_of

#: Columns for words, and as many for shapes.
WIDTH = 1 << 12
#: Labelled rows that the classifier is fitted on, at most; a documented bound.
FITTED = 4_000
#: Dimensions of the latent space; neighbours that vote; the power of similarity they vote with.
LATENT, NEIGHBOURS, SHARPNESS = 64, 15, 8
#: Weight of the shapes' block beside the words'.
SHAPES = 3.0

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = 0x30
_CLASS[0x41:0x5B] = 0x41
_CLASS[0x61:0x7B] = 0x61
_CLASS[0x80:] = 0x61


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and counts of the terms of a batch of texts."""
    raw, offsets = text_bytes(column)
    keys = [np.empty(0, np.int64)]
    for i, j in parts_of(offsets):
        part, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = words_of(part, rows)
        if not len(starts):
            continue
        row = np.searchsorted(rows, starts, side="right") - 1 + i
        word_hash = span_hashes(LOWER[part], starts, ends)
        word = word_hash >> np.uint64(52)
        shape = _CLASS[part]
        keep = np.ones(len(shape), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[starts] = True
        kept = np.cumsum(keep)  # places among what is kept
        shape = span_hashes(shape[keep], kept[starts] - 1, kept[ends - 1]) >> np.uint64(52)
        again = np.flatnonzero((word_hash[1:] == word_hash[:-1]) & (row[1:] == row[:-1]))
        keys.append(row[again] * (2 * WIDTH) + WIDTH)
        keys += [row * (2 * WIDTH) + word.astype(np.int64), row * (2 * WIDTH) + WIDTH + shape.astype(np.int64)]
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // (2 * WIDTH), key % (2 * WIDTH), count


def _sparse(column: pa.Array, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and weights of a batch, each block of a row of unit length."""
    return _weights(len(column), *term_counts(column), rarity)


def _weights(n: int, row: np.ndarray, term: np.ndarray, count: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    weight = (1 + np.log(count)) * rarity[term]
    block = row * 2 + (term >= WIDTH)
    length = np.sqrt(np.bincount(block, weight**2, 2 * n))
    weight *= np.where(term >= WIDTH, SHAPES, 1.0) / np.maximum(length[block], 1e-12)
    return row, term, weight.astype(np.float32)


def _dense(n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.zeros((n, 2 * WIDTH), np.float32)
    out[row, term] = weight
    return out


def weighted(column: pa.Array, rarity: np.ndarray) -> np.ndarray:
    """The weighted term vectors of a batch (zero for texts without terms)."""
    return _dense(len(column), *_sparse(column, rarity))


def latent(vectors: np.ndarray, space: np.ndarray) -> np.ndarray:
    out = vectors.astype(np.float64) @ space
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest; cosines in one block product."""
    cosines = vectors @ known.T
    k = min(NEIGHBOURS, known.shape[0])
    least = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, -k][:, None]
    above, level = cosines > least, cosines == least
    # of those level with the last, the first ones fill what is left
    chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    weight = np.where(chosen, np.maximum(cosines, 1e-9) ** SHARPNESS, 0.0)
    return (weight @ labels) / weight.sum(axis=1)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents in all; a fixed number of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(2 * WIDTH, np.int64), 0
        for batch in sliced(batches):
            _, term, _ = term_counts(batch.column("text"))
            total += np.bincount(term, minlength=2 * WIDTH)
            n += len(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["term", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 * WIDTH, np.int64)
    for r in found:
        if r["term"] >= 0:
            out[r["term"]] = r["n"]
    return out, next((r["n"] for r in found if r["term"] < 0), 0)


class Classifier:
    """What is broadcast: rarities, the space, and the labelled vectors.

    ``terms`` has, for each row that is learnt from, its terms and how often it has them.
    """

    def __init__(self, rarity: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray]], labels: list[int]):
        self.rarity, self.labels = rarity, np.array(labels, np.float64)
        if not terms:
            self.space, self.known = np.zeros((2 * WIDTH, 1)), np.zeros((0, 1))
            return
        # rows are made dense a few hundred at a time, so the driver never holds the whole matrix
        parts = []
        for i in range(0, len(terms), 256):
            some = terms[i : i + 256]
            row = np.repeat(np.arange(len(some)), [len(t) for t, _ in some])
            term, count = (np.concatenate(c).astype(np.int64) for c in zip(*some, strict=True))
            parts.append((len(some), *_weights(len(some), row, term, count, rarity)))
        self.space = _singular(parts, len(terms), min(LATENT, len(terms)))
        self.known = np.concatenate([latent(_dense(*p), self.space) for p in parts])

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(column), 0.5)
        vectors = weighted(column, self.rarity)
        out = np.full(len(column), self.labels.mean())
        some = np.flatnonzero(vectors.any(axis=1))
        for i in range(0, len(some), 256):
            part = some[i : i + 256]
            out[part] = vote(latent(vectors[part], self.space), self.known, self.labels)
        return np.clip(out, 0.0, 1.0)


def _singular(parts: list[tuple], n: int, k: int) -> np.ndarray:
    """Leading right singular vectors of the rows in ``parts``, by a seeded random range and two power steps."""

    def times(right: np.ndarray) -> np.ndarray:
        return np.concatenate([_dense(*p) @ right for p in parts])

    def turned(left: np.ndarray) -> np.ndarray:
        out, at = np.zeros((2 * WIDTH, left.shape[1]), np.float32), 0
        for p in parts:
            out += _dense(*p).T @ left[at : at + p[0]]
            at += p[0]
        return out

    base = np.linalg.qr(times(np.random.default_rng(7).standard_normal((2 * WIDTH, min(k + 16, n)), np.float32)))[0]
    for _ in range(2):
        base = np.linalg.qr(times(np.linalg.qr(turned(base))[0]))[0]
    return np.linalg.svd(turned(base).T, full_matrices=False)[2][:k].T.astype(np.float64).copy()


def fit(docs: DataFrame, labels: DataFrame, bound: int = FITTED) -> Classifier:
    """Fitted on at most ``bound`` rows of ``docs`` that ``labels`` (doc_id, label) covers, chosen by hash of the id.

    Half the bound goes to either label as far as there are rows, the rest to the other. Only
    term counts reach the driver, at most one for each column of each row.
    """
    counts, n = document_frequencies(docs)
    rarity = np.log((1 + n) / (1 + counts)) + 1
    ids = labels.filter("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sizes = {r["label"]: r["count"] for r in ids.groupBy("label").count().orderBy("label").limit(3).collect()}
    if not set(sizes) <= {0, 1}:
        raise ValueError(f"labels must be 0 or 1, found {sorted(sizes)}")
    few = min(sizes.values(), default=0)
    parts = [ids.filter(F.col("label") == x).orderBy(*order).limit(min(c, max(bound // 2, bound - few))) for x, c in sorted(sizes.items())]
    if not parts:
        return Classifier(rarity, [], [])
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `bound` ids
    one = found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, term, n_ = term_counts(batch.column("text"))
            edges = np.searchsorted(row, np.arange(len(batch) + 1)).tolist()
            packed = [pa.array([v[i:j].astype("<i4").tobytes() for i, j in zip(edges, edges[1:], strict=False)], pa.binary()) for v in (term, n_)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *packed], ["doc_id", "label", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = one.mapInArrow(count, f"doc_id {kind}, label int, terms binary, counts binary").orderBy(*order, "label").collect()
    return Classifier(rarity, [tuple(np.frombuffer(r[c], "<i4") for c in ("terms", "counts")) for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, classifier: Classifier, result: str = "score") -> DataFrame:
    """``docs`` with a column of scores (an input column of that name gives way)."""
    names = [c for c in docs.columns if c.lower() != result.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(texts))], [*names, result])

    kept = docs.select(*names)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(result, T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
