"""Runs of words as 64-bit hashes, made in batches; and what is counted over equal runs, in order of their hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from notelens.functions.scratch import sliced
from notelens.functions.terms import term_hashes, word_runs
from notelens.functions.text import COPY_FOLD_FROM, COPY_FOLD_TO

#: Words of the duplicate analysis, what stands between them, and how their letters fold.
WORD, NO_WORD, COPY_FOLDS = re.compile(r"[^\W_]+"), r"[^\pL\pN]+", str.maketrans(COPY_FOLD_FROM, COPY_FOLD_TO)
#: Rows in which equal runs are looked for at once.
ROWS_AT_ONCE = 1 << 19


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, which depends on their order and isn't linear in them."""
    with np.errstate(over="ignore"):
        x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def of_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has."""
    coded = words.flatten().dictionary_encode()
    return term_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)], np.diff(words.offsets.to_numpy())


def of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts' words, each distinct one folded once."""
    words = word_runs(texts, WORD, NO_WORD)
    coded = words.flatten().dictionary_encode()
    folded = [w.translate(COPY_FOLDS).lower() for w in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    there = (np.fromiter(map(len, folded), np.int64, len(folded)) > 0)[code]
    place = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    return term_hashes(folded)[code[there]], np.bincount(place[there], minlength=len(texts))


def runs(h: np.ndarray, size: np.ndarray, n: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct run of ``n`` words of texts with ``least`` words, in order; runs are hashed from shorter ones."""
    length = 1
    while length < n and len(h):
        step = min(length, n - length)
        h, length = mixed(h[:-step], h[step:]), length + step
    n_runs = np.where(size >= least, np.maximum(size - n + 1, 0), 0)
    place = np.repeat(np.arange(len(size)), n_runs)
    first = np.repeat(np.cumsum(size) - size, n_runs) + np.arange(len(place)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    h = h[first]
    order = np.lexsort((h, place))
    place, h = place[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (place[1:] != place[:-1]) | (h[1:] != h[:-1])
    return place[new], h[new]


def equal_runs(batches: Iterator[pa.RecordBatch], count: Callable[..., dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """What ``count`` makes of rows ``h, id, n`` that come in order of ``h``, some runs at once and each whole.

    It gets the rows in order of h and id, each pair once, with where their runs begin and how many rows these have.
    """

    def counted(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, id_, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((id_, h))
        h, id_, n = h[order], id_[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (id_[1:] != id_[:-1])
        h, id_, n = h[new], id_[new], n[new]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        made = count(id_, n, begin, np.diff(np.append(begin, len(h))))
        yield pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in made.items()})

    held, rows = [], 0
    for batch in batches:
        if not len(batch):
            continue
        h, id_, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if rows >= ROWS_AT_ONCE and (cut := int(np.searchsorted(h, held[-1][0][-1], "right"))) < len(h):
            yield from counted([*held, (h[:cut], id_[:cut], n[:cut])])
            held, rows, h, id_, n = [], 0, h[cut:], id_[cut:], n[cut:]
        held.append((h, id_, n))
        rows += len(h)
    if held:
        yield from counted(held)


def pairs_of_runs(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``x, y, nx, ny, shared``: pairs of the owners of runs that 2 to ``most`` have."""

    def count(id_: np.ndarray, n: np.ndarray, begin: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(2, most + 1):
            at = begin[size == s]
            if len(at):
                i, j = np.triu_indices(s, 1)
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
        left, right = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((id_[right], id_[left]))
        left, right = left[order], right[order]
        x, y = id_[left], id_[right]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, np.int64)
        return {"x": x[first], "y": y[first], "nx": n[left[first]], "ny": n[right[first]], "shared": np.diff(np.append(first, len(x)))}

    return lambda batches: equal_runs(batches, count)


def held_by_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, n, held``: how many of an owner's runs others have as well."""

    def count(id_: np.ndarray, n: np.ndarray, begin: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
        several = np.repeat(size > 1, size)
        ids, first, times = np.unique(id_[several], return_index=True, return_counts=True)
        return {"id": ids, "n": n[several][first], "held": times}

    return equal_runs(batches, count)


def run_rows(n: int, least: int, words_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], grouped: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``path, n, h`` from ``path`` and words or text; or ``h, id, n`` from ``id, group, text``, where equal runs of different groups differ."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            place, h = runs(*words_of(batch.column(batch.num_columns - 1)), n, least)
            size = pa.array(np.bincount(place, minlength=len(batch)).astype(np.int32)[place])
            owner = batch.column(0).take(pa.array(place))
            if grouped:
                yield pa.RecordBatch.from_arrays([pa.array(mixed(h, batch.column(1).to_numpy(zero_copy_only=False)[place])), owner, size], names=["h", "id", "n"])
            else:
                yield pa.RecordBatch.from_arrays([owner, size, pa.array(h)], names=["path", "n", "h"])

    return make


def run_sets(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``path, s`` from ``path, words``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            place, h = runs(*of_words(batch.column(1)), n)
            offsets = pa.array(np.searchsorted(place, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(h))], names=["path", "s"])

    return make
