"""The best texts of many queries, scored in blocks by posting lists in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts and postings of one block at most.
BLOCK_TEXTS, BLOCK_POSTINGS = 1 << 15, 1 << 22
#: Queries with fewer postings in a block are scored as they are.
FEW_POSTINGS = 2000
#: More than the rounding of scores and the order of summation can make up.
SLACK = 1e-6


@dataclass
class Queries:
    """Query ``numbers``; the terms of the i-th stand in ``terms[offsets[i]:offsets[i + 1]]``, at least one."""

    numbers: np.ndarray
    offsets: np.ndarray
    terms: np.ndarray


class Block:
    """Posting lists of some texts: positions of texts and weights, by term."""

    def __init__(self, n_texts: int, place: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.n_texts, self.texts, self.weights = n_texts, place[order].astype(np.int32), weight[order]
        size = np.bincount(term, minlength=n_terms)
        self.end = np.cumsum(size)
        self.start, self.size = self.end - size, size
        self.top = np.zeros(n_terms)
        there = np.flatnonzero(size)
        if len(there):
            self.top[there] = np.maximum.reduceat(self.weights, self.start[there])

    def _summed(self, terms: np.ndarray) -> np.ndarray:
        spans = list(zip(self.start[terms].tolist(), self.end[terms].tolist(), strict=True))
        return np.bincount(np.concatenate([self.texts[a:b] for a, b in spans]), np.concatenate([self.weights[a:b] for a, b in spans]), self.n_texts)

    def reaching(self, terms: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and sums of weights, of all texts that have ``bar`` or more and of some others.

        Terms are taken heaviest first; texts that have only terms which together stay below the bar are left out,
        and those terms are looked up for what is left, as long as it is few.
        """
        terms = terms[self.size[terms] > 0]
        n = self.size[terms]
        m = len(terms)
        if bar > 0 and n.sum() > FEW_POSTINGS:
            order = np.argsort(-self.top[terms], kind="stable")
            terms, n = terms[order], n[order]
            rest = np.append(np.cumsum(self.top[terms][::-1])[::-1], 0.0)  # what terms from here on can add
            m = int((rest[:-1] >= bar).sum())
            if n[m:].sum() * 2 < n.sum():
                m = len(terms)
        if m == 0:
            return np.empty(0, np.int64), np.empty(0)
        if m == len(terms):
            total = self._summed(terms)
            found = np.flatnonzero(total >= bar if bar > 0 else total > 0)
            return found, total[found]
        total = self._summed(terms[:m])
        found = np.flatnonzero(total >= bar - rest[m])
        total = total[found]
        for i in range(m, len(terms)):
            if not len(found):
                break
            a, b = self.start[terms[i]], self.end[terms[i]]
            at = np.minimum(np.searchsorted(self.texts[a:b], found), b - a - 1) + a
            total = total + np.where(self.texts[at] == found, self.weights[at], 0.0)
            keep = total >= bar - rest[i + 1]
            if not keep.all():
                found, total = found[keep], total[keep]
        return found, total


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of ``dl, terms, tf, keys`` that are not too large, ordered by the keys."""

    def table(held: list[pa.RecordBatch]) -> pa.Table:
        all_ = pa.Table.from_batches(held).combine_chunks()
        names = all_.column_names[3:]
        return all_.take(pc.sort_indices(all_.select(names), [(n, "ascending") for n in names])) if len(all_) else all_

    held, texts, posted = [], 0, 0
    for batch in batches:
        n = len(batch.column(1).flatten())
        if held and (texts + len(batch) > BLOCK_TEXTS or posted + n > BLOCK_POSTINGS):
            yield table(held)
            held, texts, posted = [], 0, 0
        held, texts, posted = [*held, batch], texts + len(batch), posted + n
    if held:
        yield table(held)


def best_of_blocks(shared, names: list[str], k: int, k1: float, b: float, places: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``dl, terms, tf, keys`` to ``number, keys, score`` of what reaches the task's best ``k`` of each query so far.

    ``shared`` holds the queries, each term's idf and the mean length. Of texts of one score a block hands on those of the least keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf, avgdl = shared.value
        if k < 1 or not len(asked.numbers):
            return
        best = np.zeros((len(asked.numbers), k))  # scores of 0 and less don't count
        first = asked.offsets[:-1]
        for table in blocks(batches):
            if not len(table):
                continue
            lists = table.column(1).combine_chunks()
            term = lists.flatten().to_numpy(zero_copy_only=False)
            place = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
            tf = table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            dl = table.column(0).to_numpy().astype(np.float64)[place]
            block = Block(len(table), place, term, idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), len(idf))
            del place, term, tf, dl
            most = np.add.reduceat(block.top[asked.terms], first)
            live = np.flatnonzero((most > 0) & (most >= best[:, -1] - SLACK))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for q in live.tolist():
                bar = best[q, -1]
                found, score = block.reaching(asked.terms[first[q] : asked.offsets[q + 1]], bar - SLACK)
                if not len(found):
                    continue
                score = np.round(score, places)
                low = bar
                if len(found) > k:
                    low = max(bar, np.partition(score, len(score) - k)[len(score) - k])
                keep = score >= low if low > 0 else score > 0
                found, score = found[keep], score[keep]
                if not len(found):
                    continue
                if len(found) > k:  # ties with the k-th: the least keys stay, texts are in their order
                    chosen = np.sort(np.argsort(-score, kind="stable")[:k])
                    found, score = found[chosen], score[chosen]
                out.append((np.full(len(found), q), found, score))
                best[q] = np.sort(np.concatenate([best[q], score]))[::-1][:k]
            if out:
                which, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
                at = pa.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(asked.numbers[which]), *(table.column(i).combine_chunks().take(at) for i in range(3, table.num_columns)), pa.array(score)], names=names)

    return run
