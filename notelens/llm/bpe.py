"""Byte-pair encoding over many words at once, from a ``tokenizers`` JSON file.

The merge loop is vectorised: words of equal width form a matrix, each round merges the
lowest-ranked adjacent pair of every row, so rows shrink by exactly one column a round and
join the words that were one symbol shorter from the start.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex

#: Words of more symbols than this are merged one by one with a heap.
WIDE = 160
_NONE = np.int32(2**31 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)

#: Text outside this range, and texts with a special token's opening, go through the library itself.
UNUSUAL = regex.compile(r"[^\x00-\x1b\x20-ɏ]|<\|")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


class PairTable:
    """Hash levels from a pair of ids to its merge's rank; pairs that clash in one level go to the next."""

    def __init__(self, left: np.ndarray, right: np.ndarray, width: int):
        self.width = np.int64(width)
        keys, ranks = left.astype(np.int64) * width + right, np.arange(len(left), dtype=np.int32)
        self.levels = []
        bits = max(4, int(np.ceil(np.log2(max(2, len(keys))))) + 2)
        while len(keys):
            shift = np.uint64(64 - bits)
            slots = self._slot(keys, shift)
            _, first = np.unique(slots, return_index=True)
            table, value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
            table[slots[first]], value[slots[first]] = keys[first], ranks[first]
            self.levels.append((shift, table, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, bits = keys[rest], ranks[rest], max(4, bits - 2)

    @staticmethod
    def _slot(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        out = np.full(keys.shape, _NONE, np.int32)
        for shift, table, value in self.levels:
            slots = self._slot(keys, shift)
            hit = table[slots] == keys
            out[hit] = value[slots[hit]]
        return out


class Bpe:
    """Vocabulary and merges of one file. Encodes pre-split words given as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = PairTable(left, right, max(vocab.values()) + 1)
        self.rank_of = {(a, b): r for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        letters = byte_alphabet()
        self.symbol = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32) if suffix else self.symbol
        if not suffix:
            back = {c: b for b, c in enumerate(letters)}
            self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items() if all(c in back for c in token)}

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, merged exactly as the library merges, and where each word's begin."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        short = np.flatnonzero((sizes > 0) & (sizes <= WIDE))
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            raw = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
            found += [(part[rows], grid) for rows, grid in self._merge(raw, sizes[part])]
        found += [(np.array([i]), self._merge_wide(words[i])[None, :]) for i in np.flatnonzero(sizes > WIDE)]
        for rows, grid in found:
            counts[rows] = grid.shape[1]
        starts = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(int(starts[-1]), np.int32)
        for rows, grid in found:
            flat[starts[rows][:, None] + np.arange(grid.shape[1])] = grid
        return flat, starts

    def _merge(self, raw: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Groups of finished words of one width: their numbers, and a matrix of their ids."""
        ends = np.cumsum(sizes)
        flat = self.symbol[raw]
        flat[ends - 1] = self.last[raw[ends - 1]]
        starts = ends - sizes
        by_width = np.argsort(sizes, kind="stable")
        edges = np.searchsorted(sizes[by_width], np.arange(int(sizes.max()) + 2))
        rows = np.empty(0, np.int64)
        grid = np.empty((0, int(sizes.max())), np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for width in range(int(sizes.max()), 0, -1):
            new = by_width[edges[width] : edges[width + 1]]
            if len(new):
                rows = np.concatenate([rows, new])
                grid = np.concatenate([grid, flat[starts[new][:, None] + np.arange(width)]])
            if width == 1:
                done.append((rows, grid))
                break
            if not len(rows):
                grid = np.empty((0, width - 1), np.int32)
                continue
            ranks = self.pairs.ranks(grid[:, :-1], grid[:, 1:])
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            go = best != _NONE
            done.append((rows[~go], grid[~go]))
            rows, at, best, grid = rows[go], at[go], best[go], grid[go]
            columns = np.arange(width - 1)
            grid = np.take_along_axis(grid, columns + (columns > at[:, None]), axis=1)
            grid[np.arange(len(rows)), at] = self.made[best]
        return done

    def _merge_wide(self, word: bytes) -> np.ndarray:
        ids = self.symbol[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (s := self.rank_of.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)
