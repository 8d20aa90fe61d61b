"""Hashes of byte spans (words, units) of many texts at once, and a table of what is known of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer text is hashed whole.
PART = 1 << 20

#: [\x20\x09-\x0D]
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit values (splitmix64)."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1009)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: The first n bytes of a little-endian block of 8.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = random_words(4, 3)
#: Spans longer than this are hashed by BLAKE2.
LONG = 256


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def parts_of(offsets: np.ndarray):
    """Runs of rows of about PART bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def span_hash_pairs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of ``raw``, independent of each other.

    Blocks of 8 bytes are mixed in one after another, so no linear relation of bytes carries
    over; long spans take the halves of a BLAKE2 digest.
    """
    size = ends - starts
    first = mix(size.astype(np.uint64) * _ODD[0])
    second = mix(size.astype(np.uint64) * _ODD[1])
    blocks = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))
    live = np.flatnonzero(size <= LONG)
    at, left, x, y = starts[live], size[live], first[live], second[live]
    while len(live):
        block = blocks[at] & _FIRST[np.minimum(left, 8)]
        x, y = mix(x ^ block), mix(y + block * _ODD[2])
        go = left > 8
        if not go.all():
            over = ~go
            first[live[over]], second[live[over]] = x[over], y[over]
            live, at, left, x, y = live[go], at[go], left[go], x[go], y[go]
        at, left = at + 8, left - 8
    for i in np.flatnonzero(size > LONG).tolist():
        first[i], second[i] = np.frombuffer(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=16).digest(), np.uint64)
    return first, second


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``raw``."""
    return span_hash_pairs(raw, starts, ends)[0]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of rows laid end to end; a row's end ends a word."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~BLANK[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashed_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every row in turn (A-Z as a-z if ``lower``), and the n + 1 offsets of the rows among them."""
    raw, offsets = text_bytes(column)
    hashes, counts = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in parts_of(offsets):
        part, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = words_of(part, rows)
        hashes.append(span_hashes(LOWER[part] if lower else part, starts, ends))
        counts.append(np.diff(np.searchsorted(starts, rows)))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


class SpanTable:
    """What ``learn`` found for each distinct span, kept until ``most`` spans are known.

    A span is looked up by one hash and told apart by a second one, 127 bits in all. ``learn``
    takes a list of spans as bytes and returns, for each of its pools, one flat array and the
    n + 1 starts of the spans in it.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], most: int = 1_000_000):
        self.learn, self.most, self.bits = learn, most, 17
        self.clear()

    def clear(self) -> None:
        self._make()
        self.known = 0
        self.pools: list[list] = []  # [array, filled, starts, sizes]

    def _make(self) -> None:
        self.keys, self.checks = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Entry numbers; -1 where unknown."""
        out = np.full(len(keys), -1, np.int32)
        slots = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slots]
            hit = (there == keys[open_]) & (self.checks[slots] == checks[open_])
            out[open_[hit]] = self.entry[slots[hit]]
            go = ~hit & (there != 0)
            open_, slots = open_[go], (slots[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, keys: np.ndarray, checks: np.ndarray, entries: np.ndarray) -> None:
        slots = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            free = np.flatnonzero(self.keys[slots] == 0)
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.checks[slots[put]], self.entry[slots[put]] = keys[open_[put]], checks[open_[put]], entries[open_[put]]
            go = np.ones(len(open_), bool)
            go[put] = False
            open_, slots = open_[go], (slots[go] + 1) & ((1 << self.bits) - 1)

    def entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every span; unknown ones are learnt first."""
        keys, checks = span_hash_pairs(raw, starts, ends)
        keys |= np.uint64(1)
        found = self._find(keys, checks)
        miss = np.flatnonzero(found < 0)
        if not len(miss):
            return found
        at = miss[np.lexsort((checks[miss], keys[miss]))]
        new = np.ones(len(at), bool)
        new[1:] = (keys[at[1:]] != keys[at[:-1]]) | (checks[at[1:]] != checks[at[:-1]])
        at = at[new]
        if self.known and self.known + len(at) > self.most:
            self.clear()
            return self.entries(raw, starts, ends)
        if 2 * (self.known + len(at)) > 1 << self.bits:
            used = np.flatnonzero(self.keys)
            old = self.keys[used], self.checks[used], self.entry[used]
            self.bits = int(3 * (self.known + len(at))).bit_length()
            self._make()
            self._insert(*old)
        text = raw.tobytes()
        self._add(self.learn([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        self._insert(keys[at], checks[at], np.arange(self.known, self.known + len(at), dtype=np.int32))
        self.known += len(at)
        found[miss] = self._find(keys[miss], checks[miss])
        return found

    def _add(self, learnt: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if not self.pools:
            self.pools = [[np.empty(1 << 16, flat.dtype), 0, np.empty(0, np.int64), np.empty(0, np.int64)] for flat, _ in learnt]
        for pool, (flat, starts) in zip(self.pools, learnt, strict=True):
            need = pool[1] + len(flat)
            if need > len(pool[0]):
                pool[0] = np.concatenate([pool[0], np.empty(max(need, 2 * len(pool[0])) - len(pool[0]), pool[0].dtype)])
            pool[0][pool[1] : need] = flat
            pool[2] = np.concatenate([pool[2], pool[1] + starts[:-1]])
            pool[3] = np.concatenate([pool[3], np.diff(starts)])
            pool[1] = need

    def gather(self, pool: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the entries end to end, and the n + 1 starts."""
        if not len(entries):
            return np.empty(0, np.uint8 if not self.pools else self.pools[pool][0].dtype), np.zeros(1, np.int64)
        values, _, at, sizes = self.pools[pool]
        each = sizes[entries]
        starts = np.concatenate([[0], np.cumsum(each)])
        return values[np.repeat(at[entries] - starts[:-1], each) + np.arange(starts[-1])], starts
