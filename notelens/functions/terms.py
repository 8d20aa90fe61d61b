"""Search tokens of whole Arrow batches: each distinct run of word characters is folded once."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from notelens.functions.text import APOSTROPHES, LATIN, RUN, SUFFIX_RUN, tokens_of_run

#: Distinct runs that a worker remembers.
REMEMBERED = 200_000
_SUFFIX, _BREAK, _BEYOND = rf"[{APOSTROPHES}][\pL\pN_]*", r"[^\pL\pN_]+", rf"[^\x00-\x{{{LATIN:x}}}]"


class Memo(dict):
    """What a function makes of a value, forgotten when there are too many."""

    def __init__(self, make: Callable = tokens_of_run, most: int = REMEMBERED):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(key)
        return out


def term_hashes(terms: list[str]) -> np.ndarray:
    """64-bit hashes (SipHash) of strings."""
    return pd.util.hash_array(np.array(terms, object), categorize=False).view(np.int64) if terms else np.zeros(0, np.int64)


def word_runs(texts: pa.Array, run: re.Pattern, between: str) -> pa.ListArray:
    """Runs of each text; Python splits where letters go beyond Latin, as Arrow may know others."""
    if pc.any(pc.match_substring_regex(texts, _BEYOND)).as_py():
        return pa.array([run.findall(t) if t is not None else None for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.split_pattern_regex(texts, between)


def runs_of(texts: pa.Array) -> pa.ListArray:
    """Runs of word characters of each text without what follows an apostrophe."""
    if pc.any(pc.match_substring_regex(texts, _BEYOND)).as_py():
        texts = pa.array([SUFFIX_RUN.sub("", t) if t is not None else None for t in texts.to_pylist()], pa.string())
    else:
        texts = pc.replace_substring_regex(texts, _SUFFIX, "")
    return word_runs(texts, RUN, _BREAK)


def expanded(texts: pa.Array, memo: Memo) -> tuple[np.ndarray, list, np.ndarray]:
    """For each token its text's place and its place in a list of tokens, which may have equal ones; and that list."""
    runs = runs_of(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    place = pc.list_parent_indices(runs).to_numpy(zero_copy_only=False)
    coded = runs.flatten().dictionary_encode()
    made = [memo[run] for run in coded.dictionary.to_pylist()]
    size = np.fromiter(map(len, made), np.int64, len(made))
    first = np.cumsum(size) - size
    which = coded.indices.to_numpy(zero_copy_only=False)
    n = size[which]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(place, n), list(chain.from_iterable(made)), np.repeat(first[which], n) + within


def counted(place: np.ndarray, code: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of text and code in order, and how often each occurs."""
    pairs, times = np.unique(place.astype(np.int64) * max(n_codes, 1) + code, return_counts=True)
    return *np.divmod(pairs, max(n_codes, 1)), times


def offsets_of(place: np.ndarray, n: int) -> pa.Array:
    """Offsets of a list column whose values stand in order of ``place``."""
    return pa.array(np.searchsorted(place, np.arange(n + 1)).astype(np.int32))


def bags(texts: pa.Array, memo: Memo) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of tokens; the distinct terms; and text, term's place and times of each pair."""
    place, terms, code = expanded(texts, memo)
    coded = pa.array(terms, pa.string()).dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    dl = np.bincount(place, minlength=len(texts))
    return dl, coded.dictionary, *counted(place, of[code], len(coded.dictionary))


def hashed_bags(texts: pa.Array, memo: Memo, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of tokens; and text, place in ``wanted`` (ordered hashes) and times of each wanted term."""
    place, terms, code = expanded(texts, memo)
    dl = np.bincount(place, minlength=len(texts))
    h = term_hashes(terms)
    at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
    asked = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
    keep = asked[code]
    return dl, *counted(place[keep], at[code[keep]], len(wanted))
