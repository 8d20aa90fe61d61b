"""A minimal acyclic automaton from words to their ids, as flat arrays that can be memory-mapped.

States that accept the same rest of words are one state (sorted words, suffixes shared by a
register). Each state knows how many words end at or below it, so the words passed on the
way to a word give its number in sorted order: that number is the transducer's output, and
leads to the word's ids.
"""

from __future__ import annotations

import numpy as np

_ENTRY = [("states", "<i8"), ("arcs", "<i8"), ("words", "<i8"), ("ids", "<i8"), ("root", "<i8")]


def compile_words(words: dict[bytes, list[int]]) -> bytes:
    """The automaton of ``words`` with their ids."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple((b, child) for b, child in node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # [accepts, [(byte, settled child)]] from the root to the last word's end
    letters: list[int] = []
    ordered = sorted(words)
    for word in [*ordered, None]:
        common = 0
        if word is not None:
            while common < min(len(word), len(letters)) and word[common] == letters[common]:
                common += 1
        while len(letters) > common:
            child = settle(path.pop())
            path[-1][1].append((letters.pop(), child))
        if word is not None:
            for b in word[common:]:
                letters.append(b)
                path.append([False, []])
            path[-1][0] = True
    root = settle(path[0])

    below = np.zeros(len(states), np.int64)  # children are settled before their parents
    for s, (accepts, arcs) in enumerate(states):
        below[s] = accepts + sum(below[c] for _, c in arcs)
    # one sorted key for each arc (state, byte), for walking many words at once
    keys, targets, skipped, final = [], [], [], np.zeros(len(states), np.uint8)
    for s, (accepts, arcs) in enumerate(states):
        final[s], passed = accepts, int(accepts)
        for b, child in arcs:
            keys.append(s * 256 + b)
            targets.append(child)
            skipped.append(passed)
            passed += int(below[child])
    flat = np.array([i for w in ordered for i in words[w]], "<i4")
    starts = np.concatenate([[0], np.cumsum([len(words[w]) for w in ordered])]).astype("<i4")
    head = np.array([(len(states), len(keys), len(ordered), len(flat), root)], _ENTRY)
    parts = [head, np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(skipped, "<i4"), starts, flat, final]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Words' ids from a compiled automaton; ``data`` is any buffer, such as a memory map."""

    def __init__(self, data):
        head = np.frombuffer(data, _ENTRY, 1)[0]
        at = head.nbytes

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        n, arcs, words, ids, self.root = (int(x) for x in head)
        self.keys, self.targets, self.skipped = take("<i8", arcs), take("<i4", arcs), take("<i4", arcs)
        self.starts, self.ids, self.final = take("<i4", words + 1), take("<i4", ids), take("u1", n)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; -1 if the automaton doesn't accept it. All words take a step together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words)) if len(self.keys) else np.empty(0, np.int64)
        out = np.full(len(words), -1, np.int64)
        step = 0
        while len(live):
            ended = sizes[live] == step
            over = live[ended]
            ok = over[self.final[state[over]] == 1]
            out[ok] = number[ok]
            live = live[~ended]
            key = state[live] * 256 + raw[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            live, arc = live[hit], arc[hit]
            number[live] += self.skipped[arc]
            state[live] = self.targets[arc]
            step += 1
        return out
