"""Runs of words, pairs of notes that share them and what groups cover, against plain Python; chunks in small batches."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelens.operators import chunking, dupes, shingling

TEXTS = ["İstanbul IĞDIR-Çay x2y, _a_b", "", None, "Москва и СОН ½ ﬁx", " one  TWO\nthree's four "]


def plain(text):
    words = re.findall(r"[^\W_]+", text.translate(str.maketrans(dupes.copy_fold.__globals__["COPY_FOLD_FROM"], dupes.copy_fold.__globals__["COPY_FOLD_TO"])).lower())
    return {" ".join(words[i : i + 8]) for i in range(len(words) - 7)} if len(words) >= dupes.MIN_WORDS else set()


def made_up(n=40):
    r = np.random.default_rng(5)
    parts = [" ".join(f"W{x}" for x in r.integers(0, 60, 25)) for _ in range(12)]
    return {f"{'ab'[i % 2]}/n{i * 37 % 101:03}": " ".join(parts[j] for j in r.integers(0, 12, i % 4)) for i in range(n)}


def test_words_of_texts_are_those_of_the_columns(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string").select("n", dupes.copy_words(F.coalesce("text", F.lit(""))).alias("w")).orderBy("n").collect()
    for part in (TEXTS, [t for t in TEXTS if not t or t.isascii()]):
        h, size = shingling.of_texts(pa.array(part, pa.string()))
        words = [r["w"] for r in rows if TEXTS[r["n"]] in part]
        hashed, sizes = shingling.of_words(pa.array(words, pa.list_(pa.string())))
        assert size.tolist() == sizes.tolist() and h.tolist() == hashed.tolist()


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_runs_are_told_apart(n):
    words = [["a", "b"] * 10, ["a"] * 9, [], ["b", "a"] * 3, [str(i) for i in range(30)]]
    place, h = shingling.runs(*shingling.of_words(pa.array(words, pa.list_(pa.string()))), n)
    want = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in words]
    assert np.bincount(place, minlength=5).tolist() == list(map(len, want))
    assert len(set(h.tolist())) == len(set().union(*want))


def test_equal_runs_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(shingling, "ROWS_AT_ONCE", 5)
    r = np.random.default_rng(1)
    rows = sorted({(int(h), int(i)) for h, i in zip(r.integers(0, 40, 200), r.integers(-9, 9, 200), strict=True)})
    rows += rows[-3:]
    batch = pa.RecordBatch.from_pydict({"h": [h for h, _ in rows], "id": [i for _, i in rows], "n": pa.array([i + 9 for _, i in rows], pa.int32())})
    batches = [batch.slice(i, 7) for i in range(0, len(rows), 7)]
    owners: dict = {}
    for h, i in rows:
        owners.setdefault(h, set()).add(i)
    want: dict = {}
    for o in owners.values():
        for p in combinations(sorted(o), 2) if len(o) <= 6 else ():
            want[p] = want.get(p, 0) + 1
    got: dict = {}
    parts = list(shingling.pairs_of_runs(6)(iter(batches)))
    for x in (x for b in parts for x in b.to_pylist()):
        assert (x["nx"], x["ny"]) == (x["x"] + 9, x["y"] + 9)
        got[x["x"], x["y"]] = got.get((x["x"], x["y"]), 0) + x["shared"]
    assert got == want and len(parts) > 5


def test_pairs_and_cover(spark):
    texts = made_up()
    sets = {p: plain(t) for p, t in texts.items()}
    notes = spark.createDataFrame(list(texts.items()), "path string, text string")
    owners = {s: [p for p in sets if s in sets[p]] for s in set().union(*sets.values())}
    shared: dict = {}
    for o in owners.values():
        for p in combinations(sorted(o), 2) if len(o) <= 10 else ():
            shared[p] = shared.get(p, 0) + 1
    got = {(r["a"], r["b"]): (r["shared"], r["ratio"]) for r in dupes.pair_overlaps(dupes.note_shingles(notes), 10, notes).collect()}
    assert got == {(a, b): (c, c / min(len(sets[a]), len(sets[b]))) for (a, b), c in shared.items()} and got
    cover = {r["path"]: r["covered"] for r in dupes.covered(notes.select(F.left("path", F.lit(1)).alias("root"), "path", "text")).collect()}
    rest = {p: set().union(*(sets[q] for q in sets if q != p and q[0] == p[0])) for p in sets}
    assert cover == {p: pytest.approx(len(s & rest[p]) / len(s) if s else 0.0) for p, s in sets.items()}


def test_chunks_leave_python_in_small_batches():
    notes = pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(200)], "text": ["word " * 300] * 200})
    out = list(chunking.cutter(0, chunking.CHUNKS)(iter([notes])))
    assert len(out) == 4 and sum(map(len, out)) == sum(len(chunking.chunk_note("p0", "word " * 300)[0]) for _ in range(200))
