"""Each operator against the library, a round trip or brute force, with nulls, empty texts, ties and repeated rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from notelens.llm import ann, bpe_codec, chat, jaccard, lexicon, near_vectors, packing, quality, scratch, spans, substring, token_count, warc  # noqa: E402

ODD = [
    "",
    "   ",
    "a  b   c\n\n d \n e<|endoftext|> x  <|endoftext|>",
    "你好 世界 " * 30,
    "x" * 900 + " y",
    "  " * 300 + "é" * 400,
    "à la\xa0 fin\x85 x \x1c y",
    "İstanbul naïve don't IT'LL ﬁ 123",
    "voilà  deux à  trois \t x",
]


def texts(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    words = ["".join(r.choice("etaoinshrdlué") for _ in range(r.randint(1, 9))) for _ in range(400)]
    return [" ".join(r.choice(words) + r.choice(["", "", ",", ".", "!!"]) for _ in range(r.randint(1, 120))) for _ in range(n)]


def twins(size: int) -> tuple[str, str]:
    """A Thue-Morse word over a and b, and the same with the letters swapped: linear hashes clash on these."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, extra string, score double, kept string, n_words long")


def with_extras(pairs):
    return [(i, t, "x", 1.0, "y", 2) for i, t in pairs]


# --- 1 packing ---


def test_word_ids_are_the_librarys():
    path = P.path("word_bpe_49k.json")
    sample = texts(60) + ODD
    expected = [x.ids for x in tokenizers.Tokenizer.from_file(path).encode_batch(sample, add_special_tokens=False)]
    assert [x.tolist() for x in packing.WordEncoder(path).encode(pa.array([*sample, None]))] == [*expected, []]


def test_words_that_clash_under_linear_hashes():
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sample = [w for n in (1024, 2048, 4096) for w in twins(n)]
    assert [x.tolist() for x in packing.WordEncoder(P.path("word_bpe_49k.json")).encode(pa.array(sample))] == [library.encode(w, add_special_tokens=False).ids for w in sample]
    path = P.path("byte_bpe_50k.json")
    codec, library = bpe_codec.Codec(path, P.PATTERN), tokenizers.Tokenizer.from_file(path)
    table = bpe_codec.SpanTable(codec.learn)
    assert [ids.tolist() for ids, _, _ in bpe_codec.encode(table, pa.array(sample))] == [library.encode(w, add_special_tokens=False).ids for w in sample]


def test_a_span_is_told_apart_by_its_second_hash(monkeypatch):
    real = spans.span_hash_pairs
    monkeypatch.setattr(spans, "span_hash_pairs", lambda *a: (np.full(len(a[1]), 7, np.uint64), real(*a)[1]))
    table = spans.SpanTable(lambda words: [(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]))])
    raw = np.frombuffer(b"one two one six two", np.uint8)
    starts, ends = spans.words_of(raw, np.array([0, len(raw)]))
    for _ in range(2):
        values, at = table.gather(0, table.entries(raw, starts, ends))
        assert [values[a:b].tobytes() for a, b in zip(at, at[1:])] == [b"one", b"two", b"one", b"six", b"two"]


def test_every_gap_that_three_pieces_fill_is_filled():
    r, limit = np.random.default_rng(1), 24
    for _ in range(150):
        counts = np.bincount(r.integers(1, limit + 1, r.integers(1, 14)), minlength=limit + 1)
        sums = packing.Sums(counts, limit)
        for length in np.flatnonzero(counts):
            if r.random() < 0.3:
                sums.take([int(length)])
                counts[length] -= 1
        held = [n for n in range(1, limit + 1) for _ in range(min(counts[n], 3))]
        for gap in range(1, limit + 1):
            parts = sums.filling(gap)
            assert bool(parts) == any(sum(x) == gap for n in (1, 2, 3) for x in itertools.combinations(held, n))
            assert not parts or (sum(parts) == gap and (np.bincount(parts, minlength=limit + 1) <= counts).all())
        assert (sums.left == counts).all()


@pytest.mark.parametrize("kind", ["long", "mixed", "short"])
def test_plan_of_hard_lengths(kind):
    """No more sequences than lengths above half the limit ask for, or first fit decreasing needs."""
    r, limit = np.random.default_rng(5), 512
    lengths = {"long": r.integers(200, 400, 700), "mixed": r.integers(1, 513, 900), "short": r.integers(1, 60, 2000)}[kind]
    made = packing.plan(np.bincount(lengths, minlength=limit + 1), limit)
    bins: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        at = next((i for i, gap in enumerate(bins) if gap >= n), None)
        if at is None:
            bins.append(limit - n)
        else:
            bins[at] -= n
    used = sum(np.bincount(p, minlength=limit + 1) * n for p, n in made)
    assert (used == np.bincount(lengths, minlength=limit + 1)).all() and all(sum(p) <= limit for p, _ in made)
    assert sum(n for _, n in made) <= len(bins)


def test_plan_uses_every_piece_once():
    counts = np.random.default_rng(3).integers(0, 9, 257)
    counts[0] = counts[121:] = 0  # longer pieces would need more sequences than their sum tells
    made = packing.plan(counts, 256)
    used = sum(np.bincount(p, minlength=257) * n for p, n in made)
    assert (used == counts).all() and max(map(sum, (p for p, _ in made))) <= 256
    assert sum(n for _, n in made) <= 1.02 * (counts * np.arange(257)).sum() / 256 + 1
    assert packing.plan(np.zeros(257, int), 256) == []


def test_plan_tries_every_first_length():
    counts = np.zeros(4097, int)
    counts[3000] = counts[400] = counts[350] = counts[346] = 1
    counts[401:801:4] = 1  # a hundred longer lengths, none in a pair or triple of 1096
    made = packing.plan(counts)
    assert ([3000, 400, 350, 346], 1) in made
    used = sum(np.bincount(p, minlength=4097) * n for p, n in made)
    assert (used == counts).all()


def test_pack(spark):
    path = P.path("word_bpe_49k.json")
    rows = with_extras([(i, t) for i, t in enumerate(texts(40))] + [(3, texts(40)[3]), (None, "a b"), (99, None), (98, ""), (97, "the cat " * 300)])
    out = packing.pack(docs_of(spark, rows), path, 128).collect()
    library = tokenizers.Tokenizer.from_file(path)
    expected = []
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for n, a in enumerate(range(0, len(ids), 128)):
            part = ids[a : a + 128]
            expected.append((i, n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(expected, key=key)
    places: dict = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(docs_of(spark, []), path).count() == 0


# --- 2 quality ---


def test_quality(spark):
    good = texts(60, 5)
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in texts(60, 6)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 3] + [(None, 1), (1, None)], "doc_id long, label int")
    docs = docs_of(spark, with_extras([*rows, (500, None), (501, ""), (5, good[5]), (None, bad[0])]))
    out = quality.score(docs, quality.fit(docs, labels))
    assert out.columns.count("score") == 1 and out.count() == 124
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[500] == got[501]
    assert np.mean([(got[i] >= 0.5) == (i < 60) for i in range(0, 120, 3)]) > 0.9
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_quality_is_the_plain_vote(spark):
    r = np.random.default_rng(2)
    rows = [(i, t) for i, t in enumerate(texts(80, 3))] + [(200, "long " * 400_000), (201, texts(80, 3)[4])]
    docs = docs_of(spark, with_extras(rows))
    labels = spark.createDataFrame([(i, int(r.integers(0, 2))) for i in range(60)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    got = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    known, votes = model.known, model.labels
    for i, t in rows:
        vector = quality.weighted(pa.array([t]), model.rarity)[0].astype(float) @ model.space
        vector /= np.linalg.norm(vector)
        near = sorted(((-(vector @ k), n) for n, k in enumerate(known)))[: quality.NEIGHBOURS]
        weight = [max(-c, 1e-9) ** quality.SHARPNESS for c, _ in near]
        assert got[i] == pytest.approx(sum(w * votes[n] for w, (_, n) in zip(weight, near, strict=True)) / sum(weight), abs=1e-9)
    assert len(known) == 60 and got[4] == pytest.approx(got[201])
    assert model.known.shape == quality.fit(docs, labels, 60).known.shape and len(quality.fit(docs, labels, 10).labels) == 10


def test_quality_labels(spark):
    docs = docs_of(spark, with_extras([(1, "a b c"), (1, "a b c"), (2, "d e f"), (3, "a b x")]))
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int"))).collect()} == {1.0}
    assert len(quality.fit(docs, spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, label int")).labels) == 2
    # equal neighbours of both labels: a tie, decided by the order they were fitted in
    tied = quality.fit(docs, spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, label int"))
    assert quality.score(docs, tied).filter("doc_id = 3").first()["score"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        quality.fit(docs, spark.createDataFrame([(1, 0), (2, 2)], "doc_id long, label int"))


# --- 3 chat ---


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "", None, "###\\h\\b\\t</turn></turn>", "line\n### user\nx", "日本 ### \\"]
    rows = [(c, t, r, hard[(c + t) % 6], 1) for c in range(6) for t, r in enumerate(["system", "user", "user", "assistant", "assistant", None, "a\nb###"])]
    rows += [(None, 1, "user", "x", 1), (7, None, "assistant", "late", 1), (7, 1, "assistant", "a", 1), (7, 1, "assistant", "a", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted([(-1 if t is None else t, r or "", x or "") for cc, t, r, x, _ in rows if cc == c])
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [m[1:] for m in mine]
        assert out[c]["learnt"] == "".join(x for _, r, x in mine if r == "assistant")
    assert out[7]["formatted"].count("###") == 1  # turns of one role in a row stand under one mark
    assert chat.format_conversations(turns.limit(0)).count() == 0


# --- 4 Jaccard ---


def brute_components(rows, link):
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if link(i, j) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in "\t\n\x0b\x0c\r":
        words = words.replace(b, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


@pytest.mark.parametrize("small", [2, 32])
def test_jaccard(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL_RUN", small)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 5)
    r = random.Random(2)
    base = texts(25, 8)
    rows = [(100 + i, t) for i, t in enumerate(base)]
    for k in range(60):
        words = base[k % 4].split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"w{r.randrange(9)}"
        rows.append((k, " ".join(words).upper() if k % 5 == 0 else " ".join(words)))
    rows += [(300, None), (301, ""), (302, "a b"), (303, "A  B"), (304, " \n"), (305, "a b c"), (100, base[0])]
    sets = [shingle_set(t) for _, t in rows]
    label = brute_components(rows, lambda i, j: len(sets[i] & sets[j]) * 4 >= 3 * len(sets[i] | sets[j]) > 0)
    least = [min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))]
    got = sorted(map(tuple, jaccard.near_duplicates(docs_of(spark, with_extras(rows))).collect()))
    assert got == sorted((d, len(s), c) for (d, _), s, c in zip(rows, sets, least, strict=True))


def test_jaccard_of_words_that_clash_under_linear_hashes(spark):
    out = jaccard.near_duplicates(docs_of(spark, with_extras(list(enumerate(twins(2048)))))).collect()
    assert sorted(map(tuple, out)) == [(0, 1, 0), (1, 1, 1)]


def test_jaccard_of_nothing(spark):
    assert jaccard.near_duplicates(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.near_duplicates(docs_of(spark, with_extras([(None, None), ]))).collect()] == [(None, 0, None)]


# --- 5 neighbours ---


def test_ann(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((900, 16)).astype(np.float32)
    v[40:60] = v[20]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] * 16, 1), (2080, [1.0], 1), (2100, [], 1), (None, v[0].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    out: dict = {}
    for row in ann.search(table, 20).collect():
        out.setdefault(row["query_id"], []).append(row)
    assert sorted(out) == list(range(0, 900, 20))
    hits = 0
    for q, found in out.items():
        found.sort(key=lambda x: x["rank"])
        s = (v.astype(float) * v[q].astype(float)).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20].tolist()
        hits += len(set(best) & {x["vec_id"] for x in found})
        assert [x["rank"] for x in found] == list(range(1, 21)) and all(abs(x["score"] - s[x["vec_id"]]) < 1e-12 for x in found)
        assert [(-x["score"], x["vec_id"]) for x in found] == sorted((-x["score"], x["vec_id"]) for x in found)
    assert hits / (20 * len(out)) >= 0.9
    assert ann.search(table.limit(0), 20).count() == 0
    assert len(ann.search(table.filter("vec_id < 5"), 20).collect()) == 4


def test_ann_goes_on_past_small_leaves(spark, monkeypatch):
    # clusters of 4 rows in directions of their own: what calibration asks for holds fewer than 20 rows
    monkeypatch.setattr(ann, "calibrate", lambda *_: 1)
    monkeypatch.setattr(ann, "LEAF_ROWS", 4)
    r = np.random.default_rng(6)
    centres = 50 * np.eye(60)
    v = np.repeat(centres, 4, axis=0) + 0.01 * r.standard_normal((240, 60))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, v[20].tolist())] * 22
    found: dict = {}
    for row in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).collect():
        found.setdefault(row["query_id"], []).append(row["vec_id"])
    assert sorted(found) == list(range(0, 240, 20)) and all(len(x) == 20 and q not in x for q, x in found.items())


def test_ann_with_repeated_ids(spark):
    r = np.random.default_rng(8)
    v = r.standard_normal((120, 8))
    rows = [(i // 3, x.tolist()) for i, x in enumerate(v)]
    out: dict = {}
    for row in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).collect():
        out.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    assert sorted(out) == [0, 20]
    for q, found in out.items():
        own = min(x for i, x in rows if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, x, strict=True)), i) for i, x in rows if i != q)[:20]
        assert [n for n, *_ in sorted(found)] == list(range(1, 21))
        assert len({(vec, round(s, 9)) for _, vec, s in found} & {(i, round(-t, 9)) for t, i in best}) >= 18


# --- 6 token counts ---


def test_token_counts():
    names = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    library, counter = tokenizers.Tokenizer.from_file(names[0]), token_count.Counter(*names)
    for t in texts(40) + ODD:
        n = len(library.encode(t, add_special_tokens=False).ids)
        for chunk, overlap in ((1 << 16, 512), (200, 16), (60, 2)):
            assert counter.count(t, chunk, overlap) == n, (t[:40], chunk)


def test_token_count_rows(spark):
    docs = docs_of(spark, with_extras([(1, "a b"), (1, "a b"), (2, None), (None, "é")]))
    out = token_count.count_tokens(docs, P.path("byte_bpe_50k.json"), limit=1).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == [(0, 2, 1, False), (1, 3, 2, True), (1, 3, 2, True), (2, 0, 0, False)]


def test_token_counts_of_nothing_and_of_megabytes(spark):
    path = P.path("byte_bpe_50k.json")
    assert token_count.count_tokens(docs_of(spark, []), path).count() == 0
    long = " ".join(texts(4000, 9))
    expected = len(tokenizers.Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids)
    got = token_count.count_tokens(docs_of(spark, with_extras([(1, long)])), path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first()
    assert len(long) > 1 << 20 and (got["n_bytes"], got["n_tokens"]) == (len(long.encode()), expected)
    ids = tokenizers.Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids
    coded = bpe_codec.codec_digests(docs_of(spark, with_extras([(1, long)])), path, P.PATTERN, 100).first()
    assert coded["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    words = P.path("word_bpe_49k.json")
    assert next(packing.WordEncoder(words).encode(pa.array([long]))).tolist() == tokenizers.Tokenizer.from_file(words).encode(long, add_special_tokens=False).ids


# --- 7 substrings ---


def test_substring(spark):
    r = random.Random(9)
    passage = [f"p{r.randrange(50)}" for _ in range(60)]
    rows = []
    for i in range(40):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(0, 90))]
        if i % 3 == 0:
            at = r.randrange(len(words) + 1)
            a = r.randrange(20)
            words[at:at] = passage[a : a + 34 + i % 4]
        rows.append((i, r.choice([" ", "\n", "  "]).join(words)))
    rows += [(50, " ".join(["same"] * 80)), (51, None), (52, ""), (3, rows[3][1]), (53, " ".join(passage[:34])), (None, " ".join(passage))]
    split = [(t or "").split() for _, t in rows]
    seen: dict = {}
    for i, w in enumerate(split):
        for k in range(len(w) - 34):
            seen.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + 35))
    expected = [(d, len(w), len(g), " ".join(x for n, x in enumerate(w) if n not in g)) for (d, _), w, g in zip(rows, split, gone, strict=True)]
    out = substring.removed(docs_of(spark, with_extras(rows)))
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in out.collect()), key=key) == sorted(expected, key=key)
    assert out.columns.count("kept") == 1 and sum(len(g) for g in gone) > 100
    assert substring.removed(docs_of(spark, [])).count() == 0


def test_substring_of_words_that_clash_under_linear_hashes(spark):
    same = " ".join(f"w{i}" for i in range(34))
    out = substring.digests(docs_of(spark, with_extras([(i, f"{same} {w}") for i, w in enumerate(twins(2048))]))).collect()
    assert {(r["n_words"], r["n_removed"]) for r in out} == {(35, 0)}


def test_substring_hands_no_texts_to_python_under_the_callers_settings(spark):
    blank = ["  ", "\t", "\x0b\x0c", "\r\n", " "]
    a, b = ([f"{c}{i}" for i in range(40)] for c in "ab")
    own = lambda n, c: [f"{c}.{i}é\xa0" for i in range(n)]
    # own words before, between and after; passages that overlap or touch; nothing left; nothing but blanks
    rows = [own(3, "p") + a + own(1, "q") + b + own(2, "r"), a + b[:36], b + a, a[2:] + own(4, "s"), own(50, "t"), []]
    lines = [blank[i % 5] * (i % 2) + "".join(w + blank[(i + k) % 5] for k, w in enumerate(words)) for i, words in enumerate(rows)] + ["\r \x0b"]
    kept = [own(3, "p") + own(1, "q") + own(2, "r"), [], [], own(4, "s"), own(50, "t"), [], []]
    out = substring.removed(docs_of(spark, with_extras(list(enumerate(lines)))))
    # a batch would be as large as the session's settings let it grow, in the JVM and in each worker
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython") if x in plan]
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in out.orderBy("doc_id").collect()] == [(len(w), len(w) - len(k), " ".join(k)) for w, k in zip([*rows, []], kept, strict=True)]


@pytest.mark.parametrize("most", [12, 28])
def test_substring_of_many_repeated_rows(spark, monkeypatch, most):
    monkeypatch.setattr(scratch, "MOST_BITS", most)  # the least filter lets most rows through, and changes nothing
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text)] * 300 + [(2, "x " + text), (3, " ".join(f"v{i}" for i in range(50)))]
    out = substring.removed(docs_of(spark, with_extras(rows)).repartition(6)).groupBy("doc_id", "n_removed", "kept").count().collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept"], r["count"]) for r in out) == [(1, 50, "", 300), (2, 50, "x", 1), (3, 0, rows[-1][1], 1)]


def test_filters_let_all_keys_through(spark):
    for keys in (0, 3, 5000):
        rows, wanted = spark.range(20000).withColumn("h", F.xxhash64("id")), spark.range(keys).select(F.xxhash64("id").alias("k"))
        clear, rest = scratch.split_by(rows, F.col("h"), wanted)
        assert clear.count() + rest.count() == 20000 and rest.filter(F.col("id") < keys).count() == keys
        assert clear.count() > 20000 - keys - 3000


def test_settings_stay(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    jaccard.near_duplicates(docs_of(spark, with_extras([(1, "a b")]))).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# --- 8 WARC ---


def test_warc(spark, tmp_path):
    big, other = "é" * 700, "z" * 5000
    rows = [(1, "u\r\nx", big), (5, None, big), (3, "u", big), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", other), (8, "u", ""), (9, "u", other), (9, "u", other), (None, "u", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, keeper int")
    index, folder = warc.archive(pages)
    got = sorted(tuple(-1 if x is None else x for x in r) for r in warc.read_archives(index).collect())
    expected = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = [q for q, _, x in rows if (x or "") == (h or "") and q is not None]
        again = len(raw) >= 1000 and p != max(same)
        expected.append((-1 if p is None else p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(same) if again else -1))
    assert got == sorted(expected)
    one = index.filter("page_id = 9").first()
    assert warc.parse_record(warc.BundleReader(one["bundle"]).frame(one["frame"])[one["offset"] : one["offset"] + one["length"]])[1] == other.encode()
    assert warc.read_archives(warc.archive(pages.limit(0))[0]).count() == 0


def test_bundle_frames(tmp_path):
    w = warc.BundleWriter(f"file://{tmp_path}/a/b.warc.zst")
    records = [warc.record_bytes(i, "u", bytes([i]) * 9000, "d", False, None) for i in range(90)]
    places = [w.add(r) for r in records]
    w.close()
    reader = warc.BundleReader(f"file://{tmp_path}/a/b.warc.zst")
    assert len(reader.frames) > 2 and all(reader.frame(f)[o : o + len(r)] == r for (f, o), r in zip(places, records, strict=True))


# --- 9 codec ---


def test_lexicon():
    r = random.Random(3)
    words = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))): [r.randrange(99) for _ in range(r.randint(1, 3))] for _ in range(200)}
    held = lexicon.Lexicon(lexicon.compile_words(words))
    asked = [*words, b"", b"abcabcabc", b"zz"]
    for w, n in zip(asked, held.numbers(asked), strict=True):
        assert (held.ids[held.starts[n] : held.starts[n + 1]].tolist() == words[w]) if w in words else n == -1
    assert lexicon.Lexicon(lexicon.compile_words({})).numbers([b"a"]).tolist() == [-1]


def test_codec(spark):
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(texts(50) + ODD)] + [(1, texts(50)[1]), (None, "x"), (900, None)]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_codec.codec_digests(docs_of(spark, with_extras(rows)), path, P.PATTERN, 50).collect())
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        told = ",".join(map(str, ids))
        expected.append((-1 if i is None else i, len(ids), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(expected)
    assert bpe_codec.codec_digests(docs_of(spark, []), path, P.PATTERN).count() == 0


# --- 10 near vectors ---


def test_near_vectors(spark, monkeypatch):
    for name, small in (("LEAST_SLAB", 64), ("TILE", 40), ("QUERIES", 30)):
        monkeypatch.setattr(near_vectors, name, small)
    r = np.random.default_rng(6)
    v = r.standard_normal((260, 24))
    for i in range(60):
        v[100 + i] = v[i % 7] * r.uniform(0.5, 2) + r.standard_normal(24) * r.choice([0.1, 0.25, 0.35])
    v[200:210] = v[3]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("inf")] + [1.0] * 23, 0), (903, [1.0], 0), (904, [2.0], 0), (3, v[3].tolist(), 0)]
    keep = [(i, np.array(x)) for i, x, _ in rows if x and i < 900 or i in (903, 904)]

    def link(i, j):
        a, b = keep[i][1], keep[j][1]
        return len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95

    label = brute_components(keep, link)
    expected = [(keep[i][0], sum(link(i, j) for j in range(len(keep)) if j != i), min(keep[j][0] for j in range(len(keep)) if label[j] == label[i])) for i in range(len(keep))]
    expected += [(i, 0, i) for i in (900, 901, 902)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")
    got = near_vectors.near_duplicates(table).collect()
    assert sorted(tuple(x)[:3] for x in got) == sorted(expected) and all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got)
    assert near_vectors.near_duplicates(table.limit(0)).count() == 0
