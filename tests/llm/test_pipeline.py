"""The pipeline's stages against plain Python versions of what they decide, row by row."""

import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from test_operators import brute_components, shingle_set  # noqa: E402

import corpus_pipeline  # noqa: E402
from notelens.llm import quality  # noqa: E402
from notelens.llm.queries import quality_classifier  # noqa: E402

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def plain_near_copies(rows):
    """Rows (id, text, ...) that stay: one of each group of near copies, the least (id, text hash) of it."""
    sets = [shingle_set(r[1]) for r in rows]
    label = brute_components(rows, lambda i, j: len(sets[i] & sets[j]) * 4 >= 3 * len(sets[i] | sets[j]) > 0)
    least = {}
    for r, k in zip(rows, label, strict=True):
        least[k] = min(least.get(k, r[0]), r[0])
    return [r for r, k in zip(rows, label, strict=True) if r[0] == least[k]]


def plain_without_repeats(texts):
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    out = []
    for w in split:
        gone = {n for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for n in range(k, k + 35)}
        out.append(" ".join(x for n, x in enumerate(w) if n not in gone))
    return out


def test_stages_do_what_plain_python_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "substring dedup", "best-fit packing"]

    def run(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, docs.schema), SF)
        return out.columns, sorted((tuple(r) for r in out.collect()), key=key)

    before = sorted((tuple(r) for r in docs.collect()), key=key)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality_classifier(spark, SF, docs)).collect()}
    names, good = run("quality classifier", before)
    assert names == columns and good == [r for r in before if scores[r[0]] >= 0.5] and 0 < len(good) < len(before)

    names, single = run("n-gram Jaccard join", good)
    assert names == columns and single == plain_near_copies(good) and len(single) < len(good)

    names, kept = run("substring dedup", single)
    texts = plain_without_repeats([r[1] for r in single])
    assert names == columns and kept == [(r[0], t, *r[2:-1], len(t)) for r, t in zip(single, texts, strict=True)]

    _, pieces = run("best-fit packing", kept)
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = []
    for r in kept:
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 1]
        expected += [(r[0], n, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]
    assert [p[:5] for p in pieces] == sorted(expected)
    places = {}
    for *_, length, _, sequence, offset in pieces:
        places.setdefault(sequence, []).append((offset, length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(p[3] for p in pieces) // 4096)


def test_a_repeated_passage_goes(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(200)) + (f" {passage}" if i < 3 else ""), "en", "s", 0) for i in range(5)]
    out = corpus_pipeline.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert sorted(r["text"] for r in out) == sorted(" ".join(f"d{i}w{j}" for j in range(200)) for i in range(5))


def test_nulls_empty_tables_and_columns_of_the_same_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n_words long, n_removed long, text_hash string"
    rows = [(1, text, "en", "s", 9, 0.1, "k", 7, 8, "h"), (2, None, "en", "s", 0, None, None, None, None, None), (None, None, None, None, None, 0.5, "", 0, 0, ""), (3, "", "en", "s", 0, 0.2, "k", 1, 2, "h")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        own = {r["doc_id"]: r for r in docs.collect()}
        for r in out.collect():
            assert tuple(r)[5:] == tuple(own[r["doc_id"]])[5:], name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()}
    assert kept == {(1, text), (2, None), (None, None), (3, "")}
    assert [r["text"] for r in corpus_pipeline.without_repeats(spark, docs, SF).orderBy("doc_id").collect()] == ["", text, "", ""]
    assert corpus_pipeline.packed(spark, docs, SF).count() == 4 and corpus_pipeline.packed(spark, docs.limit(0), SF).count() == 0


def test_repeated_rows_are_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + " x", "en", "s", 9), (3, None, "en", "s", 0), (3, "", "en", "s", 0)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, text), (3, ""), (3, "")]


def test_rows_of_one_id_are_decided_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, b), (5, b), (5, a), (7, c), (7, c + " x"), (8, c + " y"), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()]
    assert sorted(x for x in kept if x[0] not in (None, 7)) == [(3, b), (5, a)]
    assert (None, b) in kept and len([x for x in kept if x[0] == 7]) == 1
    # one id on top of two components: each keeps its own row
    docs = docs.filter("doc_id = 5").unionByName(docs.filter("doc_id = 8"))
    assert len(corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()) == 3
