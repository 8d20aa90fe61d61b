"""Batches of lexical queries in blocks, against every score."""

from types import SimpleNamespace as Fake

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelens.operators import lexical, topk


@pytest.mark.parametrize("few,texts", [(0, 7), (0, 40), (10**9, 13)])
def test_blocks_find_the_best_of_all(monkeypatch, few, texts):
    monkeypatch.setattr(topk, "FEW_POSTINGS", few)
    monkeypatch.setattr(topk, "BLOCK_TEXTS", texts)
    r = np.random.default_rng(3)
    n_terms, k = 30, 4
    rows = [np.unique(np.minimum(r.zipf(1.4, r.integers(0, 9)) - 1, n_terms - 1)) for _ in range(120)]
    rows[60:90] = [rows[5]] * 30  # ties beyond the k-th
    tf = [1 + x % 3 for x in rows]
    dl = [3 + len(x) % 2 for x in rows]
    keys = [f"n{i * 7919 % 997:03}" for i in range(len(rows))]
    asked = [np.unique(r.integers(0, n_terms, 6)) for _ in range(50)]
    idf = np.linspace(0.1, 5, n_terms)
    given = topk.Queries(np.arange(50) * 10, np.cumsum([0, *map(len, asked)]), np.concatenate(asked))
    table = pa.table({"dl": pa.array(dl, pa.int32()), "terms": pa.array(rows, pa.list_(pa.int32())), "tf": pa.array(tf, pa.list_(pa.int32())), "path": keys})
    run = topk.best_of_blocks(Fake(value=(given, idf, 3.5)), ["n", "path", "score"], k, 1.5, 0.75, 9)
    got: dict = {}
    handed = 0
    for batch in run(iter(table.to_batches(max_chunksize=5))):
        handed += len(batch)
        for x in batch.to_pylist():
            got.setdefault(x["n"], []).append((-x["score"], x["path"]))
    for i, terms in enumerate(asked):
        all_ = []
        for x, t, n, key in zip(rows, tf, dl, keys, strict=True):
            s = round(float(sum(idf[a] * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / 3.5)) for a, f in zip(x, t, strict=True) if a in terms)), 9)
            all_ += [(-s, key)] if s > 0 else []
        best, found = sorted(all_)[:k], sorted(got.get(i * 10, []))[:k]
        assert [p for _, p in found] == [p for _, p in best]
        assert [s for s, _ in found] == pytest.approx([s for s, _ in best], abs=2e-9)
    assert handed <= 50 * k * -(-120 // (texts - texts % 5 or 5))


def test_no_row_for_each_query_and_text(spark):
    """1,000 queries over 1,000 texts that all share a word: what is ranked is bounded by the best of each task, not by pairs."""
    texts = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("common shared w"), F.col("id") % 50).alias("text"))
    asked = spark.range(1000).select(F.col("id").alias("qid"), F.concat(F.lit("common shared w"), F.col("id") % 50).alias("text"))
    got = lexical.bm25_topk(texts, asked, ["path"], 2)
    assert got.count() == 2000 and got.filter("rank = 1").select("path").distinct().count() == 50
    rows = sum(spark.read.parquet(f).count() for f in got.inputFiles() if "/found-" in f)
    assert 2000 <= rows <= 1000 * 2 * spark.sparkContext.defaultParallelism


def test_repeated_keys_and_queries(spark):
    texts = spark.createDataFrame([("a", "aa bb"), ("a", "aa bb"), ("a", "aa"), ("b", "aa cc"), ("c", None), ("d", "")], "path string, text string")
    asked = spark.createDataFrame([(1, "aa bb"), (1, "AA cc"), (2, "-"), (3, None)], "qid int, text string")
    once = spark.createDataFrame([(1, "aa bb cc")], "qid int, text string")
    best = lexical.ranked(lexical.bm25_scores(texts, once, ["path"]), ["path"], 3)
    got = lexical.bm25_topk(texts, asked, ["path"], 3)
    assert sorted(map(tuple, got.select(*best.columns).collect())) == sorted(map(tuple, best.collect()))
    clear = texts.filter("path <> 'a'")
    assert [r["path"] for r in lexical.bm25_topk(clear, asked, ["path"], 3).collect()] == ["b"]
    assert lexical.bm25_topk(clear.limit(0), asked, ["path"], 3).count() == 0 and lexical.bm25_topk(clear, asked.limit(0), ["path"], 3).count() == 0


def test_counts_of_texts(spark):
    rows = spark.createDataFrame([("a", "aa aa HTTPServer"), ("b", "aa Москвой"), ("c", ""), ("d", None)], "path string, text string")
    assert sorted((r["path"], r["term"], r["tf"], r["dl"]) for r in lexical.postings(rows, ["path"]).collect()) == [("a", "aa", 2, 5), ("a", "http", 1, 5), ("a", "httpserver", 1, 5), ("a", "server", 1, 5), ("b", "aa", 1, 2), ("b", "москвои", 1, 2)]
    assert tuple(lexical.corpus_stats(rows).first()) == (4, pytest.approx(7 / 3))
    df = {r["term"]: r["df"] for r in lexical.frequency_of_texts(rows, ["path"]).collect()}
    assert df == {"aa": 2, "http": 1, "httpserver": 1, "server": 1, "москвои": 1}
