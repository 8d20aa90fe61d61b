"""BM25, fusion, rerank splice, recency, focus, grouping: hand-made cases."""

import datetime
import math
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelens.functions import recency, text
from notelens.operators import dense, fusion, lexical, serve
from notelens.plans import queries as queries_of_plans

TODAY = datetime.date(2026, 6, 1)


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, text string")


def test_bm25_by_hand(spark):
    notes = spark.createDataFrame([("a", "aa bb"), ("b", "aa"), ("c", "")], "path string, text string")
    got = {r["path"]: r["score"] for r in lexical.bm25_scores(notes, queries(spark, "aa AA"), ["path"]).collect()}
    idf, avgdl = math.log(1 + (3 - 2 + 0.5) / 2.5), 1.0
    for path, dl in (("a", 2), ("b", 1)):
        assert got[path] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl)), abs=1e-8)
    assert set(got) == {"a", "b"}


def test_bm25_ties_go_to_the_smaller_key(spark):
    notes = spark.createDataFrame([(p, "same words") for p in "dcab"], "path string, text string")
    assert [r["path"] for r in lexical.bm25_topk(notes, queries(spark, "words"), ["path"], 3).orderBy("rank").collect()] == ["a", "b", "c"]


@pytest.mark.parametrize(
    "given,expected",
    [
        ("HTTPServer", ["httpserver", "http", "server"]),
        ("RAG_VAULT_ROOT", ["rag_vault_root", "rag", "vault", "root"]),
        ("a b don't Konsey'in", ["don", "konsey"]),
        ("__ _a_ x__y ab_", ["_a_", "x__y", "ab_"]),
        ("fooBar_x", ["foobar_x", "foo", "bar"]),
        ("İIıi ÇŞĞ café ﾊx", ["iiii", "iii", "csg", "cafe", "ﾊx"]),
    ],
)
def test_tokens(spark, given, expected):
    row = spark.range(1).select(text.tokens(F.lit(given)).alias("t"), text.token_bag(F.lit(given)).alias("bag")).first()
    assert row["t"] == expected and sorted(row["bag"]) == sorted(expected)


WIDE = ["½ ﬁ İ Å ½x", "Москвой йод", "Ελλάδα ΣΊΣΥΦΟΣ", "한국어 값 뷁", "ｆｕｌｌ １２３", "ﾊx ｶﾞ", "ﬃ ŉ Ǆ №5 ™ Konsey’in", "Ⓐb aⒶ ℃ K", "日本語 がぎ 漢字", "عَرَبِيّ ﷲ", "ﬁ_HTTPServer fooBar", "é ño … x²y", "İSTANBUL ığdır", ""]


def test_tokens_are_folded_exactly(spark):
    """Against decomposition (NFKD) letter by letter; runs are taken apart first and folded then."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*WIDE, None])], "n int, text string")
    got = {r["n"]: r["tokens"] for r in lexical.token_rows(rows, ["n"]).collect()}
    for i, t in enumerate(WIDE):
        assert sorted(got[i]) == sorted(text.tokens_of(t)), t
    assert got[len(WIDE)] is None
    assert text.tokens_of("ﬁne ｆｕｌｌ １２３ Москвой Ελλάδα") == ["fine", "full", "123", "москвои", "ελλαδα"]
    notes = spark.createDataFrame([("a", "Москвой ﬁne"), ("b", "other words")], "path string, text string")
    assert [r["path"] for r in lexical.bm25_topk(notes, queries(spark, "москвои FINE"), ["path"], 5).collect()] == ["a"]


def test_every_letter_folds_as_it_decomposes(spark):
    letters = [chr(c) for c in (*range(0x20, 0x3000), *range(0xFB00, 0x10000)) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    rows = spark.createDataFrame([(ord(c), f"xa{c}bz {c}{c}") for c in letters], "n int, text string")
    wrong = [hex(r["n"]) for r in lexical.token_rows(rows, ["n"]).collect() if sorted(r["tokens"]) != sorted(text.tokens_of(f"xa{chr(r['n'])}bz {chr(r['n']) * 2}"))]
    assert wrong == []


@pytest.mark.parametrize("run", ["acgt" * 250_000, "é" * 1_000_000, "aB" * 100_000, "a_" * 100_000])
def test_long_runs_are_looked_through_once(spark, run):
    began = time.time()
    n = spark.createDataFrame([(run,)], "t string").select(F.size(text.token_bag(F.col("t"))).alias("n")).first()["n"]
    # the whole run, and parts of two letters or more (Ba Ba ... of aBaBa...)
    assert n == (100_000 if run.startswith("aB") else 1) and time.time() - began < 8


def test_exact_fold_decomposes_everything(spark):
    assert spark.range(1).select(text.fold_exact(F.lit("½ ﬁ İ Å")).alias("t")).first()["t"] == "1⁄2 fi i a"


def test_rrf(spark):
    def ranking(*paths):
        return spark.createDataFrame([(0, p, 0, i) for i, p in enumerate(paths, 1)], "qid int, path string, index int, rank int")

    one = {r["path"]: r["score"] for r in fusion.rrf([ranking("x", "y", "z")]).collect()}
    assert one == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62), "z": pytest.approx(1 / 63)}
    both = fusion.ranked(fusion.rrf([ranking("x", "y"), ranking("z", "y")]), fusion.KEYS, 3).orderBy("rank").collect()
    assert [r["path"] for r in both] == ["y", "x", "z"]


def test_rerank_splice(spark):
    fused = spark.createDataFrame([(0, p, 0, s) for p, s in zip("abcd", (0.4, 0.3, 0.2, 0.1), strict=True)], "qid int, path string, index int, score double")
    logits = spark.createDataFrame([(0, "a", 0, -5.0), (0, "b", 0, 5.0)], "qid int, path string, index int, logit double")
    got = {r["path"]: r for r in fusion.rerank_splice(fused, logits, top=2).collect()}
    low = 1 / (1 + math.exp(5))
    assert got["b"]["score"] > got["a"]["score"] == pytest.approx(low)
    assert got["c"]["score"] == pytest.approx(0.5 * low) and got["d"]["score"] == pytest.approx(0.25 * low)
    assert got["c"]["rerank_score"] is None


@pytest.mark.parametrize(
    "q,recent,state",
    [("güncel durum", True, True), ("neredeyiz", True, True), ("şu an ne var", True, True), ("en son ne yaptık", True, True), ("en son videoda ne var", True, False), ("durumu özetle", False, False), ("güncel sürüm", True, False), ("", False, False)],
)
def test_question_kinds(spark, q, recent, state):
    row = spark.range(1).select(recency.is_recency_query(F.lit(q)).alias("r"), recency.is_state_query(F.lit(q)).alias("s")).first()
    assert (row["r"], row["s"]) == (recent, state)


@pytest.mark.parametrize("path,day", [("a/2026-01-02 x.md", "2026-01-02"), ("2026-01-02/x.md", None), ("a/2026-02-30 2026-03-01.md", "2026-03-01"), ("12026-01-02.md", None)])
def test_note_date(spark, path, day):
    got = spark.range(1).select(recency.note_date(F.lit(path)).alias("d")).first()["d"]
    assert (got.isoformat() if got else None) == day


def _boosted(spark, q, paths, mode=None):
    scored = spark.createDataFrame([(0, p, 0, s) for p, s in paths], "qid long, path string, index int, score double")
    features = fusion.note_features(scored)
    out = fusion.boost(scored, queries(spark, q), features, F.lit(TODAY), recency_mode=mode)
    return [r["path"] for r in fusion.ranked(out, fusion.KEYS, 99).orderBy("rank").collect()]


def test_recency_orders_only_questions_about_now(spark):
    paths = [("a/2020-01-01 x.md", 1.0), ("a/2026-05-30 x.md", 1.0), ("a/x.md", 1.0)]
    assert _boosted(spark, "yeni ne var", paths)[0] == "a/2026-05-30 x.md"
    assert _boosted(spark, "ne var", paths)[0] == "a/2020-01-01 x.md"
    assert _boosted(spark, "ne var", paths, True)[0] == "a/2026-05-30 x.md"
    assert _boosted(spark, "yeni ne var", paths, False)[0] == "a/2020-01-01 x.md"


def test_state_questions_raise_index_notes(spark):
    paths = [("p/detay.md", 1.0), ("p/Proje - İndeks.md", 0.5)]
    assert _boosted(spark, "neredeyiz", paths)[0] == "p/Proje - İndeks.md"
    assert _boosted(spark, "yeni sürüm", paths)[0] == "p/detay.md"


def test_notes_add_a_tenth_of_their_next_two(spark):
    rows = [(0, "m", i, 1.0) for i in range(4)] + [(0, "s", 0, 1.1)]
    scored = spark.createDataFrame(rows, "qid long, path string, index int, score double")
    got = fusion.group_notes(scored, 5).orderBy("rank").collect()
    assert [(r["path"], r["score"], len(r["hits"])) for r in got] == [("m", pytest.approx(1.2), 4), ("s", pytest.approx(1.1), 1)]
    assert fusion.cap_per_note(scored, 1, 9).count() == 2 and fusion.cap_per_note(scored, 0, 9).count() == 0


def test_dense_keeps_every_sign_and_breaks_ties_by_key(spark):
    vectors = spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate((-1.0, 1.0, 1.0, 0.5))], "id int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, q array<double>")
    got = dense.dense_topk(vectors, q, ["id"], 4).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0), (3, 0.5), (0, -1.0)]
    assert sorted(map(tuple, dense.dense_scores(vectors, q, ["id"]).collect())) == [(0, 0, -1.0), (0, 1, 1.0), (0, 2, 1.0), (0, 3, 0.5)]


def test_dense_for_every_hundredth_vector(spark, tmp_path):
    r = np.random.default_rng(2)
    v = r.standard_normal((2600, 8)).astype(np.float32)
    v[700:800] = v[50]  # ties beyond the 50th
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    got: dict = {}
    for row in queries_of_plans.dense_topk_batch(spark, str(tmp_path)).collect():
        got.setdefault(row["qid"], []).append((row["rank"], row["vec_id"], row["score"]))
    assert sorted(got) == list(range(0, 2600, 100))
    stated = table.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        blocks = {(x["qid"], x["rank"]): x["vec_id"] for x in dense.dense_topk(table, stated, ["vec_id"], 50, block=7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q, found in got.items():
        score = np.round(v.astype(float) @ v[q].astype(float), lexical.PLACES)
        best = np.lexsort((np.arange(2600), -score))[:50]
        assert [(n, i) for n, i, _ in sorted(found)] == list(enumerate(best.tolist(), 1))
        assert [s for *_, s in sorted(found)] == pytest.approx(score[best].tolist(), abs=1e-8)
        assert [blocks[q, n] for n in range(1, 51)] == best.tolist()


def test_every_long_note_is_asked_from(spark, tmp_path):
    rows = [(i, " ".join(f"n{i}w{j}" for j in range(8 + i % 2)), "en", "s", 9) for i in range(23)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["qid"]: r["rank"] for r in queries_of_plans.eval_ranks(spark, str(tmp_path)).collect()}
    assert got == {i: 1 for i in range(1, 23, 2)}


def test_searcher_modes(spark):
    chunks = spark.createDataFrame([("a.md", 0, "cats purr"), ("b.md", 0, "dogs bark"), ("c.md", 0, "stock market")], "path string, index int, embed_text string")
    embedder = dense.HashEmbedder(32)
    vectors = chunks.withColumn("embedding", dense.embed_column(lambda: embedder, "")(F.col("embed_text"))).select("path", "index", "embedding")
    s = fusion.Searcher(chunks, vectors, lambda q: q.withColumn("q", dense.embed_column(lambda: embedder, "")(F.col("text"))).select("qid", "q"))
    asked = queries(spark, "dogs", " ")
    for mode in fusion.MODES:
        best = s.search(asked, 1, mode=mode).collect()
        assert [(r["qid"], r["path"]) for r in best] == [(0, "b.md")]
    assert s.search_notes(asked, 2).filter("rank = 1").first()["title"] == "b"
    with pytest.raises(ValueError):
        s.search(asked, mode="other")
    with pytest.raises(ValueError):
        s.search(asked, rerank=True)


def test_pool_ignores_padding():
    import numpy as np

    hidden = np.array([[[3.0, 4.0], [9.0, 9.0]]], np.float32)
    assert np.allclose(dense.pool(hidden, np.array([[1, 0]])), [[0.6, 0.8]])


def test_embedder_pads_with_the_tokenizers_token():
    from types import SimpleNamespace as Fake

    model = dense.OnnxEmbedder.__new__(dense.OnnxEmbedder)
    seen = []

    def run(_, feed):
        seen.append(feed)
        return [np.stack([feed["input_ids"], feed["input_ids"] * 0 + 1], axis=2).astype(np.float32)]

    model.tokenizer = Fake(encode_batch=lambda texts: [Fake(ids=[len(w) for w in t.split()]) for t in texts], token_to_id=lambda name: 9 if name == "[PAD]" else None)
    model.session, model.inputs, model.max_tokens, model.pad = Fake(run=run), {"input_ids", "attention_mask"}, 4, dense.pad_id(model.tokenizer)
    got = model.embed(["a bb ccc", "dddd", "a a a a a a bbb"])
    means = np.array([[2.0, 1], [4, 1], [1.5, 1]])  # the long one keeps three and its last
    assert np.allclose(got, means / np.linalg.norm(means, axis=1, keepdims=True)) and seen[0]["input_ids"].tolist() == [[4, 9, 9, 9], [1, 2, 3, 9], [1, 1, 1, 3]]
    assert model.embed([]).shape[0] == 0


def test_reranker_scores_pairs_in_order(spark, tmp_path):
    def fake_reranker():
        """Logits are sums of the unmasked ids of the second text."""
        from types import SimpleNamespace as Fake

        def encode(q, p):
            a, b = ([len(w) for w in x.split()] for x in (q, p))
            return Fake(ids=a + b, type_ids=[0] * len(a) + [1] * len(b))

        names = ("input_ids", "attention_mask", "token_type_ids")
        session = Fake(get_inputs=lambda: [Fake(name=n) for n in names], run=lambda _, f: [(f["input_ids"] * f["attention_mask"] * f["token_type_ids"]).sum(axis=1)[:, None]])
        return dense.OnnxReranker(session, Fake(encode=encode, enable_truncation=lambda **_: None, token_to_id=lambda _: 77), batch=2)

    passages = ["a bb ccc", "", "dddd", "e e e e e", "ff"]
    assert fake_reranker().score([("some query", p) for p in passages]).tolist() == [6, 0, 4, 5, 2]
    rows = spark.createDataFrame([("some query", p) for p in passages] + [(None, None)], "q string, p string")
    got = {r["p"]: r["s"] for r in rows.select("p", dense.logit_column(fake_reranker)("q", "p").alias("s")).collect() if r["p"] is not None}
    assert got == dict(zip(passages, [6, 0, 4, 5, 2], strict=True))
    assert dense.load_reranker(None) is None and dense.load_reranker(str(tmp_path)) is None
    with pytest.raises(FileNotFoundError):
        dense.load_reranker(str(tmp_path), required=True)


def test_response(spark):
    notes = spark.createDataFrame([(0, "a/2026-01-02 t.md", 0.123456, [(1, 0.1), (0, 0.05)], 1)], "qid int, path string, score double, hits array<struct<index:int,score:double>>, rank int")
    chunks = spark.createDataFrame([("a/2026-01-02 t.md", 0, "", "first", 0), ("a/2026-01-02 t.md", 1, "H", "x" * 700, 0)], "path string, index int, heading_path string, text string, parent_id int")
    parents = spark.createDataFrame([("a/2026-01-02 t.md", 0, "H", "p" * 500 + "x" * 700)], "path string, id int, heading_path string, text string")
    row = serve.search_response(notes, chunks, parents).first()
    assert (row["title"], row["date"], row["score"], len(row["text"]), row["extras"], row["matched_chunks"]) == ("2026-01-02 t", "2026-01-02", 0.1235, 600, ["first"], 2)
    assert row["parent"].endswith("x" * 700) and serve.clamp_k(0) == 1 and serve.clamp_k(99) == 20
    cut = spark.range(1).select(serve.read_section(F.lit("abcdef"), 1, 3).alias("s")).first()["s"]
    assert (cut["text"], cut["truncated"]) == ("bcd…", True)
