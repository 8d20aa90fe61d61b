"""Reciprocal rank fusion, rerank splice, recency and focus boosts, per-note caps and note grouping.

Rows are keyed ``qid, path, index``; every order ends in a unique key. A batch of queries is
one plan: nothing here loops over queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelens.functions import recency
from notelens.operators.dense import dense_topk
from notelens.operators.lexical import PLACES, bm25_topk, query_terms, ranked, score_postings

KEYS = ["path", "index"]
RRF_K, CANDIDATES, RERANK_TOP = 60, 50, 40
RECENCY_WEIGHT, STATUS_WEIGHT, PROJECT_WEIGHT = 0.05, 5.0, 0.5
FOCUS_TOP, FOCUS_MIN_SHARE, FOCUS_MIN_LIFT = 15, 0.3, 3.0
EXTRA_WEIGHT, EXTRA_CHUNKS = 0.10, 2
LIMIT_OF_LOGITS = 60.0
MODES = ("hybrid", "dense", "bm25")


def rrf(rankings: list[DataFrame], keys: list[str] = KEYS, k: int = RRF_K) -> DataFrame:
    """``qid, keys, score``: the sum of 1 / (k + rank) over rankings (``qid, keys, rank``)."""
    union = rankings[0].select("qid", *keys, "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select("qid", *keys, "rank"))
    return union.groupBy("qid", *keys).agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("score"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(LIMIT_OF_LOGITS)), F.lit(-LIMIT_OF_LOGITS))))


def rerank_candidates(fused: DataFrame, keys: list[str] = KEYS, top: int = RERANK_TOP) -> DataFrame:
    return ranked(fused, keys, top)


def rerank_splice(fused: DataFrame, logits: DataFrame, keys: list[str] = KEYS, top: int = RERANK_TOP) -> DataFrame:
    """The best ``top`` get the sigmoid of their logit; the rest keep their order below half of the least of these."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *keys)
    of_query = Window.partitionBy("qid")
    rows = fused.withColumn("rank", F.row_number().over(order)).join(logits.select("qid", *keys, "logit"), ["qid", *keys], "left")
    first = F.col("rank") <= top
    floor = F.min(F.when(first, sigmoid(F.col("logit")))).over(of_query)
    peak = F.max(F.when(~first, F.col("score"))).over(of_query)
    spliced = F.when(first, sigmoid(F.col("logit"))).otherwise(0.5 * floor * F.col("score") / peak)
    return rows.select("qid", *keys, "rank", spliced.alias("score"), F.when(first, spliced).alias("rerank_score"))


def note_features(paths: DataFrame) -> DataFrame:
    """``path, note_date, is_status, units`` of every distinct path."""
    p = F.col("path")
    return paths.select("path").distinct().select("path", recency.note_date(p).alias("note_date"), recency.is_status_note(p).alias("is_status"), recency.folder_units(p).alias("units"))


def unit_share(features: DataFrame) -> DataFrame:
    """``unit, share``: the share of notes below each folder."""
    n = features.agg(F.count("*").alias("n"))
    return features.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("unit", (F.col("c") / F.col("n")).alias("share"))


def focus_units(scored: DataFrame, features: DataFrame, shares: DataFrame, top: int = FOCUS_TOP) -> DataFrame:
    """``qid, unit``: the folder that a query's best notes lie in far more than notes do, if there is one."""
    best = scored.groupBy("qid", "path").agg(F.max("score").alias("weight"))
    best = ranked(best, ["path"], top, "weight").join(features.select("path", "units"), "path")
    total = F.sum("weight").over(Window.partitionBy("qid"))
    in_unit = best.withColumn("total", total).select("qid", "total", "weight", F.explode("units").alias("unit")).groupBy("qid", "unit", "total").agg(F.sum("weight").alias("weight"))
    rated = in_unit.filter("total > 0").withColumn("of_query", F.col("weight") / F.col("total")).join(shares, "unit").withColumn("lift", F.col("of_query") / F.col("share"))
    fit = rated.filter((F.col("of_query") >= FOCUS_MIN_SHARE) & (F.col("lift") >= FOCUS_MIN_LIFT)).withColumn("score", F.round(F.col("of_query") * F.col("lift"), PLACES))
    return ranked(fit, ["unit"], 1).select("qid", "unit")


def boost(scored: DataFrame, queries: DataFrame, features: DataFrame, today: Column, *, recency_mode: bool | None = None, half_life: float = recency.HALF_LIFE_DAYS) -> DataFrame:
    """Scores times 1 + recency, status and focus weights.

    Recency counts for queries that ask for the present (``recency_mode`` forces it on or off);
    status and focus count for those of them that ask where things stand.
    """
    active = recency.is_recency_query(F.col("text")) if recency_mode is None else F.lit(recency_mode)
    asked = queries.select("qid", active.alias("active"), (active & recency.is_state_query(F.col("text"))).alias("state"))
    rows = scored.join(features, "path").join(asked, "qid")
    # an inner join stays above the ranking, so both branches read the same exchange and nothing is scored twice
    focus = focus_units(scored.join(asked.filter("state").select("qid"), "qid"), features, unit_share(features)).withColumnRenamed("unit", "focus")
    rows = rows.join(focus, "qid", "left")
    bonus = (
        RECENCY_WEIGHT * recency.freshness(F.col("note_date"), today, half_life)
        + F.when(F.col("state") & F.col("is_status"), STATUS_WEIGHT).otherwise(0.0)
        + F.when(F.col("state") & F.coalesce(F.array_contains("units", F.col("focus")), F.lit(False)), PROJECT_WEIGHT).otherwise(0.0)
    )
    return rows.withColumn("score", F.when(F.col("active"), F.col("score") * (1 + bonus)).otherwise(F.col("score"))).select(*scored.columns)


def cap_per_note(scored: DataFrame, max_per_note: int, k: int, keys: list[str] = KEYS) -> DataFrame:
    """The best ``k`` of each query with at most ``max_per_note`` of one note."""
    within = Window.partitionBy("qid", "path").orderBy(F.desc("score"), *keys)
    few = scored.withColumn("in_note", F.row_number().over(within)).filter(F.col("in_note") <= max_per_note).drop("in_note")
    return ranked(few, keys, k)


def group_notes(scored: DataFrame, k: int, keys: list[str] = KEYS) -> DataFrame:
    """``qid, path, score, hits, rank``: a note's best chunk plus a tenth of its next two; hits best first."""
    within = Window.partitionBy("qid", "path").orderBy(F.desc("score"), *keys)
    rows = scored.withColumn("place", F.row_number().over(within))
    weight = F.when(F.col("place") == 1, 1.0).when(F.col("place") <= 1 + EXTRA_CHUNKS, EXTRA_WEIGHT).otherwise(0.0)
    hits = F.transform(F.sort_array(F.collect_list(F.struct("place", "index", F.col("score").alias("chunk_score")))), lambda h: F.struct(h["index"].alias("index"), h["chunk_score"].alias("score")))
    notes = rows.groupBy("qid", "path").agg(F.round(F.sum(F.col("score") * weight), PLACES).alias("score"), hits.alias("hits"))
    return ranked(notes, ["path"], k)


def date_and_title(notes: DataFrame) -> DataFrame:
    from notelens.functions.text import note_title

    return notes.withColumns({"title": note_title(F.col("path")), "note_date": recency.note_date(F.col("path"))})


@dataclass(frozen=True)
class Searcher:
    """Chunks (``path, index, embed_text``) and vectors (``path, index, embedding``) that queries are asked of.

    ``embed`` turns ``queries(qid, text)`` into ``(qid, q)``; ``rerank`` turns candidates
    ``(qid, path, index)`` into ``(qid, path, index, logit)``.
    """

    chunks: DataFrame
    vectors: DataFrame | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None

    def lexical_topk(self, asked: DataFrame, k: int) -> DataFrame:
        return bm25_topk(self.chunks, asked, KEYS, k, "embed_text")

    def features(self) -> DataFrame:
        return note_features(self.chunks)

    def scored(self, queries: DataFrame, mode: str = "hybrid", rerank: bool = False, recency_mode: bool | None = None, today: Column | None = None) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"unknown mode: {mode}")
        if rerank and self.rerank is None:
            raise ValueError("no reranker is set up")
        if mode != "bm25" and (self.vectors is None or self.embed is None):
            raise ValueError(f"mode {mode} needs vectors and an embedder")
        asked = queries.filter(F.length(F.trim("text")) > 0)
        rankings = []
        if mode != "dense":
            rankings.append(self.lexical_topk(asked, CANDIDATES))
        if mode != "bm25":
            rankings.append(dense_topk(self.vectors, self.embed(asked), KEYS, CANDIDATES))
        fused = rrf(rankings)
        if rerank:
            fused = rerank_splice(fused, self.rerank(asked, rerank_candidates(fused))).select("qid", *KEYS, "score")
        if recency_mode is not False:
            fused = boost(fused, asked, self.features(), today if today is not None else F.current_date(), recency_mode=recency_mode)
        return fused

    def search(self, queries: DataFrame, k: int = 5, max_per_note: int | None = None, **how) -> DataFrame:
        scored = self.scored(queries, **how)
        return ranked(scored, KEYS, k) if max_per_note is None else cap_per_note(scored, max_per_note, k)

    def search_notes(self, queries: DataFrame, k: int = 5, **how) -> DataFrame:
        return date_and_title(group_notes(self.scored(queries, **how), k))


@dataclass(frozen=True)
class IndexSearcher(Searcher):
    """The same searches on tables of an index (``indexing.Index``): no text is tokenised but the queries'."""

    postings: DataFrame | None = None
    term_stats: DataFrame | None = None
    corpus_stats: DataFrame | None = None
    notes: DataFrame | None = None

    @classmethod
    def of(cls, index, embed: Callable[[DataFrame], DataFrame] | None = None, rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> IndexSearcher:
        names = ("postings", "term_stats", "corpus_stats", "notes")
        return cls(index.table("chunks"), index.table("vectors"), embed, rerank, *map(index.table, names))

    def lexical_topk(self, asked: DataFrame, k: int) -> DataFrame:
        return ranked(score_postings(self.postings, self.term_stats, self.corpus_stats, query_terms(asked), KEYS), KEYS, k)

    def features(self) -> DataFrame:
        return self.notes
