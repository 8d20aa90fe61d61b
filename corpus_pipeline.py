"""A training corpus from raw documents: quality, near duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.llm import substring
from notelens.llm.jaccard import near_duplicate_rows, text_hash
from notelens.llm.packing import pack
from notelens.llm.quality import score
from notelens.llm.queries import quality_classifier
from notelens.llm.scratch import Scratch, read_table, split_by

#: Columns of the stages' own, apart from any that documents may have.
SCORE, REMOVED = "__score", ("__n_words", "__n_removed", "__kept")
#: A document whose score is lower goes.
LEAST_SCORE = 0.5

#: No SQL: scores come from a fitted classifier, ids from a tokeniser, places from a packing heuristic.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return score(docs, quality_classifier(spark, sf_dir, docs), SCORE).filter(F.col(SCORE) >= LEAST_SCORE).drop(SCORE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate component.

    Rows that repeat an id and text are one document; rows of one id and different texts are
    decided each, and of several in one component that of the least hash stays. A row without an id stays.
    """
    scratch = Scratch(spark, "pipeline")
    found = scratch.write(near_duplicate_rows(docs), "components")
    gone = found.filter("doc_id <> component_id or text_hash <> component_hash").filter("doc_id is not null").select("doc_id", "text_hash").distinct()
    clear, rest = split_by(docs, F.xxhash64("doc_id"), gone.select(F.xxhash64("doc_id")))
    gone = gone.select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"))
    rest = rest.join(gone, (rest["doc_id"] == F.col("__doc_id")) & (text_hash(rest["text"]) == F.col("__text_hash")), "left_anti")
    kept = clear.unionByName(rest.select(*docs.columns))
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    once, again = kept.join(repeated, "doc_id", "left_anti"), kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that stand elsewhere as well."""
    kept = substring.removed(docs, REMOVED)
    text = F.col(REMOVED[-1])
    return kept.withColumn("text", text).withColumn("n_chars", F.length(text).cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with the sequences they are packed into."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", one_of_near_copies), ("substring dedup", without_repeats), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{n}")
        if n:
            scratch.drop(f"stage-{n - 1}")
    return docs
