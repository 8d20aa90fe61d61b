"""Retrieval quality: ranks of expected notes, hit rates, mean reciprocal rank, comparisons of runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelens.operators.noise import named

DEPTH, WORST = 10, 1_000_000_000


def load_questions(path: str) -> list[dict]:
    """``id, text, expected`` from JSON lines; blank lines are skipped, a bad line is named by its number."""
    out = []
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            if not line.strip():
                continue
            try:
                row = json.loads(line)
                text, expected = row["question"], row.get("expected", [])
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                raise ValueError(f"{path}, line {n}: not a question") from e
            out.append({"qid": row.get("id") or f"q{len(out) + 1}", "text": text, "expected": [expected] if isinstance(expected, str) else list(expected)})
    return out


def add_question(path: str, text: str, expected: list[str]) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"question": text, "expected": expected}, ensure_ascii=False) + "\n")


def eval_ranks(results: DataFrame, questions: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``qid, rank`` of the first expected note (null: not within ``depth``) for questions that expect something."""
    asked = questions.filter(F.size("expected") > 0)
    hits = results.filter(F.col("rank") <= depth).join(asked.select("qid", "expected"), "qid").filter(F.exists("expected", lambda e: named(F.col("path"), e)))
    return asked.select("qid").join(hits.groupBy("qid").agg(F.min("rank").alias("rank")), "qid", "left")


def eval_metrics(ranks: DataFrame) -> DataFrame:
    """One row ``n, hit1, hit5, mrr``; zeros where nothing was asked."""

    def share(most: int):
        return F.coalesce(F.avg(F.when(F.col("rank") <= most, 1.0).otherwise(0.0)), F.lit(0.0))

    return ranks.agg(F.count("*").alias("n"), share(1).alias("hit1"), share(5).alias("hit5"), F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """``qid, before, after, change`` of questions in both runs: better, worse or same."""
    b, a = F.coalesce("before", F.lit(WORST)), F.coalesce("after", F.lit(WORST))
    rows = before.select("qid", F.col("rank").alias("before")).join(after.select("qid", F.col("rank").alias("after")), "qid")
    return rows.withColumn("change", F.when(a < b, "better").when(a > b, "worse").otherwise("same"))


def format_report(metrics: dict, misses: list[str]) -> str:
    lines = [f"questions {metrics['n']}  hit@1 {metrics['hit1']:.3f}  hit@5 {metrics['hit5']:.3f}  MRR {metrics['mrr']:.3f}"]
    return "\n".join(lines + [f"missed: {m}" for m in misses])
