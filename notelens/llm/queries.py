"""The registered queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.llm import ann, chat, near_vectors, quality, substring, warc
from notelens.llm.bpe_codec import codec_digests
from notelens.llm.jaccard import near_duplicates
from notelens.llm.packing import pack
from notelens.llm.scratch import read_table
from notelens.llm.token_count import count_tokens


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def quality_classifier(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Classifier:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(~quality.held_out(F.col("doc_id")))
    return quality.fit(docs, labels)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_classifier(spark, sf_dir, docs))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    read = chat.read_back(chat.format_conversations(read_table(spark, sf_dir, "conversations").select(*columns).unionByName(hard)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), marked AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w IS DISTINCT FROM role AS fresh FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 7
    + CASE WHEN fresh THEN length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\n')) + 5 ELSE 0 END AS chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(y) AS component_id
FROM documents d JOIN reach ON d.doc_id = x LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), 20)


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return count_tokens(read_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(read_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM split)
), again AS (
  SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM again
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM split
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t, count(*) AS n FROM words ANTI JOIN covered ON words.doc_id = covered.doc_id AND words.i = covered.i GROUP BY words.doc_id
)
SELECT s.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = warc.archive(read_table(spark, sf_dir, "pages"))
    return warc.read_archives(index)


OP8_SQL = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM kept
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM vectors
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
)
SELECT x AS vec_id, (SELECT count(*) FROM links WHERE links.x = least.x) AS n_links, y AS component_id, x = y AS kept FROM least
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pack": op1_pack, "op2_quality": op2_quality, "op3_chat": op3_chat, "op4_jaccard": op4_jaccard, "op5_ann": op5_ann, "op6_token_count": op6_token_count, "op7_substring": op7_substring, "op8_warc": op8_warc, "op9_bpe": op9_bpe, "op10_near_vectors": op10_near_vectors}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3_SQL, "op4_jaccard": OP4_SQL, "op7_substring": OP7_SQL, "op8_warc": OP8_SQL, "op10_near_vectors": OP10_SQL}
