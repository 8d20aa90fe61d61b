"""The registered queries of the search engine and corpus analytics, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.functions import recency, text
from notelens.functions.scratch import Scratch
from notelens.operators import chunking, convert, dense, dupes, evaluate, fusion, indexing, lexical, noise, serve
from notelens.plans import sql
from notelens.sources import notes as sources
from notelens.sources.readers import html_column

SINGLE = "The retitioning of thorreou, and threea HTTPServer with RAG_VAULT don't"
TODAY = "2026-06-01"
#: Queries by vector, as many as the table asks for: ids divisible by this.
QUERY_EVERY = 100
QUESTIONS = [
    "güncel durum nedir",
    "Şu an neredeyiz?",
    "en son ne yaptık",
    "en son videoda ne var",
    "güncel sürüm hangisi",
    "durumu özetle",
    "son durum",
    "acil işler",
    "what is new",
    "Index of notes",
    "su an ne oldu",
    "",
]
PATHS = ["p/Proje - İndeks.md", "p/Devam Notu.md", "x/Güncel Durum.md", "x/Durum.md", "index/log.md", "a/Index (2026-01-02).md", "a/2026-02-30 2026-03-01 not.md", "Eski/kopya_1.md"]

#: name -> (query, SQL or None)
REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql_text: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        REGISTERED[f.__name__] = (f, sql_text)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.notes_of_documents(table(spark, sf_dir, "documents"))


def asked_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def inline(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    rows = F.posexplode(F.array(*[F.lit(v) for v in values])).alias("n", name)
    return spark.range(1).select(rows).withColumn("n", F.col("n").cast("long"))


def values_sql(values: list[str], name: str) -> str:
    quoted = ", ".join("(" + str(i) + ", '" + v.replace("'", "''") + "')" for i, v in enumerate(values))
    return f"(VALUES {quoted}) AS v(n, {name})"


# --- notes, text -------------------------------------------------------------------------


@query(f"WITH {sql.NOTES} SELECT path, 'doc_' || doc_id AS title, split_part(path, '/', 1) || ' > ' || split_part(path, '/', 2) AS folder FROM notes")
def note_listing(spark, sf_dir):
    return notes_of(spark, sf_dir).select("path", text.note_title(F.col("path")).alias("title"), text.note_folder(F.col("path")).alias("folder"))


@query(f"WITH {sql.NOTES} SELECT path, CAST(ceil(len({sql.blank_split('text')}) * 1.5) AS INTEGER) AS n_tokens FROM notes")
def token_counts(spark, sf_dir):
    return notes_of(spark, sf_dir).select("path", text.estimated_tokens(F.col("text")).alias("n_tokens"))


@query(f"WITH {sql.NOTES} SELECT path, term, count(*) AS tf FROM (SELECT path, unnest({sql.tokens('text')}) AS term FROM notes) GROUP BY ALL")
def tokenize_terms(spark, sf_dir):
    return lexical.postings(notes_of(spark, sf_dir), ["path"]).select("path", "term", "tf")


TEXTS = [SINGLE, "Konsey'in İĞÜŞÖÇ ığüşöç IĞDIR", "HTTPServer fooBar RAG_VAULT_ROOT a _ x2Y", "café naïve Straße ÀÉÎ", "Москвой йод Ёлка", "Ελλάδα Άνοιξη", "ﬁne ﬁ_HTTPServer", "ｆｕｌｌ １２３"]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts, and texts of many scripts with negative numbers."""
    hard = inline(spark, TEXTS, "q").select((-1 - F.col("n")).alias("n"), "q")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"), F.col("text").alias("q")).unionByName(hard)


_TEXTS = f"texts AS (SELECT item_id AS n, text AS q FROM benchmark UNION ALL SELECT -1 - n, q FROM {values_sql(TEXTS, 'q')})"


@query(f"WITH {_TEXTS} SELECT n, list_sort({sql.tokens('q', sql.fold_wide)}) AS tokens, {sql.words('q')} AS words FROM texts")
def fold_and_split(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    words = texts.select("n", text.copy_words(F.col("q")).alias("words"))
    return lexical.token_rows(texts, ["n"], "q").select("n", F.sort_array("tokens").alias("tokens")).join(words, "n")


@query(f"WITH {sql.NOTES} SELECT path, CASE WHEN length(text) > 600 THEN left(text, 599) || '…' ELSE text END AS clipped, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 170) AS snippet FROM notes")
def text_clips(spark, sf_dir):
    return notes_of(spark, sf_dir).select("path", text.clip(F.col("text")).alias("clipped"), text.snippet(F.col("text")).alias("snippet"))


# --- lexical -----------------------------------------------------------------------------


@query(f"WITH {sql.NOTES}, t AS (SELECT {sql.tokens('text')} AS toks FROM notes) SELECT count(*) AS n, round(avg(len(toks)), 6) AS avgdl FROM t")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(notes_of(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(
    f"""WITH {sql.NOTES}, p AS (SELECT DISTINCT path, unnest({sql.tokens('text')}) AS term FROM notes), n AS (SELECT count(*) AS n FROM notes)
SELECT term, count(*) AS df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM p, n GROUP BY term, n"""
)
def term_document_frequency(spark, sf_dir):
    notes = notes_of(spark, sf_dir)
    stats = notes.agg(F.count("*").alias("n"))
    return lexical.with_idf(lexical.frequency_of_texts(notes, ["path"]), stats).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {sql.NOTES}, one AS (SELECT 0 AS qid, '{SINGLE.replace(chr(39), chr(39) * 2)}' AS text), {sql.bm25('notes', 'one')} {sql.ranked('scores', 10, columns='path, score, rank')}")
def bm25_topk_single(spark, sf_dir):
    one = spark.range(1).select(F.col("id").alias("qid"), F.lit(SINGLE).alias("text"))
    return lexical.bm25_topk(notes_of(spark, sf_dir), one, ["path"], 10).select("path", "score", "rank")


_BATCH = f"WITH {sql.NOTES}, asked AS (SELECT item_id AS qid, text FROM benchmark), {sql.bm25('notes', 'asked')}"


@query(f"{_BATCH} {sql.ranked('scores', 10, columns='qid, path, score, rank')}")
def bm25_topk_batch(spark, sf_dir):
    return lexical.bm25_topk(notes_of(spark, sf_dir), asked_of(spark, sf_dir), ["path"], 10).select("qid", "path", "score", "rank")


# --- dense -------------------------------------------------------------------------------

_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    f"""WITH s AS (SELECT a.vec_id AS qid, b.vec_id, round({_DOT}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % {QUERY_EVERY} = 0)
SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 50"""
)
def dense_topk_batch(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries_ = vectors.filter(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return dense.dense_topk(vectors, queries_, ["vec_id"], 50)


@query(f"SELECT b.vec_id, round({_DOT}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY score DESC, b.vec_id LIMIT 10")
def dense_topk_single(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.filter("vec_id = 7").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return dense.dense_scores(vectors, one, ["vec_id"]).orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "score")


@query("SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9)) AS unit FROM embeddings")
def l2_normalize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(dense.l2_normalize(F.col("embedding")), lambda x: F.round(x, 9)).alias("unit"))


# --- fusion, rerank, boosts, grouping ----------------------------------------------------


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of the benchmark's texts and vectors of the same ids, fused; notes are keyed (path, 0)."""
    notes = notes_of(spark, sf_dir).withColumn("index", F.lit(0))
    asked = asked_of(spark, sf_dir)
    words = lexical.bm25_topk(notes, asked, fusion.KEYS, fusion.CANDIDATES)
    vectors = table(spark, sf_dir, "embeddings").join(notes.select("doc_id", "path", "index"), F.col("vec_id") == F.col("doc_id"))
    near = vectors.join(asked.select("qid"), F.col("vec_id") == F.col("qid")).select("qid", F.col("embedding").alias("q"))
    return fusion.rrf([words, dense.dense_topk(vectors, near, fusion.KEYS, fusion.CANDIDATES)])


def _named(notes: DataFrame, found: DataFrame) -> DataFrame:
    """The notes whose paths are found."""
    return notes.join(found.select("path").distinct(), "path", "left_semi")


_FUSED = f"""{_BATCH},
lex AS ({sql.ranked('scores', 50)}),
vec AS (SELECT path, CAST(embedding AS DOUBLE[]) AS v, vec_id FROM embeddings JOIN notes ON vec_id = doc_id),
near AS (SELECT a.vec_id AS qid, b.path, round(list_dot_product(a.v, b.v), 9) AS score FROM vec a JOIN asked ON asked.qid = a.vec_id, vec b),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM near) WHERE rank <= 50),
fused AS (SELECT qid, path, round(sum(1 / (60 + rank)), 12) AS score FROM (SELECT qid, path, rank FROM lex UNION ALL SELECT qid, path, rank FROM den) GROUP BY qid, path)"""


@query(f"{_FUSED} {sql.ranked('fused', 20, columns='qid, path, score, rank')}")
def rrf_hybrid(spark, sf_dir):
    return fusion.ranked(_fused(spark, sf_dir), fusion.KEYS, 20).select("qid", "path", "score", "rank")


@query(
    f"""{_FUSED},
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM fused),
seen AS (SELECT DISTINCT path, unnest({sql.tokens('text')}) AS term FROM notes),
logits AS (SELECT x.qid, x.path, count(s.term) - 10.0 AS logit FROM placed x LEFT JOIN q ON q.qid = x.qid LEFT JOIN seen s ON s.path = x.path AND s.term = q.term WHERE x.rank <= 40 GROUP BY x.qid, x.path),
r AS (SELECT x.*, 1 / (1 + exp(-logit)) AS sig FROM placed x LEFT JOIN logits USING (qid, path)),
f AS (SELECT *, min(CASE WHEN rank <= 40 THEN sig END) OVER (PARTITION BY qid) AS floor, max(CASE WHEN rank > 40 THEN score END) OVER (PARTITION BY qid) AS peak FROM r)
SELECT qid, path, rank, round(CASE WHEN rank <= 40 THEN sig ELSE 0.5 * floor * score / peak END, 9) AS score FROM f"""
)
def rerank_splice(spark, sf_dir):
    scratch = Scratch(spark, "rerank")
    fused = scratch.write(_fused(spark, sf_dir), "fused")
    first = scratch.write(fusion.rerank_candidates(fused), "first")
    terms = lexical.query_terms(asked_of(spark, sf_dir))
    # only candidates are read again, whole
    seen = lexical.postings(_named(notes_of(spark, sf_dir), first), ["path"]).select("path", "term")
    hits = first.select("qid", "path").join(terms, "qid").join(seen, ["path", "term"]).groupBy("qid", "path").agg(F.count("*").alias("c"))
    logits = first.join(hits, ["qid", "path"], "left").select("qid", *fusion.KEYS, (F.coalesce("c", F.lit(0)) - 10.0).alias("logit"))
    return fusion.rerank_splice(fused, logits).select("qid", "path", "rank", F.round("score", 9).alias("score"))


def dated_path() -> Column:
    day = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")), "yyyy-MM-dd")
    name = F.when(F.col("doc_id") % 10 == 0, "Devam").otherwise("doc")
    return F.concat_ws("/", "source", F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(day, F.lit(" "))), name, F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md")))


_DATED = """dated AS (SELECT *, source || '/' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE strftime(DATE '2025-01-01' + CAST(doc_id % 500 AS INTEGER), '%Y-%m-%d') || ' ' END
  || CASE WHEN doc_id % 10 = 0 THEN 'Devam' ELSE 'doc' END || '_' || doc_id || '.md' AS path FROM documents)"""
_FRESH = f"CASE WHEN d IS NULL THEN 0 ELSE pow(0.5, greatest(date_diff('day', d, DATE '{TODAY}'), 0) / 90.0) END"
_DAY = r"TRY_CAST(nullif(regexp_extract(path, '\d{4}-\d{2}-\d{2}'), '') AS DATE)"


@query(f"WITH {_DATED}, x AS (SELECT path, {_DAY} AS d FROM dated) SELECT path, d AS note_date, round({_FRESH}, 9) AS freshness FROM x")
def recency_freshness(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(dated_path().alias("path")).withColumn("note_date", recency.note_date(F.col("path")))
    return rows.select("path", "note_date", F.round(recency.freshness(F.col("note_date"), F.lit(TODAY).cast("date")), 9).alias("freshness"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", dated_path())
    return docs.select("path", F.lit(0).alias("index"), F.coalesce("text", F.lit("")).alias("text"))


#: Every third question asks where things stand, every third for what is recent.
def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("item_id") % 3 == 0, "neredeyiz ").when(F.col("item_id") % 3 == 1, "yeni ").otherwise("")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(kind, "text").alias("text"))


_TIMED = f"""WITH RECURSIVE {_DATED}, asked AS (SELECT item_id AS qid, CASE item_id % 3 WHEN 0 THEN 'neredeyiz ' WHEN 1 THEN 'yeni ' ELSE '' END || text AS text, item_id % 3 AS kind FROM benchmark),
{sql.bm25('dated', 'asked')},
top AS ({sql.ranked('scores', 50)}),
feat AS (SELECT path, {_DAY} AS d, path LIKE '%/%Devam%' AS status, split_part(path, '/', 1) AS unit FROM dated),
share AS (SELECT unit, count(*) / (SELECT count(*) FROM feat) AS share FROM feat GROUP BY unit),
best AS (SELECT t.qid, t.path, score, unit FROM top t JOIN feat USING (path) JOIN asked USING (qid) WHERE kind = 0 AND rank <= 15),
held AS (SELECT qid, unit, sum(score) / (SELECT sum(score) FROM best b WHERE b.qid = best.qid) AS part FROM best GROUP BY qid, unit),
focus AS (SELECT qid, unit FROM (SELECT qid, unit, row_number() OVER (PARTITION BY qid ORDER BY round(part * part / share, 9) DESC, unit) AS n FROM held JOIN share USING (unit) WHERE part >= 0.3 AND part / share >= 3) WHERE n = 1)"""


@query(
    f"""{_TIMED}
SELECT t.qid, t.path, round(CASE WHEN kind = 2 THEN score ELSE score * (1 + 0.05 * {_FRESH} + CASE WHEN kind = 0 AND status THEN 5.0 ELSE 0 END + CASE WHEN kind = 0 AND f.unit = feat.unit THEN 0.5 ELSE 0 END) END, 6) AS score
FROM top t JOIN feat USING (path) JOIN asked USING (qid) LEFT JOIN focus f ON f.qid = t.qid"""
)
def recency_boost(spark, sf_dir):
    notes, asked = _dated(spark, sf_dir), _timed(spark, sf_dir)
    top = lexical.bm25_topk(notes, asked, fusion.KEYS, fusion.CANDIDATES).select("qid", *fusion.KEYS, "score")
    boosted = fusion.boost(top, asked, fusion.note_features(notes), F.lit(TODAY).cast("date"))
    return boosted.select("qid", "path", F.round("score", 6).alias("score"))


@query(f"{_TIMED} SELECT * FROM focus")
def focus_unit(spark, sf_dir):
    notes, asked = _dated(spark, sf_dir), _timed(spark, sf_dir).filter(recency.is_state_query(F.col("text")))
    features = fusion.note_features(notes)
    return fusion.focus_units(lexical.bm25_topk(notes, asked, fusion.KEYS, fusion.CANDIDATES), features, fusion.unit_share(features))


@query("WITH u AS (SELECT source AS unit, doc_id FROM documents UNION ALL SELECT lang, doc_id FROM documents) SELECT unit, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 9) AS share FROM u GROUP BY unit")
def folder_unit_share(spark, sf_dir):
    return fusion.unit_share(fusion.note_features(notes_of(spark, sf_dir))).select("unit", F.round("share", 9).alias("share"))


def _asked_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text after one of the questions."""
    of_item = F.get(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("item_id") % len(QUESTIONS)).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"), F.concat(of_item, F.lit(" "), F.col("text")).alias("q"))


_ASKED_ABOUT = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + f"][item_id % {len(QUESTIONS)} + 1] || ' ' || text"
_TOKS = f"made AS (SELECT item_id AS n, {_ASKED_ABOUT} AS q FROM benchmark), toks AS (SELECT n, q, {sql.tokens('q')} AS t FROM made)"
_RECENT = "(list_has_any(t, ['guncel', 'son', 'simdi', 'neredeyiz', 'acil', 'yeni', 'bugun']) OR contains(' ' || array_to_string(t, ' ') || ' ', ' su an '))"
_STATE = r"""(regexp_matches(' ' || array_to_string(t, ' '), ' neredey') OR (regexp_matches(' ' || array_to_string(t, ' '), ' durum') AND """ + _RECENT + r""")
 OR contains(' ' || array_to_string(t, ' ') || ' ', ' su an ') OR regexp_matches(' ' || array_to_string(t, ' ') || ' ', ' en son (ne|hangi|neler|nelerdi|neydi) '))"""


@query(f"WITH {_TOKS} SELECT n, {_RECENT} AS recent, {_STATE} AS state FROM toks")
def question_class(spark, sf_dir):
    return _asked_about(spark, sf_dir).select("n", recency.is_recency_query(F.col("q")).alias("recent"), recency.is_state_query(F.col("q")).alias("state"))


_STATUS_PATH = "source || '/' || doc_id || '/' || [" + ", ".join("'" + p.replace("'", "''") + "'" for p in PATHS) + f"][doc_id % {len(PATHS)} + 1]"


@query(
    f"""WITH x AS (SELECT n, path, {sql.tokens("regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '')")} AS t FROM (SELECT doc_id AS n, {_STATUS_PATH} AS path FROM documents))
SELECT n, list_has_any(t, ['indeks', 'index', 'devam']) OR list_has_all(t, ['guncel', 'durum']) AS is_status,
  list_sort(list_intersect(list_distinct({sql.words('path')}), ['yedek', 'backup', 'kopya', 'copy', 'eski', 'old', 'arsiv', 'archive'])) AS hints FROM x"""
)
def status_notes_and_hints(spark, sf_dir):
    named = F.get(F.array(*[F.lit(p) for p in PATHS]), (F.col("doc_id") % len(PATHS)).cast("int"))
    paths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.concat_ws("/", "source", F.col("doc_id").cast("string"), named).alias("path"))
    return paths.select("n", recency.is_status_note(F.col("path")).alias("is_status"), dupes.path_hints(F.col("path")).alias("hints"))


# --- chunks ------------------------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks_of(notes_of(spark, sf_dir))


_WINDOWS = f"""WITH RECURSIVE {sql.NOTES}, sized AS (
  SELECT path, len({sql.blank_split('text')}) AS n, greatest(400 - 9, 100) AS lim FROM notes
), cut AS (SELECT *, lim // 2 AS w, lim // 2 - 25 AS step FROM sized WHERE n > 0),
k AS (SELECT *, CASE WHEN ceil(1.5 * n) <= lim THEN 1 WHEN n <= w THEN 1 ELSE CAST(ceil((n - w) / step) AS BIGINT) + 1 END AS k FROM cut),
m AS (SELECT *, n - step * (k - 1) AS m FROM k),
j AS (SELECT *, k > 1 AND ceil(1.5 * (w + m)) <= lim AS joined FROM m)"""


@query(
    f"""{_WINDOWS}, i AS (SELECT *, unnest(range(0, k - CASE WHEN joined THEN 1 ELSE 0 END)) AS i FROM j)
SELECT path, CAST(i AS INTEGER) AS index, CASE WHEN k = 1 THEN n WHEN joined AND i = k - 2 THEN w + m WHEN i = k - 1 THEN m ELSE w END AS n_words FROM i"""
)
def chunk_windows(spark, sf_dir):
    return _chunks(spark, sf_dir).select("path", "index", F.size(text.blank_split(F.col("text"))).cast("long").alias("n_words"))


@query()
def heading_sections(spark, sf_dir):
    return chunking.chunks_of(sources.notes_of_conversations(table(spark, sf_dir, "conversations"))).select("path", "index", "heading_path", "text", "parent_id")


@query()
def parent_sections(spark, sf_dir):
    return chunking.parents_of(sources.notes_of_conversations(table(spark, sf_dir, "conversations")))


def _chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    embedded = chunks.withColumn("embed_text", text.embed_text(F.col("path"), F.col("tags"), F.col("heading_path"), F.col("text")))
    return lexical.bm25_topk(embedded, asked_of(spark, sf_dir), fusion.KEYS, fusion.CANDIDATES, "embed_text")


@query()
def max_per_note(spark, sf_dir):
    return fusion.cap_per_note(_chunk_scores(spark, sf_dir).drop("rank"), 1, 5).select("qid", "path", "index", "score", "rank")


@query()
def note_grouping(spark, sf_dir):
    return fusion.group_notes(_chunk_scores(spark, sf_dir).drop("rank"), 5)


@query()
def search_response(spark, sf_dir):
    found = Scratch(spark, "response").write(fusion.group_notes(_chunk_scores(spark, sf_dir).drop("rank"), 5), "notes")
    # a note's chunks come from that note alone, so only notes that are found are cut again
    notes = _named(notes_of(spark, sf_dir), found)
    return serve.search_response(found, chunking.chunks_of(notes), chunking.parents_of(notes))


_MADE = """made AS (SELECT doc_id % 25 AS qid, source AS path, doc_id AS index, round(((doc_id * 7919) % 1009) / 1009.0, 9) AS score FROM documents)"""


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(((F.col("doc_id") * 7919) % 1009) / 1009.0, 9)
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 25).alias("qid"), F.col("source").alias("path"), F.col("doc_id").alias("index"), score.alias("score"))


@query(
    f"""WITH {_MADE}, c AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY score DESC, index) AS m FROM made), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path, index) AS rank FROM c WHERE m <= 2)
SELECT qid, path, index, score, rank FROM r WHERE rank <= 10"""
)
def cap_per_note(spark, sf_dir):
    return fusion.cap_per_note(_made(spark, sf_dir), 2, 10)


@query(
    f"""WITH {_MADE}, c AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY score DESC, index) AS m FROM made),
g AS (SELECT qid, path, round(sum(CASE WHEN m = 1 THEN score WHEN m <= 3 THEN 0.1 * score ELSE 0 END), 9) AS score, count(*) AS n_hits, min(CASE WHEN m = 1 THEN index END) AS best FROM c GROUP BY qid, path)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM g) WHERE rank <= 10"""
)
def group_by_note(spark, sf_dir):
    grouped = fusion.group_notes(_made(spark, sf_dir), 10)
    return grouped.select("qid", "path", "score", F.size("hits").cast("long").alias("n_hits"), F.get("hits", F.lit(0))["index"].alias("best"), "rank")


# --- copies ------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dupes.note_words(notes_of(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_of(spark, sf_dir)
    return dupes.pair_overlaps(dupes.note_shingles(notes), notes=notes)


@query(f"WITH {sql.NOTES}, {sql.shingled()} SELECT a, b, shared, round(ratio, 9) AS ratio FROM pairs")
def shingle_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", "shared", F.round("ratio", 9).alias("ratio"))


@query(f"WITH {sql.NOTES}, w AS (SELECT path, array_to_string({sql.words('text')}, ' ') AS j, len({sql.words('text')}) AS n FROM notes), g AS (SELECT *, count(*) OVER (PARTITION BY j) AS c, min(path) OVER (PARTITION BY j) AS first FROM w WHERE n >= 30) SELECT path, first, c AS copies FROM g WHERE c > 1")
def exact_copies(spark, sf_dir):
    words = _words(spark, sf_dir).filter(F.size("words") >= dupes.MIN_WORDS)
    groups = words.groupBy("full_hash").agg(F.min("path").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    return words.join(groups, "full_hash").select("path", "first", "copies")


@query(
    f"""WITH RECURSIVE {sql.NOTES}, {sql.shingled()}, e AS (SELECT a, b FROM pairs WHERE ratio >= 0.9 UNION SELECT b, a FROM pairs WHERE ratio >= 0.9),
reach AS (SELECT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a) SELECT min(y) AS root, x AS path FROM reach GROUP BY x"""
)
def dup_components(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return dupes.grouped(pairs.filter(F.col("ratio") >= dupes.OVERLAP))


@query()
def dup_groups(spark, sf_dir):
    return dupes.find_duplicates(_chunks(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {sql.NOTES}, {sql.shingled()}, g AS (SELECT path, split_part(path, '/', 1) AS root FROM notes),
o AS (SELECT g.root, g.path, s FROM sh JOIN g USING (path)), h AS (SELECT root, s, count(*) AS c FROM o GROUP BY root, s),
c AS (SELECT root, path, avg(CASE WHEN c > 1 THEN 1.0 ELSE 0.0 END) AS covered FROM o JOIN h USING (root, s) GROUP BY root, path)
SELECT g.root, g.path, round(coalesce(covered, 0), 9) AS covered FROM g LEFT JOIN c USING (root, path)"""
)
def covered_share(spark, sf_dir):
    owned = notes_of(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("root"), "path", "text")
    return dupes.covered(owned).select("root", "path", F.round("covered", 9).alias("covered"))


_LINKED = """linked AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN '[[doc_' || (doc_id // 2) || '|x]] and [[src/doc_' || (doc_id + 1) || '.md#y]]' WHEN doc_id % 3 = 1 THEN '[[DOC_' || (doc_id // 5) || ']]' ELSE '' END AS text FROM notes)"""


@query(
    rf"""WITH {sql.NOTES}, {_LINKED}, l AS (SELECT path, unnest(regexp_extract_all(text, '\[\[([^\]|#\n]+)', 1)) AS link FROM linked),
n AS (SELECT path AS source, lower(regexp_replace(regexp_extract(link, '[^/]*$'), '(?i)\.md$', '')) AS title FROM l),
i AS (SELECT p.path, count(DISTINCT source) AS c FROM n JOIN notes p ON 'doc_' || p.doc_id = title AND p.path <> source GROUP BY p.path),
o AS (SELECT path, count(*) AS c FROM l GROUP BY path)
SELECT path, coalesce(i.c, 0) AS inbound, coalesce(o.c, 0) AS outbound FROM notes LEFT JOIN i USING (path) LEFT JOIN o USING (path)"""
)
def link_counts(spark, sf_dir):
    n = F.col("doc_id")
    first = F.concat(F.lit("[[doc_"), F.floor(n / 2).cast("string"), F.lit("|x]] and [[src/doc_"), (n + 1).cast("string"), F.lit(".md#y]]"))
    second = F.concat(F.lit("[[DOC_"), F.floor(n / 5).cast("string"), F.lit("]]"))
    linked = notes_of(spark, sf_dir).select("path", F.when(n % 3 == 0, first).when(n % 3 == 1, second).otherwise("").alias("text"))
    return dupes.link_counts(linked)


# --- noise -------------------------------------------------------------------------------


def _whole_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as one chunk each."""
    return notes_of(spark, sf_dir).select("path", F.lit(0).alias("index"), F.lit("").alias("heading_path"), "text")


def _appearances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = _whole_notes(spark, sf_dir)
    made = noise.make_queries(chunks)
    results = lexical.bm25_topk(chunks, made, ["path"], noise.TOP)
    return chunks, made, noise.count_appearances(results, made)


_PICK = "CAST('0x' || substr(md5({0}), 1, 12) AS BIGINT)"
_NOISE = f"""WITH {sql.NOTES}, ws AS (SELECT path, {sql.blank_split('text')} AS w FROM notes),
drawn AS (SELECT path, w, '7|' || path || '|' || s AS name FROM ws, (VALUES (1), (2)) v(s) WHERE len(w) >= 12),
starts AS (SELECT *, {_PICK.format("name || '|start'")} % (len(w) - 11) AS start FROM drawn),
asked AS (SELECT 't|' || path AS qid, regexp_extract(path, 'doc_\\d+') AS text, path AS own FROM notes
  UNION ALL SELECT 's|' || name, array_to_string(list_slice(w, start + 1, start + 12), ' '), path FROM starts),
{sql.bm25('notes', 'asked')}, top AS ({sql.ranked('scores', 5)}),
seen AS (SELECT top.path, count(*) AS appearances FROM top JOIN asked USING (qid) WHERE top.path <> own GROUP BY top.path)"""


@query(f"{_NOISE} SELECT path, appearances FROM seen")
def noise_appearances(spark, sf_dir):
    return _appearances(spark, sf_dir)[2]


@query(
    f"""{_NOISE}, n AS (SELECT count(*) AS n FROM asked), r AS (SELECT path, appearances, appearances / n AS rate FROM seen, n),
h AS (SELECT * FROM r WHERE rate >= (SELECT greatest(0.005, 3 * median(rate)) FROM r))
SELECT path, appearances, round(rate, 9) AS rate, CAST(len({sql.words('text')}) AS INTEGER) AS words,
  CASE WHEN len({sql.words('text')}) >= 3000 THEN ['long', 'orphan', 'unstructured'] ELSE ['orphan', 'unstructured'] END AS flags, 'strong' AS strength FROM h JOIN notes USING (path)"""
)
def noise_hubs(spark, sf_dir):
    chunks, made, counts = _appearances(spark, sf_dir)
    # a title for each note that has one, and snippets for each that is long enough
    found = noise.find_noise(chunks, counts, made.count())
    return found.select("path", "appearances", F.round("rate", 9).alias("rate"), "words", "flags", "strength")


# --- evaluation --------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions of three words of every note that is long enough, which is what they expect; half expect its folder."""
    notes = notes_of(spark, sf_dir)
    w = text.blank_split(F.col("text"))
    few = notes.filter(F.size(w) >= 9)
    expected = F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.substring_index("path", "/", 2), F.lit("/")))
    return notes, few.select(F.col("doc_id").alias("qid"), F.array_join(F.slice(w, 4, 3), " ").alias("text"), F.array(expected).alias("expected"))


_EVAL = f"""WITH {sql.NOTES}, few AS (SELECT doc_id, path, {sql.blank_split('text')} AS w FROM notes),
asked AS (SELECT doc_id AS qid, array_to_string(list_slice(w, 4, 6), ' ') AS text, CASE WHEN doc_id % 2 = 0 THEN path ELSE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' END AS e FROM few WHERE len(w) >= 9),
{sql.bm25('notes', 'asked')}, top AS ({sql.ranked('scores', 10)}),
hit AS (SELECT qid, min(rank) AS rank FROM top JOIN asked USING (qid) WHERE path = e OR (e LIKE '%/' AND starts_with(path, e)) GROUP BY qid),
ranks AS (SELECT asked.qid, hit.rank FROM asked LEFT JOIN hit USING (qid))"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes, asked = _labelled(spark, sf_dir)
    return evaluate.eval_ranks(lexical.bm25_topk(notes, asked, ["path"], evaluate.DEPTH), asked)


@query(f"{_EVAL} SELECT qid, rank FROM ranks")
def eval_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(
    f"""{_EVAL} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 9) AS hit1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS hit5,
round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM ranks"""
)
def eval_metrics(spark, sf_dir):
    return evaluate.eval_metrics(_ranks(spark, sf_dir)).select("n", *[F.round(c, 9).alias(c) for c in ("hit1", "hit5", "mrr")])


def _run(offset: int) -> Column:
    place = (F.col("item_id") * 31 + offset) % 13
    return F.when(place < 10, place + 1)


@query(
    """WITH r AS (SELECT item_id AS qid, CASE WHEN (item_id * 31) % 13 < 10 THEN (item_id * 31) % 13 + 1 END AS before, CASE WHEN (item_id * 31 + 5) % 13 < 10 THEN (item_id * 31 + 5) % 13 + 1 END AS after FROM benchmark)
SELECT *, CASE WHEN coalesce(after, 1000000000) < coalesce(before, 1000000000) THEN 'better' WHEN coalesce(after, 1000000000) > coalesce(before, 1000000000) THEN 'worse' ELSE 'same' END AS change FROM r"""
)
def eval_compare(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return evaluate.compare(items.select(F.col("item_id").alias("qid"), _run(0).alias("rank")), items.select(F.col("item_id").alias("qid"), _run(5).alias("rank")))


# --- index upkeep, conversion ------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    notes = notes_of(spark, sf_dir)
    n, size = F.col("doc_id"), F.octet_length("text").cast("long")
    old = notes.filter(n % 10 != 3).select("path", (n * 1000).alias("mtime_ns"), size.alias("size"))
    new = notes.filter(n % 10 != 4).select("path", (n * 1000 + F.when(n % 10 == 5, 1).otherwise(0)).alias("mtime_ns"), (size + F.when(n % 10 == 6, 1).otherwise(0)).alias("size"))
    return old, new


@query(f"WITH {sql.NOTES} SELECT path, CASE WHEN doc_id % 10 = 4 THEN 'deleted' ELSE 'changed' END AS change FROM notes WHERE doc_id % 10 IN (3, 4, 5, 6)")
def manifest_diff(spark, sf_dir):
    return indexing.manifest_diff(*_snapshots(spark, sf_dir))


@query(f"WITH {sql.NOTES} SELECT path, CASE WHEN doc_id % 10 IN (3, 5, 6) THEN 'new' ELSE 'kept' END AS version FROM notes WHERE doc_id % 10 <> 4")
def incremental_carry_over(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    changes = indexing.manifest_diff(old, new)
    kept = indexing.carry_over(old.select("path", F.lit("kept").alias("version")), changes)
    return kept.unionByName(changes.filter("change = 'changed'").select("path", F.lit("new").alias("version")))


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files to convert; a third has no sidecar, a few have one of another origin, the rest are current or stale."""
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    kind = F.when(n % 5 == 0, "pdf").otherwise("html")
    sources_ = pages.select(F.concat(F.lit("p/"), n.cast("string"), F.lit(".x")).alias("path"), kind.alias("kind"), F.octet_length("html").cast("string").alias("version"))
    producer = F.when(n % 9 == 1, "other").otherwise(convert.PRODUCER)
    held = F.when(n % 4 == 1, "0").otherwise(F.octet_length("html").cast("string"))
    sidecars = pages.filter(n % 3 != 0).select(F.concat(F.lit("p/"), n.cast("string"), F.lit(".x.md")).alias("path"), producer.alias("producer"), held.alias("source_version"))
    return convert.plan(sources_, sidecars)


_PLANNED = """planned AS (SELECT 'p/' || page_id || '.x' AS path, CASE WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'html' END AS kind,
  CASE WHEN page_id % 3 = 0 THEN 'new' WHEN page_id % 9 = 1 THEN 'foreign' WHEN page_id % 4 = 1 AND strlen(html) > 0 THEN 'refresh' ELSE 'current' END AS status FROM pages)"""


@query(f"WITH {_PLANNED} SELECT status, kind, count(*) AS n FROM planned GROUP BY GROUPING SETS ((status), (kind))")
def status_kind_counts(spark, sf_dir):
    return convert.status_counts(_planned(spark, sf_dir))


@query(f"WITH {_PLANNED} SELECT path, kind, status FROM planned ORDER BY list_position(['new', 'refresh', 'foreign', 'current'], status), path LIMIT 200")
def conversion_list(spark, sf_dir):
    return convert.listed(_planned(spark, sf_dir))


@query()
def html_to_markdown(spark, sf_dir):
    return html_column(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in REGISTERED.items() if s}
