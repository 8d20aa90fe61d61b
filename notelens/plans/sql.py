"""Pieces of the SQL that says the same as the queries."""

from __future__ import annotations

LETTERS = r"[\p{L}\p{N}_]"


def fold(x: str) -> str:
    return f"strip_accents(lower(translate({x}, 'İIı', 'iii')))"


def fold_wide(x: str) -> str:
    """The same for texts with these compatibility letters, which ``strip_accents`` leaves alone."""
    return f"replace(translate({fold(x)}, 'ｆｕｌ１２３', 'ful123'), 'ﬁ', 'fi')"


def _parts(x: str) -> str:
    low_up = r"'([a-zçğıöşü0-9])([A-ZÇĞİÖŞÜ])', '\1 \2', 'g'"
    up_word = r"'([A-ZÇĞİÖŞÜ])([A-ZÇĞİÖŞÜ][a-zçğıöşü])', '\1 \2', 'g'"
    return f"list_filter(string_split(regexp_replace(regexp_replace(replace({x}, '_', ' '), {low_up}), {up_word}), ' '), lambda p: p <> '')"


def tokens(x: str, fold=fold) -> str:
    runs = f"regexp_extract_all(regexp_replace({x}, '[''’‘`´]{LETTERS}*', '', 'g'), '{LETTERS}+')"
    of_run = f"CASE WHEN len({_parts('r')}) > 1 THEN list_prepend({fold('r')}, list_transform({_parts('r')}, lambda s: {fold('s')})) WHEN len({_parts('r')}) = 1 THEN [{fold('r')}] ELSE [] END"
    return f"list_filter(flatten(list_transform({runs}, lambda r: {of_run})), lambda t: length(t) > 1)"


def words(x: str) -> str:
    """Words of the duplicate analysis."""
    return rf"regexp_extract_all(lower(translate({x}, 'İIıĞğÜüŞşÖöÇç', 'iiigguussoocc')), '[\p{{L}}\p{{N}}]+')"


def blank_split(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"


NOTES = "notes AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.md' AS path, coalesce(text, '') AS text FROM documents)"


def bm25(texts: str, asked: str, keys: str = "path") -> str:
    """CTEs up to ``scores(qid, keys, score)`` over tables ``texts(keys, text)`` and ``asked(qid, text)``."""
    return f"""
t AS (SELECT {keys}, {tokens("text")} AS toks FROM {texts}),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
p AS (SELECT {keys}, dl, term, count(*) AS tf FROM (SELECT {keys}, len(toks) AS dl, unnest(toks) AS term FROM t) GROUP BY ALL),
d AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term, n),
q AS (SELECT DISTINCT qid, unnest({tokens("text")}) AS term FROM {asked}),
scores AS (
  SELECT qid, {keys}, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM p JOIN q USING (term) JOIN d USING (term), st GROUP BY qid, {keys}
)"""


def ranked(table: str, k: int, keys: str = "path", columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {keys}) AS rank FROM {table} WHERE score > 0) WHERE rank <= {k}"


def shingled(notes: str = "notes") -> str:
    """CTEs ``w(path, words)``, ``sh(path, s)`` and ``sz(path, n)`` of the duplicate analysis."""
    return f"""
w AS (SELECT path, {words("text")} AS words FROM {notes}),
sh AS (SELECT DISTINCT path, array_to_string(list_slice(words, i, i + 7), ' ') AS s FROM (SELECT path, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 30)),
sz AS (SELECT path, count(*) AS n FROM sh GROUP BY path),
fit AS (SELECT s FROM sh GROUP BY s HAVING count(*) BETWEEN 2 AND 25),
pairs AS (
  SELECT a.path AS a, b.path AS b, count(*) AS shared, count(*) / least(any_value(x.n), any_value(y.n)) AS ratio
  FROM sh a JOIN fit USING (s) JOIN sh b USING (s) JOIN sz x ON x.path = a.path JOIN sz y ON y.path = b.path WHERE a.path < b.path GROUP BY a.path, b.path
)"""
