"""Dates in note names, questions about the present, status notes, folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelens.functions.text import folders, note_title, tokens

# Folded words that ask for the present, and for where things stand.
RECENCY_WORDS = ["guncel", "son", "simdi", "neredeyiz", "acil", "yeni", "bugun"]
RECENCY_PAIRS = [("su", "an")]
STATE_ASK_WORDS = ["ne", "hangi", "neler", "nelerdi", "neydi"]
STATE_PREFIX, STATUS_PREFIX = "neredey", "durum"
STATE_PAIR, ASKED_PAIR = ("su", "an"), ("en", "son")
STATUS_WORDS = ["indeks", "index", "devam"]
STATUS_PAIR = ["guncel", "durum"]

HALF_LIFE_DAYS = 90


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def note_date(path: Column) -> Column:
    """The first valid yyyy-mm-dd in the file name."""
    name = F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)
    found = F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)"), 1)
    return F.try_element_at(F.filter(F.transform(found, lambda x: F.try_to_date(x, "yyyy-MM-dd")), lambda d: d.isNotNull()), F.lit(1))


def _has_pair(t: Column, pair: tuple[str, str], then: list[str] | None = None) -> Column:
    places = F.sequence(F.lit(1), F.size(t))

    def at(i: Column) -> Column:
        hit = (F.get(t, i - 1) == pair[0]) & (F.get(t, i) == pair[1])
        return hit if then is None else hit & F.coalesce(F.get(t, i + 1).isin(then), F.lit(False))

    return F.when(F.size(t) < 2, F.lit(False)).otherwise(F.exists(places, lambda i: F.coalesce(at(i), F.lit(False))))


def is_recency_query(query: Column) -> Column:
    t = tokens(query)
    out = F.arrays_overlap(t, _words(RECENCY_WORDS))
    for pair in RECENCY_PAIRS:
        out = out | _has_pair(t, pair)
    return out


def is_state_query(query: Column) -> Column:
    """Narrower than recency: the answer sums a project up."""
    t = tokens(query)
    return (
        F.exists(t, lambda x: x.startswith(STATE_PREFIX))
        | (F.exists(t, lambda x: x.startswith(STATUS_PREFIX)) & is_recency_query(query))
        | _has_pair(t, STATE_PAIR)
        | _has_pair(t, ASKED_PAIR, STATE_ASK_WORDS)
    )


def freshness(d: Column, today: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """1 for today or later, halved every ``half_life`` days, 0 without a date."""
    return F.when(d.isNull(), 0.0).otherwise(F.pow(F.lit(0.5), F.greatest(F.datediff(today, d), F.lit(0)) / half_life))


def is_status_note(path: Column) -> Column:
    t = tokens(note_title(path))
    return F.arrays_overlap(t, _words(STATUS_WORDS)) | (F.size(F.array_except(_words(STATUS_PAIR), t)) == 0)


def folder_units(path: Column) -> Column:
    return F.array_distinct(F.transform(folders(path), F.lower))
