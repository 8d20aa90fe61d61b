"""Text functions as Column builders: folding, search tokens, words, note paths, clips."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and patterns that decide what a search token is.
APOSTROPHES = "'’‘`´"
LOWER_LETTERS = "a-zçğıöşü"
UPPER_LETTERS = "A-ZÇĞİÖŞÜ"
WORD_CHARS = r"\p{L}\p{N}_"
#: Letters that the duplicate analysis folds.
COPY_FOLD_FROM = "İIıĞğÜüŞşÖöÇç"
COPY_FOLD_TO = "iiigguussoocc"

SUFFIX = f"[{APOSTROPHES}][{WORD_CHARS}]*"
CAMEL = f"(?<=[{LOWER_LETTERS}0-9])(?=[{UPPER_LETTERS}])|(?<=[{UPPER_LETTERS}])(?=[{UPPER_LETTERS}][{LOWER_LETTERS}])"
#: Whether a text may have a run that is taken apart, and such runs: each run is looked through once, from its start.
MAY_SPLIT = f"_|[{LOWER_LETTERS}0-9][{UPPER_LETTERS}]|[{UPPER_LETTERS}][{UPPER_LETTERS}][{LOWER_LETTERS}]"
SPLIT_RUN = f"(?<![{WORD_CHARS}])((?=[{WORD_CHARS}]*?(?:_|{CAMEL}))[{WORD_CHARS}]+)"
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")


def _is_word(text: str) -> list[bool]:
    return [c == "_" or unicodedata.category(c)[0] in "LN" for c in text]


#: Dotted and dotless i are one letter.
DOTS = str.maketrans("İIı", "iii")


#: Letters up to here are Latin.
LATIN = 0x24F


def _narrow_letters() -> tuple[str, str, str, str]:
    """Pairs of letters and what they fold to one-to-one, and two character classes of what needs more than these.

    Latin, full-width and symbol blocks and the Chinese characters are looked at. Folding leaves
    the others alone, the pairs cover them, or they stay outside words. The first class has the
    exceptions among Latin letters; the second is meant for texts that go beyond Latin.
    """
    source, base, exceptions, ranges = [], [], [], [[0, LATIN]]
    for code in (*range(0x80, LATIN + 1), *range(0x1E00, 0x1F00), *range(0x2010, 0x2768), *range(0x4E00, 0x9FD0), *range(0xFF01, 0xFF5F)):
        letter = chr(code)
        low = letter.translate(DOTS).lower()
        bare = _bare(low)
        if len(low) == 1 and len(bare) == 1 and bare != low and _is_word(bare) == _is_word(low):
            source.append(low)
            base.append(bare)
        elif bare != low and any(_is_word(letter + bare)) or unicodedata.category(letter) == "Mn":
            exceptions += [letter] * (code <= LATIN)
            continue
        if code > LATIN:
            if code == ranges[-1][1] + 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(source), "".join(base), "[" + "".join(exceptions) + "]", "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


ACCENTED, BARE, LATIN_EXCEPTIONS, BEYOND = _narrow_letters()


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _lower(c: Column) -> Column:
    return F.lower(F.translate(c, "İIı", "iii"))


def fold(c: Column) -> Column:
    """Lower case with dotted and dotless i as one letter and diacritics dropped.

    Built-in functions alone: Latin and full-width letters that decompose to one, and combining
    marks. ``fold_exact`` covers all of Unicode.
    """
    return F.when(_is_ascii(c), F.lower(c)).otherwise(F.regexp_replace(F.translate(_lower(c), ACCENTED, BARE), r"\p{Mn}+", ""))


#: Marks that Latin letters decompose to, dropped; others are looked up.
MARKS = dict.fromkeys(c for c in range(0x300, 0x370) if unicodedata.category(chr(c)) == "Mn")


def fold_text(text: str) -> str:
    if text.isascii():
        return text.lower()
    low = text.translate(DOTS).lower()
    bare = unicodedata.normalize("NFKD", low).translate(MARKS)
    return bare if bare.isascii() else _bare(bare)


def fold_exact(c: Column) -> Column:
    """``fold`` for every letter that decomposes, ligatures and fractions too; runs in Python over Arrow batches."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fold_text(v))

    return run(c)


def copy_fold(c: Column) -> Column:
    """The folding of the duplicate analysis: a fixed letter map, then lower case; other diacritics stay."""
    return F.lower(F.translate(c, COPY_FOLD_FROM, COPY_FOLD_TO))


def _without_suffixes(c: Column) -> Column:
    return F.when(c.rlike(f"[{APOSTROPHES}]"), F.regexp_replace(c, SUFFIX, "")).otherwise(c)


def _parts(run: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.translate(run, "_", " "), CAMEL, " "), " "), lambda p: p != "")


def tokens(c: Column) -> Column:
    """Search tokens in order, with duplicates: each run of word characters and, if it has several, its parts.

    Folds as ``fold`` does; ``exact_token_bag`` is exact for all of Unicode.
    """
    runs = F.regexp_extract_all(_without_suffixes(c), F.lit(f"([{WORD_CHARS}]+)"), 1)

    def of_run(run: Column) -> Column:
        parts = _parts(run)
        return F.when(F.size(parts) > 1, F.concat(F.array(fold(run)), F.transform(parts, fold))).when(F.size(parts) == 1, F.array(fold(run))).otherwise(F.array().cast("array<string>"))

    return F.filter(F.flatten(F.transform(runs, of_run)), lambda t: F.length(t) > 1)


SUFFIX_RUN, _CAMEL, RUN = re.compile(rf"[{APOSTROPHES}]\w*"), re.compile(CAMEL), re.compile(r"\w+")


def tokens_of(text: str) -> list[str]:
    """Search tokens of one text in order, folded exactly."""
    out = []
    for run in RUN.findall(SUFFIX_RUN.sub("", text)):
        parts = _CAMEL.sub(" ", run.replace("_", " ")).split()
        out += [fold_text(x) for x in ([run, *parts] if len(parts) > 1 else [run] if parts else [])]
    return [t for t in out if len(t) > 1]


def tokens_of_run(run: str) -> tuple[str, ...]:
    """``tokens_of`` for one run of word characters; most have nothing to take apart."""
    later = run[1:]
    if "_" in run or later != later.lower():
        return tuple(tokens_of(run))
    token = fold_text(run)
    return (token,) if len(token) > 1 else ()


def exact_token_bag(c: Column) -> Column:
    """The tokens of any text, folded exactly; runs in Python over Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else tokens_of(v))

    return run(c)


def token_bag(c: Column) -> Column:
    """The tokens of ``tokens`` in any order, for texts that aren't wide.

    A text is folded as a whole: that keeps word characters word characters, so runs of the folded
    text are the folded runs; only runs with an underscore or a change of case are taken apart.
    """
    plain = _without_suffixes(c)
    folded = F.when(_is_ascii(plain), F.lower(plain)).otherwise(F.translate(_lower(plain), ACCENTED, BARE))
    runs = F.regexp_extract_all(folded, F.lit(f"[{WORD_CHARS}]{{2,}}"), 0)
    whole = F.when(F.contains(folded, F.lit("_")), F.filter(runs, lambda t: F.ltrim(t, F.lit("_")) != "")).otherwise(runs)
    split = F.filter(F.transform(F.regexp_extract_all(plain, F.lit(SPLIT_RUN), 1), _parts), lambda p: F.size(p) > 1)
    more = F.filter(F.transform(F.flatten(split), fold), lambda t: F.length(t) > 1)
    fast = F.when(plain.rlike(MAY_SPLIT), F.concat(whole, more)).otherwise(whole)
    return fast


def is_wide(c: Column) -> Column:
    """Whether a text has a character that the built-in folding doesn't cover."""
    return ~_is_ascii(c) & (c.rlike(LATIN_EXCEPTIONS) | (c.rlike(f"[^\\x00-\\x{{{LATIN:x}}}]") & c.rlike(BEYOND)))


def copy_words(c: Column) -> Column:
    """Words of the duplicate analysis: folded runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(copy_fold(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def blank_split(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, BLANKS), lambda w: w != "")


def estimated_tokens(c: Column) -> Column:
    """The default size estimate: one and a half tokens for a word, rounded up."""
    return F.ceil(F.size(blank_split(c)) * 1.5).cast("int")


def _steps(path: Column) -> Column:
    return F.split(F.translate(path, "\\", "/"), "/")


def note_title(path: Column) -> Column:
    """File name without its .md ending."""
    return F.regexp_replace(F.element_at(_steps(path), -1), r"(?i)\.md$", "")


def folders(path: Column) -> Column:
    steps = _steps(path)
    return F.filter(F.slice(steps, 1, F.size(steps) - 1), lambda s: s != "")


def note_folder(path: Column) -> Column:
    return F.array_join(folders(path), " > ")


def parent_key(heading_path: Column) -> Column:
    """The heading path without its last step; a path of one step is its own parent."""
    return F.regexp_replace(heading_path, r" > (?:(?! > ).)*$", "")


def header(path: Column, tags: Column, heading_path: Column) -> Column:
    """The lines that stand before a chunk's text when it is embedded or indexed."""
    folder = note_folder(path)
    return F.concat(
        F.lit("Note: "),
        note_title(path),
        F.lit("\n"),
        F.when(folder != "", F.concat(F.lit("Folder: "), folder, F.lit("\n"))).otherwise(""),
        F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "), F.lit("\n"))).otherwise(""),
        F.when(heading_path != "", F.concat(F.lit("Section: "), heading_path, F.lit("\n"))).otherwise(""),
    )


def embed_text(path: Column, tags: Column, heading_path: Column, text: Column) -> Column:
    return F.concat(header(path, tags, heading_path), text)


def clip(c: Column, limit: int = 600) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 1)), F.lit("…"))).otherwise(c)


def around(text: Column, anchor: Column, limit: int) -> Column:
    """A window of ``limit`` characters around the start of ``anchor`` (its first 80 characters) in ``text``."""
    at = F.greatest(F.locate(F.left(anchor, F.lit(80)), text) - 1, F.lit(0)) if isinstance(anchor, str) else F.greatest(F.instr(text, F.left(anchor, F.lit(80))) - 1, F.lit(0))
    start = F.greatest(F.least(at - limit // 2, F.length(text) - limit), F.lit(0))
    window = F.substr(text, start + 1, F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.when(start > 0, F.lit("…")).otherwise(""), window, F.when(start + limit < F.length(text), F.lit("…")).otherwise(""))
    )


def snippet(c: Column, limit: int = 170) -> Column:
    return F.left(F.trim(F.regexp_replace(c, BLANKS, " ")), F.lit(limit))
