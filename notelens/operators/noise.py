"""Notes that crowd results: how often they come up for queries that aren't about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.functions.text import blank_split, copy_words, note_title
from notelens.operators.dupes import link_counts, note_texts, path_hints

FACTOR, MIN_RATE, LONG_WORDS = 3.0, 0.005, 3000
SNIPPETS, SNIPPET_WORDS, SEED, TOP = 2, 12, 7, 5
DATE_IN_TITLE = r"\s*\(?\d{4}-\d{2}-\d{2}\)?"


def pick(seed: Column, n: Column) -> Column:
    """A number from 0 to n - 1 that depends on the seed text alone."""
    return F.pmod(F.conv(F.left(F.md5(seed.cast("binary")), F.lit(12)), 16, 10).cast("long"), n.cast("long"))


def make_queries(chunks: DataFrame, snippets: int = SNIPPETS, n_words: int = SNIPPET_WORDS, seed: int = SEED, extra: DataFrame | None = None) -> DataFrame:
    """``qid, text, exclude``: each note's title without its date, runs of its own words, and extra queries."""
    titled = chunks.select("path").distinct().select("path", F.trim(F.regexp_replace(note_title(F.col("path")), DATE_IN_TITLE, "")).alias("text"))
    titles = titled.filter("text <> ''").select(F.concat(F.lit("t|"), "path").alias("qid"), "text", F.array("path").alias("exclude"))
    usable = chunks.select("path", "index", blank_split(F.col("text")).alias("w")).filter(F.size("w") >= n_words)
    gathered = usable.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("index", "w"))).alias("all"))
    drawn = gathered.select("path", "all", F.explode(F.sequence(F.lit(1), F.lit(snippets))).alias("n"))
    name = F.concat_ws("|", F.lit(str(seed)), "path", F.col("n").cast("string"))
    chosen = drawn.withColumn("name", name).withColumn("w", F.get("all", pick(F.col("name"), F.size("all")).cast("int"))["w"])
    start = pick(F.concat(F.col("name"), F.lit("|start")), F.size("w") - n_words + 1).cast("int")
    runs = chosen.select(F.concat(F.lit("s|"), "name").alias("qid"), F.array_join(F.slice("w", start + 1, n_words), " ").alias("text"), F.array("path").alias("exclude"))
    out = titles.unionByName(runs)
    return out if extra is None else out.unionByName(extra.select("qid", "text", "exclude"))


def named(path: Column, entry: Column) -> Column:
    """An entry names a note, or a folder if it ends in a slash."""
    return (path == entry) | (entry.endswith("/") & path.startswith(entry))


def count_appearances(results: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``path, appearances`` in the best ``k`` (``results``: qid, path, rank) of queries that don't name the note."""
    rows = results.filter(F.col("rank") <= k).join(queries.select("qid", "exclude"), "qid")
    free = rows.filter(~F.exists("exclude", lambda e: named(F.col("path"), e)))
    return free.groupBy("path").agg(F.count("*").alias("appearances"))


def hubs(counts: DataFrame, n_queries: Column, factor: float = FACTOR, min_rate: float = MIN_RATE) -> DataFrame:
    """``path, appearances, rate`` of notes at or above the threshold."""
    rates = counts.filter("appearances > 0").withColumn("rate", F.col("appearances") / n_queries)
    bar = rates.agg(F.greatest(F.lit(min_rate), factor * F.median("rate")).alias("bar"))  # one row
    return rates.crossJoin(F.broadcast(bar)).filter("rate >= bar").select("path", "appearances", "rate")


def find_noise(chunks: DataFrame, counts: DataFrame, n_queries: int, long_words: int = LONG_WORDS) -> DataFrame:
    """Hubs with flags, strong ones (two flags or more) first."""
    notes = note_texts(chunks)
    headed = chunks.groupBy("path").agg(F.max(F.when(F.col("heading_path") != "", 1).otherwise(0)).alias("headed"))
    rows = hubs(counts, F.lit(n_queries)).join(notes.select("path", F.size(copy_words(F.col("text"))).alias("words"), "chunks"), "path").join(link_counts(notes), "path").join(headed, "path")
    flags = F.array_compact(
        F.array(
            F.when(F.col("words") >= long_words, "long"),
            F.when((F.col("inbound") == 0) & (F.col("outbound") == 0), "orphan"),
            F.when(F.col("headed") == 0, "unstructured"),
        )
    )
    rows = rows.withColumn("flags", flags).withColumns({"strength": F.when(F.size("flags") >= 2, "strong").otherwise("look"), "hints": path_hints(F.col("path"))}).drop("headed")
    return rows.orderBy(F.col("strength") != "strong", F.desc(F.size("flags")), F.desc("rate"), "path")
