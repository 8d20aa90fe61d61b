"""Chat formatting with Spark expressions only.

A conversation is formatted as runs of one role: ``### role``, a new line, then the texts of
the run, each ended by ``</turn>``. Control strings inside texts and roles are escaped with a
backslash and a letter, so they never occur in what is between the marks, and splitting at
the marks reads everything back. The loss mask has a (start, length) pair for each turn: the
code points, counted from 1 in what stands up to that turn's end mark, that are learnt; the
length is 0 where the turn isn't an assistant's.

Defined results: null roles and texts are empty; turns are ordered by number (null first),
then role and text, and repeated rows are formatted each; a null ``conv_id`` is one
conversation; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN, TURN = "###", "</turn>"
#: String, its escape; the backslash comes first when escaping and last when reading back.
ESCAPES = [("\\", "\\b"), (RUN, "\\h"), (TURN, "\\t")]
LEARNT = "assistant"


def escape(c: Column) -> Column:
    for plain, escaped in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def unescape(c: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def merged_runs(turns: DataFrame) -> DataFrame:
    """``conv_id, runs``: a conversation's turns in order, adjacent ones of one role as one array of texts."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def begins(i: Column) -> Column:
        return (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"])

    firsts = sorted_.select("conv_id", "turns", F.filter(F.sequence(F.lit(1), F.size("turns")), begins).alias("firsts"))

    def run(i: Column, k: Column) -> Column:
        after = F.coalesce(F.get("firsts", k + 1), F.size("turns") + 1)
        return F.struct(F.get("turns", i - 1)["role"].alias("role"), F.transform(F.slice("turns", i, after - i), lambda t: t["text"]).alias("texts"))

    return firsts.select("conv_id", F.transform("firsts", run).alias("runs"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` from rows ``conv_id, turn, role, text``.

    A conversation is one value of the result, so its turns are gathered in one row; each is
    copied a fixed number of times.
    """
    escaped = F.transform(
        "runs",
        lambda r: F.struct(
            F.concat(F.lit(RUN + " "), _escape_role(r["role"]), F.lit("\n")).alias("mark"),
            (r["role"] == LEARNT).alias("learnt"),
            F.transform(r["texts"], escape).alias("bodies"),
        ),
    )
    runs = merged_runs(turns).select("conv_id", escaped.alias("runs"))

    def mask(r: Column) -> Column:
        def of_turn(body: Column, i: Column) -> Column:
            start = F.when(i == 0, F.length(r["mark"])).otherwise(0) + 1
            return F.struct(start.alias("start"), F.when(r["learnt"], F.length(body)).otherwise(0).alias("length"))

        return F.transform(r["bodies"], of_turn)

    return runs.select(
        "conv_id",
        F.array_join(F.transform("runs", lambda r: F.concat(r["mark"], F.array_join(r["bodies"], TURN), F.lit(TURN))), "").alias("formatted"),
        F.flatten(F.transform("runs", mask)).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, learnt`` from the formatted text and the mask alone."""
    runs = F.filter(F.split("formatted", RUN), lambda r: r != "")
    turns = F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                F.slice(F.split(F.substr(r, F.locate("\n", r) + 1), TURN), F.lit(1), F.size(F.split(r, TURN)) - 1),
                lambda body: F.struct(_unescape_role(F.substr(F.substring_index(r, "\n", 1), F.lit(2))).alias("role"), unescape(body).alias("text")),
            ),
        )
    )
    learnt = F.array_join(F.zip_with(F.slice(F.split("formatted", TURN), F.lit(1), F.size("loss_mask")), "loss_mask", lambda part, m: unescape(F.substr(part, m["start"], m["length"]))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), learnt.alias("learnt"))
