"""Decisions on what an audit found, and what is left to decide."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.sources.notes import excluded, split_excludes

KINDS_OF_DECISION = ("kept_groups", "kept_notes", "excluded")
LOOK = 20


class ExclusionError(ValueError):
    pass


def load_decisions(path: str) -> dict[str, dict[str, str]]:
    """Empty if there is no file; a file that can't be read is an error, never empty."""
    if not os.path.exists(path):
        return {k: {} for k in KINDS_OF_DECISION}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    if not isinstance(held, dict) or not all(isinstance(held.get(k, {}), dict) for k in KINDS_OF_DECISION):
        raise ValueError(f"{path} holds no decisions")
    return {k: held.get(k, {}) for k in KINDS_OF_DECISION}


def save_decisions(path: str, decisions: dict[str, dict[str, str]]) -> None:
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(decisions, f, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(path + ".new", path)


def mark(decisions: dict[str, dict[str, str]], kind: str, name: str, day: str) -> dict[str, dict[str, str]]:
    return decisions | {kind: decisions[kind] | {name: day}}


def noise_id(path: Column) -> Column:
    return F.concat(F.lit("n"), F.left(F.sha1(path.cast("binary")), F.lit(8)))


def open_groups(groups: DataFrame, decisions: dict[str, dict[str, str]]) -> DataFrame:
    """Groups not decided on that still have two notes; decided names are few and travel as literals."""
    gone, kept = F.array(*[F.lit(p) for p in sorted(decisions["excluded"])]).cast("array<string>"), sorted(decisions["kept_groups"])
    live = groups.withColumn("paths", F.filter("paths", lambda p: ~F.array_contains(gone, p)))
    return live.filter(~F.col("key").isin(kept) & (F.size("paths") >= 2)) if kept else live.filter(F.size("paths") >= 2)


def open_noise(found: DataFrame, decisions: dict[str, dict[str, str]], look: int = LOOK) -> DataFrame:
    """All strong candidates and the first ``look`` others that are not decided on."""
    done = sorted({*decisions["kept_notes"], *decisions["excluded"]})
    rows = found.filter(~F.col("path").isin(done)) if done else found
    weak = rows.filter("strength = 'look'").orderBy(F.desc(F.size("flags")), F.desc("rate"), "path").limit(look)
    return rows.filter("strength = 'strong'").unionByName(weak)


def plan_exclusion(paths: list[str], asked: list[str], entries: list[str]) -> dict[str, list[str]]:
    """What leaving out ``asked`` takes: entries, the notes that go, and those that nobody asked to go."""
    missing = sorted(set(asked) - set(paths))
    if missing:
        raise ExclusionError(f"not indexed: {', '.join(missing)}")
    new = [a if "/" in a else f"/{a}" for a in asked]
    names, places = split_excludes([*entries, *new])
    places |= {a for a in asked if "/" not in a}
    names -= {a for a in asked if "/" not in a}
    before = {p for p in paths if not excluded(p, *split_excludes(entries))}
    removed = sorted(p for p in before if excluded(p, names, places))
    return {"entries": asked, "removed": removed, "extra": sorted(set(removed) - set(asked))}
