"""Severity levels: order, aliases and the grammar of level lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From most to least severe; the position is the rank.
LEVELS = ("PANIC", "FATAL", "ERROR", "WARNING", "NOTICE", "LOG", "INFO", "DEBUG1", "DEBUG2", "DEBUG3", "DEBUG4", "DEBUG5")
RANK = {name: k for k, name in enumerate(LEVELS)}
#: Names that a user may type; fixed values.
ALIASES = {
    "ERR": "ERROR", "WARN": "WARNING", "INF": "INFO", "DBG": "DEBUG1", "DEBUG": "DEBUG1", "FAT": "FATAL", "PAN": "PANIC", "NOT": "NOTICE", "NTC": "NOTICE",
    "E": "ERROR", "W": "WARNING", "I": "INFO", "L": "LOG", "D": "DEBUG1", "F": "FATAL", "P": "PANIC", "N": "NOTICE",
}
#: Words in a line's level place that are no levels; fixed values.
IN_LINES = {"DEBUG": "DEBUG1", "STATEMENT": "LOG", "DETAIL": "LOG", "HINT": "LOG", "CONTEXT": "LOG"}
ERRORS = ("PANIC", "FATAL", "ERROR")
WARNINGS = ("WARNING",)
TRACKED = ERRORS + WARNINGS


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalised(word: Column) -> Column:
    """A line's level word as a level; unknown words and null are LOG."""
    return F.coalesce(F.element_at(_table({n: n for n in LEVELS} | IN_LINES), F.upper(F.coalesce(word, F.lit("")))), F.lit("LOG"))


def known(word: Column) -> Column:
    """Whether a word is a level or may stand for one in a line."""
    return F.upper(F.coalesce(word, F.lit(""))).isin(*LEVELS, *IN_LINES)


def rank(level: Column) -> Column:
    return F.element_at(_table(RANK), level).cast("tinyint")


def level_of(name: str) -> str:
    """The level that a typed name means; ValueError if none."""
    upper = name.strip().upper()
    upper = ALIASES.get(upper, upper)
    if upper not in RANK:
        raise ValueError(f"unknown level: {name}")
    return upper


def at_or_above(level: str) -> frozenset[str]:
    return frozenset(LEVELS[: RANK[level] + 1])


def at_or_below(level: str) -> frozenset[str]:
    return frozenset(LEVELS[RANK[level] :])


def level_list(words: list[str]) -> tuple[frozenset[str] | None, list[str]]:
    """(levels, words not understood) of exact names, NAME+, NAME-, commas and ALL; None means every level."""
    parts = [p for w in words for p in w.split(",") if p]
    if not parts or len(parts) == 1 and parts[0].upper() == "ALL":
        return None, []
    found, bad = set(), []
    for part in parts:
        stem, reach = (part[:-1], part[-1]) if part[-1] in "+-" else (part, "")
        try:
            level = level_of(stem)
        except ValueError:
            bad.append(part)
            continue
        found |= {"": {level}, "+": at_or_above(level), "-": at_or_below(level)}[reach]
    return (frozenset(found) or None), bad
