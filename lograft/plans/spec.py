"""Filters as immutable specifications that compile to one condition, the cheapest terms first."""

from __future__ import annotations

import dataclasses
import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_list
from ..functions.timestamps import parse_time

#: Field names that a user may type and the columns they mean; fixed values.
FIELD_COLUMNS = {
    "app": "application_name", "application": "application_name", "db": "database_name", "database": "database_name", "user": "user_name", "pid": "pid",
    "backend": "backend_type", "host": "connection_from", "ip": "connection_from", "client": "connection_from", "connection_from": "connection_from",
}


def java_regex(pattern: str, case_sensitive: bool = False) -> str:
    """A Python regular expression as Java reads it; what Java lacks is refused."""
    for unknown in ("(?P>", "(?(", r"\Z"):
        if unknown in pattern:
            raise ValueError(f"{unknown} is not supported")
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
    return ("(?U)" if case_sensitive else "(?iuU)") + pattern


@dataclasses.dataclass(frozen=True)
class Pattern:
    text: str
    case_sensitive: bool = False

    def of(self, col: Column) -> Column:
        return F.coalesce(col.rlike(java_regex(self.text, self.case_sensitive)), F.lit(False))


@dataclasses.dataclass(frozen=True)
class FilterSpec:
    """Levels, fields, times and patterns; a missing value never satisfies a term."""

    levels: frozenset[str] | None = None
    include: tuple[Pattern, ...] = ()
    exclude: tuple[Pattern, ...] = ()
    every: tuple[Pattern, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    since: dt.datetime | None = None
    until: dt.datetime | None = None

    def with_levels(self, words: list[str]) -> FilterSpec:
        """Replaces the levels; any word that is not understood leaves the filter as it is."""
        levels, bad = level_list(words)
        return self if bad else dataclasses.replace(self, levels=levels)

    def with_pattern(self, arg: str) -> FilterSpec:
        """/p/ replaces the includes, +/p/ adds one, -/p/ excludes, &/p/ must match too; a trailing c minds case."""
        kind, body = (arg[0], arg[1:]) if arg[:1] in "-+&" else ("", arg)
        p = parse_pattern(body)
        if kind == "":
            return dataclasses.replace(self, include=(p,))
        name = {"+": "include", "-": "exclude", "&": "every"}[kind]
        return dataclasses.replace(self, **{name: (*getattr(self, name), p)})

    def with_field(self, name: str, value: str) -> FilterSpec:
        """One value per field: a later one replaces the earlier."""
        column = FIELD_COLUMNS[name.lower()]
        return dataclasses.replace(self, fields=(*[f for f in self.fields if f[0] != column], (column, value)))

    def with_time(self, since: str | None = None, until: str | None = None, now: dt.datetime | None = None) -> FilterSpec:
        """Replaces the whole time filter."""
        now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        a, b = (parse_time(v, now) if v else None for v in (since, until))
        if a and b and a > b:
            raise ValueError("since is after until")
        return dataclasses.replace(self, since=a, until=b)

    def cleared(self, anchor: FilterSpec | None = None) -> FilterSpec:
        """Back to the filter that a session began with, or to none."""
        return anchor or FilterSpec()

    def condition(self) -> Column:
        """For where: terms joined by AND, in which null drops a row; comparisons stay bare, so that Spark pushes them into stored tables."""
        terms = []
        if self.since is not None:
            terms.append(F.col("timestamp") >= utc(self.since))
        if self.until is not None:
            terms.append(F.col("timestamp") <= utc(self.until))
        if self.levels is not None:
            terms.append(F.col("level").isin(*sorted(self.levels)))
        for column, value in self.fields:
            same = F.col(column).cast("string") == value if column == "pid" else F.lower(column) == value.lower()
            terms.append(same)
        if self.include:
            terms.append(reduce(lambda a, b: a | b, [p.of(F.col("raw")) for p in self.include]))
        terms += [~p.of(F.col("raw")) for p in self.exclude] + [p.of(F.col("raw")) for p in self.every]
        return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)

    def apply(self, logs: DataFrame) -> DataFrame:
        return logs.where(self.condition())


def utc(at: dt.datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")


def parse_pattern(arg: str) -> Pattern:
    """/p/ or /p/c."""
    case = arg.endswith("/c") and len(arg) > 2
    end = -2 if case else -1
    if not arg.startswith("/") or not (case or arg.endswith("/")) or len(arg) < 2:
        raise ValueError(f"a pattern looks like /text/ or /text/c: {arg}")
    if not arg[1:end]:
        raise ValueError("empty pattern")
    return Pattern(arg[1:end], case)


def export_condition(levels: frozenset[str] | None = None, patterns: FilterSpec | None = None, since: dt.datetime | None = None) -> Column:
    """What an export takes: rows without a time pass the time filter, fields are not looked at."""
    spec = FilterSpec(levels=levels) if patterns is None else dataclasses.replace(patterns, levels=levels, fields=(), since=None, until=None)
    late = F.lit(True) if since is None else F.col("timestamp").isNull() | (F.col("timestamp") >= utc(since))
    return late & spec.condition()
