"""Alert rules over parsed rows."""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import TRACKED, level_list
from ..functions.text import duration_ms, in_quiet_hours, severity, shortened
from ..plans.spec import Pattern, parse_pattern
from .windows import allowed


@dataclasses.dataclass(frozen=True)
class Rules:
    levels: frozenset[str] = frozenset()
    patterns: tuple[Pattern, ...] = ()
    errors_per_minute: int | None = None
    slow_ms: float | None = None
    quiet: tuple[str, str] | None = None

    def on(self, command: str) -> Rules:
        """Levels add up, patterns are appended, a rate or a duration replaces the one before."""
        command = command.strip()
        if command.startswith("/"):
            loose = command.endswith("/i")
            p = parse_pattern(command[:-1] if loose else command)
            return dataclasses.replace(self, patterns=(*self.patterns, Pattern(p.text, not loose)))
        if m := re.fullmatch(r"errors\s*>\s*(\d+)\s*/\s*min", command, re.I):
            return dataclasses.replace(self, errors_per_minute=int(m[1]))
        if m := re.fullmatch(r"slow\s*>\s*(\d+(?:\.\d+)?)\s*(ms|s)", command, re.I):
            return dataclasses.replace(self, slow_ms=float(m[1]) * (1000 if m[2].lower() == "s" else 1))
        levels, bad = level_list(command.split())
        if bad or not levels:
            raise ValueError(f"cannot read the rule: {command}")
        return dataclasses.replace(self, levels=self.levels | levels)

    def silent(self, hours: str) -> Rules:
        m = re.fullmatch(r"([01]?\d|2[0-3]):([0-5]\d)-([01]?\d|2[0-3]):([0-5]\d)", hours)
        if not m:
            raise ValueError(f"quiet hours look like HH:MM-HH:MM: {hours}")
        return dataclasses.replace(self, quiet=(f"{int(m[1]):02}:{m[2]}", f"{int(m[3]):02}:{m[4]}"))


def rated(logs: DataFrame, by: str) -> DataFrame:
    """logs with rate: tracked rows of their group in the minute up to them, themselves included."""
    near = Window.partitionBy(by).orderBy(F.unix_micros("timestamp")).rangeBetween(-60_000_000 + 1, 0)
    return logs.withColumn("rate", F.count_if(F.col("level").isin(*TRACKED)).over(near))


def matched(logs: DataFrame, rules: Rules, by: str | None = None) -> DataFrame:
    """Rows that a rule matches, with the first such rule: level, pattern, rate, slow. by: the source that rates count."""
    df = rated(logs, by) if rules.errors_per_minute is not None and by else logs
    rule: Column = F.lit(None).cast("string")
    if rules.slow_ms is not None:
        rule = F.when(duration_ms(F.col("message")) > rules.slow_ms, "slow")
    if rules.errors_per_minute is not None and by:
        rule = F.when(F.col("level").isin(*TRACKED) & (F.col("rate") > rules.errors_per_minute), "rate").otherwise(rule)
    for p in reversed(rules.patterns):
        rule = F.when(p.of(F.col("message")), "pattern").otherwise(rule)
    if rules.levels:
        rule = F.when(F.col("level").isin(*sorted(rules.levels)), "level").otherwise(rule)
    out = df.withColumn("rule", rule).where("rule is not null")
    if rules.quiet:
        out = out.where(~in_quiet_hours(F.col("timestamp"), *rules.quiet))
    body = shortened(F.col("message"), 150, 147)
    return out.select(*logs.columns, "rule", severity(F.col("level")).alias("severity"), body.alias("body"))


def alerts(logs: DataFrame, rules: Rules, by: str, seconds: float = 5, pause: float = 60) -> DataFrame:
    """Matches that pass the one limiter of all sources, by arrival; what only a rate makes a match waits for the pause since the last such match first."""
    found = matched(logs, rules, by)
    if rules.errors_per_minute is not None:
        rate = found.where("rule = 'rate'")
        found = found.where("rule <> 'rate'").unionByName(rate.join(allowed(rate, None, pause).select("seq"), "seq", "left_semi"))
    return found.join(allowed(found, None, seconds).select("seq"), "seq", "left_semi")
