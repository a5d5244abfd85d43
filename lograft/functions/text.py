"""Scalar functions on messages: durations, classes, sparklines, markup, cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DURATION = r"(?i)duration:\s*(\d+\.?\d*)\s*(ms|s)"
GLYPHS = "▁▂▃▄▅▆▇█"


def duration_ms(text: Column) -> Column:
    """The first duration in a text in milliseconds, null without one."""
    value = F.regexp_extract(text, DURATION, 1).try_cast("double")
    return F.when(F.lower(F.regexp_extract(text, DURATION, 2)) == "s", value * 1000).otherwise(value)


def slow_level(ms: Column, warning: float = 100, slow: float = 500, critical: float = 1000) -> Column:
    """critical, slow or warning if strictly above that threshold, else null."""
    return F.when(ms > critical, "critical").when(ms > slow, "slow").when(ms > warning, "warning")


def check_thresholds(warning: float, slow: float, critical: float) -> None:
    if not 0 < warning < slow < critical:
        raise ValueError("thresholds must be positive and ascend")


def slow_thresholds(n: float) -> tuple[float, float, float]:
    """The thresholds that one number stands for."""
    return n, 2 * n, 5 * n


def duration_severity(ms: Column, slow: float = 100, very_slow: float = 500, critical: float = 5000) -> Column:
    """critical, very_slow, slow or fast; thresholds count as reached when met."""
    return F.when(ms.isNotNull(), F.when(ms >= critical, "critical").when(ms >= very_slow, "very_slow").when(ms >= slow, "slow").otherwise("fast"))


def session_seconds(text: Column) -> Column:
    """H:MM:SS.mmm as seconds, null for anything else."""
    p = F.split(text, ":")
    part = lambda k: F.get(p, F.lit(k)).try_cast("double")
    return F.when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2))


def sparkline(values: Column) -> Column:
    """One glyph per value of an array, scaled by its largest."""
    top = F.greatest(F.array_max(values), F.lit(1)).cast("double")
    glyph = lambda v: F.substring(F.lit(GLYPHS), F.least((v / top * 7).cast("int"), F.lit(7)) + 1, F.lit(1))
    return F.array_join(F.transform(values, glyph), "")


def strip_markup(text: Column) -> Column:
    """Without any bracketed run."""
    return F.regexp_replace(text, r"\[/?[^\]]*\]", "")


def strip_styles(text: Column) -> Column:
    """Without style tags; numbers in brackets stay and escaped brackets become plain."""
    hidden = F.replace(text, F.lit("\\["), F.lit("\u0001"))
    return F.translate(F.regexp_replace(hidden, r"\[(?!\d+(?:-\d+)?\])/?[^\]]*\]", ""), "\u0001", "[")


def shortened(text: Column, most: int, keep: int | None = None) -> Column:
    """At most `most` characters; longer texts are cut to keep (most by default) and get three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most if keep is None else keep), F.lit("..."))).otherwise(text)


def severity(level: Column) -> Column:
    """A level's class for alerts."""
    return F.when(level.isin("PANIC", "FATAL"), "critical").when(level == "ERROR", "error").when(level == "WARNING", "warning").otherwise("info")


def in_quiet_hours(at: Column, start: str, end: str) -> Column:
    """Whether a time of day lies in HH:MM-HH:MM, both ends included; over midnight if start is after end."""
    now = F.date_format(at, "HH:mm:ss.SSSSSS")
    a, b = f"{start}:00.000000", f"{end}:00.000000"
    return (now >= a) & (now <= b) if a <= b else (now >= a) | (now <= b)


def suggestion(word: str, names: list[str], cutoff: float = 0.6) -> str | None:
    """The known name closest to a mistyped one."""
    import difflib

    found = difflib.get_close_matches(word, names, n=1, cutoff=cutoff)
    return found[0] if found else None


def completion(prefix: str, names: list[str]) -> str | None:
    """The first name in order that begins with prefix, whatever the case."""
    low = prefix.lower()
    return next((n for n in sorted(names) if n.lower().startswith(low)), None)


def ago(seconds: Column) -> Column:
    """An age in words: 5s ago, 3m 5s ago, 2h 3m ago, 4d 2h ago."""
    s = seconds.cast("bigint")
    part = lambda n, unit: F.concat((n).cast("string"), F.lit(unit))
    text = (
        F.when(s < 60, part(s, "s")).when(s < 3600, F.concat_ws(" ", part(F.floor(s / 60), "m"), part(s % 60, "s")))
        .when(s < 86400, F.concat_ws(" ", part(F.floor(s / 3600), "h"), part(F.floor(s % 3600 / 60), "m"))).otherwise(F.concat_ws(" ", part(F.floor(s / 86400), "d"), part(F.floor(s % 86400 / 3600), "h")))
    )
    return F.concat(text, F.lit(" ago"))


def time_range(since: Column, until: Column) -> Column:
    """A time filter in words."""
    a, b = F.date_format(since, "yyyy-MM-dd HH:mm:ss"), F.date_format(until, "yyyy-MM-dd HH:mm:ss")
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit("between "), a, F.lit(" and "), b)).when(a.isNotNull(), F.concat(F.lit("since "), a)).when(b.isNotNull(), F.concat(F.lit("until "), b)).otherwise("all time")
