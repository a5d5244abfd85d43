"""Log timestamps as UTC instants. Zone names mean fixed offsets, never regional rules."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours east of UTC; fixed values.
ZONES = {
    "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
    "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "JST": 9, "KST": 9, "IST": 5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
}
PLAIN = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$"
OFFSET = r"([+-])(\d{2}):?(\d{2})?$"


def plain_timestamp(text: Column) -> Column:
    """Date and time without a zone, at most six fraction digits, as an instant of the session's zone (UTC); else null."""
    return F.when(text.rlike(PLAIN), text.try_cast("timestamp_ntz")).cast("timestamp")


def log_timestamp(text: Column) -> Column:
    """A CSV or JSON log's timestamp: zone name, ISO offset, T and Z; without a zone it is UTC. Null where it cannot be read.

    Unknown names of up to five letters count as UTC. Offsets of a day or more give null.
    """
    s = F.trim(text)
    iso = s.rlike(r"\dT\d")
    zulu = iso & s.endswith("Z")
    offset = ~zulu & s.rlike(OFFSET)
    word = F.when(~iso & ~offset, F.regexp_extract(s, r" (\S{1,5})$", 1))
    named = F.coalesce(word.rlike(r"^\p{L}+$"), F.lit(False))
    zone = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    hours = F.when(named, F.coalesce(F.element_at(zone, F.upper(word)), F.lit(0))).otherwise(0)
    sign = F.when(F.regexp_extract(s, OFFSET, 1) == "-", -1).otherwise(1)
    minutes = F.when(
        offset, sign * (F.regexp_extract(s, OFFSET, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(s, OFFSET, 3).try_cast("int"), F.lit(0)))
    ).otherwise(hours * 60)
    bare = F.when(zulu, F.regexp_replace(s, "Z$", "")).when(offset, F.rtrim(F.regexp_replace(s, OFFSET, ""))).when(named, F.regexp_replace(s, r" \S+$", "")).otherwise(s)
    at = plain_timestamp(F.translate(bare, "T", " "))
    return F.when(F.abs(minutes) < 1440, at - F.make_dt_interval(mins=minutes))


def parse_time(value: str, now: dt.datetime) -> dt.datetime:
    """A typed time as a naive UTC datetime: 5m, 30s, 2h, 1d before now, HH:MM[:SS] of now's day, or ISO 8601."""
    value = value.strip()
    if m := re.fullmatch(r"(\d+)([smhd])", value, re.I):
        return now - dt.timedelta(seconds=int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2].lower()])
    if m := re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2}))?", value):
        h, mi, s = int(m[1]), int(m[2]), int(m[3] or 0)
        if h > 23 or mi > 59 or s > 59:
            raise ValueError(f"no time of day: {value}")
        return now.replace(hour=h, minute=mi, second=s, microsecond=0)
    try:
        at = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"cannot read the time: {value}") from None
    return at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def is_future(at: dt.datetime, now: dt.datetime) -> bool:
    return at > now
