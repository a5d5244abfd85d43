"""Entities in messages: where they stand, what they are. Everything stays in the JVM."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from ..functions.sql import region
from ..functions.text import duration_severity

SPAN = "array<struct<start:int,priority:int,ordinal:int,end:int,entity:string,text:string,class:string>>"


@dataclasses.dataclass(frozen=True)
class Extractor:
    """pattern: Java's; group: the one that counts; needs: a text that every match holds (lower case), checked first; in_sql: only inside SQL."""

    name: str
    priority: int
    pattern: str
    group: int = 0
    needs: str = ""
    kind: Callable[[Column], Column] | None = None
    in_sql: bool = False


def keyword_pattern(words: list[str], ignore_case: bool = True) -> str:
    """Words that no letter or digit touches; at one place the shortest wins."""
    escaped = [re.escape(w) for w in sorted(words, key=len)]
    return ("(?iu)" if ignore_case else "") + r"(?<![\p{L}\p{N}])(?:" + "|".join(escaped) + r")(?![\p{L}\p{N}])"


#: Condition names, process names, lock modes and phrases of server messages.
ERROR_NAMES = (
    "unique_violation", "foreign_key_violation", "not_null_violation", "check_violation", "exclusion_violation", "restrict_violation",
    "deadlock_detected", "serialization_failure", "lock_not_available", "data_exception", "division_by_zero", "invalid_text_representation",
    "numeric_value_out_of_range", "string_data_right_truncation", "datetime_field_overflow", "insufficient_resources", "disk_full", "out_of_memory",
    "too_many_connections", "statement_too_complex", "too_many_columns", "too_many_arguments", "undefined_table", "undefined_column",
    "undefined_function", "undefined_object", "duplicate_table", "duplicate_column", "duplicate_object", "duplicate_database", "duplicate_schema",
    "ambiguous_column", "ambiguous_function", "syntax_error", "connection_exception", "connection_failure", "protocol_violation",
    "invalid_transaction_state", "read_only_sql_transaction", "no_active_sql_transaction", "system_error", "io_error", "config_file_error",
    "query_canceled", "admin_shutdown", "crash_shutdown", "cannot_connect_now", "raise_exception", "no_data_found", "too_many_rows",
)
BACKENDS = [
    "autovacuum", "autovacuum launcher", "autovacuum worker", "checkpointer", "background writer", "bgwriter", "walwriter", "wal writer", "walsender", "wal sender",
    "walreceiver", "wal receiver", "startup", "archiver", "parallel worker", "parallel leader", "logical replication launcher", "logical replication worker",
    "stats collector", "postmaster", "postgres", "backend", "recovery",
]
SHARED_LOCKS = ["AccessShareLock", "RowShareLock", "ShareLock", "ShareRowExclusiveLock", "ShareUpdateExclusiveLock"]
EXCLUSIVE_LOCKS = ["RowExclusiveLock", "ExclusiveLock", "AccessExclusiveLock"]
CHECKPOINT = [
    "checkpoint starting", "checkpoint complete", "checkpoint", "time", "xlog", "wal", "shutdown", "immediate", "force", "checkpointer", "restartpoint", "wrote",
    "sync", "synced", "total", "longest", "average",
]
RECOVERY = [
    "redo starts at", "redo done at", "redo", "recovery", "recovering", "recovered", "consistent recovery state", "ready to accept connections",
    "ready to accept read only connections", "entering standby mode", "starting point-in-time recovery", "requested", "database system was interrupted",
    "database system was not properly shut down", "database system is ready", "database system was shut down", "database system is starting up", "startup",
    "starting up", "shutting down", "shut down", "archive recovery", "restored log file", "selected new timeline", "streaming replication", "primary", "standby", "replica",
]
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}(?:/\d{{1,2}})?\b"
#: Eight groups of hexadecimal digits, or fewer around one double colon; a mask may follow. No letter, digit or colon touches it.
HEXES = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\w:])(?:(?:{HEXES}:){{7}}{HEXES}|{HEXES}(?::{HEXES}){{0,5}}::(?:{HEXES}(?::{HEXES}){{0,5}})?|::{HEXES}(?::{HEXES}){{0,6}})(?:/\d{{1,3}})?(?![\w:])"


def _sqlstate_class(code: Column) -> Column:
    two = F.substring(code, 1, 2)
    return F.when(two == "00", "success").when(two.isin("01", "02"), "warning").when(two.isin("XX", "YY", "ZZ", "P0", "F0"), "internal").otherwise("error")


def _duration_class(text: Column) -> Column:
    return duration_severity(F.regexp_extract(text, r"^(\d+(?:\.\d+)?)", 1).try_cast("double"))


#: The patterns decide what counts as an entity, so results depend on their every detail.
EXTRACTORS = (
    Extractor("timestamp", 100, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{3,6})?(?: ?(?:[A-Z]{2,4}|[+-]\d{2}:?\d{2}))?", needs=":"),
    Extractor("pid", 110, r"\[(\d+)(?:-\d+)?\]", needs="["),
    Extractor("context", 120, r"(?:DETAIL|HINT|CONTEXT|STATEMENT|QUERY|LOCATION):", needs=":"),
    Extractor("sqlstate", 200, r"\b([0-9A-Z]{5})\b", kind=_sqlstate_class),
    Extractor("error_name", 210, keyword_pattern(ERROR_NAMES), needs="_"),
    Extractor("duration", 300, r"\b(\d+(?:\.\d+)?)\s*(ms)\b", needs="ms", kind=_duration_class),
    Extractor("memory", 310, r"(?i)\d+(?:\.\d+)?\s*(?:bytes|kB|MB|GB|TB)\b"),
    Extractor("statistics", 320, r"(?i)\b(\d+(?:\.\d+)?)\s*(buffers?|pages?|tuples?|rows?|transactions?|blocks?|segments?|files?|%)"),
    Extractor("identifier", 400, r'"(?:[^"\\]|""|\\.)*"', needs='"'),
    Extractor("relation", 410, r'(?i)\b(?:relation|(?:foreign )?table|index|sequence|constraint|(?:materialized )?view)\s+"?([a-zA-Z_][a-zA-Z0-9_]*)"?', group=1),
    Extractor("schema", 420, r'\b([a-zA-Z_][a-zA-Z0-9_]*)\.(?:"[^"]+"|[a-zA-Z_][a-zA-Z0-9_]*)', needs="."),
    Extractor("lsn", 500, r"\b[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\b", needs="/"),
    Extractor("wal_segment", 510, r"\b[0-9A-Fa-f]{24}\b"),
    Extractor("txid", 520, r"(?i)\b(?:xid|xmin|xmax|transaction)\s*:?\s*(\d+)\b", group=1),
    Extractor("connection", 600, r'(?i)\b(host|port|user|database|application_name)=("[^"]*"|[^\s,]+)', needs="=", kind=lambda t: F.lower(F.substring_index(t, "=", 1))),
    Extractor("ip", 610, f"(?:{IPV4})|(?:{IPV6})"),
    Extractor("backend", 620, keyword_pattern(BACKENDS)),
    Extractor("sql_param", 700, r"\$\d+", needs="$", in_sql=True),
    Extractor("sql_string", 720, r"(?s)\$([a-zA-Z_][a-zA-Z0-9_]*)?\$.*?\$\1?\$|'(?:[^']|'')*'", in_sql=True),
    Extractor("sql_number", 730, r"\b(?:0x[0-9A-Fa-f]+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\b", in_sql=True),
    Extractor("sql_operator", 740, r"<>|!=|<=|>=|\|\||::|[=<>+\-*/%!|:&^~@#]", in_sql=True),
    Extractor("lock_type", 800, keyword_pattern(SHARED_LOCKS + EXCLUSIVE_LOCKS, False), needs="lock", kind=lambda t: F.when(t.isin(*SHARED_LOCKS), "share").otherwise("exclusive")),
    Extractor("lock_wait", 810, r"(?i)\b(?:process \d+ still waiting|(?:still )?waiting for|acquired|deadlock detected|lock timeout)\b"),
    Extractor("checkpoint", 900, keyword_pattern(CHECKPOINT)),
    Extractor("recovery", 910, keyword_pattern(RECOVERY)),
    Extractor("boolean", 1000, r"(?i)\b(on|off|true|false|yes|no)\b", kind=lambda t: F.when(F.lower(t).isin("on", "true", "yes"), "true").otherwise("false")),
    Extractor("null", 1010, r"(?i)\bNULL\b", needs="null"),
    Extractor("oid", 1020, r"(?i)\b(OID|regclass|regtype|regproc)\s*[=:]?\s*(\d+)\b"),
    Extractor("path", 1030, r"\B(/(?:[\w.-]+/)+[\w.-]+)\b", needs="/"),
)
BY_NAME = {e.name: e for e in EXTRACTORS}


def enabled(names: set[str] | None = None, disabled: set[str] = frozenset(), more: tuple[Extractor, ...] = ()) -> tuple[Extractor, ...]:
    """The built-in extractors of these names (all without names), but for disabled ones, and more."""
    unknown = ((names or set()) | set(disabled)) - set(BY_NAME)
    if unknown:
        raise ValueError(f"unknown extractors: {', '.join(sorted(unknown))}")
    return tuple(e for e in EXTRACTORS if (names is None or e.name in names) and e.name not in disabled) + more


def sql_keyword(words: list[str]) -> Extractor:
    """The extractor of SQL keywords, which come from functions.sql.keywords."""
    return Extractor("sql_keyword", 710, keyword_pattern(words), in_sql=True)


def custom(name: str, pattern: str, priority: int = 1050) -> Extractor:
    """A user's extractor; its name must be new and its pattern never empty."""
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name) or name in BY_NAME:
        raise ValueError(f"bad name: {name}")
    if not pattern or re.search(pattern, ""):
        raise ValueError("the pattern is empty or matches the empty text")
    return Extractor(name, max(priority, 1050), pattern)


#: Named parts of an entity, each with what stands before it in the entity.
PARTS = {
    "timestamp": (("date", "", r"\d{4}-\d{2}-\d{2}"), ("time", ".{11}", r"\d{2}:\d{2}:\d{2}"), ("ms", r".{19}\.", r"\d{3,6}"), ("tz", r".{19}(?:\.\d{3,6})? ?", r"[A-Z]{2,4}|[+-]\d{2}:?\d{2}")),
    "memory": (("value", "", r"\d+(?:\.\d+)?"), ("unit", r"\d+(?:\.\d+)?\s*", "[A-Za-z]+")),
    "lsn": (("segment", "", "[0-9A-Fa-f]+"), ("offset", "[0-9A-Fa-f]+/", "[0-9A-Fa-f]+")),
}


def parts(found: DataFrame) -> DataFrame:
    """Rows of spans (entity, start, end, text, ...), those of entities with parts replaced by one row per part that is there, named entity.part."""

    def one(name: str, part: str, head: str, body: str) -> Column:
        form = f"^({head})({body})"
        start = F.col("start") + F.length(F.regexp_extract("text", form, 1))
        value = F.regexp_extract("text", form, 2)
        return F.struct(F.lit(f"{name}.{part}").alias("entity"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("text"))

    rows = F.array(F.struct("entity", "start", "end", "text"))
    for name, pieces in PARTS.items():
        rows = F.when(F.col("entity") == name, F.array(*[one(name, *p) for p in pieces])).otherwise(rows)
    kept = [c for c in found.columns if c not in ("entity", "start", "end", "text")]
    out = found.select(*kept, F.explode(rows).alias("_part")).where("_part.text <> ''")
    return out.select(*[F.col(c) if c in kept else F.col(f"_part.{c}") for c in found.columns])


#: Stand around a match, and between it and its group, while a text is searched.
MARK, INNER = "\x01", "\x02"


def plain(text: Column) -> Column:
    """A text of the same length without marks."""
    return F.translate(text, MARK + INNER, "\x03\x03")


def spans(text: Column, e: Extractor, ordinal: int = 0, shift: Column | None = None, low: Column | None = None) -> Column:
    """All matches of one extractor in a text without marks (plain): one pass marks them, and the parts between marks are folded into places.

    low: the text in lower case, if it is there already."""
    none = F.array().cast(SPAN)
    form = f"{MARK}$0{INNER}${e.group}{MARK}" if e.group else f"{MARK}$0{MARK}"
    marked = F.regexp_replace(text, F.lit(e.pattern), F.lit(form))
    if e.needs:
        marked = F.when(F.contains(F.lower(text) if low is None else low, F.lit(e.needs)), marked)

    def step(acc, x):
        hit = F.substring_index(x, INNER, 1) if e.group else x
        part = F.substring_index(x, INNER, -1) if e.group else x
        # A group that is not the whole match ends it, but for a closing quote.
        inset = F.length(hit) - F.length(part) - F.when(hit.endswith('"') & ~part.endswith('"'), 1).otherwise(0) if e.group else F.lit(0)
        start = acc["at"] + inset if shift is None else acc["at"] + inset + shift
        one = F.struct(
            start.cast("int").alias("start"), F.lit(e.priority).alias("priority"), F.lit(ordinal).alias("ordinal"), (start + F.length(part)).cast("int").alias("end"),
            F.lit(e.name).alias("entity"), part.alias("text"), (e.kind(part) if e.kind else F.lit(None).cast("string")).alias("class"),
        )
        out = F.when(acc["hit"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(F.when(acc["hit"], hit).otherwise(x))).alias("at"), (~acc["hit"]).alias("hit"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("out"))
    fold = lambda m: F.aggregate(F.split(m, MARK, -1), begin, step, lambda a: a["out"])
    # The array holds the marked text once; without a mark there is nothing to fold.
    return F.flatten(F.transform(F.filter(F.array(marked), lambda m: F.coalesce(F.contains(m, F.lit(MARK)), F.lit(False))), fold))


def chain(text: Column, sql: Column, extractors: tuple[Extractor, ...] = EXTRACTORS, low: Column | None = None) -> Column:
    """Matches of all extractors without overlaps: by place, then priority; what begins before the last end is dropped. sql: the text's region of SQL."""
    shift = F.length(sql["prefix"])
    found = [spans(sql["sql"], e, k, shift) if e.in_sql else spans(text, e, k, None, low) for k, e in enumerate(extractors)]
    start = F.struct(F.lit(0).alias("last"), F.array().cast(SPAN).alias("out"))
    step = lambda a, x: F.when((x["start"] >= a["last"]) & (x["end"] > x["start"]), F.struct(x["end"].alias("last"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    return F.aggregate(F.array_sort(F.concat(*found)), start, step, lambda a: a["out"])


def with_region(logs: DataFrame, depth: int | None = None) -> DataFrame:
    """seq with the message, its text without marks, that in lower case, and its SQL; only so many characters are looked at, where depth is given."""
    df = once(logs.select("seq", "message"), "_text", plain(F.substring("message", 1, depth) if depth else F.col("message")))
    return once(once(df, "_low", F.lower("_text")), "_sql", region(F.col("_text")))


def annotated(logs: DataFrame, extractors: tuple[Extractor, ...] = EXTRACTORS, depth: int | None = None, in_parts: bool = False) -> DataFrame:
    """One row per span: seq, entity, start, end, text, class, priority. in_parts: entities that have named parts come as these (see parts)."""
    found = with_region(logs, depth).select("seq", "message", F.explode(chain(F.col("_text"), F.col("_sql"), extractors, F.col("_low"))).alias("s"))
    out = found.select("seq", "s.entity", "s.start", "s.end", _own_text(), "s.class", "s.priority")
    return parts(out) if in_parts else out


def _own_text() -> Column:
    return F.substring(F.col("message"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text")


def texts_of(logs: DataFrame, name: str) -> DataFrame:
    """One row per match of one extractor alone."""
    e = BY_NAME[name]
    df = with_region(logs) if e.in_sql else once(logs, "_text", plain(F.col("message")))
    found = spans(F.col("_sql.sql"), e, 0, F.length("_sql.prefix")) if e.in_sql else spans(F.col("_text"), e)
    return df.select("seq", "message", F.explode(found).alias("s")).select("seq", "s.start", "s.end", _own_text(), "s.class")
