"""Rows as text: compact, full, chosen fields, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_markup
from ..sources.logs import FIELDS

#: Secondary fields of the full form with their labels; fixed values.
LABELS = {
    "application_name": "Application", "database_name": "Database", "user_name": "User", "query": "Query", "detail": "Detail", "hint": "Hint", "context": "Context",
    "location": "Location", "backend_type": "Backend", "session_id": "Session",
}
#: Names that a projection may have; fixed values.
SHOWN = {
    "timestamp": "timestamp", "pid": "pid", "level": "level", "message": "message", "sql_state": "sql_state", "user": "user_name", "database": "database_name",
    "application": "application_name", "query": "query", "detail": "detail", "hint": "hint", "context": "context", "location": "location",
    "backend_type": "backend_type", "session_id": "session_id", "command_tag": "command_tag",
}
CORE = ("timestamp", "level", "message", "raw", "pid", "format", "source_file")


def _clock() -> Column:
    return F.date_format("timestamp", "HH:mm:ss.SSS")


def compact() -> Column:
    """Time, [pid], level and message on one line; a pid of 0 is not shown."""
    pid = F.when(F.col("pid") != 0, F.concat(F.lit("["), F.col("pid").cast("string"), F.lit("] ")))
    level = F.rpad("level", 7, " ")
    head = F.when(F.nullif(F.col("sql_state"), F.lit("")).isNotNull(), F.concat(level, F.lit(" "), F.col("sql_state"), F.lit(": "))).otherwise(F.concat(level, F.lit(": ")))
    return F.concat(F.coalesce(F.concat(_clock(), F.lit(" ")), F.lit("")), F.coalesce(pid, F.lit("")), head, F.col("message"))


def tail_compact() -> Column:
    """As a tail shows it: the file first, the pid five wide, no blank between level and code."""
    pid = F.when(F.col("pid") != 0, F.concat(F.lit("["), F.rpad(F.col("pid").cast("string"), 5, " "), F.lit("]")))
    file = F.when(F.col("source_file").isNotNull(), F.concat(F.lit("["), F.col("source_file"), F.lit("]")))
    return F.concat_ws(" ", file, _clock(), pid, F.concat(F.rpad("level", 7, " "), F.coalesce(F.nullif(F.col("sql_state"), F.lit("")), F.lit("")), F.lit(":")), F.col("message"))


def full() -> Column:
    """The compact line, then each secondary field that has a value on a line of its own."""
    rest = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in LABELS.items()]
    return F.concat_ws("\n  ", compact(), *rest)


def chosen(names: list[str]) -> tuple[list[Column], list[str]]:
    """Columns of the names that may be shown, and the other names."""
    return [F.col(SHOWN[n]).alias(n) for n in names if n in SHOWN], [n for n in names if n not in SHOWN]


def present() -> Column:
    """Names of the fields that have a value."""
    names = [*CORE, *[n for n, *_ in FIELDS if n not in CORE]]
    return F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))


def as_json() -> Column:
    """All fields with a value as one JSON object."""
    names = [*CORE, *[n for n, *_ in FIELDS if n not in CORE]]
    at = {"timestamp", "session_start"}
    return F.to_json(F.struct(*[(F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if n in at else F.col(n)).alias(n) for n in names]))


def export_json() -> Column:
    """timestamp, level, pid and message, nulls kept, markup removed."""
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    return F.to_json(F.struct(at, "level", "pid", strip_markup(F.col("message")).alias("message")), {"ignoreNullFields": "false"})


def export_text(keep_markup: bool = True) -> Column:
    return F.col("raw") if keep_markup else strip_markup(F.col("raw"))


def status(shown: DataFrame) -> DataFrame:
    """Counters of the rows that are displayed."""
    return shown.agg(F.count_if(F.col("level").isin("ERROR", "FATAL", "PANIC")).alias("e"), F.count_if(F.col("level") == "WARNING").alias("w"), F.count("*").alias("total"))


def head(rows: DataFrame, first: int = 50) -> DataFrame:
    """The first rows of a log, parsed or not."""
    return rows.orderBy(F.col("seq").asc_nulls_last()).limit(first)


def server(logs: DataFrame, first: int = 50) -> DataFrame:
    """version and port that the first rows of a log tell. Of a long log, parse the head only."""
    m = F.col("message")
    version = F.nullif(F.regexp_extract(m, r"(?i)starting PostgreSQL (\d+(?:\.\d+)?)", 1), F.lit(""))
    port = F.coalesce(F.nullif(F.regexp_extract(m, r"listening on .*port (\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(m, r"\.s\.PGSQL\.(\d+)", 1), F.lit("")))
    found = head(logs, first).select("seq", version.alias("version"), port.try_cast("int").alias("port"))
    return found.agg(F.expr("min_by(version, seq) FILTER (WHERE version IS NOT NULL)").alias("version"), F.expr("min_by(port, seq) FILTER (WHERE port IS NOT NULL)").alias("port"))


def custom(names: list[str]) -> Column:
    """The chosen fields that have a value, blank between them: the time as a clock, the pid in brackets, the level seven wide."""
    own = {"timestamp": _clock(), "pid": F.when(F.col("pid") != 0, F.concat(F.lit("["), F.col("pid").cast("string"), F.lit("]"))), "level": F.rpad("level", 7, " ")}
    return F.concat_ws(" ", *[own[n] if n in own else F.nullif(F.col(SHOWN[n]).cast("string"), F.lit("")) for n in names if n in SHOWN])


def shown(mode: str = "compact", fmt: str = "text", names: list[str] | None = None) -> Column:
    """A row as the display settings ask: JSON whatever the mode, else compact, full or custom (with names); other modes are compact."""
    if fmt == "json":
        return as_json()
    if mode == "custom":
        return custom(names or [])
    return full() if mode == "full" else compact()


def merged(spans: Column) -> Column:
    """Spans of several patterns (arrays of struct with start and end, in any order) as the places that any of them covers: what overlaps or touches is one."""
    place = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(place, none, step)


def highlighted(slow: Column, marked: Column, plain: Column) -> Column:
    """What a line is shown as: as a slow query if it is one, else with the user's marks if it has any, else plainly."""
    return F.coalesce(slow, marked, plain)


def marked(message: Column, spans: Column) -> Column:
    """A message with its spans (array of start, end, ... in order, without overlaps) in double angle brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(message, a["at"] + 1, x["start"] - a["at"]), F.lit("«"), F.substring(message, x["start"] + 1, x["end"] - x["start"]), F.lit("»")).alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(message, a["at"] + 1, F.length(message))))
