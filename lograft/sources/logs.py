"""Lines of text, CSV and JSON logs as one typed table."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import LEVELS, known, normalised, rank
from ..functions.once import once
from ..functions.timestamps import log_timestamp, plain_timestamp

#: Columns of a CSV log in order; fixed values.
CSV_COLUMNS = (
    "log_time", "user_name", "database_name", "process_id", "connection_from", "session_id", "session_line_num", "command_tag", "session_start_time",
    "virtual_transaction_id", "transaction_id", "error_severity", "sql_state_code", "message", "detail", "hint", "internal_query", "internal_query_pos",
    "context", "query", "query_pos", "location", "application_name", "backend_type", "leader_pid", "query_id",
)
#: Keys of a JSON log; fixed values.
JSON_KEYS = (
    "timestamp", "user", "dbname", "pid", "remote_host", "remote_port", "session_id", "line_num", "session_start", "vxid", "txid", "error_severity",
    "state_code", "message", "detail", "hint", "internal_query", "internal_position", "context", "statement", "cursor_position", "func_name", "file_name",
    "file_line_num", "application_name", "backend_type", "leader_pid", "query_id",
)
#: The parsed row: name, type, CSV column, JSON key.
FIELDS = (
    ("timestamp", "timestamp", "log_time", "timestamp"), ("pid", "int", "process_id", "pid"), ("user_name", "string", "user_name", "user"),
    ("database_name", "string", "database_name", "dbname"), ("connection_from", "string", "connection_from", None), ("remote_host", "string", None, "remote_host"),
    ("remote_port", "int", None, "remote_port"), ("session_id", "string", "session_id", "session_id"), ("session_line_num", "bigint", "session_line_num", "line_num"),
    ("command_tag", "string", "command_tag", None), ("session_start", "timestamp", "session_start_time", "session_start"),
    ("virtual_transaction_id", "string", "virtual_transaction_id", "vxid"), ("transaction_id", "string", "transaction_id", "txid"),
    ("sql_state", "string", "sql_state_code", "state_code"), ("detail", "string", "detail", "detail"), ("hint", "string", "hint", "hint"),
    ("internal_query", "string", "internal_query", "internal_query"), ("internal_query_pos", "int", "internal_query_pos", "internal_position"),
    ("context", "string", "context", "context"), ("query", "string", "query", "statement"), ("query_pos", "int", "query_pos", "cursor_position"),
    ("location", "string", "location", None), ("func_name", "string", None, "func_name"), ("file_name", "string", None, "file_name"),
    ("file_line_num", "int", None, "file_line_num"), ("application_name", "string", "application_name", "application_name"),
    ("backend_type", "string", "backend_type", "backend_type"), ("leader_pid", "int", "leader_pid", "leader_pid"), ("query_id", "bigint", "query_id", "query_id"),
)
TIME, WORD, NUMBER = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)", r"(\w+)", r"(\d+)"
#: What stands before a line's level: time and zone in brackets, the process id in brackets and perhaps one more bracket; or
#: a bare time, and then a process id in brackets, perhaps with a zone before it, or only a zone.
IN_BRACKETS = rf"\[{TIME}\s+{WORD}\]\s+\[{NUMBER}\]\s+(?:\[[^\]]*\]\s+)?"
BARE = rf"{TIME}\s+(?:{WORD}?\s*\[{NUMBER}\]|{WORD})\s+"
#: Groups: time, zone, pid of the first; time, zone, pid, zone alone of the second; level; message.
TEXT_LINE = rf"(?Us)^(?:{IN_BRACKETS}|{BARE}){WORD}:\s*(.*)$"
CUT = "\u0001"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, source_file, source_path, seq) of text files, globs or folders; seq orders the lines of a file. Invalid UTF-8 becomes U+FFFD."""
    meta = F.col("_metadata")
    lines = spark.read.text(paths).select(F.make_valid_utf8("value").alias("value"), meta["file_name"].alias("source_file"), meta["file_path"].alias("source_path"))
    return lines.withColumn("seq", F.monotonically_increasing_id()).where(F.col("value").rlike(r"\S"))


def csv_fields(value: Column) -> Column:
    """Number of fields of a CSV line, commas in quotes aside."""
    bare = F.regexp_replace(value, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _json(value: Column) -> Column:
    return F.from_json(value, ", ".join(f"`{k}` string" for k in JSON_KEYS))


def _is_object(value: Column) -> Column:
    return F.coalesce(value.startswith("{") & F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


def _csv(value: Column) -> Column:
    return F.from_csv(value, F.lit(", ".join(f"`{c}` string" for c in CSV_COLUMNS)), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})


def line_format(value: Column) -> Column:
    """json, csv or text, from one line alone."""
    v = F.trim(value)
    row = _json(v)
    is_json = _is_object(v) & row["message"].isNotNull() & F.upper(row["error_severity"]).isin(*LEVELS)
    fields = csv_fields(v)
    csv = _csv(v)
    is_csv = fields.between(22, 26) & csv["log_time"].rlike(r"^\d{4}-\d{2}-\d{2}") & known(csv["error_severity"])
    return F.when(is_json, "json").when(F.coalesce(is_csv, F.lit(False)), "csv").otherwise("text")


def sticky_formats(lines: DataFrame) -> DataFrame:
    """lines with the format of their file, which its first line that is not blank decides; files are told apart by their paths, where lines have them."""
    key = "source_path" if "source_path" in lines.columns else "source_file"
    first = lines.where(F.col("value").rlike(r"\S")).groupBy(key).agg(F.min_by("value", "seq").alias("first"))
    return lines.join(first.select(key, line_format(F.col("first")).alias("format")), key)


def _with_text(df: DataFrame) -> DataFrame:
    """df with the array _p of a text line's time, zone, pid, level and message: one pass joins the groups, those of the head that does not fit are empty."""
    joined = F.regexp_replace("raw", TEXT_LINE, CUT.join(("$1$4", "$2$5$7", "$3$6", "$8", "$9")))
    df = once(df, "_h", joined)
    return once(df, "_p", F.when(F.col("_h") != F.col("raw"), F.split("_h", CUT, 5))).drop("_h")


def _typed(value: Column, kind: str) -> Column:
    value = F.nullif(value, F.lit(""))
    if kind == "timestamp":
        return log_timestamp(value)
    return value if kind == "string" else F.trim(value).try_cast(kind)


def parse(lines: DataFrame, fmt: str | None = None) -> DataFrame:
    """The typed table of lines (value, and what else they have); without fmt, from their column format.

    Lines that do not parse are kept whole as messages of level LOG without a timestamp. Line feeds end rows, so a statement
    over several lines gives several.
    """
    value = F.regexp_replace("value", r"[\r\n]+$", "")
    df = lines.withColumn("raw", value)
    df = df.withColumn("format", F.lit(fmt)) if fmt else df
    text, csv, js = ((F.col("format") == f) if fmt is None else F.lit(f == fmt) for f in ("text", "csv", "json"))
    if fmt in (None, "csv"):
        df = once(df, "_c", F.when(csv & (csv_fields(F.col("raw")) >= 14), _csv(F.col("raw"))))
    if fmt in (None, "json"):
        df = once(df, "_j", F.when(js & _is_object(F.trim("raw")), _json(F.col("raw"))))
    if fmt in (None, "text"):
        df = _with_text(df)
    none = F.lit(None).cast("string")
    pick = lambda c, j, k: F.coalesce(*[F.col(f"_c.{c}")] * (fmt in (None, "csv")), *[F.col(f"_j.{j}")] * (fmt in (None, "json")), *[F.when(text, F.get("_p", F.lit(k)))] * (fmt in (None, "text")))
    word, said = pick("error_severity", "error_severity", 3), pick("message", "message", 4)
    parsed = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c, f in (("_c", "csv"), ("_j", "json")) if fmt in (None, f)], F.lit(False))
    message = F.coalesce(said, F.when(parsed, "").otherwise(none), F.col("raw"))
    own = {"timestamp": plain_timestamp(F.regexp_replace(F.get("_p", F.lit(0)), r"\s+", " ")), "pid": F.get("_p", F.lit(2)).try_cast("int")}
    # Strings of either format first, so that each is converted once.
    columns = []
    for name, kind, c, j in FIELDS:
        parts = [F.col(f"_c.{c}")] * bool(c and fmt in (None, "csv")) + [F.col(f"_j.{j}")] * bool(j and fmt in (None, "json"))
        typed = _typed(F.coalesce(*parts) if len(parts) > 1 else parts[0], kind) if parts else F.lit(None).cast(kind)
        if name in ("timestamp", "pid") and fmt in (None, "text"):
            typed = F.coalesce(typed, F.when(text, own[name])) if parts else own[name]
        columns.append(typed.alias(name))
    rest = [F.col(c) for c in lines.columns if c not in ("value", "format", "raw")]
    level = normalised(word)
    zone = F.get("_p", F.lit(1)) if fmt in (None, "text") else none
    utc = parsed | F.coalesce(F.upper(zone) == "UTC", F.lit(False))
    out = df.select(*rest, utc.alias("ts_is_utc"), level.alias("level"), message.alias("message"), "raw", "format", *columns)
    return out.withColumn("level_rank", rank(F.col("level")))


def parse_logs(lines: DataFrame) -> DataFrame:
    """The typed table of lines whose files decide their formats: one plan per format, each without the others' columns."""
    known_format = sticky_formats(lines)
    text, csv, js = (parse(known_format.where(F.col("format") == f), f) for f in ("text", "csv", "json"))
    return text.unionByName(csv).unionByName(js)


def interleaved(logs: DataFrame) -> DataFrame:
    """Rows of several files in order of time, those without a time first, then by file and arrival."""
    return logs.orderBy(F.col("timestamp").asc_nulls_first(), "source_file", "seq")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for an intermediate table, in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex[:12]}"


def placed(logs: DataFrame) -> DataFrame:
    """All rows with place, from 1, in the order of interleaved: a range-partitioned sort and the offsets of its partitions."""
    spark = logs.sparkSession
    order = [F.col("timestamp").asc_nulls_first(), F.col("source_file").asc(), F.col("seq").asc()]
    ranged = logs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = scratch(spark, "placed")
    ranged.write.parquet(path)  # read twice, and a second sort may cut its ranges elsewhere
    rows = spark.read.schema(ranged.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    # As many rows as the sort has partitions.
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts = list(itertools.accumulate((r.n for r in sizes), initial=0))
    offsets = spark.createDataFrame([(r[0], at) for r, at in zip(sizes, starts)], "_part bigint, _start bigint")
    return rows.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_start")


def conf_values(lines: DataFrame, last: bool = True) -> DataFrame:
    """(name, setting) of a server's configuration file: the last (or first) line of a name counts."""
    pattern = r"^\s*([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(?:'((?:[^']|'')*)'|([^#\s]*))"
    found = lines.where(F.col("value").rlike(pattern)).select(
        "seq", F.lower(F.regexp_extract("value", pattern, 1)).alias("name"), F.concat(F.replace(F.regexp_extract("value", pattern, 2), F.lit("''"), F.lit("'")), F.regexp_extract("value", pattern, 3)).alias("setting")
    )
    pick = F.max_by if last else F.min_by
    return found.groupBy("name").agg(pick("setting", "seq").alias("setting"))


def stdin_lines(spark: SparkSession, lines) -> DataFrame:
    """Lines of a finite stream that the driver holds, as rows."""
    rows = [(k, line.rstrip("\r\n"), "stdin") for k, line in enumerate(lines) if line.strip()]
    return spark.createDataFrame(rows, "seq long, value string, source_file string")
