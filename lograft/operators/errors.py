"""Error statistics: counters, breakdowns, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqlstate
from ..functions.levels import ERRORS, TRACKED, WARNINGS
from ..functions.text import shortened, sparkline


def tracked(logs: DataFrame, since: Column | None = None, cleared_at_seq: int | None = None) -> DataFrame:
    """Warnings and worse; since: a least time; cleared_at_seq: only rows that arrived later."""
    out = logs.where(F.col("level").isin(*TRACKED))
    if since is not None:
        out = out.where(F.col("timestamp") >= since)
    return out if cleared_at_seq is None else out.where(F.col("seq") > cleared_at_seq)


def events(logs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Error events: messages cut to 200 characters, a missing time replaced by as_of."""
    at = F.col("timestamp") if as_of is None else F.coalesce("timestamp", as_of)
    return tracked(logs).select(
        "seq", at.alias("timestamp"), "level", "sql_state", F.substring("message", 1, 200).alias("message"), "pid", F.col("database_name").alias("database"), F.col("user_name").alias("user")
    )


def newest(logs: DataFrame, n: int = 10_000) -> DataFrame:
    """The last n rows by arrival."""
    return logs.orderBy(F.desc("seq")).limit(n)


def counters(logs: DataFrame) -> DataFrame:
    """errors, warnings and the time of the last one to arrive."""
    return tracked(logs).agg(
        F.count_if(F.col("level").isin(*ERRORS)).alias("errors"), F.count_if(F.col("level").isin(*WARNINGS)).alias("warnings"), F.max_by("timestamp", "seq").alias("last_at")
    )


def by_level(logs: DataFrame) -> DataFrame:
    return tracked(logs).groupBy("level").agg(F.count("*").alias("cnt"))


def by_code(logs: DataFrame) -> DataFrame:
    """Counts by code with names and classes; rows without a code are UNKNOWN; first_seq breaks ties."""
    out = tracked(logs).groupBy(F.coalesce("sql_state", F.lit("UNKNOWN")).alias("code")).agg(F.count("*").alias("cnt"), F.min("seq").alias("first_seq"))
    return out.select("code", sqlstate.name(F.col("code")).alias("name"), sqlstate.category(F.col("code")).alias("category"), "cnt", "first_seq")


def top_codes(logs: DataFrame, k: int = 10) -> DataFrame:
    return by_code(logs).orderBy(F.desc("cnt"), "first_seq").limit(k)


def examples(logs: DataFrame, code: str, k: int = 5) -> DataFrame:
    """The last k rows of one code, oldest first, messages cut to 60 characters."""
    last = tracked(logs).where(F.col("sql_state") == code).orderBy(F.desc("seq")).limit(k)
    return last.select("seq", "timestamp", shortened(F.col("message"), 60).alias("message")).orderBy("seq")


def code_summary(logs: DataFrame, code: str, k: int = 5) -> DataFrame:
    """One row for a code: how often it came, when first and last, and its last k messages, oldest first and cut to 60 characters. Each task keeps k rows at most."""
    some = tracked(logs).where(F.col("sql_state") == code)
    total = some.agg(F.count("*").alias("cnt"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    last = examples(logs, code, k).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]).alias("messages"))
    return total.crossJoin(last).select(F.lit(code).alias("code"), "cnt", "first_at", "last_at", "messages")  # of one row each


def summary(logs: DataFrame, k: int = 10) -> DataFrame:
    """(section, name, cnt): errors and warnings in all, each level, and the k most frequent codes (ties by name), from one pass over the rows."""
    counts = tracked(logs).groupBy("level", F.coalesce("sql_state", F.lit("UNKNOWN")).alias("code")).agg(F.count("*").alias("n"))  # a row for each level and code
    kind = F.when(F.col("level").isin(*ERRORS), "errors").otherwise("warnings")
    parts = F.array(*[F.struct(F.lit(section).alias("section"), name.alias("name")) for section, name in (("total", kind), ("level", F.col("level")), ("code", F.col("code")))])
    sums = counts.select("n", F.explode(parts).alias("p")).groupBy("p.section", "p.name").agg(F.sum("n").alias("cnt"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("cnt"), "name"))
    return sums.withColumn("_place", place).where((F.col("section") != "code") | (F.col("_place") <= k)).select("section", "name", "cnt")


def trend(logs: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """minute_idx (0 is the oldest), cnt for every minute before as_of; ages are cut towards zero, so the last future minute counts as now."""
    age = ((F.unix_micros(as_of) - F.unix_micros("timestamp")) / 60_000_000).cast("int")
    counts = tracked(logs).select((F.lit(minutes - 1) - age).alias("minute_idx")).where(F.col("minute_idx").between(0, minutes - 1)).groupBy("minute_idx").agg(F.count("*").alias("cnt"))
    every = logs.sparkSession.range(minutes).select(F.col("id").cast("int").alias("minute_idx"))
    return every.join(counts, "minute_idx", "left").select("minute_idx", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def trend_summary(trend: DataFrame) -> DataFrame:
    """total, average, the peak and whether it is a spike (over twice the average), and a sparkline."""
    found = trend.agg(
        F.sum("cnt").alias("total"), F.avg("cnt").alias("average"), F.max("cnt").alias("peak"), F.min_by("minute_idx", F.struct(-F.col("cnt"), "minute_idx")).alias("peak_idx"),
        F.transform(F.array_sort(F.collect_list(F.struct("minute_idx", "cnt"))), lambda x: x["cnt"]).alias("_all"),
    )
    return found.select("total", "average", "peak", "peak_idx", (F.col("peak") > 2 * F.col("average")).alias("spike"), sparkline(F.col("_all")).alias("line"))
