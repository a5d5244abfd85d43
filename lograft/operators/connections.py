"""Connections: events from messages, open sessions, groups and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import session_seconds

AUTHORIZED = r"connection authorized:\s+user=(\S+)\s+database=(\S+)(?:\s+application_name=(\S+))?"
CLOSED = r"disconnection:\s+session time:\s+([\d:\.]+)\s+user=(\S+)\s+database=(\S+)\s+host=(\S+)(?:\s+port=(\d+))?"
#: Parts of FATAL messages that mean a refused connection; fixed values.
REFUSED = (
    "too many connections", "too many clients already", "connection limit exceeded", "password authentication failed", "no pg_hba.conf entry",
    "database .* does not exist", "role .* does not exist", "authentication failed",
)
DIMENSIONS = ("database", "user", "application", "host")


def event_type(message: Column, level: Column) -> Column:
    """connect, disconnect, failed or null. Connections merely received are no events."""
    refused = F.lower(message).rlike("|".join(REFUSED))
    return F.when(message.rlike(AUTHORIZED), "connect").when(message.rlike(CLOSED), "disconnect").when((level == "FATAL") & refused, "failed")


def _given(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def events(logs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """seq, timestamp, event_type, pid, user, database, application, host, port, duration_seconds; a row's own fields come before its message's."""
    m, kind = F.col("message"), F.col("event_type")
    on, off = kind == "connect", kind == "disconnect"
    part = lambda k_on, k_off: F.when(on & F.lit(k_on > 0), F.regexp_extract(m, AUTHORIZED, max(k_on, 1))).when(off & F.lit(k_off > 0), F.regexp_extract(m, CLOSED, max(k_off, 1)))
    at = F.col("timestamp") if as_of is None else F.coalesce("timestamp", as_of)
    found = logs.withColumn("event_type", event_type(m, F.col("level"))).where("event_type is not null")
    return found.select(
        "seq", at.alias("timestamp"), "event_type", "pid", _given(F.col("user_name"), part(1, 2)).alias("user"), _given(F.col("database_name"), part(2, 3)).alias("database"),
        F.coalesce(_given(F.col("application_name"), part(3, 0)), F.lit("unknown")).alias("application"), _given(F.col("remote_host"), part(0, 4)).alias("host"),
        F.coalesce("remote_port", part(0, 5).try_cast("int")).alias("port"), session_seconds(part(0, 1)).alias("duration_seconds"),
    )


def matching(events: DataFrame, database: str | None = None, user: str | None = None, application: str | None = None) -> DataFrame:
    """Exact values, case minded; null never matches."""
    for name, value in (("database", database), ("user", user), ("application", application)):
        if value is not None:
            events = events.where(F.col(name) == value)
    return events


def counters(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.agg(*[F.count_if(kind == k).alias(n) for k, n in (("connect", "connects"), ("disconnect", "disconnects"), ("failed", "failures"))])


def active(events: DataFrame) -> DataFrame:
    """Sessions whose process's last event but failures is a connect: one partial maximum per process and task."""
    last = events.where("pid is not null and event_type <> 'failed'").groupBy("pid").agg(F.max_by(F.struct("*"), "seq").alias("last"))
    return last.select("last.*").where("event_type = 'connect'")


def active_by(sessions: DataFrame) -> DataFrame:
    """(dimension, value, cnt) of open sessions by database, user, application and host in one pass."""
    named = sessions.select(*[F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("unknown")).alias(d) for d in DIMENSIONS])
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])).alias("p")
    return named.select(pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("cnt"))


def summary(events: DataFrame, database: str | None = None, user: str | None = None, application: str | None = None) -> DataFrame:
    """(section, name, cnt): connects, disconnects, failures and open sessions of all events, and the open sessions that match by database, user, application and host."""
    kinds = {"connect": "connects", "disconnect": "disconnects", "failed": "failures"}
    totals = counters(events).select(F.explode(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(n).alias("name"), F.col(n).alias("cnt")) for n in kinds.values()])).alias("t")).select("t.*")
    sessions = active(events).select(*DIMENSIONS)
    is_open = sessions.agg(F.lit("total").alias("section"), F.lit("open").alias("name"), F.count("*").alias("cnt"))
    some = active_by(matching(sessions, database, user, application)).select(F.col("dimension").alias("section"), F.col("value").alias("name"), "cnt")
    return totals.unionByName(is_open).unionByName(some)


def trend(events: DataFrame, as_of: Column, minutes: int = 60, bucket: int = 15) -> DataFrame:
    """bucket_idx (0 is the oldest), connects, disconnects; the future and failures do not count."""
    n = max(1, minutes // bucket)
    age = (F.unix_micros(as_of) - F.unix_micros("timestamp")) / 60_000_000
    some = events.withColumn("age", age).where(f"age >= 0 and age < {minutes} and event_type <> 'failed'")
    idx = F.greatest(F.lit(0), F.least(F.lit(n - 1), n - 1 - F.floor(F.col("age") / bucket))).cast("int")
    counts = some.groupBy(idx.alias("bucket_idx")).agg(F.count_if(F.col("event_type") == "connect").alias("connects"), F.count_if(F.col("event_type") == "disconnect").alias("disconnects"))
    every = events.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket_idx"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(counts, "bucket_idx", "left").select("bucket_idx", zero("connects"), zero("disconnects"))


def history(trend: DataFrame) -> DataFrame:
    """Totals of a trend, the net change, a label, and whether connections seem to leak."""
    t = trend.agg(F.sum("connects").alias("connects"), F.sum("disconnects").alias("disconnects"))
    c, d = F.col("connects"), F.col("disconnects")
    leak = ((c > 10) & (d == 0)) | ((c > 20) & (d < 0.1 * c))
    return t.select("connects", "disconnects", (c - d).alias("net"), F.when(c > d, "growing").when(c < d, "shrinking").otherwise("stable").alias("label"), leak.alias("leak"))
