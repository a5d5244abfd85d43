"""Streaming jobs over parsed logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import connections, errors
from ..sources.logs import interleaved, parse
from .tail import TailSource


def tailed(spark: SparkSession, path: str, fmt: str = "text", position: str = "latest") -> DataFrame:
    """The parsed rows of growing files; their order in a batch is the sink's business (see in_order)."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("logtail").option("startingPosition", position).load(path)
    return parse(lines, fmt)


def fan_out(logs: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """One query whose batches go to all sinks in turn; the batch is held while they read it."""

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, n)
        finally:
            batch.unpersist()

    return logs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def in_order(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink whose batches come in order of time, file and arrival."""
    return lambda batch, n: write(interleaved(batch), n)


def error_counts(logs: DataFrame) -> DataFrame:
    """Running counts by level, for complete or update mode."""
    return errors.by_level(logs)


def connection_events(logs: DataFrame) -> DataFrame:
    """Events as they come, for append mode."""
    return connections.events(logs)


def last_events(logs: DataFrame) -> DataFrame:
    """Each process's last event but failures, for update mode; sessions are open where it is a connect."""
    some = connections.events(logs).where("pid is not null and event_type <> 'failed'")
    return some.groupBy("pid").agg(F.max_by(F.struct("seq", "timestamp", "event_type", "user", "database", "application", "host"), "seq").alias("last"))


def _limit(gap_us: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        last = state.get[0] if state.exists else None
        keep = []
        for at in rows["at"]:
            go = last is None or at - last >= gap_us
            keep.append(go)
            last = at if go else last
        state.update((int(last),))
        yield rows[keep][["source_file", "seq", "at"]]

    return run


def limited(logs: DataFrame, seconds: float = 5) -> DataFrame:
    """Rows of each file that come at least so many seconds after the last that passed; append mode.

    The state is one time per file. A batch's rows of one file are decided in order of arrival.
    """
    rows = logs.where("timestamp is not null").select("source_file", "seq", F.unix_micros("timestamp").alias("at"))
    return rows.groupBy("source_file").applyInPandasWithState(_limit(int(seconds * 1_000_000)), "source_file string, seq bigint, at bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


HELD = "at array<bigint>, source_file array<string>, seq array<bigint>, value array<string>, newest bigint, released bigint"


def _reorder(delay_us: int, idle_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["at", "source_file", "seq", "value"]
        at, files, seqs, values, newest, released = state.get if state.exists else ([], [], [], [], None, None)
        held = pd.DataFrame({"at": pd.array(list(at), "int64"), "source_file": list(files), "seq": pd.array(list(seqs), "int64"), "value": list(values)})
        idle = state.hasTimedOut
        fresh = [held] if len(held) else []
        fresh += [] if idle else [b[columns] for b in batches]
        rows = pd.concat(fresh) if fresh else held
        if len(rows):
            newest = max(int(rows["at"].max()), newest if newest is not None else int(rows["at"].max()))
        rows = rows.sort_values(["at", "source_file", "seq"], kind="stable")
        upto = newest if idle or newest is None else newest - delay_us
        go = rows["at"] <= upto if upto is not None else rows["at"] < 0
        out, rest = rows[go].copy(), rows[~go]
        out["late"] = out["at"] < released if released is not None else False
        if len(out):
            released = max(int(out["at"].max()), released if released is not None else int(out["at"].max()))
        state.update((*[rest[c].tolist() for c in columns], newest, released))
        if len(rest):
            state.setTimeoutDuration(idle_ms)
        out.insert(0, "log", key[0])
        out["place"] = range(len(out))
        yield out

    return run


def reordered(logs: DataFrame, by: str | None = None, delay: float = 5, idle: float = 10) -> DataFrame:
    """The lines of files that are written out of step, in order of time: log, at (microseconds), source_file, seq, value, late, place; append mode.

    by: a column that tells servers apart, whose lines are ordered for themselves; without it all lines are one log. A line waits in
    keyed state until one that is so many seconds younger has come, or for idle seconds if none comes. Rows of a batch are in the order of place,
    and batches follow each other; a line behind what was released comes at once, marked late. Lines without a time count as the oldest.
    State holds the lines of the last delay seconds of a server.
    """
    at = F.coalesce(F.unix_micros("timestamp"), F.lit(0)).alias("at")
    rows = logs.select((F.col(by).cast("string") if by else F.lit("")).alias("log"), at, "source_file", "seq", F.col("raw").alias("value"))
    out = "log string, at bigint, source_file string, seq bigint, value string, late boolean, place bigint"
    return rows.groupBy("log").applyInPandasWithState(_reorder(int(delay * 1_000_000), int(idle * 1000)), out, HELD, "append", GroupStateTimeout.ProcessingTimeTimeout)


CHANGES = "pid int, change int, seq bigint, user string, database string, application string, host string"


def _session(forget_ms: int | None):
    fields = ["user", "database", "application", "host"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else None  # last seq, whether open, fields
        if state.hasTimedOut:
            state.remove()
            gone = [(key[0], -1, before[0], *before[2:])] if before and before[1] else []
            yield pd.DataFrame(gone, columns=["pid", "change", "seq", *fields])
            return
        rows = pd.concat(list(batches)).astype(object)
        last = rows.loc[rows["seq"].astype("int64").idxmax()]
        if before is not None and last["seq"] < before[0]:
            return  # all older than what is known
        now = (int(last["seq"]), last["event_type"] == "connect", *[None if pd.isna(last[f]) else last[f] for f in fields])
        out = [(key[0], -1, now[0], *before[2:])] if before and before[1] else []
        out += [(key[0], 1, now[0], *now[2:])] if now[1] else []
        state.update(now)
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["pid", "change", "seq", *fields])

    return run


def session_changes(logs: DataFrame, forget: float | None = None) -> DataFrame:
    """Sessions that open (change 1) and close (-1) as a stream, append mode: a process's session is open while its last event but failures is a connect.

    State is one row per process. forget: seconds after which a process without events is dropped, and its session closed, so that state does
    not grow with all processes that ever were. A batch's changes of a process are its net change.
    """
    some = connections.events(logs).where("pid is not null and event_type <> 'failed'").select("pid", "seq", "event_type", *connections.DIMENSIONS)
    known = "seq bigint, open boolean, user string, database string, application string, host string"
    some = some.select("pid", "seq", "event_type", "user", "database", "application", "host")
    timeout = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout
    return some.groupBy("pid").applyInPandasWithState(_session(None if forget is None else int(forget * 1000)), CHANGES, known, "append", timeout)


def by_batch(rows: DataFrame, path: str, checkpoint: str):
    """The stream that stores each batch of rows as a folder of its own, which a repeated batch replaces; to be started."""
    return rows.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint)


def open_by(changes: DataFrame) -> DataFrame:
    """(dimension, value, cnt) of the sessions that are open after all these changes: sums that are taken before the shuffle."""
    named = changes.select("change", *[F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("unknown")).alias(d) for d in connections.DIMENSIONS])
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in connections.DIMENSIONS])).alias("p")
    return named.select("change", pairs).groupBy("p.dimension", "p.value").agg(F.sum("change").alias("cnt")).where("cnt > 0")
