"""What depends on the order of arrival: rings, repeats, rates."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.logs import scratch


def ring(rows: DataFrame, n: int = 10_000) -> DataFrame:
    """The last n rows: a top-n per task before the one that merges them."""
    return rows.orderBy(F.desc("seq")).limit(n)


def without_repeats(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Rows whose value differs from the one before in their group."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy("seq"))
    first = F.row_number().over(Window.partitionBy(by).orderBy("seq")) == 1
    return rows.withColumn("_new", first | ~F.col(value).eqNullSafe(before)).where("_new").drop("_new")


def last_with_prefix(rows: DataFrame, value: str, prefix: str) -> DataFrame:
    """The last value that begins with prefix and is longer."""
    return rows.where(F.col(value).startswith(prefix) & (F.col(value) != prefix)).agg(F.max_by(value, "seq").alias("found"))


def since_pause(rows: DataFrame, seq: int) -> DataFrame:
    return rows.agg(F.count_if(F.col("seq") > seq).alias("cnt"))


def age_of_last(rows: DataFrame, as_of: Column) -> DataFrame:
    """Seconds from the last row to arrive until as_of."""
    return rows.agg(F.max_by("timestamp", "seq").alias("last")).select(((F.unix_micros(as_of) - F.unix_micros("last")) / 1_000_000).alias("seconds"))


#: Rows of a limiter's block.
BLOCK = 1 << 16


def allowed(rows: DataFrame, by: str | None, seconds: float = 5, block: int = BLOCK) -> DataFrame:
    """Rows that a limiter lets pass: at least so many seconds after the last that passed, by arrival, in each group or, without by, among all rows.

    Rows are sorted in ranges of (group, seq) and cut into blocks. Of a block's rows, those that may be the first to pass are the
    ones later than all before them in the block, and each leads to one last row; that is the block's table. What enters
    a block is no later than all before it, so only the rows near its start count. Those short tables are chained in order,
    and each block then passes its own rows. No task holds or reads the rows of a group.
    """
    gap, spark = int(seconds * 1_000_000), rows.sparkSession
    key = [by] if by else []
    found = rows.where("timestamp is not null").select(*key, "seq", "timestamp", F.unix_micros("timestamp").alias("_at"))
    order = [*key, "seq", "timestamp"]
    schema = StructType([*found.schema.fields, *StructType.fromDDL("_part long, _nth long").fields])
    path = scratch(spark, "limited")
    found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered(by, block), schema).write.parquet(path)
    cut = spark.read.schema(schema).parquet(path)
    # Tables of blocks: sorted again inside their task, since a file may be read in several splits.
    place = [*key, "_part", "_nth"]
    ordered = cut.repartition("_part", "_nth").sortWithinPartitions("_part", "_nth", "seq", "timestamp")
    tables = ordered.mapInArrow(_tables(by, gap), StructType([*found.select(*key).schema.fields, *StructType.fromDDL(TABLE).fields]))
    group = Window.partitionBy(*key).orderBy("_part", "_nth")
    before = F.max("top").over(group.rowsBetween(Window.unboundedPreceding, -1))
    near = F.col("before") + gap
    some = F.filter("ways", lambda w, k: (k == 0) | (F.get("ways", k - 1)["at"] < near))  # one at or behind the bound stays
    short = tables.withColumn("before", before).select(*place, F.when(F.col("before").isNull(), F.slice("ways", 1, 1)).otherwise(some).alias("ways"))
    chained = short.repartition(*(key or [F.lit(0)])).sortWithinPartitions(*place).mapInArrow(_chain(by, gap), "_part long, _nth long, _last long")
    whole = cut.join(chained, ["_part", "_nth"]).repartition("_part", "_nth").sortWithinPartitions("_part", "_nth", "seq", "timestamp")
    return whole.mapInArrow(_passing(key, gap), found.drop("_at").schema)


TABLE = "_part long, _nth long, top long, ways array<struct<at:long,last:long>>"


def _numbered(by: str | None, block: int):
    """Rows with their task and block; a block is of one group and of at most so many rows."""

    def run(batches):
        part, nth, group, held = TaskContext.get().partitionId(), -1, None, block
        for batch in batches:
            names = batch[by].to_pylist() if by else [0] * batch.num_rows
            blocks = []
            for name in names:
                if held == block or name != group:
                    nth, group, held = nth + 1, name, 0
                held += 1
                blocks.append(nth)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int64()), pa.array(blocks, pa.int64())], [*batch.schema.names, "_part", "_nth"])

    return run


def _whole(batches):
    """The rows of each block, as tables."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        place = table["_part"].to_numpy().astype(np.int64) << 40 | table["_nth"].to_numpy()
        ends = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist()]
        for a, b in zip(ends, ends[1:]):
            yield table.slice(a, b - a)
        held = table.slice(ends[-1])
    if held is not None and held.num_rows:
        yield held


def _next(at: np.ndarray, gap: int) -> list[int]:
    """For each row the first one behind it that is at least gap later, len(at) without one."""
    n = len(at)
    out, stack = [n] * n, []  # rows behind that are later than all between, the nearest last
    times: list[int] = []  # their times, negated, so that they ascend
    for k in range(n - 1, -1, -1):
        # Times ascend from the nearest row to the farthest; the nearest that is late enough is sought among them.
        where = bisect.bisect_right(times, -(int(at[k]) + gap))
        out[k] = stack[where - 1] if where else n
        while times and -times[-1] <= at[k]:
            times.pop(), stack.pop()
        times.append(-int(at[k])), stack.append(k)
    return out


def _tables(by: str | None, gap: int):
    ways = pa.list_(pa.struct([("at", pa.int64()), ("last", pa.int64())]))
    fields = [("_part", pa.int64()), ("_nth", pa.int64()), ("top", pa.int64()), ("ways", ways)]

    def run(batches):
        out, schema = [], None
        for table in _whole(batches):
            schema = schema or pa.schema(([(by, table.schema.field(by).type)] if by else []) + fields)
            at = table["_at"].to_numpy()
            onward, last = _next(at, gap), at.tolist()
            for k in range(len(last) - 1, -1, -1):
                last[k] = last[onward[k]] if onward[k] < len(last) else last[k]
            top = np.maximum.accumulate(at)
            first = np.flatnonzero(np.concatenate([[True], at[1:] > top[:-1]])).tolist()
            out.append(({by: table[by][0].as_py()} if by else {}) | {"_part": table["_part"][0].as_py(), "_nth": table["_nth"][0].as_py(), "top": int(top[-1]), "ways": [{"at": int(at[k]), "last": last[k]} for k in first]})
            if len(out) == 16:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _chain(by: str | None, gap: int):
    """For each block the time of the last row that passed before it."""

    def run(batches):
        group, last = object(), None
        for batch in batches:
            out = []
            for name, part, nth, ways in zip(batch[by].to_pylist() if by else [0] * batch.num_rows, batch["_part"].to_pylist(), batch["_nth"].to_pylist(), batch["ways"].to_pylist()):
                if name != group:
                    group, last = name, None
                out.append({"_part": part, "_nth": nth, "_last": last})
                k = 0 if last is None else bisect.bisect_left([w["at"] for w in ways], last + gap)
                last = ways[k]["last"] if k < len(ways) else last
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_part", pa.int64()), ("_nth", pa.int64()), ("_last", pa.int64())]))

    return run


def _passing(key: list[str], gap: int):
    def run(batches):
        place, last = None, None
        for batch in batches:
            keep = []
            for part, nth, before, at in zip(*(batch[c].to_pylist() for c in ("_part", "_nth", "_last", "_at"))):
                if (part, nth) != place:
                    place, last = (part, nth), before
                go = last is None or at - last >= gap
                keep.append(go)
                last = at if go else last
            yield batch.filter(pa.array(keep, pa.bool_())).select([*key, "seq", "timestamp"])

    return run
