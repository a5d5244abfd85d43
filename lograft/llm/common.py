"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage ends here, and a lost executor costs a read instead of a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that written made, once nothing that is still to be computed reads it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the shuffle files of finished jobs deleted: Spark does so once the driver's JVM has collected what refers to
    them, which it would otherwise put off until its heap is full, while executors' disks fill up."""
    spark._jvm.System.gc()


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings (dots as __) for the jobs that run inside the block."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at once, unless the session says otherwise: whole texts stand in them.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers wherever they run, and keeps their batches small."""
    import os
    import zipfile

    if spark.conf.get(ROWS) == "10000":  # Spark's default
        spark.conf.set(ROWS, BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_lograft_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "lograft.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "lograft")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._lograft_shipped = True


def runs(batches, key: list[str]):
    """Complete groups of rows that stand together under one key, as Arrow tables; the input is sorted by key."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        cut = np.zeros(table.num_rows - 1, bool)
        for k in key:
            col = table[k].to_numpy(zero_copy_only=False)
            cut |= col[1:] != col[:-1]
        ends = np.flatnonzero(cut) + 1
        start = 0
        for end in ends:
            yield table.slice(start, end - start)
            start = end
        held = table.slice(start)
    if held is not None and held.num_rows:
        yield held
