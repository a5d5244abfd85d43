"""A stored log that can be shown again under other filters, and held back, while it goes on arriving.

A stream's batches are stored as folders, each with its number, and each row with its place in the batch: its arrival mark. A view reads
what satisfies its filter between two marks. When the filter changes, all that is stored up to the newest whole batch is shown again, and
what arrives later follows from that mark on, so that nothing is missing and nothing comes twice. While a view is paused rows wait in the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import FilterSpec

ARRIVAL = ("batch", "place")


def stored(logs: DataFrame, path: str, checkpoint: str):
    """The stream that stores logs, to be started. A batch that is run again replaces its own folder."""
    order = [F.col("timestamp").asc_nulls_first(), F.col("source_file").asc(), F.col("seq").asc()]

    def each(batch: DataFrame, n: int) -> None:
        rows = batch.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return logs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


class View:
    """What a user sees of a stored log: a filter, the mark up to which rows were shown, and whether it is paused."""

    def __init__(self, spark: SparkSession, path: str, spec: FilterSpec | None = None):
        self.spark, self.path, self.spec = spark, path, spec or FilterSpec()
        self.mark, self.paused = -1, False

    def newest(self) -> int:
        """The number up to which all batches are whole; a batch that is being written does not count, nor what follows it."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return -1
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/_SUCCESS"))
        whole = {int(f.getPath().getParent().getName().split("=")[1]) for f in found}
        n = -1
        while n + 1 in whole:
            n += 1
        return n

    def between(self, after: int, upto: int) -> DataFrame:
        """The rows of the batches in (after, upto] that satisfy the filter; other folders are not read. In order by batch and place."""
        paths = [f"{self.path}/batch={n}" for n in range(max(after, -1) + 1, upto + 1)]
        if not paths:
            return self._none()
        return self.spec.apply(self.spark.read.option("basePath", self.path).parquet(*paths))

    def _none(self) -> DataFrame:
        if self.newest() < 0:
            raise ValueError(f"nothing is stored in {self.path} yet")
        return self.spark.read.parquet(f"{self.path}/batch=0").withColumn("batch", F.lit(0)).where("false")

    def poll(self) -> DataFrame:
        """What has arrived since the last call and satisfies the filter; nothing while paused."""
        upto = self.mark if self.paused else self.newest()
        found, self.mark = self.between(self.mark, upto), upto
        return found

    def swap(self, spec: FilterSpec) -> DataFrame:
        """Changes the filter: all that is stored and satisfies the new one, up to the mark from which poll goes on. While paused, up to the mark of the pause."""
        upto = self.mark if self.paused else self.newest()
        self.spec, self.mark = spec, upto
        return self.between(-1, upto)

    def pause(self) -> None:
        self.paused = True

    def waiting(self) -> DataFrame:
        """The number of rows that came since the pause and satisfy the filter."""
        return self.between(self.mark, self.newest()).agg(F.count("*").alias("cnt"))

    def follow(self) -> DataFrame:
        """Ends a pause: what waited, once."""
        self.paused = False
        return self.poll()
