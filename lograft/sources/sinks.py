"""Exports: folders of part files, single ordered files, processes."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.render import export_json, export_text

CSV_FIELDS = ("timestamp", "level", "pid", "message")


def export(logs: DataFrame, path: str, fmt: str = "text", append: bool = False, keep_markup: bool = True) -> None:
    """logs as a folder of files that executors write in parallel."""
    writer = _rows(logs, fmt, keep_markup).write.mode("append" if append else "overwrite")
    writer.option("header", not append).csv(path) if fmt == "csv" else writer.text(path)


def _rows(logs: DataFrame, fmt: str, keep_markup: bool) -> DataFrame:
    if fmt == "csv":
        at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
        return logs.select(at, "level", "pid", "message")
    if fmt not in ("text", "json"):
        raise ValueError(f"unknown format: {fmt}")
    return logs.select((export_json() if fmt == "json" else export_text(keep_markup)).alias("value"))


def export_file(logs: DataFrame, path: str, fmt: str = "text", append: bool = False, keep_markup: bool = True) -> int:
    """One ordered file on the driver, streamed partition by partition; returns the number of rows."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows = _rows(logs.orderBy("seq"), fmt, keep_markup)
    n = 0
    with open(path, "a" if append else "w", encoding="utf-8", newline="") as f:
        if fmt == "csv":
            import csv

            out = csv.writer(f, lineterminator="\n")
            if not append:
                out.writerow(CSV_FIELDS)
            for r in rows.toLocalIterator():
                out.writerow(["" if v is None else v for v in r])
                n += 1
        else:
            for r in rows.toLocalIterator():
                f.write(r[0] + "\n")
                n += 1
    return n


#: The folder of a followed export's header; it sorts before those of the batches.
HEADER = "batch=-header"


def followed(logs: DataFrame, path: str, checkpoint: str, fmt: str = "text", keep_markup: bool = True):
    """A stream's rows as files in order, to be started: a folder for each batch, named by its number, whose files in the order of their names hold its rows in order of time, file and arrival.

    A batch that is run again after a failure replaces its own folder only, so that all files read in order (in_sequence) have the same bytes however often the
    stream was stopped. Executors write them; nothing passes through the driver.
    """
    if fmt == "csv":
        _rows(logs, fmt, keep_markup)  # the columns are there
    order = [F.col("timestamp").asc_nulls_first(), F.col("source_file").asc(), F.col("seq").asc()]

    def each(batch: DataFrame, n: int) -> None:
        if fmt == "csv" and n == 0:
            head = batch.sparkSession.createDataFrame([(",".join(CSV_FIELDS),)], "value string")
            head.coalesce(1).write.mode("overwrite").text(f"{path}/{HEADER}")
        rows = _rows(batch.repartitionByRange(*order).sortWithinPartitions(*order), fmt, keep_markup)
        writer = rows.write.mode("overwrite")
        folder = f"{path}/batch={n:012d}"
        writer.option("header", False).csv(folder) if fmt == "csv" else writer.text(folder)

    return logs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def in_sequence(spark, path: str) -> DataFrame:
    """(place, value): the lines of a followed export, ordered by place."""
    meta = F.col("_metadata")
    lines = spark.read.text(f"{path}/batch=*").select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    return lines.select(F.struct("file", "block", "at").alias("place"), "value")


def check_options(follow: bool, append: bool, since: str | None) -> None:
    if follow and (append or since):
        raise ValueError("follow excludes append and since")


def pipe(logs: DataFrame, command: list[str], fmt: str = "text") -> tuple[int, int]:
    """Streams the rows in order into a process's input: (its return code, rows sent); a process that stops early counts as ended well."""
    process = subprocess.Popen(command, stdin=subprocess.PIPE, text=True, encoding="utf-8")
    n = 0
    try:
        for r in _rows(logs.orderBy("seq"), fmt, True).toLocalIterator():
            process.stdin.write((r[0] if len(r) == 1 else ",".join("" if v is None else str(v) for v in r)) + "\n")
            n += 1
        process.stdin.close()
    except BrokenPipeError:
        process.wait()
        return 0, n
    return process.wait(), n


