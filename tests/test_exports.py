"""Followed exports over stops, lines of several files in order, exact percentiles."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lograft.operators import durations
from lograft.sources import sinks
from lograft.streaming import jobs

from .test_streaming import line


def content(path):
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/batch=*/part-*")))


@pytest.mark.parametrize("fmt", ["text", "json", "csv"])
def test_followed_export_over_stops(spark, tmp_path, fmt):
    log, want = tmp_path / "a.log", []
    export = lambda: sinks.followed(jobs.tailed(spark, str(log), position="earliest"), str(tmp_path / "out"), str(tmp_path / "c"), fmt).start()
    for k in range(3):
        with log.open("a") as f:
            f.write("".join(line(10 * k + j, second=9 - j) for j in range(3)))
        want += [10 * k + j for j in (2, 1, 0)]
        q = export()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        if k == 1:  # the last batch is written but not marked as done: it is run again
            before = content(tmp_path / "out")
            last = max(glob.glob(str(tmp_path / "c" / "commits" / "[0-9]*")), key=lambda p: int(p.rsplit("/", 1)[1]))
            for p in (last, last.replace("commits/", "commits/.") + ".crc"):
                open(p, "a").close()
                os.remove(p)
            q = export()
            try:
                q.processAllAvailable()
            finally:
                q.stop()
            assert content(tmp_path / "out") == before
    got = [r.value for r in sinks.in_sequence(spark, str(tmp_path / "out")).orderBy("place").collect()]
    assert "\n".join(got) + "\n" == content(tmp_path / "out").decode()
    assert (got[0] == "timestamp,level,pid,message") == (fmt == "csv")
    rows = got[1:] if fmt == "csv" else got
    assert len(rows) == 9
    if fmt != "text":
        assert [k for r in rows for k in want if (f'"pid":{k},' in r if fmt == "json" else f",{k}," in r)] == want


def test_files_out_of_step_come_in_order(spark, tmp_path):
    clock = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02} UTC [{s}] LOG:  x\n"
    files = [tmp_path / f"{k}.log" for k in range(3)]
    for f in files:
        f.write_text("")
    df = jobs.reordered(jobs.tailed(spark, str(tmp_path / "*.log"), position="earliest"), delay=20, idle=15)
    batches = []
    q = df.writeStream.foreachBatch(lambda b, n: batches.append([(r["at"] // 1_000_000 % 3600, r["late"]) for r in b.orderBy("place").collect()])).option("checkpointLocation", str(tmp_path / "c")).start()

    def put(k, *seconds):
        with files[k].open("a") as f:
            f.write("".join(map(clock, seconds)))

    found = []

    def until(n):  # with timers, a stream always has another batch: there is no last one to wait for
        for _ in range(120):
            found[:] = [x for b in batches for x in b]
            if len(found) >= n:
                return
            time.sleep(0.5)

    try:
        put(0, 1, 4, 30), put(1, 2, 29)
        until(3)
        put(2, 12, 13, 35), put(1, 31, 60)
        until(9)
        assert found == [(s, False) for s in (1, 2, 4, 12, 13, 29, 30, 31, 35)]
        put(0, 33, 70), put(2, 5, 71)  # 35 was released before
        until(14)  # nothing more comes: the rest is released after a while
        assert sorted(found[9:11]) == [(5, True), (33, True)] and found[11:] == [(60, False), (70, False), (71, False)]
    finally:
        q.stop()


@pytest.mark.parametrize("values", [[], [3.5], [2.0] * 500 + [1.0] * 200 + [9.0], [random.Random(1).gauss(0, 9) for _ in range(3000)], [None, 1.0, 2.0]])
def test_percentiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "duration_ms double").repartition(5)
    found = durations.statistics(df).first()
    want = df.agg(F.count("duration_ms"), *[F.coalesce(c, F.lit(0.0)) for c in (F.avg("duration_ms"), F.min("duration_ms"), F.max("duration_ms"), *[F.percentile("duration_ms", p) for p in (0.5, 0.95, 0.99)])]).first()
    assert tuple(found) == pytest.approx(tuple(want))
