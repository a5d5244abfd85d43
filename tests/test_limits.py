"""The limiter against a loop, with groups too large for one array row to be welcome."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lograft.operators import alerts, windows


def loop(rows, seconds, by=lambda f: f):
    want, last = [], {}
    for seq, f, t in rows:
        if t is not None and (by(f) not in last or (t - last[by(f)]).total_seconds() >= seconds):
            want.append((seq, str(f)))
            last[by(f)] = t
    return sorted(want)


@pytest.mark.parametrize(("block", "seconds", "spread"), [(windows.BLOCK, 10, 20), (50, 10, 20), (7, 10, 0), (3, 300, 500), (1, 10, 20)])
def test_allowed(spark, block, seconds, spread):
    """In groups and among all rows, in whole blocks and tiny ones, with times out of order."""
    r, start = random.Random(block), dt.datetime(2024, 1, 1)
    rows = [(k, r.choice(["a", "b", None, ""]), None if k % 50 == 0 else start + dt.timedelta(seconds=k // 3 + r.randint(-spread, spread))) for k in range(2000)]
    df = spark.createDataFrame(rows, "seq long, source_file string, timestamp timestamp").repartition(5)
    found = windows.allowed(df, "source_file", seconds, block).collect()
    assert sorted((x.seq, str(x.source_file)) for x in found) == loop(rows, seconds)
    found = windows.allowed(df, None, seconds, block).collect()
    assert sorted(x.seq for x in found) == [s for s, _ in loop(rows, seconds, lambda f: 0)]


def test_allowed_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "seq long, timestamp timestamp")
    assert windows.allowed(none, None, 5).count() == 0


def test_rate_alerts_pause(spark):
    """A rate above its bound alerts once a minute; the limiter of all sources comes after."""
    start = dt.datetime(2024, 1, 1)
    rows = [(k, "ab"[k % 2], start + dt.timedelta(seconds=2 * k), "FATAL" if k == 40 else "ERROR", "m") for k in range(100)]
    df = spark.createDataFrame(rows, "seq long, source_file string, timestamp timestamp, level string, message string")
    rules = alerts.Rules().on("errors > 5/min").on("fatal")
    found = sorted((x.seq, x.rule) for x in alerts.alerts(df, rules, "source_file", 5).collect())
    rates = {}
    match, paused, last, want = [], None, None, []
    for seq, f, t, level, _ in rows:
        times = rates.setdefault(f, [])
        times.append(t)
        n = sum((t - u).total_seconds() < 60 for u in times)
        if level == "FATAL":
            match.append((seq, "level", t))
        elif n > 5 and (paused is None or (t - paused).total_seconds() >= 60):
            match.append((seq, "rate", t))
            paused = t
    for seq, rule, t in match:
        if last is None or (t - last).total_seconds() >= 5:
            want.append((seq, rule))
            last = t
    assert found == want and len(want) >= 3


def test_allowed_holds_no_group_in_one_row(spark):
    rows = spark.range(300_000).select(F.col("id").alias("seq"), F.lit("one").alias("source_file"), F.timestamp_seconds("id").alias("timestamp"))
    df = windows.allowed(rows, "source_file", 1)
    assert "collect_list" not in df._jdf.queryExecution().toString() and df.count() == 300_000
    assert windows.allowed(rows, None, 10).count() == 30_000
