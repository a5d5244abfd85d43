"""Nothing is cut: all interleaved rows have places."""

import datetime as dt
import random

from lograft import registry
from lograft.sources import logs

SF = "/root/testdata/sf0.001"


def test_places_of_all_rows(spark):
    r = random.Random(2)
    rows = [(k, f"log{k % 3}", None if k % 40 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 500))) for k in range(3000)]
    found = logs.placed(spark.createDataFrame(rows, "seq long, source_file string, timestamp timestamp").repartition(6)).collect()
    want = sorted(rows, key=lambda x: (x[2] is not None, x[2] or dt.datetime(2024, 1, 1), x[1], x[0]))
    assert [x.seq for x in sorted(found, key=lambda x: x.place)] == [x[0] for x in want] and sorted(x.place for x in found) == list(range(1, 3001))


def test_whole_interleaving_is_registered(spark):
    assert registry.QUERIES["s4_interleave_whole"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count() > 500
