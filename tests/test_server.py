"""Version and port of a server, whatever its first rows are."""

import duckdb
import pytest

from lograft import registry
from lograft.operators import render

SF = "/root/testdata/sf0.001"
ROWS = {
    "other keys": "SELECT * REPLACE (event_id + 100000 AS event_id) FROM events",
    "negative keys": "SELECT * REPLACE (event_id - 500 AS event_id) FROM events",
    "first no error": "SELECT * FROM events WHERE event_id > 0",
    "first fatal": "SELECT * FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INT) % 5 = 0)",
    "last rows first": "SELECT * REPLACE (-event_id AS event_id) FROM events",
    "one row": "SELECT * FROM events WHERE event_id = 7",
    "no rows": "SELECT * FROM events WHERE event_id < 0",
    "first without fields": "SELECT * REPLACE (CASE WHEN event_id > 0 THEN ts END AS ts, CASE WHEN event_id > 0 THEN event_type END AS event_type) FROM events",
    "first without k": "SELECT * REPLACE (CASE WHEN event_id > 0 THEN props END AS props) FROM events",
    "most without keys": "SELECT * REPLACE (CASE WHEN event_id > 900 THEN event_id END AS event_id) FROM events",
}


@pytest.mark.parametrize("rows", ROWS)
def test_server_of_any_first_rows(spark, tmp_path, rows):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    con.execute(f"COPY ({ROWS[rows]}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(registry.ORACLE_SQL["a17_server"]).fetchall()
    assert [tuple(r) for r in registry.QUERIES["a17_server"](spark, str(tmp_path)).collect()] == want


def test_server_looks_at_the_first_rows(spark):
    said = [(k, "x") for k in range(2, 80)] + [(1, "starting PostgreSQL 17.2 on x"), (50, 'listening on Unix socket "/tmp/.s.PGSQL.5433"'), (51, "starting PostgreSQL 9")] + [(None, "x")] * 60
    rows = spark.createDataFrame([r for r in said if r not in ((50, "x"), (51, "x"))], "seq long, message string").repartition(4)
    assert tuple(render.server(rows).first()) == ("17.2", 5433)
    assert tuple(render.server(rows, 49).first()) == ("17.2", None)
