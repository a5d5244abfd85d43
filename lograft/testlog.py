"""The events table as server logs: the lines that the queries parse, and the same fields as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.logs import CSV_COLUMNS, parse

#: DuckDB's view of the rows that the lines were made from.
LG = """
e AS (SELECT event_id AS seq, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(floor(abs(coalesce(value, 0)) * 100) AS BIGINT) AS cents FROM events),
lg AS (SELECT seq, date_trunc('milliseconds', ts) AS ts, user_id, k, cents, event_type, CAST(1000 + user_id AS INT) AS pid,
    CASE WHEN event_type <> 'error' THEN 'LOG' WHEN k % 5 = 0 THEN 'FATAL' WHEN k % 5 = 1 THEN 'WARNING' ELSE 'ERROR' END AS level,
    CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN '23505' WHEN 1 THEN '42P01' END END AS sql_state,
    CASE event_type
        WHEN 'view' THEN 'duration: ' || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' ms  statement: SELECT * FROM app.t' || k || ' WHERE id = ' || user_id
        WHEN 'signup' THEN 'connection authorized: user=u' || (user_id % 50) || ' database=db' || (k % 7) || ' application_name=app' || (k % 5)
        WHEN 'purchase' THEN 'disconnection: session time: 0:0' || (k % 6) || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || '.500 user=u' || (user_id % 50) || ' database=db' || (k % 7) || ' host=10.0.' || (k % 4) || '.' || (k % 100) || ' port=' || (5000 + k)
        WHEN 'error' THEN CASE WHEN k % 5 = 0 THEN 'password authentication failed for user "u' || (user_id % 50) || '"' ELSE 'duplicate key value violates unique constraint "pk_' || k || '"' END
        ELSE 'checkpoint complete: wrote ' || k || ' buffers (12.5%); write=' || (cents // 100) || ' s, sync=on' END AS message,
    'u' || (user_id % 50) AS user_name, 'db' || (k % 7) AS database_name, CASE WHEN k % 9 > 0 THEN 'app' || (k % 5) END AS application_name, 'log' || (seq % 3) AS source_file
    FROM e)"""


def with_lg(sql: str) -> str:
    return f"WITH {LG} {sql}"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"), "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor(F.abs(F.coalesce("value", F.lit(0.0))) * 100).cast("bigint").alias("cents")
    )
    return e.selectExpr(
        "seq", "ts", "user_id", "k", "cents", "event_type", "cast(1000 + user_id as int) pid",
        "case when event_type <> 'error' then 'LOG' when k % 5 = 0 then 'FATAL' when k % 5 = 1 then 'WARNING' else 'ERROR' end level",
        "case when event_type = 'error' then case k % 3 when 0 then '23505' when 1 then '42P01' end end sql_state",
        """case event_type
        when 'view' then 'duration: ' || (cents div 100) || '.' || lpad(cast(cents % 100 as string), 2, '0') || ' ms  statement: SELECT * FROM app.t' || k || ' WHERE id = ' || user_id
        when 'signup' then 'connection authorized: user=u' || (user_id % 50) || ' database=db' || (k % 7) || ' application_name=app' || (k % 5)
        when 'purchase' then 'disconnection: session time: 0:0' || (k % 6) || ':' || lpad(cast(k % 60 as string), 2, '0') || '.500 user=u' || (user_id % 50) || ' database=db' || (k % 7) || ' host=10.0.' || (k % 4) || '.' || (k % 100) || ' port=' || (5000 + k)
        when 'error' then case when k % 5 = 0 then 'password authentication failed for user "u' || (user_id % 50) || '"' else 'duplicate key value violates unique constraint "pk_' || k || '"' end
        else 'checkpoint complete: wrote ' || k || ' buffers (12.5%); write=' || (cents div 100) || ' s, sync=on' end message""",
        "'u' || (user_id % 50) user_name", "'db' || (k % 7) database_name", "case when k % 9 > 0 then 'app' || (k % 5) end application_name", "'log' || (seq % 3) source_file",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS') at",
    )


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).selectExpr("seq", "source_file", "at || ' UTC [' || pid || '] ' || level || ':  ' || message value")


def started_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_lines behind two lines of the server's start, which stand there without any rows too: the version is k of the first row (none where k is null), the port is fixed."""
    first = _base(spark, sf_dir).orderBy(F.col("seq").asc_nulls_last()).limit(1).agg(F.max("at").alias("at"), F.max("k").alias("k"))  # a row even of none
    messages = """array(concat_ws(' ', 'starting PostgreSQL', k), 'listening on IPv4 address "0.0.0.0", port 5432')"""
    start = first.selectExpr("at", f"posexplode({messages}) as (n, message)").selectExpr(
        "-9223372036854775808L + n seq", "'log0' source_file", "coalesce(at, '2024-01-01 00:00:00.000') || ' UTC [1] LOG:  ' || message value"
    )
    return start.unionByName(text_lines(spark, sf_dir))


def logs_of(spark: SparkSession, sf_dir: str, message: str) -> DataFrame:
    """The parsed rows of text lines with another message: SQL over the fields of the base rows."""
    return parse(_base(spark, sf_dir).withColumn("clock", F.col("at")).selectExpr("seq", "source_file", f"at || ' UTC [' || pid || '] ' || level || ':  ' || {message} value"), "text")


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"log_time": "at || ' UTC'", "user_name": "user_name", "database_name": "database_name", "process_id": "pid", "error_severity": "level", "sql_state_code": "coalesce(sql_state, '')",
             "message": "'\"' || replace(message, '\"', '\"\"') || '\"'", "application_name": "coalesce(application_name, '')", "connection_from": "'10.0.0.1:' || (5000 + k)", "query_id": "seq * 1000000007"}
    line = " || ',' || ".join(f"cast({known[c]} as string)" if c in known else "''" for c in CSV_COLUMNS)
    return _base(spark, sf_dir).selectExpr("seq", "source_file", f"{line} value")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = "named_struct('timestamp', at || '+02:00', 'user', user_name, 'dbname', database_name, 'pid', pid, 'remote_host', '10.0.0.' || (k % 250), 'remote_port', cast(5000 + k as string), 'error_severity', level, 'state_code', sql_state, 'message', message, 'application_name', application_name, 'ps', 'x')"
    return _base(spark, sf_dir).selectExpr("seq", "source_file", f"to_json({row}) value")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files, one of each format."""
    pick = lambda df, k: df.where(f"source_file = 'log{k}'")
    return pick(text_lines(spark, sf_dir), 0).union(pick(csv_lines(spark, sf_dir), 1)).union(pick(json_lines(spark, sf_dir), 2))


def text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(text_lines(spark, sf_dir), "text")


def csv_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(csv_lines(spark, sf_dir), "csv")


def json_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(json_lines(spark, sf_dir), "json")
