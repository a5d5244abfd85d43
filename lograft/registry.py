"""All queries over the driver's tables and their SQL, by name. Lines are made from events; the queries parse them, the SQL reads the fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import levels, sqlstate, text
from .functions import sql as sqltext
from .functions.once import once
from .operators import alerts, connections, durations, errors, render, spans, windows
from .plans.spec import FilterSpec, Pattern, export_condition
from .sources import logs as source
from .testlog import csv_lines, csv_logs, json_lines, json_logs, logs_of, mixed_lines, started_lines, text_lines, text_logs, with_lg

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, lg: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_lg(sql) if lg else sql
        return f

    return add


def at(col="timestamp"):
    """A time as the SQL shows it."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSS")


AT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"
ALL_LEVELS = "(CASE level WHEN 'PANIC' THEN 0 WHEN 'FATAL' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 3 ELSE 5 END)"
RAW = f"({AT} || ' UTC [' || pid || '] ' || level || ':  ' || message)"
KEPT = "SELECT seq, level, pid, message FROM lg WHERE "
TRACKED = "level IN ('PANIC', 'FATAL', 'ERROR', 'WARNING')"


def kept(df: DataFrame) -> DataFrame:
    return df.select("seq", "level", "pid", "message")


def last_time(logs: DataFrame):
    """The latest time of a table, as a column of one value for the operators that look back from now."""
    return F.lit(logs.agg(F.max("timestamp")).first()[0]).cast("timestamp")


# -- sources


@query("s9_parse_text", f"SELECT seq, {AT} AS at, level, pid, message, {ALL_LEVELS} AS level_rank FROM lg")
def _(spark, d):
    return text_logs(spark, d).select("seq", at().alias("at"), "level", "pid", "message", F.col("level_rank").cast("int").alias("level_rank"))


@query("s10_parse_csv", f"SELECT seq, {AT} AS at, level, pid, message, sql_state, user_name, database_name, application_name, '10.0.0.1:' || (5000 + k) AS connection_from, CAST(seq AS BIGINT) * 1000000007 AS query_id FROM lg")
def _(spark, d):
    return csv_logs(spark, d).select("seq", at().alias("at"), "level", "pid", "message", "sql_state", "user_name", "database_name", "application_name", "connection_from", "query_id")


@query("s11_parse_json", "SELECT seq, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%g') AS at, level, pid, message, sql_state, user_name, database_name, application_name, '10.0.0.' || (k % 250) AS remote_host, CAST(5000 + k AS INT) AS remote_port FROM lg")
def _(spark, d):
    return json_logs(spark, d).select("seq", at().alias("at"), "level", "pid", "message", "sql_state", "user_name", "database_name", "application_name", "remote_host", "remote_port")


@query("s1_read_files", f"SELECT {AT} AS at, level, pid, message, CASE source_file WHEN 'log1' THEN 'csv' ELSE 'text' END AS format, 'logs-' || source_file AS folder, count(*) AS cnt FROM lg GROUP BY ALL")
def _(spark, d):
    """Log files of one name in several folders, text and CSV, written by Spark and read again."""
    path = source.scratch(spark, "written-logs")
    text_lines(spark, d).where("source_file <> 'log1'").select("value", F.concat(F.lit("logs-"), "source_file").alias("folder")).write.partitionBy("folder").text(f"{path}/a")
    csv_lines(spark, d).where("source_file = 'log1'").select("value", F.concat(F.lit("logs-"), "source_file").alias("folder")).write.partitionBy("folder").text(f"{path}/b")
    logs = source.parse_logs(source.read_lines(spark, [f"{path}/a/*/*", f"{path}/b/*/*"]))
    folder = F.regexp_extract("source_path", "folder=([^/]*)/", 1).alias("folder")
    return logs.select(at().alias("at"), "level", "pid", "message", "format", folder).groupBy("at", "level", "pid", "message", "format", "folder").agg(F.count("*").alias("cnt"))


@query("s8_line_format", "SELECT CASE seq % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'csv' ELSE 'json' END AS format, source_file, count(*) AS cnt FROM lg GROUP BY ALL")
def _(spark, d):
    return mixed_lines(spark, d).select(source.line_format(F.col("value")).alias("format"), "source_file").groupBy("format", "source_file").agg(F.count("*").alias("cnt"))


@query("s12_parse_mixed_files", f"SELECT source_file, CASE seq % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'csv' ELSE 'json' END AS format, level, count(*) AS cnt, min({AT}) FILTER (WHERE seq % 3 < 2) AS first_at FROM lg GROUP BY ALL")
def _(spark, d):
    found = source.parse_logs(mixed_lines(spark, d))
    return found.groupBy("source_file", "format", "level").agg(F.count("*").alias("cnt"), F.min(F.when(F.col("format") != "json", at())).alias("first_at"))


@query("s13_level_words", "SELECT event_type, count(*) AS cnt, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG1' ELSE 'LOG' END AS level FROM lg GROUP BY ALL")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    word = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "debug").otherwise("nonsense")
    return e.groupBy("event_type").agg(F.count("*").alias("cnt")).select("event_type", "cnt", levels.normalised(word).alias("level"))


@query("s4_interleave", "SELECT seq, source_file, row_number() OVER (ORDER BY ts, source_file, seq) AS place FROM lg")
@query("s4_interleave_whole", "SELECT seq, source_file, row_number() OVER (ORDER BY ts, source_file, seq) AS place FROM lg")
def _(spark, d):
    return source.placed(text_logs(spark, d)).select("seq", "source_file", "place")


@query("s7_conf_values", "SELECT 'app.p' || k AS name, CAST(max_by(cents, seq) AS VARCHAR) AS setting FROM lg GROUP BY k")
def _(spark, d):
    from .testlog import _base

    return source.conf_values(_base(spark, d).selectExpr("seq", "'App.p' || k || ' = ''' || cents || '''  # set' value"))


# -- filters


def filtered(name: str, where: str, spec: FilterSpec, logs=text_logs):
    @query(name, KEPT + where)
    def _(spark, d):
        return kept(spec.apply(logs(spark, d)))


NOW = dt.datetime(2024, 1, 20)
filtered("f2_at_or_above", "level IN ('PANIC', 'FATAL', 'ERROR')", FilterSpec().with_levels(["err+"]))
filtered("f3_at_or_below", "level NOT IN ('PANIC', 'FATAL', 'ERROR')", FilterSpec().with_levels(["w-"]))
filtered("f4_level_list", "level IN ('PANIC', 'FATAL', 'WARNING')", FilterSpec().with_levels(["F+,warn"]))
filtered("f6_regex_include", f"regexp_matches({RAW}, '(?i)PK_1\\d\"|db3')", FilterSpec().with_pattern('/PK_1\\d"|db3/'))
filtered("f7_regex_exclude", f"NOT regexp_matches({RAW}, 'duration|checkpoint')", FilterSpec().with_pattern("-/duration/c").with_pattern("-/checkpoint/"))
filtered("f8_regex_all", f"regexp_matches({RAW}, 'user=') AND regexp_matches({RAW}, 'db[0-3]')", FilterSpec().with_pattern("&/user=/").with_pattern("&/db[0-3]/"))
filtered("f9_regex_grammar", f"(regexp_matches({RAW}, 'user=') OR regexp_matches({RAW}, 'wrote')) AND NOT regexp_matches({RAW}, 'db1') AND regexp_matches({RAW}, '[02468]')", FilterSpec().with_pattern("/gone/").with_pattern("/user=/").with_pattern("+/wrote/").with_pattern("-/db1/").with_pattern("&/[02468]/"))
filtered("f10_fields", "user_name = 'u7' AND application_name = 'app2'", FilterSpec().with_field("user", "x").with_field("user", "U7").with_field("app", "APP2"), csv_logs)
filtered("f10_pid", "pid = 1007", FilterSpec().with_field("pid", "1007"))
filtered("f12_time_range", "ts BETWEEN TIMESTAMP '2024-01-02 06:00:00' AND TIMESTAMP '2024-01-19 12:00:00'", FilterSpec().with_time("2024-01-02T06:00:00Z", "12h", dt.datetime(2024, 1, 20)))
filtered("f15_composite", f"ts >= TIMESTAMP '2024-01-01 00:30:00' AND level = 'ERROR' AND lower(database_name) = 'db2' AND regexp_matches({RAW}, '(?i)unique') AND NOT regexp_matches({RAW}, 'pk_9')", FilterSpec().with_time("2024-01-01 00:30:00").with_levels(["error"]).with_field("db", "DB2").with_pattern("/UNIQUE/").with_pattern("-/pk_9/"), csv_logs)


@query("f17_export_filter", KEPT + f"ts >= TIMESTAMP '2024-01-03' AND {TRACKED} AND regexp_matches({RAW}, 'pk_')")
def _(spark, d):
    patterns = FilterSpec(include=(Pattern("pk_"),), fields=(("pid", "-1"),))
    return kept(text_logs(spark, d).where(export_condition(frozenset(levels.TRACKED), patterns, dt.datetime(2024, 1, 3))))


@query("f19_events_by_code", "SELECT seq, level, message FROM lg WHERE sql_state = '23505' AND " + TRACKED)
def _(spark, d):
    return errors.events(csv_logs(spark, d)).where("sql_state = '23505'").select("seq", "level", "message")


@query("f20_tracked", KEPT + TRACKED)
def _(spark, d):
    return kept(errors.tracked(text_logs(spark, d)))


# -- projections


@query("p2_present_fields", "SELECT CASE WHEN sql_state IS NULL THEN 0 ELSE 1 END + CASE WHEN application_name IS NULL THEN 0 ELSE 1 END + 11 AS fields, count(*) AS cnt FROM lg GROUP BY ALL")
def _(spark, d):
    return csv_logs(spark, d).select(F.size(render.present()).alias("fields")).groupBy("fields").agg(F.count("*").alias("cnt"))


CLOCK = "strftime(ts, '%H:%M:%S.%g')"


@query("p4_compact", f"SELECT seq, {CLOCK} || ' [' || pid || '] ' || rpad(level, 7, ' ') || coalesce(' ' || sql_state, '') || ': ' || message AS line FROM lg")
def _(spark, d):
    return csv_logs(spark, d).select("seq", render.compact().alias("line"))


@query("p4b_tail_compact", f"SELECT seq, '[' || source_file || '] ' || {CLOCK} || ' [' || rpad(CAST(pid AS VARCHAR), 5, ' ') || '] ' || rpad(level, 7, ' ') || coalesce(sql_state, '') || ': ' || message AS line FROM lg")
def _(spark, d):
    return csv_logs(spark, d).select("seq", render.tail_compact().alias("line"))


@query("p5_full", f"SELECT seq, {CLOCK} || ' [' || pid || '] ' || rpad(level, 7, ' ') || coalesce(' ' || sql_state, '') || ': ' || message || coalesce(chr(10) || '  Application: ' || application_name, '') || chr(10) || '  Database: ' || database_name || chr(10) || '  User: ' || user_name AS line FROM lg")
def _(spark, d):
    return csv_logs(spark, d).select("seq", render.full().alias("line"))


@query("p6_chosen_fields", "SELECT user_name AS \"user\", database_name AS database, level, count(*) AS cnt FROM lg GROUP BY ALL")
def _(spark, d):
    columns, _unknown = render.chosen(["user", "database", "nonsense", "level"])
    return csv_logs(spark, d).select(*columns).groupBy("user", "database", "level").agg(F.count("*").alias("cnt"))


@query("p7_json", "SELECT seq, level, message, CAST(pid AS VARCHAR) AS pid, application_name FROM lg")
def _(spark, d):
    j = csv_logs(spark, d).select("seq", render.as_json().alias("j"))
    return j.select("seq", *[F.get_json_object("j", f"$.{k}").alias(k) for k in ("level", "message", "pid", "application_name")])


@query("c17_export_json", f"SELECT seq, '{{\"timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '000\",\"level\":\"' || level || '\",\"pid\":' || pid || ',\"message\":' || to_json(message) || '}}' AS line FROM lg")
def _(spark, d):
    return text_logs(spark, d).select("seq", render.export_json().alias("line"))


@query("c17_export_text", f"SELECT seq, replace({RAW}, '[' || pid || ']', '') AS line FROM lg")
def _(spark, d):
    return text_logs(spark, d).select("seq", render.export_text(False).alias("line"))


@query("a16_status", "SELECT count(*) FILTER (WHERE level IN ('ERROR', 'FATAL')) AS e, count(*) FILTER (WHERE level = 'WARNING') AS w, count(*) AS total FROM lg")
def _(spark, d):
    return render.status(text_logs(spark, d))


@query("a17_server", "SELECT CAST(max(k) AS VARCHAR) AS version, 5432 AS port FROM (SELECT k FROM lg ORDER BY seq LIMIT 1)")
def _(spark, d):
    return render.server(source.parse(render.head(started_lines(spark, d)), "text"))


# -- errors


@query("a1_counters", f"SELECT count(*) FILTER (WHERE level IN ('FATAL', 'ERROR')) AS errors, count(*) FILTER (WHERE level = 'WARNING') AS warnings, strftime(max_by(ts, seq), '%Y-%m-%d %H:%M:%S.%g') AS last_at FROM lg WHERE {TRACKED}")
def _(spark, d):
    return errors.counters(text_logs(spark, d)).select("errors", "warnings", at("last_at").alias("last_at"))


@query("a2_count_by_level", f"SELECT level, count(*) AS cnt FROM lg WHERE {TRACKED} GROUP BY level")
def _(spark, d):
    return errors.by_level(text_logs(spark, d))


@query("a2_ring_by_level", f"SELECT level, count(*) AS cnt FROM (SELECT * FROM lg WHERE {TRACKED} ORDER BY seq DESC LIMIT 1000) GROUP BY level")
def _(spark, d):
    return errors.by_level(errors.newest(errors.tracked(text_logs(spark, d)), 1000))


CODES = f"SELECT coalesce(sql_state, 'UNKNOWN') AS code, CASE sql_state WHEN '23505' THEN 'unique_violation' WHEN '42P01' THEN 'undefined_table' ELSE 'UNKNOWN' END AS name, CASE sql_state WHEN '23505' THEN 'Integrity Constraint Violation' WHEN '42P01' THEN 'Syntax Error or Access Rule Violation' ELSE 'Unknown' END AS category, count(*) AS cnt, min(seq) AS first_seq FROM lg WHERE {TRACKED} GROUP BY ALL"


@query("a3_by_code", CODES)
def _(spark, d):
    return errors.by_code(csv_logs(spark, d))


@query("a4_top_codes", CODES + " ORDER BY cnt DESC, first_seq LIMIT 2")
def _(spark, d):
    return errors.top_codes(csv_logs(spark, d), 2)


@query("a4_since", f"SELECT level, count(*) AS cnt FROM lg WHERE {TRACKED} AND ts >= TIMESTAMP '2024-01-02' GROUP BY level")
def _(spark, d):
    return errors.tracked(text_logs(spark, d), since=F.lit("2024-01-02").cast("timestamp")).groupBy("level").agg(F.count("*").alias("cnt"))


@query("a5_examples", f"SELECT seq, {AT} AS at, CASE WHEN length(message) > 60 THEN substr(message, 1, 60) || '...' ELSE message END AS message FROM lg WHERE sql_state = '42P01' AND {TRACKED} ORDER BY seq DESC LIMIT 5")
def _(spark, d):
    return errors.examples(csv_logs(spark, d), "42P01").select("seq", at().alias("at"), "message")


TREND = f"""SELECT CAST(i AS INT) AS minute_idx, count(lg.seq) AS cnt FROM range(1440) r(i)
    LEFT JOIN lg ON {TRACKED} AND 1439 - CAST(trunc((epoch_us((SELECT max(ts) FROM lg)) - epoch_us(lg.ts)) / 60000000.0) AS INT) = i GROUP BY i"""


@query("a6_trend", TREND)
def _(spark, d):
    logs = text_logs(spark, d)
    return errors.trend(logs, last_time(logs), 1440)


@query("a7_trend_summary", f", t AS ({TREND}) SELECT sum(cnt)::BIGINT AS total, avg(cnt) AS average, max(cnt) AS peak, max(cnt) > 2 * avg(cnt) AS spike, 1440 AS glyphs FROM t")
def _(spark, d):
    logs = text_logs(spark, d)
    found = errors.trend_summary(errors.trend(logs, last_time(logs), 1440))
    return found.select("total", "average", "peak", "spike", F.length("line").alias("glyphs"))


@query("a19_reset", f"SELECT count(*) AS cnt FROM lg WHERE {TRACKED} AND seq > 500")
def _(spark, d):
    return errors.tracked(text_logs(spark, d), cleared_at_seq=500).agg(F.count("*").alias("cnt"))


@query("a20_events", f"SELECT seq, {AT} AS at, level, sql_state, substr(message, 1, 200) AS message, pid, database_name AS database, user_name AS \"user\" FROM lg WHERE {TRACKED}")
def _(spark, d):
    return errors.events(csv_logs(spark, d)).select("seq", at().alias("at"), "level", "sql_state", "message", "pid", "database", "user")


@query("j1_code_names", "SELECT CASE k % 3 WHEN 0 THEN 'unique_violation' WHEN 1 THEN 'undefined_table' ELSE '99999' END AS name, CASE k % 3 WHEN 0 THEN 'Integrity Constraint Violation' WHEN 1 THEN 'Syntax Error or Access Rule Violation' ELSE 'Unknown' END AS category, count(*) AS cnt FROM lg WHERE event_type = 'error' GROUP BY ALL")
def _(spark, d):
    e = csv_logs(spark, d).where("level <> 'LOG'")
    code = F.coalesce("sql_state", F.lit("99999"))
    return e.select(sqlstate.name(code).alias("name"), sqlstate.category(code).alias("category")).groupBy("name", "category").agg(F.count("*").alias("cnt"))


# -- durations

MS = "(cents / 100.0)"


@query("c1_duration", f"SELECT seq, {MS} AS duration_ms FROM lg WHERE event_type = 'view'")
def _(spark, d):
    return durations.durations(text_logs(spark, d))


@query("a8_a9_statistics", f"SELECT count(*) AS cnt, round(avg({MS}), 6) AS average, min({MS}) AS least, max({MS}) AS largest, round(quantile_cont({MS}, 0.5), 6) AS p50, round(quantile_cont({MS}, 0.95), 6) AS p95, round(quantile_cont({MS}, 0.99), 6) AS p99 FROM lg WHERE event_type = 'view'")
def _(spark, d):
    found = durations.statistics(durations.durations(text_logs(spark, d)))
    return found.select("cnt", "least", "largest", *[F.round(c, 6).alias(c) for c in ("average", "p50", "p95", "p99")])


@query("c2_slow_levels", f"SELECT CASE WHEN {MS} > 80 THEN 'critical' WHEN {MS} > 40 THEN 'slow' ELSE 'warning' END AS slow_level, count(*) AS cnt FROM lg WHERE event_type = 'view' AND {MS} > 10 GROUP BY ALL")
def _(spark, d):
    return durations.slow_queries(text_logs(spark, d), 10, 40, 80).groupBy("slow_level").agg(F.count("*").alias("cnt"))


@query("c24_severity", f"SELECT CASE WHEN {MS} >= 80 THEN 'critical' WHEN {MS} >= 40 THEN 'very_slow' WHEN {MS} >= 10 THEN 'slow' ELSE 'fast' END AS severity, count(*) AS cnt FROM lg WHERE event_type = 'view' GROUP BY ALL")
def _(spark, d):
    found = durations.durations(text_logs(spark, d)).select(text.duration_severity(F.col("duration_ms"), 10, 40, 80).alias("severity"))
    return found.groupBy("severity").agg(F.count("*").alias("cnt"))


# -- connections

CONN = "CASE event_type WHEN 'signup' THEN 'connect' WHEN 'purchase' THEN 'disconnect' ELSE 'failed' END"
IS_CONN = "(event_type IN ('signup', 'purchase') OR level = 'FATAL')"


@query("c6_connection_events", f"SELECT seq, {CONN} AS event_type, pid, CASE WHEN event_type <> 'error' THEN user_name END AS \"user\", CASE WHEN event_type <> 'error' THEN database_name END AS database, CASE WHEN event_type = 'signup' THEN 'app' || (k % 5) ELSE 'unknown' END AS application, CASE WHEN event_type = 'purchase' THEN '10.0.' || (k % 4) || '.' || (k % 100) END AS host, CASE WHEN event_type = 'purchase' THEN CAST(5000 + k AS INT) END AS port, CASE WHEN event_type = 'purchase' THEN (k % 6) * 60 + (k % 60) + 0.5 END::DOUBLE AS duration_seconds FROM lg WHERE {IS_CONN}")
def _(spark, d):
    return connections.events(text_logs(spark, d)).drop("timestamp")


@query("a10_connection_counters", f"SELECT count(*) FILTER (WHERE event_type = 'signup') AS connects, count(*) FILTER (WHERE event_type = 'purchase') AS disconnects, count(*) FILTER (WHERE level = 'FATAL') AS failures FROM lg")
def _(spark, d):
    return connections.counters(connections.events(text_logs(spark, d)))


ACTIVE = ", last AS (SELECT pid, max_by(event_type, seq) AS kind, max_by(user_name, seq) AS user_name, max_by(database_name, seq) AS database_name, max_by('app' || (k % 5), seq) AS app, max(seq) AS seq FROM lg WHERE event_type IN ('signup', 'purchase') GROUP BY pid), act AS (SELECT * FROM last WHERE kind = 'signup')"


@query("a11_active_sessions", ACTIVE + " SELECT pid, seq, user_name AS \"user\", database_name AS database, app AS application FROM act")
def _(spark, d):
    return connections.active(connections.events(text_logs(spark, d))).select("pid", "seq", "user", "database", "application")


@query("a12_active_by", ACTIVE + " SELECT 'user' AS dimension, user_name AS value, count(*) AS cnt FROM act GROUP BY ALL UNION ALL SELECT 'database', database_name, count(*) FROM act GROUP BY ALL UNION ALL SELECT 'application', app, count(*) FROM act GROUP BY ALL UNION ALL SELECT 'host', 'unknown', count(*) FROM act HAVING count(*) > 0")
def _(spark, d):
    return connections.active_by(connections.active(connections.events(text_logs(spark, d))))


@query("a13_filtered_summary", ACTIVE + " SELECT user_name AS value, count(*) AS cnt FROM act WHERE database_name = 'db3' GROUP BY ALL")
def _(spark, d):
    some = connections.matching(connections.active(connections.events(text_logs(spark, d))), database="db3")
    return connections.active_by(some).where("dimension = 'user'").select("value", "cnt")


CTREND = """SELECT CAST(i AS INT) AS bucket_idx, count(*) FILTER (WHERE lg.event_type = 'signup') AS connects, count(*) FILTER (WHERE lg.event_type = 'purchase') AS disconnects FROM range(48) r(i)
    LEFT JOIN lg ON lg.event_type IN ('signup', 'purchase') AND (epoch_us((SELECT max(ts) FROM lg)) - epoch_us(lg.ts)) / 60000000.0 < 2880
    AND 47 - CAST(floor((epoch_us((SELECT max(ts) FROM lg)) - epoch_us(lg.ts)) / 60000000.0 / 60) AS INT) = i GROUP BY i"""


@query("a14_connection_trend", CTREND)
def _(spark, d):
    logs = text_logs(spark, d)
    return connections.trend(connections.events(logs), last_time(logs), 2880, 60)


@query("a15_history", f", t AS ({CTREND}), s AS (SELECT sum(connects)::BIGINT AS connects, sum(disconnects)::BIGINT AS disconnects FROM t) SELECT connects, disconnects, connects - disconnects AS net, CASE WHEN connects > disconnects THEN 'growing' WHEN connects < disconnects THEN 'shrinking' ELSE 'stable' END AS label, (connects > 10 AND disconnects = 0) OR (connects > 20 AND disconnects < 0.1 * connects) AS leak FROM s")
def _(spark, d):
    logs = text_logs(spark, d)
    return connections.history(connections.trend(connections.events(logs), last_time(logs), 2880, 60))


# -- order of arrival


@query("w1_ring", "SELECT seq, level FROM lg ORDER BY seq DESC LIMIT 700")
def _(spark, d):
    return windows.ring(text_logs(spark, d), 700).select("seq", "level")


@query("w3_without_repeats", "SELECT seq, pid, level FROM (SELECT *, lag(level) OVER w AS was, row_number() OVER w AS n FROM lg WINDOW w AS (PARTITION BY pid ORDER BY seq)) WHERE n = 1 OR was IS DISTINCT FROM level")
def _(spark, d):
    return windows.without_repeats(text_logs(spark, d), "level", "pid").select("seq", "pid", "level")


@query("w4_last_with_prefix", "SELECT max_by(message, seq) AS found FROM lg WHERE starts_with(message, 'duplicate')")
def _(spark, d):
    return windows.last_with_prefix(text_logs(spark, d), "message", "duplicate")


@query("w5_since_pause", "SELECT count(*) FILTER (WHERE seq > 321) AS cnt FROM lg")
def _(spark, d):
    return windows.since_pause(text_logs(spark, d), 321)


@query("w6_age_of_last_error", f"SELECT (epoch_us((SELECT max(ts) FROM lg)) - epoch_us(max_by(ts, seq))) / 1000000.0 AS seconds FROM lg WHERE {TRACKED}")
def _(spark, d):
    logs = text_logs(spark, d)
    return windows.age_of_last(errors.tracked(logs), last_time(logs))


@query("w2_rate_limit", """, RECURSIVE_ROWS AS (SELECT pid, seq, ts, row_number() OVER (PARTITION BY pid ORDER BY seq) AS n FROM lg WHERE event_type = 'error'),
    first AS (SELECT pid, list(struct_pack(s := seq, t := epoch_us(ts)) ORDER BY seq) AS l FROM RECURSIVE_ROWS GROUP BY pid),
    folded AS (SELECT pid, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1].t - a[len(a)].t >= 3600000000 THEN list_concat(a, x) ELSE a END) AS out FROM first)
    SELECT pid, u.s AS seq FROM (SELECT pid, unnest(out) AS u FROM folded)""")
def _(spark, d):
    return windows.allowed(errors.tracked(text_logs(spark, d)), "pid", 3600).select("pid", "seq")


# -- texts


@query("c5_session_seconds", "SELECT seq, ((k % 6) * 60 + k % 60 + 0.5)::DOUBLE AS seconds FROM lg WHERE event_type = 'purchase'")
def _(spark, d):
    off = text_logs(spark, d).where(F.col("message").startswith("disconnection"))
    return off.select("seq", text.session_seconds(F.regexp_extract("message", connections.CLOSED, 1)).alias("seconds"))


@query("c13_severity", "SELECT CASE level WHEN 'FATAL' THEN 'critical' WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'info' END AS severity, count(*) AS cnt FROM lg GROUP BY ALL")
def _(spark, d):
    return text_logs(spark, d).groupBy(text.severity(F.col("level")).alias("severity")).agg(F.count("*").alias("cnt"))


@query("c14_quiet_hours", "SELECT count(*) AS cnt FROM lg WHERE strftime(ts, '%H:%M:%S.%f') >= '22:30:00.000000' OR strftime(ts, '%H:%M:%S.%f') <= '06:00:00.000000'")
def _(spark, d):
    return text_logs(spark, d).where(text.in_quiet_hours(F.col("timestamp"), "22:30", "06:00")).agg(F.count("*").alias("cnt"))


@query("c10_strip_markup", "SELECT page_id, length(regexp_replace('[b]' || url || '[/b] [12] x', '\\[/?[^\\]]*\\]', '', 'g')) AS n FROM pages", lg=False)
def _(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.length(text.strip_markup(F.concat(F.lit("[b]"), "url", F.lit("[/b] [12] x")))).cast("bigint").alias("n"))


@query("c12_shortened", "SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 147) || '...' ELSE text END AS body FROM documents", lg=False)
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.shortened(F.col("text"), 150, 147).alias("body"))


@query("c9_sparkline", ", c AS (SELECT level, hour(ts) AS h, count(*) AS cnt FROM lg GROUP BY ALL), a AS (SELECT l.level, i, coalesce(cnt, 0) AS v FROM (SELECT DISTINCT level FROM lg) l CROSS JOIN range(24) r(i) LEFT JOIN c ON c.level = l.level AND c.h = i), m AS (SELECT *, max(v) OVER (PARTITION BY level) AS top FROM a) SELECT level, string_agg(substr('▁▂▃▄▅▆▇█', least(CAST(trunc(v / greatest(top, 1)::DOUBLE * 7) AS INT), 7) + 1, 1), '' ORDER BY i) AS line FROM m GROUP BY level")
def _(spark, d):
    hours = text_logs(spark, d).groupBy("level").agg(*[F.count_if(F.hour("timestamp") == h).alias(f"h{h}") for h in range(24)])
    return hours.select("level", text.sparkline(F.array(*[f"h{h}" for h in range(24)])).alias("line"))


@query("c18_sql_region", "SELECT seq, message[1:strpos(message, 'SELECT') - 1] AS prefix, 'SELECT * FROM app.t' || k || ' WHERE id = ' || user_id AS sql, '' AS suffix FROM lg WHERE event_type = 'view'")
def _(spark, d):
    found = once(text_logs(spark, d).select("seq", "message"), "r", sqltext.region(F.col("message"))).where("r is not null")
    return found.select("seq", "r.prefix", "r.sql", "r.suffix")


@query("c19_sql_probe", "SELECT seq, strpos(message, 'SELECT')::INT - 1 AS start FROM lg WHERE event_type = 'view'")
def _(spark, d):
    found = text_logs(spark, d).select("seq", sqltext.probe(F.col("message")).alias("p")).where("p.found")
    return found.select("seq", "p.start")


@query("c20_sql_tokens", "SELECT t.type, t.text, count(*) AS cnt FROM (SELECT unnest([struct_pack(type := 'keyword', text := 'SELECT'), struct_pack(type := 'operator', text := '*'), struct_pack(type := 'keyword', text := 'FROM'), struct_pack(type := 'identifier', text := 'app'), struct_pack(type := 'punctuation', text := '.'), struct_pack(type := 'identifier', text := 't' || k), struct_pack(type := 'keyword', text := 'WHERE'), struct_pack(type := 'identifier', text := 'id'), struct_pack(type := 'operator', text := '='), struct_pack(type := 'number', text := CAST(user_id AS VARCHAR))]) AS t FROM lg WHERE event_type = 'view') GROUP BY ALL")
def _(spark, d):
    sql = once(text_logs(spark, d).select("message"), "sql", sqltext.region(F.col("message"))["sql"]).where("sql is not null")
    found = sql.select(F.explode(sqltext.tokens(F.col("sql"), sqltext.keywords(spark))).alias("t")).where("t.type <> 'whitespace'")
    return found.groupBy("t.type", "t.text").agg(F.count("*").alias("cnt"))


# -- spans: every extractor alone, against the texts that DuckDB's regular expressions find


def extracted(name: str, pattern: str, group: int = 0, where: str = "true"):
    sql = f", m AS (SELECT seq, message, unnest(regexp_extract_all(message, '{pattern}', {group})) AS text FROM lg WHERE {where}) SELECT seq, text, count(*) AS cnt, strpos(any_value(message), text)::INT - 1 AS first_start FROM m GROUP BY seq, text"

    @query(f"x_{name}", sql)
    def _(spark, d):
        found = spans.texts_of(text_logs(spark, d), name)
        return found.groupBy("seq", "text").agg(F.count("*").alias("cnt"), F.min("start").alias("first_start"))


SQL_ONLY = "event_type = 'view'"
extracted("sqlstate", r"\b([0-9A-Z]{5})\b", 1)
extracted("duration", r"\b\d+(?:\.\d+)?\s*ms\b")
extracted("statistics", r"(?i)\b\d+(?:\.\d+)?\s*(?:buffers?|pages?|tuples?|rows?|transactions?|blocks?|segments?|files?|%)")
extracted("identifier", r'"(?:[^"\\]|""|\\.)*"')
extracted("relation", r'(?i)\b(?:relation|table|index|sequence|constraint|view)\s+"?([a-zA-Z_][a-zA-Z0-9_]*)"?', 1)
extracted("schema", r'\b[a-zA-Z_][a-zA-Z0-9_]*\.(?:"[^"]+"|[a-zA-Z_][a-zA-Z0-9_]*)')
extracted("connection", r'(?i)\b(?:host|port|user|database|application_name)=(?:"[^"]*"|[^\s,]+)')
extracted("ip", r"\b10\.0\.\d+\.\d+\b", 0, "event_type = 'purchase'")
extracted("checkpoint", r"(?i)\b(?:checkpoint|wrote|sync|time)\b", 0, "event_type IN ('click', 'purchase')")
extracted("boolean", r"(?i)\b(?:on|off|true|false|yes|no)\b")


@query("x1_chain_counts")
def _(spark, d):
    words = spans.sql_keyword(sqltext.keywords(spark))
    found = spans.annotated(text_logs(spark, d), spans.enabled(more=(words,)))
    return found.groupBy("entity", "class").agg(F.count("*").alias("cnt"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("x31_paths_in_pages", r"SELECT page_id, unnest(regexp_extract_all(html || ' $' || page_id, '\$\d+')) AS text FROM pages", lg=False)
def _(spark, d):
    """A user's own extractor (prices) over whole pages, each of which gets one at its end."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat("html", F.lit(" $"), "page_id").alias("html"))
    return p.select("page_id", F.explode(spans.spans(spans.plain(F.col("html")), spans.custom("price", r"\$\d+"))).alias("s")).select("page_id", "s.text")


@query("x31_paths_in_whole_pages", r"SELECT page_id, unnest(regexp_extract_all(replace(html, '</', ' /x/'), '\B/(?:[\w.-]+/)*[\w.-]+/[\w.-]+\b')) AS text FROM pages", lg=False)
def _(spark, d):
    """Closing tags stand in for paths, as pages hold no others."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.replace("html", F.lit("</"), F.lit(" /x/")).alias("html"))
    return p.select("page_id", F.explode(spans.spans(spans.plain(F.col("html")), spans.BY_NAME["path"])).alias("s")).select("page_id", "s.text")


# -- alerts


@query("r7_alert_rules", f"SELECT seq, CASE WHEN level = 'FATAL' THEN 'level' WHEN regexp_matches(message, 'pk_1') THEN 'pattern' ELSE 'slow' END AS rule, CASE level WHEN 'FATAL' THEN 'critical' WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'info' END AS severity FROM lg WHERE level = 'FATAL' OR regexp_matches(message, 'pk_1') OR (event_type = 'view' AND {MS} > 60)")
def _(spark, d):
    rules = alerts.Rules().on("fatal").on("/PK_1/i").on("slow > 60 ms")
    return alerts.matched(text_logs(spark, d), rules).select("seq", "rule", "severity")


@query("r5_error_rate", f", near AS (SELECT seq, pid, level, count(*) FILTER (WHERE {TRACKED}) OVER (PARTITION BY source_file ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM lg) SELECT seq, 'rate' AS rule FROM near WHERE {TRACKED} AND n > 1")
def _(spark, d):
    return alerts.matched(text_logs(spark, d), alerts.Rules().on("errors > 1/min"), "source_file").select("seq", "rule")


@query("r10_quiet_alerts", "SELECT seq FROM lg WHERE level = 'FATAL' AND NOT (strftime(ts, '%H:%M') >= '08:00' AND strftime(ts, '%H:%M:%S.%f') <= '18:30:00.000000')")
def _(spark, d):
    return alerts.matched(text_logs(spark, d), alerts.Rules().on("fatal").silent("8:00-18:30")).select("seq")


def limited(where: str, seconds: int, columns: str) -> str:
    """SQL of a limiter over all rows of lg: a fold in the order of arrival."""
    return f""", hit AS (SELECT list(struct_pack(s := seq, t := epoch_us(ts)) ORDER BY seq) AS l FROM lg WHERE {where}),
    folded AS (SELECT list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1].t - a[len(a)].t >= {seconds * 1_000_000} THEN list_concat(a, x) ELSE a END) AS out FROM hit),
    gone AS (SELECT u.s AS seq FROM (SELECT unnest(out) AS u FROM folded)) SELECT {columns} FROM gone JOIN lg USING (seq)"""


@query("r9_limited_alerts", limited("level = 'FATAL'", 600, "seq, source_file, 'level' AS rule, message AS body"))
def _(spark, d):
    return alerts.alerts(text_logs(spark, d), alerts.Rules().on("fatal"), "source_file", 600).select("seq", "source_file", "rule", "body")


# -- more of the above


@query("f18_connection_filter", f"SELECT seq, pid FROM lg WHERE event_type = 'signup' AND database_name = 'db2' AND k % 5 = 3")
def _(spark, d):
    return connections.matching(connections.events(text_logs(spark, d)), database="db2", application="app3").select("seq", "pid")


@query("f19_events_since", f"SELECT seq, level FROM lg WHERE {TRACKED} AND ts >= TIMESTAMP '2024-01-10 12:00:00'")
def _(spark, d):
    return errors.events(errors.tracked(text_logs(spark, d), since=F.lit("2024-01-10 12:00:00").cast("timestamp"))).select("seq", "level")


@query("p3_present_values", "SELECT seq, application_name, sql_state FROM lg WHERE application_name IS NOT NULL AND sql_state IS NOT NULL")
def _(spark, d):
    j = once(csv_logs(spark, d), "j", render.as_json()).select("seq", "j").where(F.col("j").contains('"application_name"') & F.col("j").contains('"sql_state"'))
    return j.select("seq", F.get_json_object("j", "$.application_name").alias("application_name"), F.get_json_object("j", "$.sql_state").alias("sql_state"))


@query("p10_marked", "SELECT seq, replace(message, 'pk_' || k, '«pk_' || k || '»') AS line FROM lg WHERE level IN ('ERROR', 'WARNING')")
def _(spark, d):
    rows = text_logs(spark, d).where("level in ('ERROR', 'WARNING')").select("seq", "message")
    found = once(rows, "s", spans.spans(spans.plain(F.col("message")), spans.custom("key", r"pk_\d+")))
    return found.select("seq", render.marked(F.col("message"), F.col("s")).alias("line"))


@query("p9_precedence", f"SELECT CASE WHEN event_type = 'view' AND {MS} > 40 THEN 'slow' WHEN event_type = 'error' AND k % 5 > 0 THEN 'marked' ELSE 'plain' END AS shown, count(*) AS cnt FROM lg GROUP BY ALL")
def _(spark, d):
    m = F.col("message")
    slow = F.when(text.duration_ms(m) > 40, "slow")
    rows = text_logs(spark, d).select(render.highlighted(slow, F.when(m.contains("pk_"), "marked"), F.lit("plain")).alias("shown"))
    return rows.groupBy("shown").agg(F.count("*").alias("cnt"))


@query("a4b_levels_by_count", f"SELECT level, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, level) AS place FROM lg WHERE {TRACKED} GROUP BY level")
def _(spark, d):
    from pyspark.sql import Window

    return errors.by_level(text_logs(spark, d)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("cnt"), "level")).cast("bigint"))


@query("c15_age_in_words", "SELECT k, CASE WHEN k * 97 < 60 THEN (k * 97) || 's' WHEN k * 97 < 3600 THEN (k * 97 // 60) || 'm ' || (k * 97 % 60) || 's' ELSE (k * 97 // 3600) || 'h ' || (k * 97 % 3600 // 60) || 'm' END || ' ago' AS age FROM (SELECT DISTINCT k FROM lg)")
def _(spark, d):
    from .testlog import _base

    return _base(spark, d).select("k").distinct().select("k", text.ago(F.col("k") * 97).alias("age"))


@query("a4_summary", f", t AS (SELECT * FROM lg WHERE {TRACKED}) SELECT 'total' AS section, CASE level WHEN 'WARNING' THEN 'warnings' ELSE 'errors' END AS name, count(*) AS cnt FROM t GROUP BY ALL UNION ALL SELECT 'level', level, count(*) FROM t GROUP BY ALL UNION ALL SELECT * FROM (SELECT 'code', coalesce(sql_state, 'UNKNOWN') AS c, count(*) AS n FROM t GROUP BY ALL ORDER BY n DESC, c LIMIT 2)")
def _(spark, d):
    return errors.summary(csv_logs(spark, d), 2)


@query("a5_code_summary", f", t AS (SELECT * FROM lg WHERE sql_state = '23505' AND {TRACKED}) SELECT '23505' AS code, count(*) AS cnt, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS last_at, (SELECT string_agg(CASE WHEN length(message) > 60 THEN substr(message, 1, 60) || '...' ELSE message END, '; ' ORDER BY seq) FROM (SELECT * FROM t ORDER BY seq DESC LIMIT 3)) AS messages FROM t")
def _(spark, d):
    found = errors.code_summary(csv_logs(spark, d), "23505", 3)
    return found.select("code", "cnt", at("first_at").alias("first_at"), at("last_at").alias("last_at"), F.array_join("messages", "; ").alias("messages"))


@query("a13_summary", ACTIVE + ", m AS (SELECT * FROM act WHERE database_name = 'db3') SELECT 'total' AS section, name, cnt FROM (SELECT count(*) FILTER (WHERE event_type = 'signup') AS connects, count(*) FILTER (WHERE event_type = 'purchase') AS disconnects, count(*) FILTER (WHERE level = 'FATAL') AS failures FROM lg) UNPIVOT (cnt FOR name IN (connects, disconnects, failures)) UNION ALL SELECT 'total', 'open', count(*) FROM act UNION ALL SELECT 'user', user_name, count(*) FROM m GROUP BY ALL UNION ALL SELECT 'database', database_name, count(*) FROM m GROUP BY ALL UNION ALL SELECT 'application', app, count(*) FROM m GROUP BY ALL UNION ALL SELECT 'host', 'unknown', count(*) FROM m HAVING count(*) > 0")
def _(spark, d):
    return connections.summary(connections.events(text_logs(spark, d)), database="db3")


@query("p8_dispatch", f"SELECT seq, CASE seq % 4 WHEN 0 THEN {CLOCK} || ' [' || pid || '] ' || rpad(level, 7, ' ') || coalesce(' ' || sql_state, '') || ': ' || message WHEN 1 THEN {CLOCK} || ' [' || pid || '] ' || rpad(level, 7, ' ') || coalesce(' ' || sql_state, '') || ': ' || message || coalesce(chr(10) || '  Application: ' || application_name, '') || chr(10) || '  Database: ' || database_name || chr(10) || '  User: ' || user_name WHEN 2 THEN rpad(level, 7, ' ') || ' [' || pid || ']' || coalesce(' ' || application_name, '') || ' ' || message ELSE level END AS line FROM lg")
def _(spark, d):
    """Each row under one of the display settings; of a JSON line its level."""
    k = F.col("seq") % 4
    line = F.when(k == 0, render.shown()).when(k == 1, render.shown("full")).when(k == 2, render.shown("custom", names=["level", "pid", "application", "nonsense", "message"]))
    return csv_logs(spark, d).select("seq", line.otherwise(F.get_json_object(render.shown("full", "json"), "$.level")).alias("line"))


@query("p10_merged", "SELECT seq, replace(message, 'key value violates unique constraint \"pk_' || k || '\"', '«key value» «violates unique constraint \"pk_' || k || '»\"') AS line FROM lg WHERE level IN ('ERROR', 'WARNING')")
def _(spark, d):
    """Marks of several patterns, of which three overlap or touch."""
    rows = text_logs(spark, d).where("level in ('ERROR', 'WARNING')").select("seq", "message")
    m = spans.plain(F.col("message"))
    found = F.concat(*[spans.spans(m, spans.custom(f"c{n}", p)) for n, p in enumerate(("unique constraint", r'constraint "pk', r"_\d+", "violates unique", "key value"))])
    return once(rows, "s", render.merged(found)).select("seq", render.marked(F.col("message"), F.col("s")).alias("line"))


@query("r13_replay", "SELECT seq, level, seq % 3 AS batch FROM lg WHERE level = 'ERROR'")
def _(spark, d):
    """A log stored in three batches: shown up to the second, shown again under another filter, then what came meanwhile."""
    from .streaming import replay

    path = source.scratch(spark, "stored")
    arrived = text_logs(spark, d).select("seq", "timestamp", "level", "raw", F.col("seq").alias("place"))
    view = replay.View(spark, path, FilterSpec().with_levels(["warning"]))
    for n in range(3):
        arrived.where(F.col("seq") % 3 == n).write.mode("overwrite").parquet(f"{path}/batch={n}")
        if n == 0:
            view.poll()
        if n == 1:
            again = view.swap(FilterSpec().with_levels(["error"]))
    return again.unionByName(view.poll()).select("seq", "level", F.col("batch").cast("bigint").alias("batch"))


PART = "SELECT seq, 'timestamp.' || p.n AS entity, CAST(5 + p.o AS INT) AS start, substr(strftime(ts, '%Y-%m-%d %H:%M:%S.%g'), p.o + 1, p.l) AS text FROM lg, (VALUES ('date', 0, 10), ('time', 11, 8), ('ms', 20, 3)) p(n, o, l)"


@query("x2_chain_parts", f"{PART} UNION ALL SELECT seq, 'duration', 34, k || ' ms' FROM lg")
def _(spark, d):
    """Parts of entities inside the chain of all extractors."""
    logs = logs_of(spark, d, "'from ' || clock || ' took ' || k || ' ms'")
    return spans.annotated(logs, in_parts=True).select("seq", "entity", "start", "text")
