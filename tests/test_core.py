import datetime as dt

import pytest
from pyspark.sql import functions as F

from lograft.functions import levels, sql, sqlstate, text, timestamps
from lograft.operators import alerts, connections, errors, render, spans, windows
from lograft.plans.spec import FilterSpec, java_regex, parse_pattern
from lograft.sources import logs, sinks


def lines(spark, rows, file="a"):
    return spark.createDataFrame([(k, v, file) for k, v in enumerate(rows)], "seq long, value string, source_file string")


def one(spark, expr, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("r")).collect()]


def test_level_lists():
    assert levels.level_list(["error+", "info"]) == (frozenset({"PANIC", "FATAL", "ERROR", "INFO"}), [])
    assert levels.level_list(["ALL"]) == (None, [])
    assert levels.level_list(["nonsense"]) == (None, ["nonsense"])
    assert levels.level_list(["w-"])[0] == levels.at_or_below("WARNING")
    spec = FilterSpec().with_levels(["error"])
    assert spec.with_levels(["error", "x"]) is spec


def test_text_forms(spark):
    rows = [
        "2024-01-15 10:30:45.123 UTC [12345] ERROR:  no such table", "2024-01-15 10:30:45 PST LOG:  started", "[2024-01-15 10:30:45.1 UTC] [7] [db] WARNING:  low",
        "  continued line", "2024-01-15 10:30:45 [9] STATEMENT:  SELECT 1",
    ]
    out = logs.parse(lines(spark, rows), "text").orderBy("seq").collect()
    assert [r.level for r in out] == ["ERROR", "LOG", "WARNING", "LOG", "LOG"]
    assert [r.pid for r in out] == [12345, None, 7, None, 9]
    assert [r.ts_is_utc for r in out] == [True, False, True, False, False]
    assert out[0].timestamp == dt.datetime(2024, 1, 15, 10, 30, 45, 123000) and out[3].timestamp is None and out[3].message == "  continued line"


def test_formats_and_fallbacks(spark):
    csv = '2024-01-15 10:30:45.123 PST,u,d,42,h:1,s,1,tag,2024-01-15 10:00:00 UTC,v,t,ERROR,23505,"dup ""key"", x",det,,,,,q,,loc,app,backend,,99'
    js = '{"timestamp":"2024-01-15T10:30:45.5Z","pid":"7","error_severity":"FATAL","message":"gone","remote_port":"55","ps":"x"}'
    c = logs.parse(lines(spark, [csv, "a,b,c"]), "csv").orderBy("seq").collect()
    assert (c[0].level, c[0].message, c[0].sql_state, c[0].pid, c[0].query_id, c[0].hint) == ("ERROR", 'dup "key", x', "23505", 42, 99, None)
    assert c[0].timestamp == dt.datetime(2024, 1, 15, 18, 30, 45, 123000)
    assert (c[1].level, c[1].message, c[1].timestamp) == ("LOG", "a,b,c", None)
    j = logs.parse(lines(spark, [js, "[1]", "{bad"]), "json").orderBy("seq").collect()
    assert (j[0].level, j[0].pid, j[0].remote_port, j[0].timestamp) == ("FATAL", 7, 55, dt.datetime(2024, 1, 15, 10, 30, 45, 500000))
    assert [r.message for r in j[1:]] == ["[1]", "{bad"]
    assert one(spark, logs.line_format, csv, js, "x", '{"message":1}') == ["csv", "json", "text", "text"]


def test_first_line_decides(spark):
    js = '{"error_severity":"LOG","message":"m"}'
    both = lines(spark, [" ", js, "plain"], "j").union(lines(spark, ["plain", js], "t"))
    got = {(r.source_file, r.seq): r.format for r in logs.sticky_formats(both).collect()}
    assert got[("j", 2)] == "json" and got[("t", 1)] == "text"


def test_zones(spark):
    texts = ["2024-07-01 00:00:00 PST", "2024-07-01 00:00:00.5 IST", "2024-07-01 00:00:00 XYZ", "2024-07-01 00:00:00+05:30", "2024-07-01T00:00:00Z", "2024-07-01 00:00:00", "2024-07-01", "2024-07-01 00:00:00.1234567 UTC", "2024-07-01 00:00:00+99", None]
    got = one(spark, timestamps.log_timestamp, *texts)
    day = dt.datetime(2024, 7, 1)
    assert got == [day + dt.timedelta(hours=8), day - dt.timedelta(hours=5) + dt.timedelta(seconds=0.5), day, day - dt.timedelta(hours=5.5), day, day, None, None, None, None]
    now = dt.datetime(2024, 1, 2, 12)
    assert timestamps.parse_time("90m", now) == dt.datetime(2024, 1, 2, 10, 30) and timestamps.parse_time("08:05", now).hour == 8
    with pytest.raises(ValueError):
        timestamps.parse_time("25:00", now)


def test_scalars(spark):
    assert one(spark, text.duration_ms, "Duration: 1.5 s x", "duration: 12 ms", "none", "duration: 5 sessions") == [1500.0, 12.0, None, 5000.0]
    assert one(spark, text.slow_level, 100.0, 100.1, 501.0, 1001.0, None, kind="double") == [None, "warning", "slow", "critical", None]
    assert one(spark, text.session_seconds, "0:01:23.5", "1:2", None) == [83.5, None, None]
    assert one(spark, text.strip_markup, "[b]x[/b] [1]") == ["x "]
    assert one(spark, text.strip_styles, "[b]x[/b] [12] \\[y") == ["x [12] [y"]
    assert one(spark, text.sparkline, [0, 1, 7], [0, 0], [], kind="array<int>") == ["▁▂█", "▁▁", ""]
    assert one(spark, sqlstate.name, "23505", "99999", None) == ["unique_violation", "99999", None]
    assert one(spark, sqlstate.category, "23505", "9", None) == ["Integrity Constraint Violation", "Unknown", "Unknown"]


def test_patterns():
    assert java_regex("(?P<a>x)(?P=a)") == "(?iuU)(?<a>x)\\k<a>"
    assert parse_pattern("/a/c").case_sensitive and not parse_pattern("/a/").case_sensitive
    for bad in ("a", "//", "/a"):
        with pytest.raises(ValueError):
            parse_pattern(bad)


def test_null_never_satisfies(spark):
    rows = logs.parse(lines(spark, ["x"]), "text")
    assert FilterSpec().with_field("app", "a").apply(rows).count() == 0
    assert FilterSpec().with_time("2020-01-01").apply(rows).count() == 0
    assert FilterSpec().with_pattern("-/y/").apply(rows).count() == 1


def test_connections(spark):
    rows = [
        "2024-01-01 00:00:00 UTC [1] LOG:  connection authorized: user=a database=d application_name=p", "2024-01-01 00:00:01 UTC [2] LOG:  connection authorized: user=b database=d",
        "2024-01-01 00:00:02 UTC [1] LOG:  disconnection: session time: 0:00:02.000 user=a database=d host=h port=5", "2024-01-01 00:00:03 UTC [9] LOG:  disconnection: session time: 0:00:02.000 user=a database=d host=h",
        "2024-01-01 00:00:03 UTC [3] FATAL:  sorry, too many clients already", "2024-01-01 00:00:04 UTC [4] LOG:  connection received: host=h",
    ]
    ev = connections.events(logs.parse(lines(spark, rows), "text"))
    assert [r.event_type for r in ev.orderBy("seq").collect()] == ["connect", "connect", "disconnect", "disconnect", "failed"]
    assert [r.pid for r in connections.active(ev).collect()] == [2]
    assert tuple(connections.counters(ev).first()) == (2, 2, 1)


def test_limiter_and_repeats(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, "s", base + dt.timedelta(seconds=t)) for k, t in enumerate((0, 3, 5, 9, 10, 16))], "seq long, src string, timestamp timestamp")
    assert sorted(r.seq for r in windows.allowed(df, "src").collect()) == [0, 2, 4, 5]
    c = spark.createDataFrame([(0, "a", "g"), (1, "a", "g"), (2, None, "g"), (3, None, "g"), (4, "a", "g")], "seq long, v string, g string")
    assert sorted(r.seq for r in windows.without_repeats(c, "v", "g").collect()) == [0, 2, 4]


def test_trend_edges(spark):
    as_of = dt.datetime(2024, 1, 1, 1)
    rows = [f"2024-01-01 {t} UTC [1] ERROR:  x" for t in ("01:00:30", "00:59:30", "00:00:30", "01:01:30")]
    got = errors.trend(logs.parse(lines(spark, rows), "text"), F.lit(as_of), 60)
    assert {r.minute_idx: r.cnt for r in got.collect() if r.cnt} == {59: 2, 0: 1}


def test_sql_tokens_and_regions(spark):
    assert one(spark, lambda c: sql.region(c)["sql"], "execute p1: SELECT 1 ", "DETAIL: x", "plain", "statement:  ") == ["SELECT 1", "x", None, None]
    got = one(spark, lambda c: sql.tokens(c, ["SELECT"]), "SELECT f(1.5), 'a''b' -- c\n/* d */ \"q\" $t$x$t$ <> ;?")[0]
    assert "".join(t.text for t in got) == "SELECT f(1.5), 'a''b' -- c\n/* d */ \"q\" $t$x$t$ <> ;?"
    kinds = [t.type for t in got if t.type != "whitespace"]
    assert kinds == ["keyword", "function", "punctuation", "number", "punctuation", "punctuation", "string", "comment", "comment", "quoted_identifier", "string", "operator", "punctuation", "unknown"]


def test_spans(spark):
    m = 'process 7 waiting for ShareLock on relation "users" after 1000.5 ms; [42] LSN 0/1A2B3C host=10.0.0.1 checkpoint starting'
    rows = logs.parse(lines(spark, [m]), "text")
    got = {(r.entity, r.text): (r.start, r["class"]) for r in spans.annotated(rows).collect()}
    assert got[("lock_type", "ShareLock")][1] == "share" and got[("duration", "1000.5 ms")][1] == "very_slow"
    assert got[("pid", "[42]")][0] == m.index("[42]") and got[("checkpoint", "checkpoint")][0] == m.index("checkpoint")
    assert ("identifier", '"users"') in got and ("lsn", "0/1A2B3C") in got
    with pytest.raises(ValueError):
        spans.custom("x", "a*")


def test_alert_rules(spark):
    rules = alerts.Rules().on("error+").on("warning").on("/Dead/").on("slow > 2s").on("errors > 5/min").silent("22:00-6:00")
    assert rules.levels >= {"PANIC", "WARNING"} and rules.slow_ms == 2000 and rules.errors_per_minute == 5 and rules.quiet == ("22:00", "06:00")
    with pytest.raises(ValueError):
        alerts.Rules().on("nonsense")


def test_export(spark, tmp_path):
    rows = logs.parse(lines(spark, ["2024-01-15 10:30:45.123 UTC [5] ERROR:  é [b]x"]), "text")
    for fmt, want in (("text", "2024-01-15 10:30:45.123 UTC [5] ERROR:  é [b]x"), ("csv", "timestamp,level,pid,message"), ("json", '{"timestamp":"2024-01-15T10:30:45.123000","level":"ERROR","pid":5,"message":"é x"}')):
        path = tmp_path / "deep" / f"f.{fmt}"
        assert sinks.export_file(rows, str(path), fmt) == 1
        assert path.read_text(encoding="utf-8").splitlines()[0] == want
    assert sinks.export_file(rows, str(tmp_path / "deep" / "f.csv"), "csv", append=True) == 1
    assert len((tmp_path / "deep" / "f.csv").read_text().splitlines()) == 3
    assert sinks.pipe(rows, ["cat"])[0] == 0
    with pytest.raises(ValueError):
        sinks.check_options(True, True, None)
    assert rows.select(render.compact()).first()[0] == "10:30:45.123 [5] ERROR  : é [b]x"


def test_empty(spark):
    empty = logs.parse(spark.createDataFrame([], "seq long, value string, source_file string"), "text")
    assert errors.by_code(empty).count() == 0 and connections.active(connections.events(empty)).count() == 0 and spans.annotated(empty).count() == 0


def test_marks_in_a_message_change_nothing(spark):
    """U+0001 and U+0002 stand in a message: spans keep their places and texts."""
    from lograft.operators import spans

    message = "a\x01b [12] \x02 took 3.5 ms for host=x\x01y and 10.0.0.1"
    df = spark.createDataFrame([(1, message)], "seq long, message string")
    found = spans.annotated(df).collect()
    assert {r.entity for r in found} >= {"pid", "duration", "ip"} and all(message[r.start : r.end] == r.text for r in found)


def test_files_of_one_name_have_formats_of_their_own(spark, tmp_path):
    from lograft.sources import logs

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.log").write_text("2024-01-15 10:30:45.123 UTC [12] LOG:  text line\n")
    (tmp_path / "b" / "x.log").write_text('{"timestamp":"2024-01-15 10:30:45.123 UTC","error_severity":"ERROR","message":"json line"}\n')
    found = logs.parse_logs(logs.read_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")])).collect()
    assert {(r.source_file, r.format, r.level, r.message) for r in found} == {("x.log", "text", "LOG", "text line"), ("x.log", "json", "ERROR", "json line")}


def test_filters_reach_the_scan(spark, tmp_path):
    """Times, levels and fields of a filter are pushed into a stored log."""
    logs.parse(lines(spark, ["2024-01-15 10:30:45 UTC [1] ERROR:  x", "no time"]), "text").write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spec = FilterSpec().with_time("2024-01-15T00:00:00Z").with_levels(["error"]).with_field("pid", "1").with_pattern("-/y/")
    found = spec.apply(spark.read.parquet(str(tmp_path / "t")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(timestamp" in plan and "EqualTo(level,ERROR)" in plan
    assert [r.message for r in found.collect()] == ["x"]
