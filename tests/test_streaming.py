import os

from pyspark.sql import functions as F

from lograft.streaming import jobs


def run(df, name, mode, tmp_path):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()


def line(k, level="ERROR", message="x", second=0):
    return f"2024-01-01 00:00:{second:02} UTC [{k}] {level}:  {message}\n"


def test_tail_append_and_rotation(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_text(line(1) + "2024-01-01 00:00:00 UTC [2] ERR")
    q = run(jobs.tailed(spark, str(log), position="earliest").select("pid", "message"), "tail", "append", tmp_path)
    try:
        pids = lambda: [r.pid for r in spark.sql("SELECT pid FROM tail ORDER BY pid").collect()]
        q.processAllAvailable()
        assert pids() == [1]
        with log.open("a") as f:
            f.write("OR:  y\n" + line(3))
        q.processAllAvailable()
        assert pids() == [1, 2, 3]
        os.remove(log)
        log.write_text(line(4))
        q.processAllAvailable()
        assert pids() == [1, 2, 3, 4]
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    log = tmp_path / "b.log"
    log.write_text("".join(line(k % 3, "ERROR" if k % 2 else "WARNING") for k in range(20)))
    q = run(jobs.error_counts(jobs.tailed(spark, str(log), position="earliest")), "counts", "complete", tmp_path)
    try:
        q.processAllAvailable()
        with log.open("a") as f:
            f.write(line(1, "FATAL"))
        q.processAllAvailable()
        assert {r.level: r.cnt for r in spark.sql("SELECT * FROM counts").collect()} == {"ERROR": 10, "WARNING": 10, "FATAL": 1}
    finally:
        q.stop()


def test_sessions_and_limiter(spark, tmp_path):
    log = tmp_path / "c.log"
    log.write_text(line(1, "LOG", "connection authorized: user=a database=d") + line(2, "LOG", "connection authorized: user=b database=d", 3))
    q = run(jobs.last_events(jobs.tailed(spark, str(log), position="earliest")).select("pid", "last.seq", "last.event_type"), "sessions", "update", tmp_path)
    r = run(jobs.limited(jobs.tailed(spark, str(log), position="earliest")), "limited", "append", tmp_path)
    try:
        q.processAllAvailable(), r.processAllAvailable()
        with log.open("a") as f:
            f.write(line(1, "LOG", "disconnection: session time: 0:00:02.000 user=a database=d host=h", 6))
        q.processAllAvailable(), r.processAllAvailable()
        last = spark.sql("SELECT pid, max_by(event_type, seq) AS kind FROM sessions GROUP BY pid").where("kind = 'connect'")
        assert [x.pid for x in last.collect()] == [2]
        assert sorted(x["at"] % 60_000_000 for x in spark.table("limited").collect()) == [0, 6_000_000]
    finally:
        q.stop()
        r.stop()


def test_fan_out(spark, tmp_path):
    log = tmp_path / "d.log"
    log.write_text(line(2, second=5) + line(1, second=1))
    seen = []
    sinks = [lambda b, n: seen.append(("n", b.count())), jobs.in_order(lambda b, n: seen.append(("pids", [r.pid for r in b.select("pid").collect()])))]
    q = jobs.fan_out(jobs.tailed(spark, str(log), position="earliest").where(F.col("pid").isNotNull()), sinks, str(tmp_path / "fan")).start()
    try:
        q.processAllAvailable()
        assert ("n", 2) in seen and ("pids", [1, 2]) in seen
    finally:
        q.stop()
