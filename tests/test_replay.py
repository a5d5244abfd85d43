"""Filters that change while rows arrive, and pauses: what is shown equals a plain filter over all that has arrived."""

from lograft.plans.spec import FilterSpec
from lograft.streaming import jobs, replay

from .test_streaming import line


def test_swaps_and_pauses(spark, tmp_path):
    log, store, everything = tmp_path / "a.log", str(tmp_path / "store"), []
    log.write_text("")
    n = 0

    def arrive():
        nonlocal n
        rows = [(n + k, ("ERROR", "WARNING", "LOG")[(n + k) % 3], "even" if (n + k) % 2 == 0 else "odd") for k in range(7)]
        n += 7
        everything.extend(rows)
        with log.open("a") as f:
            f.write("".join(line(p, level, text, p % 60) for p, level, text in rows))
        q.processAllAvailable()

    def shown(df):
        return [r.pid for r in df.orderBy(*replay.ARRIVAL).collect()]

    q = replay.stored(jobs.tailed(spark, str(log), position="earliest"), store, str(tmp_path / "c")).start()
    try:
        view = replay.View(spark, store)
        assert view.newest() == -1
        arrive()
        seen = shown(view.poll())
        arrive()
        seen += shown(view.poll()) + shown(view.poll())
        assert seen == [p for p, _, _ in everything]
        seen = shown(view.swap(FilterSpec().with_levels(["error"])))
        arrive()
        seen += shown(view.poll())
        assert seen == [p for p, level, _ in everything if level == "ERROR"]
        view.pause()
        arrive()
        assert shown(view.poll()) == [] and view.waiting().first().cnt == sum(level == "ERROR" for _, level, _ in everything[-7:])
        seen = shown(view.swap(FilterSpec().with_pattern("/even/")))  # while paused: only up to the pause
        assert seen == [p for p, _, text in everything[:-7] if text == "even"]
        arrive()
        seen += shown(view.follow()) + shown(view.poll())
        assert seen == [p for p, _, text in everything if text == "even"]
    finally:
        q.stop()
    again = replay.View(spark, store, FilterSpec().with_levels(["warning"]))  # later, from the store alone
    assert shown(again.poll()) == [p for p, level, _ in everything if level == "WARNING"]


def test_open_sessions_equal_batch_after_each_batch(spark, tmp_path):
    import random

    from lograft.operators import connections
    from lograft.sources import logs as source

    r, log, second = random.Random(4), tmp_path / "s.log", 0
    log.write_text("")
    changes = jobs.session_changes(jobs.tailed(spark, str(log), position="earliest"))
    q = jobs.by_batch(changes, str(tmp_path / "changes"), str(tmp_path / "c")).start()
    try:
        for _ in range(4):
            with log.open("a") as f:
                for _ in range(25):
                    pid, user, db = r.randint(1, 8), r.choice("ab"), r.choice("xyz")
                    text = r.choice([f"connection authorized: user={user} database={db} application_name=app", f"disconnection: session time: 0:00:02.000 user={user} database={db} host=h", "password authentication failed"])
                    f.write(line(pid, "FATAL" if text.startswith("pass") else "LOG", text, second % 60))
                    second += 1
            q.processAllAvailable()
            found = jobs.open_by(spark.read.schema(jobs.CHANGES).parquet(str(tmp_path / "changes")))
            whole = source.parse(spark.read.text(str(log)).selectExpr("value", "'s.log' source_file", "monotonically_increasing_id() seq"), "text")
            want = connections.active_by(connections.active(connections.events(whole)))
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    finally:
        q.stop()


def test_forgotten_processes(spark, tmp_path):
    import time

    log = tmp_path / "f.log"
    log.write_text(line(1, "LOG", "connection authorized: user=a database=d"))
    q = jobs.by_batch(jobs.session_changes(jobs.tailed(spark, str(log), position="earliest"), forget=2), str(tmp_path / "changes"), str(tmp_path / "c")).start()
    try:
        for _ in range(80):
            time.sleep(0.5)
            found = [x.change for x in spark.read.schema(jobs.CHANGES).parquet(str(tmp_path / "changes")).collect()] if (tmp_path / "changes").exists() else []
            if len(found) == 2:
                break
        assert sorted(found) == [-1, 1]
    finally:
        q.stop()
