"""Following a server's log over renames, new files and a pointer file: every line once, the old file's rest before the new one's start."""

import os
import time

from lograft.streaming import follow

from .test_streaming import run


class Log:
    """Lines that a reader without Spark gets, offset by offset, as the engine would ask."""

    def __init__(self, **options):
        self.options = options
        self.reader = follow.FollowReader(options)
        self.at = self.reader.initialOffset()
        self.lines = []

    def restart(self):
        self.reader = follow.FollowReader(self.options)

    def poll(self):
        now = self.reader.latestOffset()
        for p in self.reader.partitions(self.at, now):
            self.lines += [r[0] for r in self.reader.read(p)]
        self.at = now
        return self.lines


def add(path, *lines, end="\n"):
    with open(path, "a") as f:
        f.write("\n".join(lines) + end)
    time.sleep(0.01)


def test_rename(tmp_path):
    log = tmp_path / "db.log"
    add(log, "a1", "a2")
    tail = Log(path=str(log), startingposition="earliest", scanseconds="0")
    assert tail.poll() == ["a1", "a2"]
    add(log, "a3", "a4")
    os.rename(log, tmp_path / "db.log.1")
    add(log, "b1")
    assert tail.poll() == ["a1", "a2", "a3", "a4", "b1"]
    add(log, "b2")
    add(tmp_path / "db.log.1", "a5")  # a late line of the old file
    assert sorted(tail.poll()) == ["a1", "a2", "a3", "a4", "a5", "b1", "b2"]


def test_newest_file_of_a_folder(tmp_path):
    add(tmp_path / "old.log", "o1")
    add(tmp_path / "pg-1.log", "a1")
    add(tmp_path / "pg-1.csv", "not,this")
    tail = Log(logdir=str(tmp_path), startingposition="earliest", scanseconds="0")
    assert tail.poll() == ["a1"]
    add(tmp_path / "pg-1.log", "a2", "a3 without a feed", end="")
    add(tmp_path / "pg-2.log", "b1")
    assert tail.poll() == ["a1", "a2", "a3 without a feed", "b1"]
    add(tmp_path / "pg-3.log", "c1")
    add(tmp_path / "pg-4.log", "d1", "d2")
    assert tail.poll() == ["a1", "a2", "a3 without a feed", "b1", "c1", "d1", "d2"]


def test_pointer_file_and_restart(tmp_path):
    (tmp_path / "log").mkdir()
    one, two = tmp_path / "log" / "1.log", tmp_path / "log" / "2.log"
    add(one, "a1")
    (tmp_path / "current_logfiles").write_text("stderr log/1.log\ncsvlog log/1.csv\n")
    tail = Log(datadir=str(tmp_path), startingposition="earliest", scanseconds="0")
    assert tail.poll() == ["a1"]
    add(two, "b1")  # the server has the file already, but has not turned to it
    assert tail.poll() == ["a1"]
    tail.restart()
    add(one, "a2")
    add(two, "b2")
    (tmp_path / "current_logfiles").write_text(f"stderr {two}\n")
    assert tail.poll() == ["a1", "a2", "b1", "b2"]
    add(two, "b3")
    tail.restart()
    assert tail.poll() == ["a1", "a2", "b1", "b2", "b3"]


def test_one_look_a_second(tmp_path):
    add(tmp_path / "a.log", "a1")
    tail = Log(logdir=str(tmp_path), startingposition="earliest")
    assert tail.poll() == ["a1"]
    add(tmp_path / "b.log", "b1")
    assert tail.poll() == ["a1"]
    tail.reader.scanned -= 2
    assert tail.poll() == ["a1", "b1"]
    os.remove(tmp_path / "b.log")
    add(tmp_path / "c.log", "c1")
    assert tail.poll() == ["a1", "b1", "c1"]  # the active file is gone: no need to wait


def test_latest_and_truncation(tmp_path):
    log = tmp_path / "x.log"
    add(log, "old")
    tail = Log(path=str(log), scanseconds="0")
    assert tail.poll() == []
    add(log, "new")
    assert tail.poll() == ["new"]
    log.write_text("short\n")
    assert tail.poll() == ["new", "short"]


def test_stream_over_a_switch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    add(logs / "1.log", "a1", "a2")
    spark.dataSource.register(follow.FollowSource)
    lines = lambda: spark.readStream.format("logfollow").option("logDir", str(logs)).option("startingPosition", "earliest").option("scanSeconds", "0").load()
    sink = lambda: lines().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
    for k in range(3):  # the query is stopped and started anew between the switches
        q = sink()
        try:
            q.processAllAvailable()
            add(logs / f"{k + 1}.log", f"{k}x")
            add(logs / f"{k + 2}.log", f"{k}y", f"{k}z")
            q.processAllAvailable()
        finally:
            q.stop()
    found = sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == sorted(["a1", "a2", *[f"{k}{x}" for k in range(3) for x in "xyz"]])


def test_globs_are_newest_first(tmp_path):
    from lograft.streaming.tail import expand

    for k, name in enumerate(["b.log", "a.log", "c.log", "d.txt"]):
        add(tmp_path / name, "x")
        os.utime(tmp_path / name, (100 + k // 2, 100 + k // 2))
    (tmp_path / "e.log").mkdir()
    assert [os.path.basename(p) for p in expand(str(tmp_path / "*.log"))] == ["c.log", "a.log", "b.log"]
    assert expand(str(tmp_path / "gone.log")) == [str(tmp_path / "gone.log")]


def test_status(spark, tmp_path, monkeypatch):
    path = tmp_path / "s.log"
    reader = follow.StatusReader({"path": str(path)})
    states, at = [], reader.initialOffset()

    def poll():
        nonlocal at
        now = reader.latestOffset()
        states.extend(next(iter(reader.read(p)))[1] for p in reader.partitions(at, now))
        at = now
        return states

    assert poll() == ["missing"]
    path.write_text("x\n")
    assert poll() == ["missing", "available"] == poll()

    def denied(*_):
        raise PermissionError

    monkeypatch.setattr(follow, "open", denied, raising=False)
    assert poll() == ["missing", "available", "denied"]
    monkeypatch.undo()
    assert poll() == ["missing", "available", "denied", "available"]
    spark.dataSource.register(follow.StatusSource)
    q = run(spark.readStream.format("logstatus").load(str(path)), "status", "append", tmp_path)
    try:
        q.processAllAvailable()
        os.remove(path)
        q.processAllAvailable()
        assert [r.state for r in spark.sql("SELECT state FROM status ORDER BY since").collect()] == ["available", "missing"]
    finally:
        q.stop()
