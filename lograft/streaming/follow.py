"""The log that a server writes now, across switches to new files, as a stream; and whether files can be read.

A server names its log in a pointer file (current_logfiles in its data folder), or the newest file of a folder with the same
suffix is its log. Files are known by their inodes and first lines, so a file that is renamed keeps its place. An offset holds, for each file
of the folder, how far it counts as read and whether it is or was followed. Between two offsets tasks read the rest of files that were
followed, then whole files that came in between, then the new one from its start: no line is lost or doubled, also over a restart.
"""

from __future__ import annotations

import os
import time
import zlib

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .tail import complete_to

#: The pointer file and the kinds of logs in it; fixed values.
POINTER, KINDS = "current_logfiles", ("stderr", "csvlog", "jsonlog")
#: Seconds between two looks at the folder.
SCAN_SECONDS = 1.0


class FollowRange(InputPartition):
    def __init__(self, path: str, start: int, end: int, order: int):
        self.path, self.start, self.end, self.order = path, start, end, order


def pointed(data_dir: str) -> str | None:
    """The first log that the pointer file of a data folder names."""
    try:
        with open(os.path.join(data_dir, POINTER), encoding="utf-8") as f:
            named = [line.split(maxsplit=1) for line in f]
    except OSError:
        return None
    return next((os.path.join(data_dir, x[1].strip()) for x in named if len(x) == 2 and x[0] in KINDS), None)


def first_line(path: str) -> int:
    """A number of a file's first whole line, 0 without one: it tells a file from a later one that got the same inode."""
    with open(path, "rb") as f:
        line, end, _ = f.read(1024).partition(b"\n")
    return zlib.crc32(line) if end else 0


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.data_dir, self.log_dir, self.path = options.get("datadir"), options.get("logdir"), options.get("path")
        self.earliest = options.get("startingposition", "latest") == "earliest"
        self.scan_seconds = float(options.get("scanseconds", SCAN_SECONDS))
        self.active: str | None = None  # the path
        self.on: set[str] = set()  # keys of files that are or were followed
        self.listed: list[str] = []
        self.scanned = float("-inf")
        self.mark = 0  # when the active file was last written, as last seen

    def _scan(self) -> None:
        """Chooses the active file; looks at the folder at most once in scan_seconds, sooner only if the active file is gone."""
        now = time.monotonic()
        if self.active is not None and now - self.scanned < self.scan_seconds and os.path.exists(self.active):
            return
        self.scanned = now
        first = pointed(self.data_dir) if self.data_dir else None
        folder = self.log_dir or os.path.dirname(first or self.path or "")
        suffix = os.path.splitext(first or self.active or self.path or "x.log")[1]
        try:
            self.listed = sorted(e.path for e in os.scandir(folder or ".") if e.is_file() and (e.name.endswith(suffix) or suffix + "." in e.name))
        except OSError:
            self.listed = []
        if first and os.path.exists(first):
            self.active = first
        elif self.log_dir:
            newest = [p for p in self.listed if os.path.splitext(p)[1] == suffix]
            self.active = max(newest, key=lambda p: (os.stat(p).st_mtime_ns, p), default=self.active)
        else:
            self.active = self.path

    def latestOffset(self) -> dict:
        before = self.active
        self._scan()
        files = {}
        for path in dict.fromkeys([*self.listed, *([self.active] if self.active else [])]):
            try:
                s = os.stat(path)
                files[f"{s.st_dev}:{s.st_ino}:{first_line(path)}"] = {"path": path, "pos": complete_to(path, s.st_size), "size": s.st_size, "mtime": s.st_mtime_ns, "on": False}
            except OSError:
                continue  # not there or not readable now; its place stays in the offset that had it
        real = os.path.realpath(self.active) if self.active else None
        now = next((k for k, f in files.items() if os.path.realpath(f["path"]) == real), None)
        if now is None:
            return {"active": "", "files": files}
        for key, f in files.items():
            if key == now or key in self.on:
                f["on"] = True
            elif before not in (None, self.active) and f["mtime"] > self.mark:
                f["on"] = True  # came and went between two looks
            if f["on"]:
                self.on.add(key)
            if key != now and f["on"]:
                f["pos"] = f["size"]  # no longer written: its last line is whole
            elif key != now and (f["mtime"], f["path"]) > (files[now]["mtime"], files[now]["path"]):
                f["pos"] = 0  # newer than the active one: unread, should the server turn to it
        self.mark = files[now]["mtime"]
        return {"active": now, "files": files}

    def initialOffset(self) -> dict:
        found = self.latestOffset()
        if self.earliest and found["active"]:
            found["files"][found["active"]] |= {"pos": 0, "size": 0}
        return found

    def partitions(self, start: dict, end: dict) -> list[FollowRange]:
        out = []
        was = start["files"]
        since = was[start["active"]]["mtime"] if start["active"] in was else 0
        # Which files are read: those followed before or now, and those that came after the one followed before.
        for key, f in sorted(end["files"].items(), key=lambda x: (x[0] == end["active"], x[1]["mtime"], x[1]["path"])):
            s = was.get(key)
            if not (f["on"] or (s and s["on"]) or (s is None and f["mtime"] > since and end["active"] != start["active"])):
                continue
            begin = 0 if s is None or f["size"] < s["size"] else s["pos"]
            finish = f["pos"] if key == end["active"] or not (s and s["on"]) else f["size"]
            if begin < finish:
                out.append(FollowRange(f["path"], begin, finish, f["mtime"]))
        return out

    def read(self, partition: FollowRange):
        name, at = os.path.basename(partition.path), partition.start
        with open(partition.path, "rb") as f:
            f.seek(at)
            while at < partition.end:
                line = f.readline(partition.end - at)
                if not line:
                    break
                if line.strip():
                    yield (line.decode("utf-8", "replace").rstrip("\r\n"), name, at, partition.order)
                at += len(line)


class FollowSource(DataSource):
    """spark.readStream.format("logfollow"): dataDir (with the pointer file), logDir (newest file) or path; startingPosition latest or earliest; scanSeconds. file_order and seq order the lines of a batch."""

    @classmethod
    def name(cls) -> str:
        return "logfollow"

    def schema(self) -> str:
        return "value string, source_file string, seq bigint, file_order bigint"

    def streamReader(self, schema) -> FollowReader:
        return FollowReader({k.lower(): v for k, v in self.options.items()})


def availability(path: str) -> str:
    """available, denied or missing."""
    try:
        with open(path, "rb"):
            return "available"
    except PermissionError:
        return "denied" if os.path.exists(path) else "missing"
    except OSError:
        return "missing"


class StatusReader(DataSourceStreamReader):
    """Offsets hold each path's state and since when it has it; a row comes for each change."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.known: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = time.time_ns() // 1000
        for path in self.paths:
            state = availability(path)
            if self.known.get(path, {}).get("state") != state:
                self.known[path] = {"state": state, "since": now}
        return {p: dict(s) for p, s in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((p, s["state"], s["since"])) for p, s in end.items() if start.get(p, {}).get("state") != s["state"]]

    def read(self, partition: InputPartition):
        yield partition.value


class StatusSource(DataSource):
    """spark.readStream.format("logstatus"): path, several by commas. A row (path, state, since in microseconds) at the start and for each change; the data of such a file resume by its inode in logtail and logfollow."""

    @classmethod
    def name(cls) -> str:
        return "logstatus"

    def schema(self) -> str:
        return "path string, state string, since bigint"

    def streamReader(self, schema) -> StatusReader:
        return StatusReader({k.lower(): v for k, v in self.options.items()})
