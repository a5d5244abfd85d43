"""Growing log files as a stream: appended lines, rotation, new files.

The offset maps each file to its inode, the place after its last complete line, its size and its time of change. A line
without its line feed waits for the rest. Executors read the byte ranges between two offsets, one task per file.
"""

from __future__ import annotations

import glob
import os
import stat

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class TailRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def complete_to(path: str, size: int, step: int = 1 << 16) -> int:
    """The place after the last line feed of the first size bytes, 0 without one."""
    with open(path, "rb") as f:
        while size > 0:
            begin = max(0, size - step)
            f.seek(begin)
            at = f.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return 0


def state_of(path: str) -> dict | None:
    """A file's part of the offset; None while it cannot be read."""
    try:
        s = os.stat(path)
        return {"inode": s.st_ino, "pos": complete_to(path, s.st_size), "size": s.st_size, "mtime": s.st_mtime_ns}
    except OSError:
        return None


def expand(pattern: str) -> list[str]:
    """The files of a glob, those written last first (ties by path); a path without *, ? or [ as it is. Files that vanish meanwhile are left out."""
    if not glob.has_magic(pattern):
        return [os.path.abspath(pattern)]
    found = []
    for path in glob.glob(pattern, recursive=True):
        try:
            s = os.stat(path)
        except OSError:
            continue
        if stat.S_ISREG(s.st_mode):
            found.append((-s.st_mtime_ns, os.path.abspath(path)))
    return [path for _, path in sorted(found)]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.latest = options.get("startingposition", "latest") == "latest"
        self.newcomers_latest = options.get("newfiles", "latest" if self.latest else "earliest") == "latest"

    def _now(self) -> dict:
        found = {p: state_of(p) for p in expand(self.pattern)}
        return {p: s for p, s in found.items() if s is not None}

    def initialOffset(self) -> dict:
        now = self._now()
        return now if self.latest else {p: s | {"pos": 0, "size": -1} for p, s in now.items()}

    def latestOffset(self) -> dict:
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[TailRange]:
        out = []
        for path, e in end.items():
            s = start.get(path)
            if s is None:
                begin = e["pos"] if self.newcomers_latest else 0
            elif s["inode"] != e["inode"] or e["size"] < s["size"] or e["pos"] < s["pos"]:
                begin = 0  # another file under this name, or a shorter one
            elif e["size"] == s["size"] and e["mtime"] != s["mtime"] and s["size"] >= 0:
                begin = 0  # written anew with the same length
            else:
                begin = s["pos"]
            if begin < e["pos"]:
                out.append(TailRange(path, begin, e["pos"]))
        return out

    def read(self, partition: TailRange):
        name = os.path.basename(partition.path)
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text.strip():
                    yield (text, name, at)
                at += len(line)


class TailSource(DataSource):
    """spark.readStream.format("logtail"): path (a file or a glob), startingPosition latest or earliest, newFiles latest or earliest."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "value string, source_file string, seq bigint"

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})
