"""Packing documents into sequences by minimum bin slack.

Only lengths matter for the choice, and there are at most `capacity` different ones, so the plan is made from a table of
counts by length whose size is bounded whatever the corpus. For each sequence in turn, a subset-sum over the lengths
that are left (a bitset of reachable totals) finds the fullest feasible combination with the longest piece left; it is
taken as often as it stays available. Spark numbers the pieces of each length, and the plan turns a number into
a sequence and an offset.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, ship, whole_text, written
from .tokens import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids: itself, or full pieces after a shorter first one."""
    if n <= capacity:
        return [n]
    return [n % capacity] * bool(n % capacity) + [capacity] * (n // capacity)


def _cut(path: str, capacity: int):
    def run(batches):
        task, seen = TaskContext.get().partitionId(), {}
        encode = encoder(path).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + b"\0\0\0\0"
                start = 0
                for k, n in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    rows.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), task, nth))
                    start += n
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination (length: uses) of available lengths with the largest total up to room; longer lengths preferred."""
    full, reach, layers = (1 << room + 1) - 1, 1, []
    for n in sorted(k for k, c in counts.items() if c and k <= room):
        left, step = min(counts[n], room // n), 1
        layers.append((n, reach))
        while left:
            take = min(step, left)
            reach |= reach << n * take & full
            left, step = left - take, step * 2
    total, out = reach.bit_length() - 1, {}
    for n, before in reversed(layers):
        most = min(counts[n], total // n)
        # The most uses of n after which the rest is still reachable with shorter lengths.
        for uses in range(most, -1, -1):
            if before >> total - uses * n & 1:
                break
        if uses:
            out[n], total = uses, total - uses * n
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: uses}) for runs of equal sequences, until no piece is left."""
    left, runs = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        one = fullest(left, capacity - longest)
        left[longest] += 1
        one[longest] = one.get(longest, 0) + 1
        times = min(left[n] // u for n, u in one.items())
        for n, u in one.items():
            left[n] -= u * times
            if not left[n]:
                del left[n]
        runs.append((times, one))
    return runs


def slots(runs: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, uses per sequence, first sequence, offset) in ascending order of the first number."""
    taken, found, sequence = {}, {}, 0
    for times, one in runs:
        offset = 0
        for n, u in sorted(one.items(), reverse=True):
            found.setdefault(n, []).append((taken.get(n, 0), u, sequence, offset))
            taken[n] = taken.get(n, 0) + u * times
            offset += u * n
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in found.items()}


def _place(table: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), table[int(n)]
                first, uses, seq, off = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1].T
                sequence[at] = seq + (number[at] - first) // uses
                offset[at] = off + (number[at] - first) % uses * n
            keep = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text), with its sequence and its offset there.

    Null texts count as empty: the end id alone. Texts of any length are encoded whole; documents longer than capacity are cut into full pieces, the first may
    be shorter. Repeated rows are packed as often as they occur, null doc_ids too; other columns are not looked at; an
    empty table gives an empty result. Sequences are numbered from 0.
    """
    ship(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(_cut(tokenizer or default_path(), capacity), PIECES)
    pieces = written(cut, "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    first = by_task.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    first = written(first.select("length", "task", "n", F.coalesce("first", F.lit(0)).alias("first")), "piece-counts")
    counts = {r["length"]: r["n"] for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    # A row per task and length: it grows with the corpus, so it is not broadcast.
    numbered = pieces.join(first.select("length", "task", "first").hint("merge"), ["length", "task"]).withColumn("number", F.col("first") + F.col("nth"))
    table = slots(plan(counts, capacity))
    columns = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return columns.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
