"""SimHash near-duplicates: exact comparison of all fingerprints in tiles.

Distinct fingerprints are dealt into tiles by the population counts of their four 16-bit words. Flipping k bits moves
these counts by k at most in sum, so two tiles whose counts differ by more than the radius are never compared; all
other pairs of tiles are, by exclusive-or and bit counts in numpy. Large tiles are split, so a task's blocks are bounded
whatever the data. A block reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, runs, ship, whole_text, written
from .components import components

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = b" \t\n\r\x0b\x0c"
#: Rows of a tile that stay at home in one block, rows that visit it, and rows compared at a time.
HOME, VISITORS, STRIP = 4096, 16384, 64
#: Texts longer than this many bytes are hashed piece by piece.
PIECE = 1 << 22


def pieces(data: bytes, width: int = 3):
    """Lists of the words of data; each list but the first begins with its predecessor's last width - 1 words."""
    if len(data) <= PIECE:
        yield data.split()
        return
    start, last = 0, []
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and data[end] not in SPACE:
            end += 1
        words = last + data[start:end].split()
        yield words
        last, start = words[max(0, len(words) - width + 1) :], end


def fingerprint(text: str, width: int = 3) -> int:
    """64 bits, each set if it is set in more than half of the hashes of the word shingles; 0 without words."""
    ones, n, few = np.zeros(64, np.int64), 0, []
    for words in pieces(text.encode("utf-8", "surrogatepass").translate(LOWER), width):
        if width != 3:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        else:
            shingles = map(b" ".join, zip(words, words[1:], words[2:]))
        found = b"".join(map(xxhash.xxh64_digest, shingles, itertools.repeat(SEED)))
        few = words
        for at in range(0, len(found), 1 << 19):
            part = np.frombuffer(found, np.uint8, min(1 << 19, len(found) - at), at)
            ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(found) // 8
    if not n:
        return int(xxhash.xxh64_intdigest(b" ".join(few), SEED)) if few else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        found = [fingerprint(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of four counts that sum to the radius at most, each pair of opposite ones once."""
    r = range(-radius, radius + 1)
    return [d for d in itertools.product(r, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


class Forest:
    """Union of nodes 0..n-1 in bulk; links() gives one link per union made."""

    def __init__(self, n: int):
        self.parent, self.made = np.arange(n), []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        while len(i):
            while True:
                up = p[p]
                if (up == p).all():
                    break
                p[:] = up
            a, b = p[i], p[j]
            apart = a != b
            i, j, hi, lo = i[apart], j[apart], np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            p[hi] = lo
            hooked = np.unique(hi)
            self.made.append(np.stack([hooked, p[hooked]]))

    def links(self) -> np.ndarray:
        return np.concatenate(self.made, axis=1) if self.made else np.zeros((2, 0), np.int64)


def block_links(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly the fingerprints of one block that lie within the radius."""
    values, at = np.unique(np.concatenate([home, visitors]), return_inverse=True)
    forest = Forest(len(values))
    h, v = at[: len(home)], at[len(home) :]
    for s in range(0, len(home), STRIP):
        near = np.bitwise_count(home[s : s + STRIP, None] ^ visitors[None, :]) <= radius
        i, j = np.nonzero(near)
        if len(i):
            forest.join(h[s + i], v[j])
    a, b = forest.links()
    return values[a], values[b]


def _compare(radius: int):
    def run(batches):
        out = []
        for group in runs(batches, ["tile", "part", "turn"]):
            fp, at_home = group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy(zero_copy_only=False)
            a, b = block_links(fp[at_home], fp[~at_home], radius)
            if len(a):
                out.append((a, b))
            if sum(len(x) for x, _ in out) > 50_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return run


def _edges(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).view(np.int64)) for k in (0, 1)], ["a", "b"])


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links over distinct fingerprints (fp) whose components are those of all pairs within the radius."""
    word = lambda k: F.expr(f"bit_count(shiftrightunsigned(fp, {16 * k}) & 65535L)")
    counts = [word(k) for k in range(4)]
    tile = lambda cs: sum((c * 17**k for k, c in enumerate(cs)), F.lit(0))
    fps = distinct.select("fp", *[c.cast("int").alias(f"c{k}") for k, c in enumerate(counts)])
    fps = fps.withColumn("tile", tile([F.col(f"c{k}") for k in range(4)]))
    # At most 17^4 tiles exist, so what is known of each of them may be broadcast.
    size = fps.groupBy("tile", "c0", "c1", "c2", "c3").agg(F.count("*").alias("n"))
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in steps(radius)])
    inside = " and ".join(f"c{k} + m.d{k} between 0 and 16" for k in range(4))
    to = tile([F.col(f"c{k}") + F.col(f"m.d{k}") for k in range(4)])
    visits = size.withColumn("m", F.explode(moves)).where(inside).select(to.alias("tile"), "n")
    room = size.select("tile", F.ceil(F.col("n") / HOME).cast("int").alias("parts"))
    turns = visits.groupBy("tile").agg(F.ceil(F.sum("n") / VISITORS).cast("int").alias("turns"))
    plan = written(room.join(turns, "tile"), "tiles").coalesce(1)
    at = F.xxhash64("fp")
    home = (
        fps.select("fp", "tile").join(F.broadcast(plan), "tile")
        .select("tile", F.pmod(at, "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "fp", F.lit(True).alias("home"))
    )
    guests = (
        fps.withColumn("m", F.explode(moves)).where(inside).select("fp", to.alias("tile")).join(F.broadcast(plan), "tile")
        .select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(at, "turns").cast("int").alias("turn"), "fp", F.lit(False).alias("home"))
    )
    blocks = home.union(guests).repartition("tile", "part", "turn").sortWithinPartitions("tile", "part", "turn")
    return blocks.mapInArrow(_compare(radius), "a long, b long")


def near_dedup(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp (long), component_id.

    Null texts count as empty; texts without words have fingerprint 0. Equal fingerprints are linked, whatever the
    texts. component_id is the smallest doc_id that links reach; null only where no document reached has an id.
    Repeated rows get equal results, other columns are not looked at, an empty table gives an empty result.
    """
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-ids")
    return named(rows, distinct, near_links(distinct, radius))


def named(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """rows (doc_id, fp) with component_id: the least id among the fingerprints (distinct: fp, least) that links join."""
    roots = components(links).withColumnRenamed("node", "fp")
    named = written(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_dedup(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
