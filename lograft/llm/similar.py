"""Near copies by SimHash: fingerprints within a radius are candidates, each link is confirmed exactly.

Two texts are linked if the sets of their shingles (five words, A-Z lower-cased) have a Jaccard similarity of 0.8 or more.
A set's fingerprint has 256 bits, each the majority among its shingles' bits. Two sets at 0.8 differ in 15 of 100 bits,
others in half of them. Fingerprints within RADIUS bits are found by buckets: each stands in one bucket for each of BANDS
runs of BITS bits, and a bucket is compared whole, in blocks of bounded size, which return a forest of their pairs. Two
fingerprints of sets at 0.8 have no common bucket with a probability of (1 - 0.8485^7)^36, about 1 in a million, and are
over RADIUS bits apart more rarely (texts of eight and nine words: about 1 in 10,000 for both).

The pairs of the forests are confirmed first. What is within the radius in one cluster of fingerprints, but not yet in one
component, is then compared by whole sets in blocks inside a task, which returns links only, never pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, ship, whole_text, written
from .components import components
from .simhash import LOWER, SEED, Forest, named, pieces

WIDTH = 5
#: Words of a fingerprint, and bits in which two candidates differ at most: in all, and in the first two words.
WORDS, RADIUS, HALF = 4, 75, 46
#: Bits of a bucket's key and buckets of a fingerprint: nine from each word.
BITS = 7
BANDS = WORDS * (64 // BITS)
STEPS = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose bits are counted at a time: their counts fit a byte.
COUNTED = 255
#: Fingerprints of half a block, rows and columns compared at a time.
ROOM, STRIP, COLUMNS = 1 << 16, 64, 1024
#: Texts and shingles of half a block.
HOME, HELD = 512, 1 << 20


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles; of all words where they are fewer than width; none without words."""
    found, few = [], []
    for few in pieces(text.encode("utf-8", "surrogatepass").translate(LOWER), width):
        hashes = b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(few[i:] for i in range(width)))), itertools.repeat(SEED)))
        found.append(np.unique(np.frombuffer(hashes, np.uint64)))
    whole = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    if not len(whole) and few:
        return np.array([xxhash.xxh64_intdigest(b" ".join(few), SEED)], np.uint64)
    return whole


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words: each bit is set if it is set in more than half of the shingles; the first word is SimHash of the hashes themselves."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        x = hashes[at : at + COUNTED, None] + STEPS  # splitmix64 gives other bits for each word
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        x[:, 0] = hashes[at : at + COUNTED]
        ones += np.unpackbits(x.view(np.uint8).reshape(-1)).reshape(-1, 64 * WORDS).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _long(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


SIGNATURE = [f"s{k}" for k in range(WORDS)]


def _signed(batches):
    for batch in batches:
        fps, sizes, words = [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            fps.append(_key(found))
            sizes.append(len(found))
            words.append(fingerprint(found))
        words = np.array(words, np.uint64).reshape(-1, WORDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), _long(fps), pa.array(sizes, pa.int64()), *(_long(words[:, k]) for k in range(WORDS))], ["doc_id", "text", "fp", "n", *SIGNATURE]
        )


class Pairs(Forest):
    """A forest whose links are pairs that were joined, not the roots of their trees."""

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
            hooked, first = np.unique(hi, return_index=True)
            p[hooked] = lo[first]
            self.made.append(np.stack([i[first], j[first]]))


def _bits(a: list, b: list) -> np.ndarray:
    """Bits in which fingerprints differ, given by their words."""
    return sum(np.bitwise_count(x ^ y).astype(np.int16) for x, y in zip(a, b))


def near_pairs(words: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within RADIUS, and HALF in the first two words, (rows of words) where left and elsewhere, or among all rows if left is everywhere, that join just what all such pairs join."""
    forest, cols, both = Pairs(len(words)), [np.ascontiguousarray(words[:, k]) for k in range(WORDS)], left.all()
    rows, others = np.flatnonzero(left), np.flatnonzero(~left)
    differ, count = np.empty(STRIP * COLUMNS, np.uint64), np.empty(STRIP * COLUMNS, np.uint8)
    for s in range(0, len(rows), STRIP):
        i, every = rows[s : s + STRIP], rows[s:] if both else others
        tree = forest.parent[i]
        if (tree == tree[0]).all():  # what is in their tree already needs no look
            every = every[forest.parent[every] != tree[0]]
        for c in range(0, len(every), COLUMNS):
            j = every[c : c + COLUMNS]
            x, near = differ[: len(i) * len(j)].reshape(len(i), -1), count[: len(i) * len(j)].reshape(len(i), -1)
            np.bitwise_count(np.bitwise_xor(cols[0][i, None], cols[0][None, j], out=x), out=near)
            near += np.bitwise_count(np.bitwise_xor(cols[1][i, None], cols[1][None, j], out=x))
            a, b = np.divmod(np.flatnonzero(near <= HALF), len(j))
            a, b = i[a], j[b]
            apart = forest.parent[a] != forest.parent[b]
            a, b = a[apart], b[apart]
            close = _bits([x[a] for x in cols], [x[b] for x in cols]) <= RADIUS if len(a) else apart[:0]
            forest.join(a[close], b[close])
    return forest.links()


def _near(batches):
    for block in runs(batches, ["bucket", "one", "two"]):
        words = np.stack([block[c].to_numpy().view(np.uint64) for c in SIGNATURE], axis=1)
        a, b = near_pairs(words, block["part"].to_numpy() == block["one"].to_numpy())
        if len(a):
            fp = block["fp"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[a], fp[b])), pa.array(np.maximum(fp[a], fp[b]))], ["a", "b"])


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of distinct (fp, s0 to s3) within RADIUS that share a bucket, as many as join all such pairs."""
    key = lambda k, j: F.expr(f"cast(shiftrightunsigned(s{k}, {BITS * j}) & {(1 << BITS) - 1}L as int) + {(k * (64 // BITS) + j) << BITS}")
    rows = distinct.select(F.explode(F.array(*[key(k, j) for k in range(WORDS) for j in range(64 // BITS)])).alias("bucket"), "fp", *SIGNATURE)
    # There are BANDS * 2^BITS buckets at most, so their sizes may be broadcast.
    room = rows.groupBy("bucket").agg(F.ceil(F.count("*") / ROOM).cast("int").alias("parts"), F.count("*").alias("held")).where("held > 1").drop("held")
    rows = rows.join(F.broadcast(written(room, "rooms").coalesce(1)), "bucket").withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = rows.select("bucket", F.least("part", "x").alias("one"), F.greatest("part", "x").alias("two"), "part", "fp", *SIGNATURE)
    return blocks.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two").mapInArrow(_near, "a long, b long").distinct()


def _sets(batches):
    fps, found = [], []
    for batch in batches:
        for fp, text in zip(batch.column(0), batch.column(1)):
            fps.append(fp.as_py())
            found.append(shingles(text.as_py()))
            if sum(map(len, found[-64:])) > 1 << 17 or len(found) == 1024:
                yield _set_rows(fps, found)
                fps, found = [], []
    if fps:
        yield _set_rows(fps, found)


def _set_rows(fps: list, found: list) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.ListArray.from_arrays(ends, _long(np.concatenate(found)))], ["fp", "set"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is 0.8 or more: 5 common >= 4 (n + m - common)."""
    both = pairs.join(sets.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a")
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def block_links(fps: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], left: np.ndarray) -> list[tuple[int, int]]:
    """Links between the texts where left and the others, or among all if left is everywhere, that join just the components which pairs within RADIUS and at 0.8 or more join."""
    _, tree = np.unique(roots, return_inverse=True)  # the component of each text, as far as known
    sizes, out = np.array(list(map(len, sets))), []
    both, words = left.all(), np.stack([fingerprint(x) for x in sets], axis=1)
    for i in np.flatnonzero(left):
        other = tree != tree[i]
        other &= np.arange(len(fps)) > i if both else ~left
        j = np.flatnonzero(other & (5 * np.minimum(sizes, sizes[i]) >= 4 * np.maximum(sizes, sizes[i])))
        j = j[_bits(words[:, j], words[:, i]) <= RADIUS]
        if not len(j):
            continue
        flat, mine = np.concatenate([sets[k] for k in j]), sets[i]
        same = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        common = np.bincount(np.repeat(np.arange(len(j)), sizes[j])[same], minlength=len(j))
        for k in j[9 * common >= 4 * (sizes[i] + sizes[j])]:
            if tree[k] != tree[i]:
                out.append((int(fps[i]), int(fps[k])))
                tree[tree == tree[k]] = tree[i]
    return out


def _compared(batches):
    for block in runs(batches, ["cluster", "one", "two"]):
        left = block["part"].to_numpy() == block["one"].to_numpy()
        sets = [np.sort(x.values.to_numpy().view(np.uint64)) for x in block["set"]]
        links = block_links(block["fp"].to_numpy(), block["root"].to_numpy(), sets, left)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])


def _apart(keys: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links between texts of one cluster that are in different components."""
    rest = keys.select("cluster", "fp", "n").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = rest.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("texts"), F.sum("n").alias("held")).where("lo < hi")
    parts = F.ceil(F.greatest(F.col("texts") / HOME, F.col("held") / HELD)).cast("int")
    rest = rest.join(mixed.select("cluster", parts.alias("parts")), "cluster").withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    rest = rest.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = rest.select("cluster", F.least("part", "x").alias("one"), F.greatest("part", "x").alias("two"), "part", "fp", "root")
    blocks = rest.join(sets, "fp").select("cluster", "one", "two", "part", "fp", "root", "set")
    return blocks.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two").mapInArrow(_compared, "a long, b long")


def similar_links(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b) over distinct sets whose components are those of all candidate pairs at 0.8 or more. texts: fp, text; distinct: fp, n, s0 to s3."""
    near = written(near_links(distinct), "near")
    clusters = written(components(near), "clusters")
    clusters = clusters.select(F.col("node").alias("fp"), F.col("root").alias("cluster")).union(clusters.select("root", "root").distinct())
    keys = written(clusters.join(distinct.select("fp", "n"), "fp"), "clustered")
    sets = texts.groupBy("fp").agg(F.min("text").alias("text")).join(keys.select("fp"), "fp", "left_semi")
    sets = written(sets.mapInArrow(_sets, "fp long, set array<long>"), "shingles")
    size = lambda c: keys.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"))
    star = near.join(size("a"), "a").join(size("b"), "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)").select("a", "b")
    links = written(_confirmed(star.groupBy("b").agg(F.min("a").alias("a")), sets), "links")
    known = lambda: written(components(links), "link-roots").withColumnRenamed("node", "fp")
    roots = known()
    of = lambda df, c: df.join(roots.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    star = of(of(star, "a"), "b").where("root_a <> root_b").groupBy("b", "root_a").agg(F.min("a").alias("a")).select("a", "b")
    links = written(links.unionByName(_confirmed(star, sets)), "links")
    return links.unionByName(written(_apart(keys, sets, known()), "links"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp (long, of the set of shingles), component_id.

    Null texts count as empty, and texts without words are linked. component_id is the smallest doc_id that links reach;
    null only where no document reached has an id. Shingles and sets are told apart by 64-bit hashes.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    signed = written(rows.mapInArrow(_signed, "doc_id long, text string, fp long, n long, " + ", ".join(f"{c} long" for c in SIGNATURE)), "signatures")
    distinct = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in ("n", *SIGNATURE)]), "signature-ids")
    links = similar_links(signed.select("fp", "text"), distinct.where("n > 0"))
    return named(signed.select("doc_id", "fp"), distinct.select("fp", "least"), links)
