"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of `window` bytes that covers it starts anywhere else too. Sorting all suffixes of a corpus would
move it hundreds of times over, so only suffixes that can meet are sorted:

1. Every window is named by an anchor, the 32-byte gram in it with the least hash. Equal windows have equal anchors at
   equal offsets. Successive windows with one anchor form a zone, about one per 85 bytes. Anchors that occur once are
   dropped. The other zones are counted by a digest, and Spark groups them by all their bytes to check it: two equal
   zones repeat each other as a whole. Digests that stand for different bytes are looked up by the bytes instead.
   Text of a short period gives one equal zone after the other; such a run, compared by its bytes, is one row.
2. The different zones that share an anchor are brought together, and the suffixes at their window starts are sorted by
   a mergesort. Two suffixes are compared by the longest common extension, found by binary search over prefix polynomial
   hashes, and the byte after it. Neighbours with a common extension of a whole window repeat each other, after their
   bytes have been compared; if a hash collision shows up, the class is sorted again by its bytes.
3. Where very many different zones share an anchor, they are dealt further before the sort: the offsets of the anchor are
   halved, and all windows with an offset in one half share more bytes than the anchor, so zones that differ there
   part company. Halves that are equal in all their bytes are grouped as in 1. After eight halvings a half is one window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, load, release, runs, ship, whole_text, written

GRAM = 32
#: Bytes hashed at once; bytes sorted at once; different zones above which a group is dealt further before its sort.
CHUNK, SORTED, CROWD = 1 << 19, 1 << 18, 2048
#: Bytes of a text whose zones are cut in one row.
BLOCK = 1 << 17
BASE = 0x9E3779B97F4A7C15
WINDOW = 200


def powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def power(n: int, base: int = BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(max(n, CHUNK + 4096), base)
    return _POWERS[base][:n]


def prefix_hashes(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """h[i] = sum of (data[j] + 1) * base^j for j < i, modulo 2^64."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power(len(data), base), out=h[1:])
    return h


def aligned(h: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """Hash of the size bytes at each place, the same wherever they stand."""
    n = len(h) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    return (h[size:] - h[:n]) * power(n, inverse)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w successive values."""
    n = len(x)
    full = -(-n // w) * w
    a = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    a[:n] = x
    a = a.reshape(-1, w)
    ahead = np.minimum.accumulate(a, axis=1).reshape(-1)
    back = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def zones_of(data: np.ndarray, last_start: np.ndarray, window: int):
    """Zones of a buffer: hash of the anchor, first window start, number of windows, offset of the anchor from that start.

    last_start: for each place that begins a window within its document, True.
    """
    h = prefix_hashes(data)
    grams = mixed(aligned(h, GRAM))
    w = window - GRAM + 1
    if len(grams) < w:
        return (np.zeros(0, np.int64),) * 4
    where = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    anchor = (sliding_least((grams & ~low) | where, w) & low).astype(np.int64)
    starts = np.flatnonzero(last_start[: len(anchor)])
    a = anchor[starts]
    cut = np.append(True, (a[1:] != a[:-1]) | (np.diff(starts) != 1))
    first = starts[cut]
    counts = np.diff(np.append(np.flatnonzero(cut), len(starts)))
    a = a[cut]
    return grams[a].view(np.int64), first, counts, a - first


def chunks(rids, texts, window: int):
    """(buffer, [(rid, start of the text in the buffer, offset within the text, bytes)]): whole texts together, long ones in overlapping parts."""
    held, rows, size = [], [], 0
    for rid, data in zip(rids, texts, strict=True):
        for at in range(0, max(1, len(data) - window + 1), CHUNK):
            part = data[at : at + CHUNK + window - 1] if len(data) > CHUNK else data
            if size and size + len(part) > CHUNK + window:
                yield b"".join(held), rows
                held, rows, size = [], [], 0
            rows.append((rid, size, at, len(part)))
            held.append(part)
            size += len(part)
            if part is data:
                break
    if rows:
        yield b"".join(held), rows


def zone_digest(part: bytes, shape: int) -> int:
    return xxhash.xxh3_64_intdigest(part, seed=shape)


def run_starts(buf: bytes, key, digests, shape, row, first, counts, window: int) -> np.ndarray:
    """Which zones begin a run: those that do not equal the zone just before them in their text, byte for byte."""
    new = np.ones(len(key), bool)
    alike = (key[1:] == key[:-1]) & (digests[1:] == digests[:-1]) & (shape[1:] == shape[:-1]) & (row[1:] == row[:-1]) & (first[1:] == first[:-1] + counts[:-1])
    for k in (np.flatnonzero(alike) + 1).tolist():
        a, b, n = int(first[k - 1]), int(first[k]), int(counts[k]) + window - 1
        new[k] = buf[a : a + n] != buf[b : b + n]
    return new


def _zones(window: int, digest):
    """Texts -> the anchors and digests of their zones, their texts, places, shapes (offset of the anchor, windows) and how many equal ones follow each other."""

    def run(batches):
        for batch in batches:
            for buf, rows in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), window):
                data = np.frombuffer(buf, np.uint8)
                begin = np.array([r[1] for r in rows])
                ok = np.zeros(len(data), bool)
                for _, s, _, n in rows:
                    ok[s : max(s, s + n - window + 1)] = True
                key, first, count, offset = zones_of(data, ok, window)
                if not len(key):
                    continue
                shape = offset << 8 | count
                digests = np.array([digest(buf[s : s + c + window - 1], x) for s, c, x in zip(first.tolist(), count.tolist(), shape.tolist(), strict=True)], np.uint64)
                # Texts of no bytes share their start with the next one, which is the last with that start.
                row = np.searchsorted(begin, first, side="right") - 1
                at = first - begin[row] + np.array([r[2] for r in rows])[row]
                head = np.flatnonzero(run_starts(buf, key, digests, shape, row, first, count, window))
                times = np.diff(np.append(head, len(key)))
                rids = pa.array([rows[k][0] for k in row[head].tolist()], pa.int64())
                cols = [pa.array(key[head]), pa.array(digests.view(np.int64)[head]), rids, pa.array(at[head]), pa.array(shape[head].astype(np.int32)), pa.array(times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["akey", "digest", "rid", "at", "shape", "times"])

    return run


class Suffixes:
    """Suffixes of a buffer, compared on their first `window` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, window: int):
        self.data, self.window = data, window
        self.h = prefix_hashes(data)
        self.norm = power(len(data) + 1)[::-1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to window: binary search."""
        h, ha, hb, na, nb = self.h, self.h[a], self.h[b], self.norm[a], self.norm[b]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.window)
        while True:
            if not (low < high).any():
                return low
            mid = (low + high + 1) >> 1
            same = (h[a + mid] - ha) * na == (h[b + mid] - hb) * nb
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)

    def less(self, a, b, or_equal) -> np.ndarray:
        n = self.common(a, b)
        whole = n >= self.window
        n = np.minimum(n, self.window - 1)
        return np.where(whole, or_equal, self.data[a + n] < self.data[b + n])

    def sort(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sorts each class of neighbouring entries (their sizes in order) by its suffixes: a mergesort of all classes side by side."""
        place = place.copy()
        begin = np.repeat(np.cumsum(size) - size, size)
        end = begin + np.repeat(size, size)
        index = np.arange(len(place))
        width = 1
        while width < size.max(initial=0):
            k = index - begin
            mine = begin + k // width * width
            left = (k // width) % 2 == 0
            other = np.where(left, mine + width, mine - width)
            stop = np.minimum(other + width, end)
            todo = np.flatnonzero(other < end)
            # Place of each entry in the run beside its own: entries there that come before it.
            low, high, own, first = other[todo].copy(), stop[todo].copy(), place[todo], left[todo]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                before = self.less(place[mid], own[open_], ~first[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = index.copy()
            to[todo] = np.minimum(mine[todo], other[todo]) + (index[todo] - mine[todo]) + (low - other[todo])
            moved = np.empty_like(place)
            moved[to] = place
            place = moved
            width *= 2
        return place

    def repeated(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which sorted entries have a neighbour in their class with the same window, checked byte by byte."""
        starts = np.cumsum(size) - size
        inner = np.ones(len(place), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        same = self.common(place[at - 1], place[at]) >= self.window
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.window)
        at = at[same]
        true = np.concatenate([(view[place[k - 1]] == view[place[k]]).all(axis=1) for k in np.array_split(at, len(at) // 4096 + 1)]) if len(at) else np.zeros(0, bool)
        out = np.zeros(len(place), bool)
        out[at[true]] = out[at[true] - 1] = True
        for c in np.unique(np.searchsorted(starts, at[~true], side="right") - 1):  # hash collisions: by the bytes
            members = slice(starts[c], starts[c] + size[c])
            words = [self.data[p : p + self.window].tobytes() for p in place[members]]
            _, which, times = np.unique(np.array(words, dtype=object), return_inverse=True, return_counts=True)
            out[members] = times[which] > 1
        return out


def repeats(zones: list[tuple[int, int, int, bytes]], window: int) -> list[np.ndarray]:
    """For zones (group, windows, anchor offset, bytes): which of each zone's windows also stand in another zone of its group."""
    data = np.frombuffer(b"".join(z[3] for z in zones), np.uint8)
    counts = np.array([z[1] for z in zones])
    begin = np.cumsum([0, *(len(z[3]) for z in zones)])[:-1]
    total = int(counts.sum())
    zone = np.repeat(np.arange(len(zones)), counts)
    j = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    # Only windows with one offset to their anchor can be equal.
    group, offset = np.array([z[0] for z in zones])[zone], np.array([z[2] for z in zones])[zone] - j
    label = group * 256 + offset
    order = np.argsort(label, kind="stable")
    cut = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
    size = np.diff(np.append(cut, total))
    order = order[np.repeat(size > 1, size)]
    size = size[size > 1]
    flags = np.zeros(total, bool)
    if len(order):
        place = begin[zone[order]] + j[order]
        entry = np.full(len(data), -1)
        entry[place] = order
        suffixes = Suffixes(data, window)
        by = suffixes.sort(place, size)
        flags[entry[by]] = suffixes.repeated(by, size)
    return np.split(flags, np.cumsum(counts)[:-1])


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of True: (first, after the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _halved(window: int):
    """Zones whose anchors have offsets in low..high -> their parts in each half of these, keyed by what all windows of that half share."""
    names = [c.split()[0] for c in ITEMS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            out = []
            for gkey, low, high, shape, rid, at, alone, part in zip(*(batch[c].to_pylist() for c in names), strict=True):
                offset, count, mid = shape >> 8, shape & 255, (low + high) // 2
                for a, b in ((low, mid), (mid + 1, high)):
                    most, least = min(b, offset), max(a, offset - count + 1)  # window j has its anchor at offset - j
                    if least > most:
                        continue
                    j, n = offset - most, most - least + 1
                    shared = part[offset - a : offset - b + window]
                    key = xxhash.xxh3_64_intdigest(shared + gkey.to_bytes(8, "little", signed=True), seed=a << 8 | b) - (1 << 63)
                    out.append((key, a, b, most << 8 | n, rid, at + j, alone, part[j : j + n + window - 1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _sorted(window: int):
    names, kinds = ["rid", "from", "to"], [pa.int64()] * 3

    def run(batches):
        held, rows, size, out = [], [], 0, []

        def flush():
            nonlocal held, rows, size
            for (rid, at, alone), flags in zip(rows, repeats(held, window), strict=True):
                if alone:
                    out.extend((rid, at + a, at + b - 1 + window) for a, b in spans(flags))
            held, rows, size = [], [], 0

        def result():
            nonlocal out
            made, out = out, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=names)

        for k, group in enumerate(runs(batches, ["gkey"])):
            if group.num_rows > 1:
                for rid, at, alone, shape, part in zip(*(group[c].to_pylist() for c in ("rid", "at", "alone", "shape", "bytes")), strict=True):
                    held.append((k, shape & 255, shape >> 8, part))
                    rows.append((rid, at, alone))
                    size += len(part)
            if size > SORTED:
                flush()
            if len(out) > 50_000:
                yield result()
        if rows:
            flush()
        if out:
            yield result()

    return run


def _kept(texts: tuple[str, ...], columns: int):
    """Documents with their intervals -> what is left."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            out, more = [], {c: [] for c in texts}
            for doc, data, found in zip(*(batch.column(k) for k in range(3)), strict=True):
                data, kept, at, removed = data.as_py(), [], 0, []
                for i in sorted((i["from"], i["to"]) for i in found.as_py() or ()):
                    if removed and i[0] <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], i[1])
                    else:
                        removed.append([*i])
                for a, b in removed:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]]) if removed else data
                out.append((doc.as_py(), len(data), len(data) - len(left), len(removed), hashlib.sha256(left).hexdigest()))
                for c, rows in more.items():
                    rows.append(left if c == "kept" else removed if c == "removed" else left.decode("utf-8", "ignore"))
            cols = [pa.array([r[k] for r in out], kinds[k]) for k in range(5)] + [pa.array(more[c], ARROW[c]) for c in texts]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(k) for k in range(3, columns))], [*names, *texts, *batch.schema.names[3:]])

    return run


#: What dedup can return beside the digest columns.
TEXTS = {"kept": "binary", "removed": "array<array<long>>", "kept_text": "string"}
ARROW = {"kept": pa.binary(), "removed": pa.list_(pa.list_(pa.int64())), "kept_text": pa.string()}


#: Zones for the sort: only windows whose anchor has an offset in low..high, in groups that share gkey; alone: 1 if the zone's own windows are in question.
ITEMS = "gkey long, low int, high int, shape int, rid long, at long, alone int, bytes binary"


def _dealt(items: DataFrame, window: int, crowd: int, tables: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """items (ITEMS), different within a gkey -> groups for the sort of crowd rows at most (more only where hashes of single windows
    collide), and (rid, from, to) of what proved repeated on the way. Eight rounds at most, as each halves the offsets. What it
    writes is added to tables."""
    columns, key, ready, gone = [c.split()[0] for c in ITEMS.split(", ")], ["gkey", "low", "high", "shape", "bytes"], None, None
    while True:
        big = items.where("low < high").groupBy("gkey").agg(F.count("*").alias("kinds")).where(F.col("kinds") > crowd).select("gkey")
        big = written(big, "crowded")
        tables.append(big)
        if big.isEmpty():
            return items if ready is None else ready.unionByName(items), gone
        small = items.join(big, "gkey", "left_anti").select(*columns)
        ready = small if ready is None else ready.unionByName(small)
        split = written(items.join(big, "gkey", "left_semi").select(*columns).mapInArrow(_halved(window), ITEMS), "halves")
        kinds = split.groupBy(*key).agg(F.count("*").alias("n"), F.min("rid").alias("rid"), F.min("at").alias("at"), F.min("alone").alias("alone"))
        kinds = written(kinds, "half-kinds")
        tables += [split, kinds]
        equal = split.where("alone = 1").join(kinds.where("n > 1").select(*key), key)
        equal = equal.select("rid", F.col("at").alias("from"), (F.col("at") + F.col("shape").bitwiseAND(255) + (window - 1)).alias("to"))
        gone = equal if gone is None else gone.union(equal)
        # A kind that several zones share is only compared with from here on; its own windows are settled.
        items = kinds.withColumn("alone", F.when(F.col("n") == 1, F.col("alone")).otherwise(0)).select(*columns)


def dedup(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = (), texts: tuple[str, ...] = ("kept", "removed", "kept_text"), crowd: int = CROWD, digest=zone_digest) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, those of kept (binary), removed (array of [from, to)) and
    kept_text (kept without characters that lost some of their bytes) that texts names, and the columns carry.

    Texts are UTF-8 bytes, null ones empty; matches never cross documents. Every row is a document of its own, whatever
    its doc_id. Repeated rows repeat each other, so all their bytes within windows go; shorter texts stay as they are, and
    long ones are read in overlapping parts and cut in blocks, those of one byte or a short period too. Columns named like those of the result cannot be carried; others are not
    looked at. An empty table gives an empty result. The window is 33 to 200 bytes. crowd: different zones of a group above
    which it is dealt further; digest: (bytes, shape) to 64 bits; both change the work only.
    """
    if not GRAM < window <= 200:
        raise ValueError("the window is 33 to 200 bytes")
    spark = docs.sparkSession
    ship(spark)
    rows = written(docs.select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("_data"), *carry), "texts")
    data = rows.select(F.col("_rid").alias("rid"), F.col("_data").alias("data"))
    every = written(data.mapInArrow(_zones(window, digest), "akey long, digest long, rid long, at long, shape int, times long"), "all-zones")
    classes = written(every.groupBy("akey", "digest").agg(F.sum("times").alias("n")), "zone-classes")
    release(spark)
    shared = classes.groupBy("akey").agg(F.sum("n").alias("all")).where("all > 1").select("akey")
    shared = written(classes.join(shared, "akey"), "shared-classes")
    discard(classes)
    release(spark)
    zones = written(every.join(shared, ["akey", "digest"]), "zones")
    discard(every)
    discard(shared)
    release(spark)

    # The bytes of the zones, block by block of the texts, so that no row's list grows with its text.
    block = lambda col: F.floor(col / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), block(F.length("data"))), lambda k: F.struct(k.alias("block"), F.substring(F.col("data"), k * BLOCK + 1, F.lit(BLOCK + 2 * window)).alias("data")))
    lists = zones.groupBy("rid", block(F.col("at")).alias("block")).agg(F.collect_list(F.struct("akey", "digest", "at", "shape", "times", "n")).alias("zones"))
    size = lambda shape: shape.bitwiseAND(255) + F.lit(window - 1)
    part = lambda z: F.substring(F.col("data"), (z["at"] % BLOCK + 1).cast("int"), size(z["shape"]))
    cut = data.select("rid", F.inline(blocks)).join(lists, ["rid", "block"])
    cut = cut.select("rid", F.transform("zones", lambda z: F.struct(z["akey"], z["digest"], z["shape"], z["at"], z["times"], z["n"], part(z).alias("bytes"))).alias("z"))
    # Written, so that the texts' shuffle files can go before the zones are shuffled.
    cut = written(cut.select("rid", F.inline("z").alias("akey", "digest", "shape", "at", "times", "n", "bytes")), "cut-zones")
    release(spark)
    key = ["akey", "digest", "shape", "bytes"]
    # A zone without another of its digest is a kind of its own; only the others are grouped by their bytes.
    many = cut.where("n > 1").groupBy(*key).agg(F.sum("times").alias("n"), F.min("rid").alias("rid"), F.min("at").alias("at"))
    many = written(many, "zone-kinds")
    kinds = many.unionByName(cut.where("n = 1").drop("times"))
    release(spark)

    # Zones that occur more than once as a whole; a digest of several kinds says nothing.
    span = lambda df: df.select("rid", F.col("at").alias("from"), (F.col("at") + F.col("shape").bitwiseAND(255) * F.col("times") + (window - 1)).alias("to"))
    several = zones.where("n > 1")
    unclear = many.groupBy("akey", "digest").agg(F.count("*").alias("kinds")).where("kinds > 1").select("akey", "digest")
    clear = unclear.isEmpty()
    if clear:
        gone = span(several)
    else:
        unclear = written(unclear, "unclear")
        gone = span(several.join(unclear, ["akey", "digest"], "left_anti"))
        gone = gone.union(span(cut.join(unclear, ["akey", "digest"], "left_semi").join(many.where("n > 1").select(*key), key)))

    anchors = kinds.groupBy("akey").agg(F.count("*").alias("kinds")).where("kinds > 1").select("akey")
    items = kinds.join(anchors, "akey").select(F.col("akey").alias("gkey"), F.lit(0).alias("low"), F.lit(window - GRAM).alias("high"), "shape", "rid", "at", (F.col("n") == 1).cast("int").alias("alone"), "bytes")
    items = written(items, "items")
    tables = [zones, items]
    if clear:
        discard(many)
        discard(cut)
    else:
        tables += [many, cut, unclear]
    release(spark)
    ready, settled = _dealt(items, window, crowd, tables)
    found = ready.repartition("gkey").sortWithinPartitions("gkey").mapInArrow(_sorted(window), "rid long, `from` long, `to` long")
    gone = gone.union(found) if settled is None else gone.union(found).union(settled)
    gone = gone.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("from", "to")).alias("_gone"))
    gone = written(gone, "gone")
    for table in tables:
        discard(table)
    release(spark)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    extra = "".join(f", {c} {TEXTS[c]}" for c in texts) + "".join(f", `{c}` {types[c]}" for c in carry)
    final = rows.join(gone, "_rid", "left").select("doc_id", "_data", "_gone", *carry)
    return final.mapInArrow(_kept(tuple(texts), 3 + len(carry)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(load(spark, sf_dir, "documents"), texts=()).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
