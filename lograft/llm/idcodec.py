"""A compressed file format for token ids: adaptive context mixing and a range coder, in independent blocks.

For each id three predictors speak. The order-2 and the order-1 predictor name the id that last held out after the same
two ids or the same id, with a confidence; the order-0 predictor is the file's distribution over ids, which its head holds.
The id's probability is the mixture
    w2 [id = order 2] + w1 [id = order 1] + (1 - w2 - w1) P0(id),
whose weights are learned for each pair of confidences. A range coder with carry takes it, as a part of 2^32. Every block
starts from the same state and has a checksum of its ids, so blocks are coded side by side: step t handles id t of all
blocks at once, in numpy.

File, little-endian: magic, u32 ids per block, u32 number of blocks, u64 number of ids, u32 bytes of the packed
distribution, that (zlib; u32 shares by id, whose sum is a power of two), then a u32 word count for each block, a u32 CRC-32 of each block's ids
(as u32), and each block's 16-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LGI3"
BLOCK = 2048
#: Blocks coded side by side; bounds the memory of the tables.
LANES = 4096
#: Steps whose hashes and parts the encoder computes together.
STEPS = 32
#: Ids below LIMIT can be coded. The distribution's shares sum to a power of two, from 2^LEAST to 2^MOST.
LIMIT = 1 << 20
LEAST, MOST = 16, 21
#: Slots of the tables of order 1 and 2, for each block: 2^LOG1 and 2^LOG2. An entry is an id, a check of its context and a confidence.
LOG1, LOG2 = 7, 8
FOUND = np.uint32(0x7FF)  # check and confidence
TOP = np.uint32(7)
K1, K2, K3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
U1, U16, U32, U48 = np.uint64(1), np.uint64(16), np.uint64(32), np.uint64(48)
MASK32 = np.uint64((1 << 32) - 1)
LOW48, ALL = np.uint64(1 << 48), np.uint64(1 << 32)
#: Weights of order 2 and 1 stay between FLOOR and FLOOR + SPAN, of 65536.
FLOOR, SPAN = np.int32(64), np.int32(62936)
#: First weights of order 2 and 1 by confidence. Without one there is no prediction.
FIRST = np.array([0, 20000, 30000, 40000, 48000, 52000, 56000, 58000], np.uint32)


def shares(ids: np.ndarray) -> np.ndarray:
    """Shares for ids that occur, at least 1 each, in proportion to their counts; 0 for the others. With few different
    ids their sum is smaller, so that the table by which ids are looked up is too."""
    counts = np.bincount(ids).astype(np.int64)
    there = counts > 0
    scale = 1 << min(max(int(there.sum()).bit_length() + 5, LEAST), MOST)
    found = np.where(there, np.maximum(counts * (scale - int(there.sum())) // max(int(counts.sum()), 1) + 1, 1), 0)
    if len(found):
        found[int(counts.argmax())] += scale - int(found.sum())  # what rounding left
    return found.astype(np.uint32)


class Static:
    """The order-0 distribution: where each id's part of the whole begins, and which id has a place."""

    def __init__(self, share: np.ndarray):
        self.id = np.flatnonzero(share).astype(np.uint32)  # those that occur
        self.index = np.cumsum(share > 0) - 1
        share = share[self.id].astype(np.uint64)
        total = int(share.sum())
        self.shift = np.uint64(max(total.bit_length() - 1, LEAST) - 16)
        ends = np.cumsum(share)
        self.ends = (ends - share) << U32 | ends
        self.of = np.repeat(np.arange(len(share), dtype=np.uint16 if len(share) <= 1 << 16 else np.uint32), share.astype(np.int64))

    def part(self, at, rest):
        """Begin and size of ids (by their place among those that occur) in a part of rest << 16."""
        ends = self.ends.take(at)
        begin = rest * (ends >> U32) >> self.shift
        return begin, (rest * (ends & MASK32) >> self.shift) - begin


def contexts(last, before):
    """Slots and checks of order 1 and 2 after the ids last - 1 and before - 1 (0: none)."""
    h1 = last * K1
    h2 = (h1 ^ before * K2) * K3
    return h1 >> np.uint32(32 - LOG1), h2 >> np.uint32(32 - LOG2), h1 & FOUND & ~TOP, h2 & FOUND & ~TOP


def chosen(f2, f1, begin, size, not2, miss):
    """Begin and size of the part that the id has: f2, f1 behind it, or what order 0 gives behind both. Sums instead of
    choices, which numpy makes slower; where they wrap around they come back."""
    return f2 * not2 + (f1 + begin) * miss, f2 + (f1 - f2) * not2 + (size - f1) * miss


class Mixer:
    """The predictors of some blocks, from their common first state."""

    def __init__(self, lanes: int):
        rows = np.arange(lanes)
        self.t1, self.t2 = np.zeros(lanes << LOG1, np.uint32), np.zeros(lanes << LOG2, np.uint32)
        # By confidence of order 2 and of order 1: order 1 speaks where order 2 does not, and little otherwise.
        first = np.repeat(FIRST, 8) << np.uint32(16) | np.concatenate([FIRST if k == 0 else FIRST // 16 for k in range(8)])
        self.weights = np.tile(first, lanes)
        self.base1, self.base2, self.basew = rows << LOG1, rows << LOG2, rows << 6

    def look(self, at1, at2, key1, key2):
        """Entries of both orders, and their parts of 65536, 0 without a prediction and in sum 65536 - 64 at most."""
        m = len(at1)
        self.at1, self.at2 = self.base1[:m] + at1, self.base2[:m] + at2
        self.e1, self.e2 = self.t1.take(self.at1, mode="clip"), self.t2.take(self.at2, mode="clip")
        self.c1, self.c2 = (self.e1 ^ key1) & FOUND, (self.e2 ^ key2) & FOUND
        self.c1 *= self.c1 <= TOP
        self.c2 *= self.c2 <= TOP
        self.atw = self.basew[:m] + (self.c2 << np.uint32(3) | self.c1)
        w = self.weights.take(self.atw, mode="clip")
        self.v2, self.v1 = (w >> np.uint32(16)).view(np.int32), (w & np.uint32(0xFFFF)).view(np.int32)
        f2 = self.v2.view(np.uint32) * (self.c2 > 0)
        # The part that order 2 leaves is shared between order 1 and order 0.
        f1 = ((np.uint32(65536) - f2) * self.v1.view(np.uint32) >> np.uint32(16)) * (self.c1 > 0)
        return f2, f1

    def learn(self, want1, want2):
        """Takes the ids that came (an entry without confidence for each order); which predictions held."""
        hits = []
        for table, at, e, c, want in ((self.t1, self.at1, self.e1, self.c1, want1), (self.t2, self.at2, self.e2, self.c2, want2)):
            hit = (e ^ want) - np.uint32(1) < TOP
            # A prediction gains confidence when it holds and loses some when not; without any it is replaced.
            new = want + np.uint32(1)
            keep = (c > 2) | hit
            gain = (c < TOP) + np.uint32(2)
            gain *= hit
            gain += e
            gain -= np.uint32(2)
            gain -= new
            gain *= keep
            new += gain
            table[at] = new
            hits.append(hit)
        hit1, hit2 = hits
        v2 = self.v2 + ((hit2 * SPAN + FLOOR - self.v2) >> np.int32(5))
        v1 = self.v1 + ((hit1 * SPAN + FLOOR - self.v1) >> np.int32(5)) * ~hit2
        self.weights[self.atw] = v2.view(np.uint32) << np.uint32(16) | v1.view(np.uint32)
        return hit1, hit2


def _encode_lanes(ids: np.ndarray, block: int, static: Static) -> list[bytes]:
    """Words of the blocks of ids, of which the last may be shorter."""
    n, steps = -(-len(ids) // block), min(block, len(ids))
    last = len(ids) - (n - 1) * block
    padded = np.zeros((n, steps), np.uint32)  # ids + 1
    padded.reshape(-1)[: len(ids)] = ids
    padded += np.uint32(1)
    before = np.zeros((2, n), np.uint32)
    mix = Mixer(n)
    low, rng = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    width = 2 * steps + 16
    # What carries add to a word may take it beyond 16 bits until the end.
    out, pos = np.zeros((n, width), np.uint32), np.arange(n) * width
    flat = out.reshape(-1)
    for first in range(0, steps, STEPS):
        some = np.concatenate([before, padded[:, first : first + STEPS].T])
        before = some[-2:]
        sym = some[2:] - np.uint32(1)
        at1, at2, key1, key2 = contexts(some[1:-1], some[:-2])
        want1, want2 = sym << np.uint32(11) | key1, sym << np.uint32(11) | key2
        f2, f1 = np.zeros(sym.shape, np.uint64), np.zeros(sym.shape, np.uint64)
        hit2, hit1 = np.zeros(sym.shape, bool), np.zeros(sym.shape, bool)
        for k in range(len(sym)):
            m = n if first + k < last else n - 1
            f2[k, :m], f1[k, :m] = mix.look(at1[k, :m], at2[k, :m], key1[k, :m], key2[k, :m])
            hit1[k, :m], hit2[k, :m] = mix.learn(want1[k, :m], want2[k, :m])
        # Parts of 2^32: order 2, order 1, then the distribution over what is left.
        f2 <<= U16
        f1 <<= U16
        not2 = ~hit2
        miss = not2 & ~hit1
        begin, size = static.part(static.index.take(sym), ALL - f2 - f1 >> U16)
        begin, size = chosen(f2, f1, begin, size, not2.astype(np.uint64), miss.astype(np.uint64))
        for k in range(len(sym)):
            m = n if first + k < last else n - 1
            lo, rg, at = low[:m], rng[:m], pos[:m]
            r = rg >> U32
            start = r * begin[k, :m]
            lo += start
            over = lo < start
            if over.any():
                flat[at[over] - 1] += np.uint32(1)
            np.multiply(r, size[k, :m], out=rg)
            # A word of each block that has one ready; the few with another one follow.
            flat[at] = lo >> U48
            short = rg < LOW48
            at += short
            by = short * U16
            lo <<= by
            rg <<= by
            while len(few := np.flatnonzero(rg < LOW48)):
                flat[at[few]] = lo[few] >> U48
                at[few] += 1
                lo[few] <<= U16
                rg[few] <<= U16
    # One more word is enough: the one above low that is within the range, zeros behind it.
    low += LOW48 - U1
    over = low < LOW48 - U1
    flat[pos[over] - 1] += np.uint32(1)
    flat[pos] = low >> U48
    ends = pos + 1 - np.arange(n) * width
    used = out[:, : ends.max()]
    while (over := used >> np.uint32(16)).any():
        used &= np.uint32(0xFFFF)
        used[:, :-1] += over[:, 1:]
    return [used[k, : ends[k]].astype("<u2").tobytes() for k in range(n)]


def _decode_lanes(words: list[np.ndarray], total: int, block: int, static: Static) -> np.ndarray:
    """The ids of blocks, total ids in sum, of which the last block may be shorter."""
    n, steps = len(words), min(block, total)
    last = total - (n - 1) * block
    width = max(map(len, words)) + 8
    src = np.zeros((n, width), np.uint16)
    for k, w in enumerate(words):
        src[k, : len(w)] = w
    flat, pos = src.reshape(-1), np.arange(n) * width + 4
    code = np.zeros(n, np.uint64)
    for k in range(4):
        code = code << U16 | flat[pos - 4 + k]
    rng = np.full(n, (1 << 64) - 1, np.uint64)
    ids = np.zeros((steps, n), np.uint32)
    mix = Mixer(n)
    before = now = np.zeros(n, np.uint32)
    for t in range(steps):
        m = n if t < last else n - 1
        cd, rg, at = code[:m], rng[:m], pos[:m]
        at1, at2, key1, key2 = contexts(now[:m], before[:m])
        f2, f1 = mix.look(at1, at2, key1, key2)
        r = rg >> U32
        v = cd // r
        f2, f1 = f2.astype(np.uint64) << U16, f1.astype(np.uint64) << U16
        two = f2 + f1
        rest = ALL - two >> U16
        not2, miss = v >= f2, v >= two
        # Where order 0 did not speak, what this gives is not used.
        v -= two
        place = ((v + U1 << static.shift) - U1) // rest
        zero = static.of.take(place.view(np.int64), mode="clip").astype(np.intp)
        before, now = now, ids[t, :m]
        begin, size = chosen(f2, f1, *static.part(zero, rest), not2.astype(np.uint64), miss.astype(np.uint64))
        not2, miss = not2.astype(np.uint32), miss.astype(np.uint32)
        p2, p1 = mix.e2 >> np.uint32(11), mix.e1 >> np.uint32(11)
        sym = p2 + (p1 - p2) * not2 + (static.id.take(zero) - p1) * miss
        cd -= r * begin
        np.multiply(r, size, out=rg)
        short = rg < LOW48
        by = short * U16
        cd <<= by
        cd |= flat.take(at, mode="clip") * short
        rg <<= by
        at += short
        while len(few := np.flatnonzero(rg < LOW48)):
            cd[few] = cd[few] << U16 | flat.take(at[few], mode="clip")
            at[few] += 1
            rg[few] <<= U16
        ids[t, :m] = sym
        now = sym + np.uint32(1)
        sym <<= np.uint32(11)
        mix.learn(sym | key1, sym | key2)
    return ids.T.reshape(-1)[:total]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """ids, whole numbers from 0 to LIMIT - 1, as the bytes of a file. No ids give a file without blocks."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >= LIMIT:
        raise ValueError(f"ids must be below {LIMIT}")
    blocks = [ids[k : k + block] for k in range(0, len(ids), block)]
    share = shares(ids)
    static, coded = Static(share), []
    for k in range(0, len(blocks), LANES):
        coded += _encode_lanes(ids[k * block : (k + LANES) * block], block, static)
    table = zlib.compress(share.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes(), 9)  # lowest bytes first
    head = MAGIC + struct.pack("<IIQI", block, len(blocks), len(ids), len(table))
    counts = np.array([len(c) // 2 for c in coded], "<u4").tobytes()
    sums = np.array([zlib.crc32(b.tobytes()) for b in blocks], "<u4").tobytes()
    return b"".join([head, table, counts, sums, *coded])


def decode(data: bytes) -> np.ndarray:
    """The ids of a file; ValueError if it is not one or a block's checksum does not hold."""
    if data[:4] != MAGIC:
        raise ValueError("not a file of ids")
    block, n, total, size = struct.unpack_from("<IIQI", data, 4)
    try:
        table = np.frombuffer(zlib.decompress(data[24 : 24 + size]), np.uint8).reshape(4, -1)
    except zlib.error as e:
        raise ValueError("the distribution is broken") from e
    static = Static(np.ascontiguousarray(table.T).view("<u4").reshape(-1))
    begin = 24 + size
    counts, sums = np.frombuffer(data, "<u4", n, begin), np.frombuffer(data, "<u4", n, begin + 4 * n)
    at = begin + 8 * n + 2 * np.append(0, np.cumsum(counts, dtype=np.int64))
    if n and at[-1] > len(data):
        raise ValueError("the file is cut short")
    out = np.empty(total, "<u4")
    for k in range(0, n, LANES):
        some = range(k, min(n, k + LANES))
        here = slice(k * block, min((k + LANES) * block, total))
        out[here] = _decode_lanes([np.frombuffer(data, "<u2", counts[j], at[j]) for j in some], here.stop - here.start, block, static)
    for j in range(n):
        if zlib.crc32(out[j * block : (j + 1) * block].tobytes()) != sums[j]:
            raise ValueError(f"block {j}: the checksum does not hold")
    return out
