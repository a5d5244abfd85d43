"""The near stage's links against brute-force Jaccard of five-word shingles."""

import numpy as np
import pytest

import corpus_pipeline
from lograft.llm import similar

from .test_operators import AWKWARD, table, words


def sets(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()


def edited(seed, places):
    """A text of 300 words with new words at some places: each takes five shingles."""
    w = words(seed, 300).split()
    for k in places:
        w[k] = f"new{seed}x{k}"
    return " ".join(w)


def brute(rows):
    found, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common, every = len(found[a] & found[b]), len(found[a] | found[b])
            if 10 * common >= 8 * every:
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [least.get(top(k)) for k in range(len(rows))]


def corpus():
    """Pairs on both sides of 0.8, a large group of near copies, a chain whose ends are far apart."""
    rows = list(AWKWARD)
    for k in range(14):
        rows += [(100 + k, edited(900 + k, [])), (200 + k, edited(900 + k, range(10, 10 + 7 * k, 7)).upper())]
    rows += [(300 + k, edited(950, [k * 4, 290 - k * 3])) for k in range(40)]
    return rows + [(400 + k, edited(970, range(10, 10 + 24 * k, 8))) for k in range(8)]


@pytest.mark.parametrize("home", [512, 4])
def test_links(spark, monkeypatch, home):
    monkeypatch.setattr(similar, "HOME", home)
    rows = corpus()
    found = similar.near_dedup(table(spark, rows)).collect()
    want = brute(rows)
    assert sorted(repr((r.doc_id, r.component_id)) for r in found) == sorted(repr((i, c)) for (i, _), c in zip(rows, want))
    assert len(set(want)) < len(rows) - 50 and similar.near_dedup(table(spark, [])).count() == 0


def test_near_stage_drops_copies_at_similarity_80(spark):
    rows = [(i, t) for i, t in corpus() if i is not None and 100 <= i]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, table(spark, rows), "").collect()}
    assert kept == {i for (i, _), c in zip(rows, brute(rows)) if i == c}


def test_pieces_of_any_width(monkeypatch):
    t = words(5, 5000)
    whole = similar.shingles(t).tolist()
    monkeypatch.setattr("lograft.llm.simhash.PIECE", 100)
    assert similar.shingles(t).tolist() == whole and len(whole) == len(sets(t))


def test_fingerprints_are_majorities():
    found = similar.shingles(words(7, 700))
    first = int(similar.fingerprint(found)[0])
    assert [first >> k & 1 for k in range(64)] == [int(2 * sum(int(h) >> k & 1 for h in found) > len(found)) for k in range(64)]
    assert len(found) > similar.COUNTED and not similar.fingerprint(found[:0]).any()


@pytest.mark.parametrize("room", [1 << 16, 16])
def test_candidates_are_fingerprints_within_the_radius(spark, monkeypatch, room):
    monkeypatch.setattr(similar, "ROOM", room)
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (40, 256))
    for k in range(20):  # 10 + 5 k bits flipped: those of up to 75 are near
        bits[20 + k] = bits[k]
        bits[20 + k, rng.choice(256, 10 + 5 * k, replace=False)] ^= 1
    signed = np.packbits(bits, axis=1).view(np.int64)
    rows = spark.createDataFrame([(k, *map(int, w)) for k, w in enumerate(signed)], "fp long, s0 long, s1 long, s2 long, s3 long")
    found = {(r.a, r.b) for r in similar.near_links(rows).collect()}
    near = {(k, 20 + k) for k in range(20) if 10 + 5 * k <= similar.RADIUS and (bits[k] ^ bits[20 + k])[:128].sum() <= similar.HALF}
    buckets = [{(w, j, int(s) >> 7 * j & 127) for w, s in enumerate(x.view(np.uint64)) for j in range(9)} for x in signed]
    assert found == {(a, b) for a, b in near if buckets[a] & buckets[b]} and len(found) > 8
