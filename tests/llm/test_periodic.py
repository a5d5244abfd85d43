"""Strings that repeat inside long texts of a short period."""

import random

from lograft.llm import suffix_dedup

from .test_operators import repeated, table, words


def check(spark, texts):
    found = suffix_dedup.dedup(table(spark, list(enumerate(texts))), texts=()).collect()
    want = repeated([t.encode() for t in texts], 200)
    assert sorted(map(tuple, found)) == sorted((k, *w) for k, w in enumerate(want))


def test_periods_and_their_edges(spark):
    """Periods below, at and above the windows' anchors, one that holds a long run, at block and chunk edges, with shared heads and tails."""
    r = random.Random(5)
    unit = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    texts = [unit(n) * (1200 // n + 2) for n in (1, 2, 7, 33, 168, 169, 170, 199, 200, 201, 450)]
    texts += ["a" * 50 + "b", ("a" * 50 + "b") * 30, "x" * 199, "y" * 200, "z" * 201, words(1, 60) + "q" * 900 + words(2, 60), "q" * 400 + words(3, 60), words(4, 60) + texts[2][:250], "é" * 700]
    check(spark, texts)


def test_edges_of_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 9)
    check(spark, ["ab" * 1500 + words(5, 200) + "c" * 700, words(6, 900), words(6, 500)[300:] + "abc" * 400, ("a" * 60 + "b") * 40])


def test_megabytes_of_one_byte_and_of_a_short_period(spark):
    """Ten megabytes: runs are rows, so nothing grows with them but the pass that finds them."""
    clean, period = words(11, 300), "abcdefg" * 300_000
    texts = ["a" * 10_000_000, period, clean + "b" * 1_000_000 + words(12, 300), words(13, 20_000), "ab" * 60]
    found = {r.doc_id: r for r in suffix_dedup.dedup(table(spark, list(enumerate(texts))), texts=("removed",)).collect()}
    assert found[0].n_removed == len(texts[0]) and found[1].n_removed == len(period) and found[0].n_spans == found[1].n_spans == 1
    assert found[2].removed == [[len(clean), len(clean) + 1_000_000]]
    assert found[3].n_removed == found[4].n_removed == 0
