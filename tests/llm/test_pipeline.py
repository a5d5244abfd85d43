"""The pipeline on a small corpus: every stage against brute force on what the stage before it kept."""

import random
import re

import pytest

import corpus_pipeline
from lograft.llm import tokens

from .test_operators import brute_fingerprint, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    passage = words(77, 60)
    rows = [(k, words(k, 120) + ".") for k in range(60)] + [(100 + k, " ".join(w.upper() + "!!" for w in words(k, 40).split())) for k in range(30)]
    rows += [(200, words(3, 120) + "."), (201, words(4, 120).replace(" ", "\n ") + "."), (202, None), (203, ""), (204, passage), (205, words(5, 50) + " " + passage + " é " + words(6, 50)), (206, passage)]
    rows += [(207, "é" * 400), (208, words(8, 30) + "é" * 400)]
    random.Random(0).shuffle(rows)
    d = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i < 130], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def staged(spark, corpus, tmp_path_factory, n):
    """What stage n read and what it wrote."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES[: n + 1]):
        out = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, corpus).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
    return before.collect(), docs


def test_quality_stage(spark, corpus, tmp_path_factory):
    before, after = staged(spark, corpus, tmp_path_factory, 0)
    assert after.columns == COLUMNS
    ids = {r.doc_id for r in after.collect()}
    assert not [i for i in ids if 100 <= i < 130] and ids >= set(range(60)) and len(before) > len(ids)


def test_exact_stage(spark, corpus, tmp_path_factory):
    before, after = staged(spark, corpus, tmp_path_factory, 1)
    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in before}
    want = {min(j for j in norm if norm[j] == t) for t in norm.values()}
    assert {r.doc_id for r in after.collect()} == want and after.columns == COLUMNS and len(want) < len(before)


def test_near_stage(spark, corpus, tmp_path_factory):
    before, after = staged(spark, corpus, tmp_path_factory, 2)
    fps = {r.doc_id: brute_fingerprint(r.text) for r in before}
    root = {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {r.doc_id for r in after.collect()} == {top(i) for i in fps} and after.columns == COLUMNS


def test_suffix_stage(spark, corpus, tmp_path_factory):
    before, after = staged(spark, corpus, tmp_path_factory, 3)
    texts = {r.doc_id: (r.text or "").encode() for r in before}
    count = {}
    for t in texts.values():
        for k in range(len(t) - 199):
            count[t[k : k + 200]] = count.get(t[k : k + 200], 0) + 1
    want = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        left = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        if left or not any(gone):
            want[i] = left
    rows = after.collect()
    assert {r.doc_id: r.text for r in rows} == want and after.columns == COLUMNS
    assert all(r.n_chars == len(r.text) for r in rows) and sum(map(len, want.values())) < sum(len(t.decode()) for t in texts.values())


def test_whole_run(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 2048
    assert len({r.doc_id for r in rows}) > 55 and tokens.default_path()
