"""Each operator against brute force on small tables with the awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lograft.llm import bpe, chat_tools, exact_dedup, idcodec, licenses, packing, quality, simhash, suffix_dedup, token_files, tokens, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, digest string"


def table(spark, rows):
    """Documents with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], DOCS).repartition(3)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))


AWKWARD = [
    (1, None), (2, ""), (3, "   "), (4, "a b"), (5, "a\n\tb"), (6, words(1, 400)), (7, words(1, 400)), (7, words(1, 400)), (8, words(2, 100) + words(1, 400)[:900] + words(3, 100)),
    (None, "no id"), (None, None), (9, "é" * 300), (10, "x" * 1000), (11, "MIT License, cc by cc by"), (12, words(4, 20_000)), (13, words(1, 399) + " Z"), (14, "no id"),
]


def text_of(t):
    return t or ""


# 1


def repeated(texts, w):
    count = {}
    for t in texts:
        for k in range(len(t) - w + 1):
            count[t[k : k + w]] = count.get(t[k : k + w], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - w + 1):
            if count[t[k : k + w]] > 1:
                gone[k : k + w] = b"\1" * w
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("crowd", "digest"), [(2048, suffix_dedup.zone_digest), (1, suffix_dedup.zone_digest), (2048, lambda part, shape: shape % 3)])
def test_suffix_dedup(spark, crowd, digest):
    """Few and many zones to a group, and a digest that collides."""
    found = suffix_dedup.dedup(table(spark, AWKWARD), crowd=crowd, digest=digest).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = repeated([text_of(t).encode() for _, t in AWKWARD], 200)
    assert sorted(map(repr, map(tuple, found))) == sorted(repr((i, *w)) for (i, _), w in zip(AWKWARD, want))
    assert suffix_dedup.dedup(table(spark, [])).count() == 0


def test_suffix_dedup_crowded_anchor(spark):
    """More different surroundings of one line than a group may hold, some of them twice."""
    line = "the quick brown fox jumps over the lazy dog, as every typist knows by heart " * 2
    rows = [(k, words(k % 90, 12) + line + words(1000 + k % 60, 40)) for k in range(200)]
    found = suffix_dedup.dedup(table(spark, rows), crowd=8, texts=()).collect()
    want = repeated([t.encode() for _, t in rows], 200)
    assert sorted(map(tuple, found)) == sorted((i, *w) for (i, _), w in zip(rows, want))


def test_suffix_dedup_long_and_repeated_rows(spark, monkeypatch):
    """A text over several chunks (the real size), and rows that repeat often."""
    text = words(9, 160_000)
    assert len(text) > suffix_dedup.CHUNK
    rows = [(1, text), (2, text[300_000:530_000]), (3, words(8, 100))] + [(4, words(7, 120))] * 40 + [(None, words(6, 100)), (None, words(5, 100))]
    found = suffix_dedup.dedup(table(spark, rows), texts=("removed",)).collect()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[1].removed == [[300_000, 530_000]] and by[2].n_removed == 230_000 and by[3].n_removed == 0
    assert [r.n_removed for r in found if r.doc_id == 4] == [len(words(7, 120))] * 40 and all(r.n_removed == 0 for r in found if r.doc_id is None)


def test_suffix_dedup_chunks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1500)
    text = words(9, 3000).encode()
    got = set()
    for buf, rows in suffix_dedup.chunks([1, 2], [text, b""], 200):
        data, ok = np.frombuffer(buf, np.uint8), np.zeros(len(buf), bool)
        for _, s, _, n in rows:
            ok[s : max(s, s + n - 199)] = True
        _, first, count, _ = suffix_dedup.zones_of(data, ok, 200)
        begin = {s: at for _, s, at, n in rows if n}
        for f, c in zip(first.tolist(), count.tolist()):
            s = max(x for x in begin if x <= f)
            got |= set(range(f - s + begin[s], f - s + begin[s] + c))
    assert got == set(range(len(text) - 199))


def test_suffix_sort_and_collisions():
    r = np.random.default_rng(0)
    data = r.integers(0, 2, 600).astype(np.uint8)
    s = suffix_dedup.Suffixes(data, 40)
    place = np.arange(500)
    assert [data[p : p + 40].tobytes() for p in s.sort(place, np.array([500]))] == sorted(data[p : p + 40].tobytes() for p in place)
    s.common = lambda a, b: np.full(len(a), 40)  # every comparison collides
    assert not s.repeated(place, np.array([500])).any()


# 2


def test_quality(spark):
    good = [(k, words(k, 60) + ".") for k in range(80)]
    bad = [(100 + k, " ".join(w.upper() + "!!" for w in words(k, 40).split())) for k in range(40)]
    docs = table(spark, good + bad + [(None, None), (999, ""), (998, words(5, 60))])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(0, 0, 0), (None, 1, 0), (5000, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == 123 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.predicted == (r.doc_id < 100 or r.doc_id == 998) for r in found if r.doc_id is not None and r.doc_id != 999)
    none = quality.train(docs, labels.limit(0))
    assert {r.predicted for r in quality.score(docs, none).collect()} == {1}
    assert quality.score(table(spark, []), model).count() == 0


def test_quality_features_do_not_depend_on_pieces(monkeypatch):
    for t in ("a | b || c\x0bd\x0cd --", words(1, 3000) + " " + words(1, 3000), "x" * 5000, " \n\t ", "WORD! " * 700):
        whole = quality.features(t)
        for piece in (1, 7, 100, 1 << 20):
            monkeypatch.setattr(quality, "PIECE", piece)
            assert np.allclose(quality.features(t), whole)


def test_quality_fit_against_gradient_descent():
    """The weights minimise the pairs' logistic loss: plain gradient steps on the same pairs, written down apart, end at the same place."""
    r = np.random.default_rng(5)
    f = r.normal(0, 1, (60, len(quality.NAMES)))
    label = (f[:, 0] - f[:, 3] + r.normal(0, 0.7, 60) > -0.5).astype(int)
    model = quality.fit(f, label, penalty=1e-2)
    good, bad = [x for x in range(60) if label[x]], [x for x in range(60) if not label[x]]
    z = [[min(8, max(-8, (v - m) / (s + 1e-9))) for v, m, s in zip(row, f.mean(axis=0), f.std(axis=0))] for row in f]
    losers = [b for b in bad for _ in range(quality.PAIRS)]
    winners = np.random.default_rng(0).choice(good, len(losers))
    w = np.zeros(len(quality.NAMES))
    diff = np.array(z)[winners] - np.array(z)[losers]
    for _ in range(6000):
        w += 0.3 * ((diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) - 1e-2 * w)
    assert np.allclose(w, model.weights, atol=1e-3)
    above = model.score(f) >= 0.3
    errors = lambda cut: sum((s >= cut) != bool(y) for s, y in zip(np.array(z) @ w, label))
    assert sum(above != (label == 1)) == min(errors(c) for c in [-99, 99, *(np.array(z) @ w + 1e-9), *(np.array(z) @ w - 1e-9)])


# 3


@pytest.mark.parametrize("digest", [None, lambda t: F.lit("same"), lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_dedup(spark, digest):
    found = exact_dedup.dedup(table(spark, AWKWARD), **({"digest": digest} if digest else {}), files_per_batch=1).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", text_of(t)) for _, t in AWKWARD]
    want = []
    for (i, _), n in zip(AWKWARD, norm):
        ids = [j for (j, _), m in zip(AWKWARD, norm) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep))
    assert sorted(map(repr, [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found])) == sorted(map(repr, want))
    assert exact_dedup.dedup(table(spark, [])).count() == 0


def test_exact_dedup_batches_and_hot_group(spark, monkeypatch, tmp_path):
    """Files of their own in several batches, a group that is dealt by a salt, and keepers of different files."""
    monkeypatch.setattr(exact_dedup, "HOT", 20)
    rows = [(k, "one  text" if k % 3 else words(k % 50, 30)) for k in range(1, 400)]
    table(spark, rows).repartition(8).write.parquet(str(tmp_path / "docs"))
    found = exact_dedup.dedup(spark.read.parquet(str(tmp_path / "docs"))).collect()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in rows}
    ids = {}
    for i, t in norm.items():
        ids.setdefault(t, []).append(i)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == [(i, ids[t][0], len(ids[t]), i == ids[t][0]) for i, t in norm.items()]
    assert len({r.keep_locator for r in found}) > 1


# 4, 5, 8


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_path())


ODD = ["", " ", "a  b", "a   b ", "x<|endoftext|> y", "it's we're", "é b", "日本 語", "a \n b", "\x1c a", "don't.\nIt's", "a&&& b!!", "ß ×", "aaaa" * 9]


def test_encoders_agree_with_the_library(encoder):
    r = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "'s", "1", "é", ",", "\t", "<|endoftext|>", "　", "the", "!!", ".\n", "&&&", "'", "\x00", "ß", "aaaa", "😀"]
    texts = ODD + ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    vocab = bpe.Vocabulary(tokens.default_path())
    for t, ids in zip(texts, vocab.encode(texts)):
        assert encoder.encode(t) == encoder.whole(t) == ids, repr(t)
        assert vocab.decode(np.frombuffer(ids, "<u4")).tobytes().decode() == encoder.tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_cache_generations(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 20)
    for k in range(50):
        t = words(k, 30)
        assert encoder.encode(t) == encoder.whole(t)


def test_bpe(spark, encoder):
    rows = AWKWARD + [(100 + k, t) for k, t in enumerate(ODD)]
    found = bpe.code(table(spark, rows), keep_ids=True).collect()
    want = []
    for i, t in rows:
        ids = encoder.whole(text_of(t))
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text_of(t).encode()).hexdigest()))
    assert sorted(map(repr, [tuple(r)[:4] for r in found])) == sorted(map(repr, want))
    assert bpe.code(table(spark, [])).count() == 0


def test_packing(spark, encoder):
    capacity = 64
    found = packing.pack(table(spark, AWKWARD), capacity=capacity).collect()
    at = {}
    for r in found:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity
    total = sum(r.length for r in found)
    assert sorted(at) == list(range(len(at))) and len(at) == -(-total // capacity)
    want = []
    for i, t in AWKWARD:
        ids, start = encoder.whole(text_of(t)) + b"\0" * 4, 0
        for k, n in enumerate(packing.piece_lengths(len(ids) // 4, capacity)):
            want.append((i, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            start += n
    assert sorted(map(repr, [tuple(r)[:5] for r in found])) == sorted(map(repr, want))
    assert packing.pack(table(spark, [])).count() == 0


def test_fullest_is_fullest():
    r = random.Random(3)
    for _ in range(200):
        counts, room = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}, r.randint(1, 60)
        best = {0}
        for n, c in counts.items():
            best = {b + k * n for b in best for k in range(c + 1) if b + k * n <= room}
        one = packing.fullest(counts, room)
        assert sum(n * u for n, u in one.items()) == max(best) and all(u <= counts[n] for n, u in one.items())


@pytest.mark.parametrize("ids", [[], [5], [0] * 5000, list(range(3000)) * 2, [idcodec.LIMIT - 1] * 50, list(np.random.default_rng(0).integers(0, idcodec.LIMIT, 3000)), list(np.random.default_rng(1).zipf(1.3, 9000) % 50_000)])
@pytest.mark.parametrize("block", [7, 4096])
def test_codec(ids, block):
    data = idcodec.encode(np.array(ids, np.uint32), block)
    assert idcodec.decode(data).tolist() == ids
    with pytest.raises(ValueError):
        idcodec.encode(np.array([idcodec.LIMIT]))


def test_blocks_are_short_and_longer_ones_are_read():
    """A file of 100,000 ids has 49 blocks to be coded side by side; files of the former 4096 ids a block are read too."""
    ids = np.random.default_rng(4).integers(0, 50_000, 100_000)
    assert int.from_bytes(idcodec.encode(ids)[8:12], "little") == 49
    assert (idcodec.decode(idcodec.encode(ids, 4096)) == ids).all()


def test_checksums_hold():
    data = bytearray(idcodec.encode(np.arange(9000) % 4000))
    data[-60] ^= 16
    with pytest.raises(ValueError):
        idcodec.decode(bytes(data))


def test_codec_beats_the_entropy_of_order_0(encoder):
    """A real corpus (sf0.01) takes fewer bits an id than its ids' frequencies alone would."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    ids = np.frombuffer(b"".join(encoder.encode(text_of(t)) + b"\0" * 4 for t in texts), "<u4")
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    data = idcodec.encode(ids)
    assert (idcodec.decode(data) == ids).all()
    assert 8 * len(data) / len(ids) < 0.95 * -(share * np.log2(share)).sum()


def test_columns_are_encoded_as_by_the_library(encoder):
    """Pieces cut by kinds of bytes: blanks, line feeds, marks, scripts and special tokens in any order, at the ends of texts, and in a slice."""
    r = random.Random(2)
    bits = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "'", "1", "0", "é", "ß", "×", "÷", "º", ",", "!!", ".\n", "&&&", "\t", "\x00", "\x1c", "\x85", "\xa0", "\u3000", "\u2028", "<|endoftext|>", "<|", "the", "aaaa", "日", "“", "слово", "😀"]
    texts = ODD + ["", "", " a", "a ", "\n", "a\n\n b", "a\n\n", "a\u3000 b", "слово два  три"] + ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for some in (pa.array(texts), pa.array(texts).slice(7, 100), pa.array([], pa.string()), pa.array(["", ""])):
        ids, counts = encoder.encode_column(some)
        ends = np.append(0, np.cumsum(counts))
        assert len(counts) == len(some) and ends[-1] == len(ids)
        for t, a, b in zip(some.to_pylist(), ends, ends[1:]):
            assert ids[a:b].tobytes() == encoder.whole(t), repr(t)


def test_each_piece_goes_to_the_library_once(monkeypatch):
    """A word with another mark or line behind it is no new word, and the kept pieces are bounded."""
    encoder, seen = tokens.Encoder(tokens.default_path()), []

    class Model:
        def tokenize(self, piece, model=encoder.model):
            seen.append(piece)
            return model.tokenize(piece)

    encoder.model = Model()
    monkeypatch.setattr(encoder, "whole", None)
    texts = [f"one{m} two{m}\nthree{m} two" for m in ("", ".", ",", "!?", ";")]
    for _ in range(2):
        ids, _ = encoder.encode_column(pa.array(texts))
        assert encoder.tok.decode(ids.tolist(), skip_special_tokens=False) == "".join(texts)
    assert len(seen) == len(set(seen)) == 8  # one, two behind its blank, three, four marks, the line feed
    monkeypatch.setattr(tokens, "KEEP_PIECES", 20)
    for k in range(50):
        encoder.encode_column(pa.array([words(k, 30)]))
        assert len(encoder.pieces) + len(encoder.old_pieces) < 120


def test_codec_with_all_ids_and_with_carries():
    """Every id once, so that each has the least share; and long runs that narrow the range slowly, with rare others, so that carries run through words."""
    r = np.random.default_rng(6)
    ids = r.permutation(idcodec.LIMIT).astype(np.uint32)
    assert (idcodec.decode(idcodec.encode(ids)) == ids).all()
    for n in (1, 2047, 2048, 2049, 60_000):
        ids = np.where(r.random(n) < 0.002, r.integers(0, 30_000, n), 30_000).astype(np.uint32)
        assert (idcodec.decode(idcodec.encode(ids)) == ids).all()


def test_a_file_is_coded_in_one_pass():
    """All blocks of a full file stand side by side, and their tables take 4 KB a block at most."""
    assert idcodec.LANES * idcodec.BLOCK >= token_files.FILE_IDS
    mix = idcodec.Mixer(100)
    assert sum(t.nbytes for t in (mix.t1, mix.t2, mix.weights)) <= 4096 * 100


def test_gathered_batches_keep_all_rows(monkeypatch):
    monkeypatch.setattr(token_files, "GATHER", 300)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k, None], "text": ["x" * k, ""]}) for k in range(1, 40)]
    batches.insert(3, batches[0].slice(0, 0))
    found = list(token_files.gathered(iter(batches)))
    assert 1 < len(found) < 39 and pa.Table.from_batches(found).equals(pa.Table.from_batches(batches))
    assert list(token_files.gathered(iter([]))) == []


def test_token_files_without_ids_and_several_to_a_task(spark, encoder, tmp_path):
    """Rows without doc_id come first, rows with one doc_id stand together, and a task closes files as they fill."""
    token_files.write(table(spark, AWKWARD), str(tmp_path / "ids"), file_ids=500)
    files = spark.read.parquet(str(tmp_path / "ids"))
    assert files.agg(F.max("nth")).first()[0] > 0
    found = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, str(tmp_path / "ids")).collect()))
    want = sorted(repr((i, len(x) // 4, zlib.crc32(x))) for i, x in ((i, encoder.whole(text_of(t)) + b"\0" * 4) for i, t in AWKWARD))
    assert sorted(repr(r[1:]) for r in found) == want
    ends = [0]
    for start, _, n, _ in found:
        assert start == ends[-1]
        ends.append(start + n)
    docs = [r[1] for r in found]
    assert docs == sorted(docs, key=lambda i: (i is not None, i or 0))


def test_token_files(spark, encoder, tmp_path, monkeypatch):
    rows = [r for r in AWKWARD if r[0] is not None]
    token_files.write(table(spark, rows), str(tmp_path / "ids"))
    found = sorted(tuple(r) for r in token_files.read(spark, str(tmp_path / "ids")).collect())
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = encoder.whole(text_of(t)) + b"\0" * 4
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert found == want
    token_files.write(table(spark, []), str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


# 6


def test_licenses(spark):
    rows = AWKWARD + [
        (20, "SPDX-License-Identifier: GPL-3.0-only under the GNU General Public License, version 3"), (21, "..CC-BY, the MIT  License\nMIT license é"), (22, "mit licenses"),
        (23, "Licensed under CC BY-NC 4.0. Apache License " * 300), (24, "Released under the MIT License."),
    ]
    found = licenses.scan(table(spark, rows)).collect()
    assert len(found) == len(rows) and len(licenses.rules()) > 200 and found[0].keep_id == "x"
    for r in found:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text_of(r.text))
        w = re.findall(licenses.WORD, low)
        hits = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(at, default=None), max(at, default=None))
        assert r.base_labels == sorted({label for _, label in hits}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in found}
    assert by[23].labels == ["apache", "cc-by", "cc-by-nc"] and by[24].labels == ["mit"]
    spdx = by[20].detections
    assert [(d.priority, d.label) for d in spdx] == [(0, "gpl"), (2, "gpl")]
    assert licenses.scan(table(spark, [])).count() == 0


def test_suppression_against_brute_force(spark):
    """The sweep keeps just what no kept detection of equal or better priority contains."""
    docs = table(spark, [(1, "Licensed under the GNU General Public License, version 2. See gnu.org/licenses/gpl-2.0.html or CC BY-NC-SA 4.0 and Apache-2.0")])
    low = "licensed under the gnu general public license, version 2. see gnu.org/licenses/gpl-2.0.html or cc by-nc-sa 4.0 and apache-2.0"
    every = []
    for p, _, label, key, pattern in licenses.rules():
        if key in low:
            every += [(m.start(), -m.end(), p, label) for m in re.finditer(pattern, low)]
    kept = []
    for s, e, p, label in sorted(every):
        if not any(k[0] <= s and -k[1] >= -e and k[2] <= p for k in kept):
            kept.append((s, e, p, label))
    got = licenses.scan(docs).first().detections
    assert [(d.start, -d.end, d.priority, d.label) for d in got] == kept


# 7


def test_chat_tools(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"x","name":"add","arguments":"{\\"a\\":1}","after":["y"]},{"id":"z","name":"add","arguments":"{\\"a\\":-1}"}]}'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"y","name":"add","arguments":"{\\"b\\":[\\"é\\"],\\"a\\":2.0}"}]}'), (1, 3, "tool", '{"tool_call_id":"x","content":"1"}'),
        (1, 4, "tool", '{"tool_call_id":"x","content":"again"}'), (1, 5, "tool", '{"tool_call_id":"w","content":"lost"}'), (None, 6, "user", None), (2, 0, "assistant", "not {json tool_calls"),
        (3, 0, "assistant", '{"tool_calls":[{"id":"p","name":"add","arguments":"oops","after":["q"]},{"id":"q","name":"none","arguments":"{}","after":["p"]}]}'),
    ]
    items = chat_tools.items_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = chat_tools.link(items, schema).collect()
    assert len(found) == 11
    by = {(r.conv_id, r.turn, r.call_id): r for r in found}
    assert by[1, 1, "x"].linked_turn == 3 and by[1, 4, "x"].linked_turn == 1 and by[1, 5, "w"].linked_turn is None
    assert (by[1, 1, "x"].order_turn, by[1, 1, "x"].order_step) == (2, 1) and by[1, 1, "z"].order_turn == 1
    assert [by[1, 1, "x"].valid, by[1, 1, "z"].valid, by[1, 2, "y"].valid, by[3, 0, "p"].valid, by[3, 0, "q"].valid] == [True, False, True, False, False]
    assert by[1, 2, "y"].json == '{"arguments":{"a":2,"b":["é"]},"id":"y","name":"add","type":"call"}'
    assert chat_tools.link(items.limit(0), schema).count() == 0


def chat(spark, calls):
    rows = [(1, t, "call", "assistant", i, "any", a, None, after) for t, i, a, after in calls]
    return spark.createDataFrame(rows, "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, content string, after array<string>")


def test_chat_arguments_that_break_readers(spark):
    deep = "[" * 600 + "]" * 600
    texts = [deep, "{" * 5000, '"\\ud800"', "[" * 90 + "]" * 90, '{"a":1.0}', '{"a":1}', '{"a":1e400}', "1e22", None, "", '{"a":1,"a":2}', "NaN"]
    found = chat_tools.link(chat(spark, [(k, f"c{k}", t, None) for k, t in enumerate(texts)]), {"any": {}}).collect()
    by = {r.call_id: r for r in found}
    assert [by[f"c{k}"].valid for k in range(len(texts))] == [False, False, False, True, True, True, False, True, False, False, False, False]
    assert by["c4"].json.replace("c4", "c5") == by["c5"].json


def test_chat_order_is_topological(spark):
    """Chains, diamonds, cycles and calls behind a cycle, against a plain walk."""
    r = random.Random(2)
    calls = [(k, f"n{k}", "{}", [f"n{j}" for j in r.sample(range(k + 1, 40), min(2, 39 - k))] if k % 3 else None) for k in range(40)]
    calls += [(50, "p", "{}", ["q"]), (51, "q", "{}", ["p", "gone"]), (52, "s", "{}", ["p"]), (53, "self", "{}", ["self", None])]
    found = {x.call_id: (x.order_turn, x.order_step) for x in chat_tools.link(chat(spark, calls), {}).collect()}
    after = {i: [x for x in a or [] if x in found and x != i] for _, i, _, a in calls}
    turn, want = {i: t for t, i, _, _ in calls}, {}
    for k in range(39, -1, -1):
        i = f"n{k}"
        last = max((want[x] for x in after[i]), default=(-1, 0))
        want[i] = (last[0], last[1] + 1) if last >= (turn[i], 0) else (turn[i], 0)
    assert all(found[i] == want[i] for i in want)
    assert [found[i] for i in ("p", "q", "s", "self")] == [(50, 0), (51, 0), (52, 0), (53, 0)]


def test_chat_rounds_grow_with_the_logarithm(spark, monkeypatch, tmp_path):
    """A chain of 2,000 calls, one of 500 diamonds, a cycle of three with a tail of 100, all in one conversation; and nulls."""
    monkeypatch.setattr(chat_tools, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    calls = [(k, f"n{k}", "{}", [f"n{k + 1}"]) for k in range(2000)]
    calls += [(3000 + k, f"d{k}", "{}", [f"d{k + 1}a", f"d{k + 1}b"]) for k in range(500)] + [(4000 + k, f"d{k}{x}", "{}", [f"d{k}"]) for k in range(1, 501) for x in "ab"]
    calls += [(6000 + k, f"c{k}", "{}", [f"c{k + 1}" if k < 102 else "c100"]) for k in range(103)] + [(None, "no turn", "{}", ["n1999"])]
    found = {x.call_id: (x.order_turn, x.order_step) for x in chat_tools.link(chat(spark, calls), {}).collect()}
    assert all(found[f"n{k}"] == (1999, 1999 - k) for k in range(2000)) and found["no turn"] == (None, 0)
    assert found["d0"] == (4500, 999) and found["d499"] == (4500, 1) and found["d250a"] == (4500, 500) and found["d500a"] == found["d500b"] == (4500, 0)
    assert all(found[f"c{k}"] == (6000 + k, 0) for k in range(103))
    assert len(list((tmp_path / "calls").glob("round=*"))) < 15


# 9


def test_topk(spark):
    r = np.random.default_rng(0)
    vecs = [(k, [float(x) for x in r.normal(0, 1, 6)]) for k in range(300)] + [(300 + k, [1.0] * 6) for k in range(50)]
    vecs += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (405, []), (406, [2.0]), (407, [1e9] * 6), (20, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vecs], "vec_id long, embedding array<float>, label int").repartition(4)
    q = topk.quantised(df)
    rows = {(r_.vec_id, tuple(r_.q)) for r_ in q.collect()}
    assert not {400, 401, 402, 403, None} & {i for i, _ in rows}
    found = topk.top_k(q.where("vec_id % 20 = 0 and vec_id <> 20"), q, 20).collect()
    every = [(x.vec_id, x.q) for x in q.collect()]
    for i, v in {x[0]: x[1] for x in every if x[0] % 20 == 0 and x[0] != 20}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in every if j != i)[:20]
        got = sorted((x.rank, x.vec_id, x.score) for x in found if x.query_id == i)
        assert got == [(n + 1, j, -s) for n, (s, j) in enumerate(best)], i
    assert topk.top_k(q.limit(0), q).count() == 0 and topk.top_k(q, q.limit(0)).count() == 0


def test_topk_large_components_and_overflow(spark):
    """Exact where products pass 53 and 63 bits on the way; an error where a score does not fit."""
    vecs = [(0, [4e6, 1.0]), (20, [3e6, 2.0]), (1, [4e6, 0.0]), (2, [3e6, 0.0]), (3, [-4e6, 5.0]), (4, [2.0**29, 1.0]), (5, [2.0**29, -1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    q = topk.quantised(df)
    rows = {i: [int(64 * x) for x in v] for i, v in vecs}
    found = topk.top_k(q.where("vec_id in (0, 20)"), q, 3).collect()
    for i in (0, 20):
        want = sorted((-sum(a * b for a, b in zip(rows[i], v)), j) for j, v in rows.items() if j != i)[:3]
        assert sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == i) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    over = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(topk.quantised(over), topk.quantised(over), 3).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.quantised(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_topk_prunes(spark, monkeypatch):
    """On vectors that lie in clusters by identifier, most groups and blocks are never searched, and nothing is lost."""
    monkeypatch.setattr(topk, "ROUNDS", (1, 2))
    r = np.random.default_rng(3)
    m = np.floor(np.repeat(r.normal(0, 30, (6, 8)), 8000, axis=0) + r.normal(0, 1, (48_000, 8))).astype(np.int64)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(m.tolist())], "vec_id long, q array<long>")
    report = {}
    found = topk.top_k(df.where("vec_id % 300 = 0"), df, 5, report).collect()
    assert report["all"] >= 160 * 6 and report["searched"] < report["all"] / 2
    scores = m[::300] @ m.T
    scores[np.arange(160), np.arange(160) * 300] = topk.NONE + 1
    want = {(300 * i, n + 1, int(j), int(s[j])) for i, s in enumerate(scores) for n, j in enumerate(np.lexsort((np.arange(48_000), -s))[:5])}
    assert {tuple(x) for x in found} == want
    *_, scored = topk.search(np.arange(0, 48_000, 300), m[::300], np.full(160, topk.NONE), np.arange(48_000), m, 5)
    assert scored < 160 * 188 / 2


# 10


def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text_of(t))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOME", 4)
    monkeypatch.setattr(simhash, "VISITORS", 8)
    near = words(1, 1000).split()
    rows = AWKWARD + [(50 + k, " ".join([*near[: k * 9], "new", *near[k * 9 :]])) for k in range(30)]
    found = simhash.near_dedup(table(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    want = [(i, fps[k], least.get(top(k))) for k, (i, _) in enumerate(rows)]
    assert sorted(map(repr, [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in found])) == sorted(map(repr, want))
    assert len({r.component_id for r in found}) < len(rows) - 5
    assert simhash.near_dedup(table(spark, [])).count() == 0


def test_simhash_pieces(monkeypatch):
    t = words(5, 5000)
    whole = simhash.fingerprint(t)
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert simhash.fingerprint(t) == whole == brute_fingerprint(t)


@pytest.mark.parametrize(
    "change",
    [{"pre_tokenizer": {"use_regex": False}}, {"model": {"ignore_merges": True}}, {"model": {"dropout": 0.1}}, {"added_tokens": [{"content": "<a b>"}]}, {"added_tokens": [{"content": "<a>", "lstrip": True}]}, {"normalizer": {"type": "NFC"}}],
)
def test_bpe_refuses_what_it_cannot_split(tmp_path, change):
    import json

    spec = json.load(open(tokens.default_path(), encoding="utf-8"))
    for name, value in change.items():
        if name == "added_tokens":
            spec[name].append({"id": 50257, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} | value[0])
        else:
            spec[name] = (spec.get(name) or {}) | value
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="understood"):
        bpe.Vocabulary(str(tmp_path / "v.json"))
