"""Alignment against a loop over bytes with the libraries' own ids."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lograft.llm import align
from lograft.llm.tokens import byte_chars

from .test_operators import AWKWARD, table, words

MORE = [
    (20, "<|endoftext|> a<|endoftext|>b <s> </s> <0x41>"), (21, "a▁b"), (22, " lead"), (23, "trail "), (24, "two  blanks   three"), (25, "\n"), (26, " "), (27, "naïve ﬁne 你好世界 🙂🙂"), (28, "tab\tand\r\nline\n\n end"),
    (29, "don't we'll I'd"), (30, "\x00nul"), (31, "a ▁ b"), (32, "x\xa0y z"), (33, "don't we'll I'd"), (34, words(9, 3000)),
]


def slowly(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: v for v, c in byte_chars().items()}
    out, count = [], Counter()
    for doc, text in rows:
        whole = b" " + text.encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((doc, 0, 0, [], ""))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, found = 0, []
            for x in parts:
                found.append((at, at + len(x)))
                at += len(x)
            spans.append(found)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        shown, at = [], [0, 0]
        for cut in cuts:
            group = []
            for k, ids in enumerate((ids_a, ids_b)):
                end = at[k]
                while end < len(ids) and spans[k][end][1] <= cut:
                    end += 1
                group.append(",".join(map(str, ids[at[k] : end])))
                at[k] = end
            shown.append("|".join(group))
        pairs, low = [], 0
        for i, (s, e) in zip(ids_a, spans[0]):
            while spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(ids_b) and spans[1][k][0] < e:
                pairs.append((i, ids_b[k]))
                k += 1
        count.update(pairs)
        out.append((doc, len(ids_a), len(ids_b), pairs, ";".join(shown)))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(
        (repr((d, x, y, s.count(";") + 1 if s else 0, len(p), sum(count[q] == best[q[1]] for q in p), sum(count[q] for q in p), hashlib.sha256(s.encode()).hexdigest() if s else "")) for d, x, y, p, s in out)
    )


@pytest.mark.parametrize("chunk", [1, 2000, align.CHUNK_LINKS])
def test_align(spark, chunk):
    rows = AWKWARD + MORE
    found = align.align(table(spark, rows), chunk_links=chunk).collect()
    assert sorted(repr(tuple(x)) for x in found) == slowly(rows)


def test_small_batches(spark, monkeypatch):
    a, b = align.sides(align.default_path(), align.default_pieces())
    texts = [t for _, t in AWKWARD + MORE]
    whole, doc, pairs, times = align.aligned(texts, a, b)
    for k, t in enumerate(texts):
        one, _, p, n = align.aligned([t], a, b)
        assert one[0] == whole[k] and p.tolist() == pairs[doc == k].tolist() and n.tolist() == times[doc == k].tolist()


def test_given_and_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(repr(tuple(x)) for x in align.op11_align(spark, d).collect()) == slowly(rows)
    assert align.align(table(spark, [])).count() == 0
    assert align.align(table(spark, [(1, None), (2, "")])).count() == 2
