"""Byte-level BPE encoding and decoding by an index of pair occurrences.

All pretokens of a partition's batch that have not been met before are merged together. An index maps each pair of
neighbouring symbols, by the rank of its merge, to all its positions in the batch. Active ranks are applied in ascending
order, each to all its positions at once in numpy; only the pairs beside a merge change, and their new positions join the
lists of their ranks. A merge can only make pairs of higher rank, as a symbol is made before it is used, so one
ascending pass over the ranks is enough.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, ship, whole_text
from .tokens import BETWEEN, OTHER_SPACE, PLAIN, SPLIT, byte_chars, default_path

#: Chunks kept per worker, in each of two generations; bytes of text handled at once.
KEEP, BATCH = 150_000, 8 << 20


class Vocabulary:
    """A byte-level vocabulary with ranked merges, from a tokenizers file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE vocabularies are understood")
        model, added = spec["model"], spec.get("added_tokens", [])
        if not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("vocabularies without the usual split, or whose merges are skipped or left to chance, are not understood")
        if any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("added tokens that hold or take white space, or that are whole words only, are not understood")
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.left, self.right, self.made = pairs.T.copy()
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        chars = byte_chars()
        self.first = np.array([vocab.get(chars[b], -1) for b in range(256)], np.int32)
        of_char = {c: b for b, c in chars.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        table = {i: bytes(of_char[c] for c in t) for t, i in vocab.items() if t not in self.special and all(c in of_char for c in t)}
        table |= {i: t.encode() for t, i in self.special.items()}
        self.lengths = np.zeros(max(table) + 1, np.int64)
        for i, t in table.items():
            self.lengths[i] = len(t)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table.get(i, b"") for i in range(max(table) + 1)), np.uint8)
        self.split = regex.compile(SPLIT)
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.back = str.maketrans({c: chr(b) for b, c in chars.items()})
        self.later: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 without one."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """ids of each word, as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(w) for w in words], np.int64)
        n = int(sizes.sum())
        if not n:
            return [b""] * len(words)
        tok = self.first[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        if (tok < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        ends = np.cumsum(sizes)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends[sizes > 0] - 1] = -1
        prv[(ends - sizes)[sizes > 0]] = -1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that begin at these positions into the index."""
            rank = self.ranks(tok[at], tok[nxt[at]])
            some = rank >= 0
            at, rank = at[some], rank[some]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, a, b in zip(rank[np.append(0, cut)].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            left, right = self.left[r], self.right[r]
            after = nxt[at]
            at = at[(tok[at] == left) & (after >= 0) & (tok[after] == right)]
            if left == right and len(at) > 1:
                at = np.sort(at)
                # In a run of overlapping pairs every second one counts, from the first.
                follows = np.append(False, nxt[at[:-1]] == at[1:])
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            beyond = nxt[gone]
            tok[at], tok[gone] = self.made[r], -1
            nxt[at] = beyond
            inner = beyond >= 0
            prv[beyond[inner]] = at[inner]
            before = prv[at]
            enter(np.unique(np.concatenate([at[inner], before[before >= 0]])))
        alive = tok >= 0
        ids = tok[alive].astype("<u4").tobytes()
        upto = np.append(0, np.cumsum(alive))
        bounds = (4 * upto[np.append(0, ends)]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after the other."""
        n = self.lengths[ids]
        upto = np.cumsum(n)
        return self.bytes[np.repeat(self.begins[ids] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]

    def pretokens(self, chunk: str) -> list[bytes]:
        if PLAIN.fullmatch(chunk, 1) or PLAIN.fullmatch(chunk):
            return [w.encode() for w in self.split.findall(chunk)]
        return [w.translate(self.back).encode("latin-1") for w, _ in self.pre.pre_tokenize_str(chunk)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text, the merges of all new chunks done together."""
        if len(self.later) > KEEP:
            self.old, self.later = self.later, {}
        later, old = self.later, self.old
        parts, new, own = [], {}, {}
        for text in texts:
            data = text.encode()
            if "  " in text or "\n " in text or " \n" in text or len(data.translate(None, OTHER_SPACE)) != len(data):
                chunks = BETWEEN.split(text)
            else:
                chunks = text.split(" ")
            for w in chunks[1:]:
                if w not in later and w not in new:
                    if w in old:
                        later[w] = old[w]
                    else:
                        new[w] = None
            own.setdefault(chunks[0], None)
            parts.append(chunks)
        pieces: dict[bytes, bytes | None] = {}
        split = {}
        for kind, words, lead in ((0, new, " "), (1, own, "")):
            for w in words:
                got = []
                for k, s in enumerate(self.special_split.split(lead + w) if self.special_split else [lead + w]):
                    if k % 2:
                        got.append((None, s))
                    elif s:
                        for p in self.pretokens(s):
                            pieces.setdefault(p, None)
                            got.append((p, None))
                split[kind, w] = got
        for p, ids in zip(pieces, self.merge(list(pieces)), strict=True):
            pieces[p] = ids
        for (kind, w), got in split.items():
            ids = b"".join(pieces[p] if p is not None else self.special[s].to_bytes(4, "little") for p, s in got)
            (own if kind else new)[w] = ids
        for w, ids in new.items():
            if len(w) < 64:
                later[w] = ids
        out = []
        for chunks in parts:
            found = list(map(later.get, chunks[1:]))
            if None in found:
                found = [new[w] if ids is None else ids for w, ids in zip(chunks[1:], found, strict=True)]
            out.append(own[chunks[0]] + b"".join(found))
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _coded(path: str, keep_ids: bool):
    def run(batches):
        vocab = vocabulary(path)

        def rows(docs, texts):
            n_tokens, ids_sha, text_sha, kept = [], [], [], []
            for ids in vocab.encode(texts):
                back = vocab.decode(np.frombuffer(ids, "<u4")).tobytes().decode("utf-8", "replace").encode()
                n_tokens.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                if keep_ids:
                    kept.append((np.frombuffer(ids, "<u4").astype(np.int64), back.decode()))
            cols = [pa.array(docs, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([k[0] for k in kept], pa.list_(pa.int64())), pa.array([k[1] for k in kept])]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(cols, names)

        docs, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                texts.append(text)
                held += len(text)
                if held > BATCH:
                    yield rows(docs, texts)
                    docs, texts, held = [], [], 0
        if docs:
            yield rows(docs, texts)

    return run


def code(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids and decoded.

    The ids are those of the tokenizers library without added special tokens; the decoded text is its decoding with special
    tokens kept. Null texts count as empty: no ids. Each row is coded alone, repeated ones too; other columns are not
    looked at; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(_coded(tokenizer or default_path(), keep_ids), schema)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return code(load(spark, sf_dir, "documents"))
