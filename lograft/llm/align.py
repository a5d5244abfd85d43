"""Alignment of two tokenizers' tokens over a corpus: groups that both cut alike, links of overlapping tokens, best partners.

Tokens of a batch of texts lie on one line of bytes. All of them are sorted by where they start; a group breaks where a start
reaches the greatest end so far (numpy.maximum.accumulate), and inside groups every overlap is a link. Tasks return the
links of a text as counts of id pairs, numbered inside a chunk of texts, and each chunk's pairs once. Pairs are counted over the
corpus, and each chunk gets back the counts of its own pairs only: what is shuffled grows with the pairs of chunks, not with links,
and nothing is broadcast or held that grows with the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, ship, written
from .tokens import BETWEEN, Encoder, byte_chars, default_path

#: Links after which a chunk of texts is closed.
CHUNK_LINKS = 8 << 20
#: Characters of texts that are aligned at once, if they are several.
BATCH_CHARS = 2 << 20
#: Pairs in one row of a chunk's table.
ROW_PAIRS = 1 << 14
#: Chunks of text kept per worker, in each of two generations.
KEEP = 200_000


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Bytewise:
    """A: ids of space+text, special tokens' strings as plain text, and the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        if not self.encoder.bytewise:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.encoder.tok.encode_special_tokens, self.encoder.added = True, []
        back = {c: b for b, c in byte_chars().items()}
        vocabulary = self.encoder.tok.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def encode(self, text: str) -> bytes:
        return self.encoder.encode(" " + text)


class Pieces:
    """B: ids of a text by sentencepiece, and the bytes of each id.

    Where no piece holds a space mark behind another character and texts are not normalised, merges never cross a blank between
    two other characters; then the ids of blank-separated parts are kept between texts.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        byte = lambda k, name: bytes([int(name[3:5], 16)]) if self.model.is_byte(k) else name.replace("▁", " ").encode()
        self.bytes = [byte(k, name) for k, name in enumerate(names)]
        rule, user = spec.normalizer_spec, any(p.type == 4 for p in spec.pieces)
        self.apart = rule.name == "identity" and rule.add_dummy_prefix and not rule.remove_extra_whitespaces and spec.trainer_spec.model_type == 2 and not user
        self.apart &= not any("▁" in name.lstrip("▁") for name in names)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text), "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self._ids(part)
        if len(part) < 64:
            self.new[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.apart:
            return self._ids(text)
        if len(self.new) > KEEP:
            self.old, self.new = self.new, {}
        parts = BETWEEN.split(text)
        found = list(map(self.new.get, parts))
        if None in found:
            found = [ids if ids is not None else self.new.get(part) or self._part(part) for ids, part in zip(found, parts, strict=True)]
        return b"".join(found)


class Side:
    """A tokenizer with what alignment looks up by id."""

    def __init__(self, encoder):
        self.encode, self.bytes = encoder.encode, encoder.bytes
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        #: Each id with what may follow it: nothing, a comma, a bar, a semicolon.
        self.shown = [b"%d%s" % (k, mark) for k in range(len(self.bytes)) for mark in (b"", b",", b"|", b";")]

    def ids(self, text: str, whole: bytes) -> np.ndarray | None:
        """ids of a text, None unless their bytes are those of whole."""
        ids = np.frombuffer(self.encode(text), "<u4")
        return ids if b"".join(map(self.bytes.__getitem__, ids.tolist())) == whole else None


_SIDES: dict[tuple[str, str], Side] = {}


def sides(a: str, b: str) -> tuple[Side, Side]:
    """Both tokenizers, kept between a worker's tasks."""
    for kind, path in ((Bytewise, a), (Pieces, b)):
        if (kind.__name__, path) not in _SIDES:
            _SIDES[kind.__name__, path] = Side(kind(path))
    return _SIDES["Bytewise", a], _SIDES["Pieces", b]


def groups(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token; the tokens of either side tile one line."""
    n = len(length_a)
    ends = np.concatenate([np.cumsum(length_a), np.cumsum(length_b)])
    starts = ends - np.concatenate([length_a, length_b])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.empty(len(order), np.int64)
    fresh[:1] = 0
    fresh[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh)
    return group[:n], group[n:]


def links(length_a: np.ndarray, length_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token that overlap, in order: products inside groups of one token on a side, the others by places."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    first_of = np.searchsorted(group_b, group_a, "left")
    last_of = np.searchsorted(group_b, group_a, "right")
    several = (np.bincount(group_a)[group_a] > 1) & (last_of - first_of > 1)
    at = np.flatnonzero(several)
    first_of[at] = np.searchsorted(end_b, (end_a - length_a)[at], "right")
    last_of[at] = np.searchsorted(end_b - length_b, end_a[at], "left")
    times = last_of - first_of
    a = np.repeat(np.arange(len(length_a)), times)
    ramp = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    return a, np.repeat(first_of, times) + ramp


def shown(a: Side, b: Side, ids_a, ids_b, group_a, group_b, docs_a: np.ndarray, n_docs: int) -> list[bytes]:
    """For each text its groups as a1,a2|b1;a3|b2,b3, from the tokens in the order group, side, place."""
    n = len(ids_a)
    group = np.concatenate([group_a, group_b])
    order = np.lexsort((np.repeat([0, 1], [n, len(ids_b)]), group))
    group, is_a = group[order], order < n
    mark = np.zeros(len(order), np.int64)
    if len(order):
        alike = group[1:] == group[:-1]
        mark[:-1] = np.where(alike, np.where(is_a[1:] == is_a[:-1], 1, 2), 3)
    # The text of a group is that of its A tokens; a text's last token has no mark.
    doc_of_group = np.empty(int(group_a[-1]) + 1 if n else 0, np.int64)
    doc_of_group[group_a] = docs_a
    doc = doc_of_group[group]
    mark[np.flatnonzero(doc[1:] != doc[:-1])] = 0
    code = 4 * np.concatenate([ids_a, ids_b]).astype(np.int64)[order] + mark
    words = np.empty(len(order), object)
    for side, mine in ((a, is_a), (b, ~is_a)):
        words[mine] = list(map(side.shown.__getitem__, code[mine].tolist()))
    cuts = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
    words = words.tolist()
    return [b"".join(words[i:j]) for i, j in zip(cuts, cuts[1:])]


def aligned(texts: list[str | None], a: Side, b: Side) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    """A batch of texts: for each its sizes and groups_sha256; then, sorted by text and pair, the text, the pair (A id << 32 | B id) and its number of links."""
    found, size = [], []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        ids_a = a.ids(text, whole) if text else None
        ids_b = b.ids(text, whole) if ids_a is not None else None
        found.append((ids_a, ids_b) if ids_b is not None else (np.zeros(0, "<u4"),) * 2)
    size = np.array([[len(x), len(y)] for x, y in found], np.int64).reshape(-1, 2)
    ids_a, ids_b = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
    docs_a = np.repeat(np.arange(len(found)), size[:, 0])
    length_a, length_b = a.length[ids_a], b.length[ids_b]
    group_a, group_b = groups(length_a, length_b)
    one, other = links(length_a, length_b, group_a, group_b)
    texts_shown = shown(a, b, ids_a, ids_b, group_a, group_b, docs_a, len(found))
    doc = docs_a[one]
    n_links = np.bincount(doc, minlength=len(found))
    n_groups = np.bincount(docs_a[np.flatnonzero(np.diff(group_a, prepend=-1))], minlength=len(found)) if len(group_a) else np.zeros(len(found), np.int64)
    pairs, local = np.unique(ids_a[one] << 32 | ids_b[other], return_inverse=True)
    both, times = np.unique(doc * max(len(pairs), 1) + local, return_counts=True)
    rows = [
        {"n_a": int(n[0]), "n_b": int(n[1]), "n_groups": int(g), "n_links": int(k), "groups_sha256": hashlib.sha256(s).hexdigest() if n[0] else ""}
        for n, g, k, s in zip(size, n_groups, n_links, texts_shown, strict=True)
    ]
    return rows, both // max(len(pairs), 1), pairs[both % max(len(pairs), 1)] if len(pairs) else pairs, times


CHUNKS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair_at binary, times binary, first long, a array<long>, b array<long>, n array<long>"
SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("pair_at", pa.binary()), ("times", pa.binary()), ("first", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("a", "b", "n")]
)
NAMES = SCHEMA.names
#: A text's columns besides its id.
SIZES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _chunks(path_a: str, path_b: str, chunk_links: int):
    def run(batches):
        a, b = sides(path_a, path_b)
        part, nth = TaskContext.get().partitionId(), 0
        rows: list[dict] = []  # of the open chunk
        held: list[tuple[np.ndarray, np.ndarray]] = []  # for each of its texts: pairs, times
        links = 0

        def close():
            nonlocal rows, held, links, nth
            chunk = part << 32 | nth
            nth += 1
            pairs, local = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            counts = np.bincount(local, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)
            at = 0
            for row, (mine, times) in zip(rows, held, strict=True):
                row |= {"chunk": chunk, "pair_at": local[at : at + len(mine)].astype("<u4").tobytes(), "times": times.astype("<u4").tobytes()}
                at += len(mine)
            for k in range(0, len(pairs), ROW_PAIRS):
                some = pairs[k : k + ROW_PAIRS]
                rows.append(dict.fromkeys(NAMES) | {"chunk": chunk, "first": k, "a": some >> 32, "b": some & 0xFFFFFFFF, "n": counts[k : k + ROW_PAIRS]})
            table = pa.Table.from_pylist([dict.fromkeys(NAMES) | r for r in rows], SCHEMA)
            rows, held, links = [], [], 0
            return table.to_batches(1 << 12)

        def take(ids, texts):
            nonlocal links
            found, doc, pairs, times = aligned(texts, a, b)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            for k, row in enumerate(found):
                rows.append({"doc_id": ids[k]} | row)
                held.append((pairs[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]]))
                links += row["n_links"]

        for batch in batches:
            ids, texts, chars = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if texts and chars + len(text or "") > BATCH_CHARS:
                    take(ids, texts)
                    ids, texts, chars = [], [], 0
                ids.append(doc), texts.append(text)
                chars += len(text or "")
            if texts:
                take(ids, texts)
            if links >= chunk_links:
                yield from close()
        if rows:
            yield from close()

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A chunk's texts with the counts of its pairs."""
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    place = pairs["at"].to_numpy()
    count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    n_best, total = [], []
    for at, times in zip(docs["pair_at"], docs["times"], strict=True):
        at, times = (np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in (at, times))
        n_best.append(int(best[at] @ times))
        total.append(int(count[at] @ times))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, a: str | None = None, b: str | None = None, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """One row per row of docs (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, for space+text by a byte-level vocabulary a and pieces b.

    A pair's count is the number of links in all docs; n_best counts the links whose pair has its B id's highest, ties included. Texts that are
    null, empty or not given back by both tokenizers have no tokens: zeros and an empty groups_sha256. Rows with one doc_id or a null one
    are texts of their own; other columns are not looked at; an empty table gives no rows. A text of any length is aligned whole, in memory
    that grows with it; other texts share a worker's memory in batches.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = written(rows.mapInArrow(_chunks(a or default_path(), b or default_pieces(), chunk_links), CHUNKS), "chunks")
    pairs = chunks.where("first is not null").select("chunk", "first", F.posexplode(F.arrays_zip("a", "b", "n")).alias("k", "p"))
    pairs = pairs.select("chunk", (F.col("first") + F.col("k")).alias("at"), "p.a", "p.b", "p.n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = counts.select("a", "b", "count", (F.col("count") == F.max("count").over(Window.partitionBy("b"))).cast("long").alias("best"))
    known = pairs.drop("n").join(counts, ["a", "b"]).select("chunk", "at", "count", "best")
    texts = chunks.where("first is null").select(F.col("chunk").alias("of"), "doc_id", *SIZES, "pair_at", "times")
    return texts.groupBy("of").cogroup(known.groupBy("chunk")).applyInArrow(_summed, RESULT)


def op11_align(spark, sf_dir: str) -> DataFrame:
    return align(load(spark, sf_dir, "documents"))
