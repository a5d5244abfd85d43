"""Token ids of whole texts by the tokenizers library.

Byte-level BPE never merges across a blank that stands between two other characters, so a text's ids are those of its
blank-separated chunks. A worker keeps the ids of chunks that it has met, which saves most calls of the library; its
memory is bounded, and whatever the rule does not cover goes to the library as a whole text.
"""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks kept per worker, in each of two generations.
KEEP = 200_000
#: Distinct pieces kept by encode_column, in each of two generations.
KEEP_PIECES = 400_000
#: Blanks with no white space on either side.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Bytes that may begin white space other than blanks and line feeds.
OTHER_SPACE = bytes([*range(10), *range(11, 32), 0xC2, 0xE1, 0xE2, 0xE3])
#: Chunks of these characters are split into pretokens here; all others by the library.
PLAIN = re.compile("[\n!-~À-ÖØ-öø-ÿ]*")
#: Punctuation that is one pretoken after a word.
MARKS = """!"#$%&()*+,-./:;<=>?@[]^_`{|}~"""
#: How byte-level BPE splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Kinds of bytes for encode_column: any byte whose meaning is not plain from itself is ODD. Bytes from 0x80 to 0xBF and 0xC3
#: are letters, since what another first byte begins is odd anyway; the two marks among 0xC3's characters are looked for.
BLANK, FEED, LETTER, DIGIT, MARK, ODD = range(6)


def _kind(b: int) -> int:
    c = chr(b)
    if c in " \n":
        return BLANK if c == " " else FEED
    if 0x80 <= b < 0xC0 or b == 0xC3 or (b < 0x80 and c.isalpha()):
        return LETTER
    return DIGIT if c.isascii() and c.isdigit() else MARK if c in MARKS and c != "'" else ODD


KINDS = bytes(map(_kind, range(256)))
#: Bytes that begin no white space: of visible ASCII, and first bytes but 0xC2 and 0xE1 to 0xE3.
FULL = bytes(0x20 < b < 0x7F or (b >= 0xC3 and not 0xE1 <= b <= 0xE3) for b in range(256))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """encode(text): ids as little-endian unsigned 32-bit integers, those of encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self.bytewise = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
        self.bytewise &= all(" " not in t["content"] and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in spec.get("added_tokens", []))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile(SPLIT)
        self.model, self.chars = self.tok.model, str.maketrans({chr(b): c for b, c in byte_chars().items()})
        self.marks: dict[str, bytes] = {}
        self.feed = self._pretoken("\n") if self.bytewise else b""
        self.later: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before
        self.pieces: dict[bytes, bytes] = {}
        self.old_pieces: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pretoken(self, word: str) -> bytes:
        return b"".join([k.id.to_bytes(4, "little") for k in self.model.tokenize(word.encode().decode("latin-1").translate(self.chars))])

    def marked(self, mark: str) -> bytes:
        """ids of punctuation that stands alone."""
        ids = self.marks.get(mark)
        if ids is None:
            ids = self._pretoken(mark) if mark else b""
            if len(mark) < 16:
                self.marks[mark] = ids
        return ids

    def _later(self, word: str) -> bytes:
        """ids of a word after a blank."""
        ids = self.old.get(word)
        if ids is None:
            if not PLAIN.fullmatch(word) or any(t in word for t in self.added):
                ids = self.whole(" " + word)
            elif word.isalpha():
                ids = self._pretoken(" " + word)
            else:
                stem = word.rstrip(MARKS)
                mark = word[len(stem) :]
                if mark and stem.isalpha():  # two pretokens
                    ids = (self.later.get(stem) or self._later(stem)) + self.marked(mark)
                else:
                    line, _, rest = word.partition("\n")
                    stem = rest.rstrip(MARKS)
                    if line and stem.isalpha() and line[-1] in ".!?":  # a line's last word and the next one's first
                        ids = (self.later.get(line) or self._later(line)) + self.feed + self._pretoken(stem) + self.marked(rest[len(stem) :])
                    else:
                        ids = b"".join(map(self._pretoken, self.split.findall(" " + word)))
        if len(word) < 64:
            self.later[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.bytewise:
            return self.whole(text)
        data = text.encode()
        if "  " in text or "\n " in text or " \n" in text or len(data.translate(None, OTHER_SPACE)) != len(data):
            parts = BETWEEN.split(text)
        else:
            parts = text.split(" ")
        if len(self.later) > KEEP:
            self.old, self.later, self.marks = self.later, {}, {}
        head = self.whole(parts[0]) if parts[0] else b""
        rest = parts[1:]
        found = list(map(self.later.get, rest))
        if None in found:
            later = self.later
            for k, ids in enumerate(found):
                if ids is None:
                    w = rest[k]
                    found[k] = later.get(w) or self._later(w)
        return head + b"".join(found)


    def _cut(self, data: bytes, begins):
        """Where pieces of texts begin that stand in data one after the other, and which are pretokens, by kinds of bytes.

        A pretoken begins at every blank with a character behind it that is no white space. From one such blank to the next,
        a piece is a pretoken, or all of it where something in it is odd: white space of other forms, an apostrophe, another
        script, a special token.
        """
        import numpy as np

        raw, kind = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(KINDS)), np.uint8)
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        kind[lead[(raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)]] = ODD
        for t in self.added:
            at = data.find(t.encode())
            while at >= 0:
                kind[at] = ODD
                at = data.find(t.encode(), at + 1)
        n = len(raw)
        start = np.zeros(n + 1, bool)
        start[begins] = True
        first, last = start[:n], start[1:].copy()  # of a text
        last[n - 1] = True
        inner = kind == FEED
        inner &= ~(first | last)
        blanks = np.flatnonzero(kind == BLANK)
        cuts = blanks[~last[blanks]]
        cuts = cuts[np.frombuffer(FULL, bool)[raw[cuts + 1]]]
        start[cuts] = True
        chunks = np.flatnonzero(first)
        # Odd chunks: those with an odd byte or a blank that is no cut.
        kind[blanks] = ODD
        kind[cuts] = BLANK
        odd = np.zeros(len(chunks), bool)
        odd[np.searchsorted(chunks, np.flatnonzero(kind == ODD), "right") - 1] = True
        # Pretokens begin where the kind changes, but behind a blank; the last of several line feeds is one of its own.
        inside = kind[1:] != kind[:-1]
        inside &= kind[:-1] != BLANK
        feeds = np.flatnonzero(inner)
        inside[feeds[(kind[feeds - 1] == FEED) & (kind[feeds + 1] > FEED)] - 1] = True
        odd = np.repeat(odd, np.diff(chunks, append=n))
        inside &= ~odd[1:]
        first[1:] |= inside
        where = np.flatnonzero(first)
        return where, ~odd[where]

    def _found(self, names: list[bytes], plain) -> list[bytes]:
        """ids of each of the pieces."""
        import numpy as np

        found = list(map(self.pieces.get, names))
        missing = [k for k, ids in enumerate(found) if ids is None]
        older = list(map(self.old_pieces.get, map(names.__getitem__, missing)))
        new = [k for k, ids in zip(missing, older) if ids is None and plain[k]]
        text, tokenize = b"".join(map(names.__getitem__, new)).decode("latin-1").translate(self.chars), self.model.tokenize
        ids, ends, end = [], [0], 0
        for k in new:
            begin, end = end, end + len(names[k])
            ids += [x.id for x in tokenize(text[begin:end])]
            ends.append(len(ids))
        ids = np.array(ids, "<u4").tobytes()
        for k, begin, end in zip(new, ends, ends[1:]):
            found[k] = ids[4 * begin : 4 * end]
        for k, old in zip(missing, older):
            if found[k] is None:
                found[k] = self.whole(names[k].decode()) if old is None else old
        self.pieces.update((names[k], found[k]) for k in missing if len(names[k]) < 64)
        return found

    def encode_column(self, texts):
        """ids of all texts (an Arrow array of strings without nulls) one after the other, and how many each text has.

        The texts are cut into pieces in numpy, and the library encodes each different piece once, as long as it is kept.
        """
        import numpy as np
        import pyarrow as pa

        if not self.bytewise:
            found = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        begins = offsets - offsets[0]
        if not begins[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data = texts.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes()
        where, plain = self._cut(data, begins)
        bounds = pa.py_buffer(np.append(where, len(data)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(where), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        at = pieces.indices.to_numpy()
        plain_one = np.zeros(len(pieces.dictionary), bool)
        plain_one[at] = plain
        ends, different = np.frombuffer(pieces.dictionary.buffers()[1], np.int64)[: len(pieces.dictionary) + 1].tolist(), pieces.dictionary.buffers()[2].to_pybytes()
        if len(self.pieces) > KEEP_PIECES:
            self.old_pieces, self.pieces = self.pieces, {}
        names = [different[a:b] for a, b in zip(ends, ends[1:])]
        found = self._found(names, plain_one.tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # Each piece's ids, from where they stand among those of the different pieces.
        n = sizes[at]
        ends = np.append(0, np.cumsum(n))
        ids = np.frombuffer(b"".join(found), "<u4").take(np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1]))
        return ids, np.diff(ends[np.searchsorted(where, begins)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
