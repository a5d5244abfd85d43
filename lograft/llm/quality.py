"""Quality scores by Bradley-Terry pairwise ranking.

Each document has features of its whole text. A preference pair is a document labelled 1 over one labelled 0; the score
w.f is learned by logistic loss on feature differences, and the threshold is a quantile of the training scores. The fit uses
a bounded sample of the labelled rows; scoring uses every document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, ship, whole_text

#: Labelled rows that are fitted at most, taken in the order of a hash of their doc_id; preference pairs per label-0 row.
MAX_LABELS, PAIRS = 20_000, 16
#: The score that the threshold maps to.
CUT = 0.3
#: Bytes of a text whose words are held at once; the features are the same for any number.
PIECE = 1 << 20
#: Bytes counted together.
KINDS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "stop": b".,;:?'\"()-", "bang": b"!",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "high": bytes(range(128, 256)), "control": bytes([*range(9), *range(14, 32), 127]), "line": b"\n",
}
GROUP = np.zeros((256, len(KINDS)))
for _k, _bytes in enumerate(KINDS.values()):
    GROUP[list(_bytes), _k] = 1
NAMES = [*KINDS, "length", "word_length", "distinct", "repeats", "short", "bare_symbols", "capitals", "line_repeats", "long"]
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words without any letter or digit.
BARE = re.compile(rb"(?<![^\x20\x09-\x0D])[!-/:-@\[-`{-~]+(?![^\x20\x09-\x0D])")


def features(text: str) -> np.ndarray:
    """Shares of kinds of bytes, words and lines of the whole text; all 0 without text."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(len(NAMES))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ GROUP / len(data)
    n = repeats = short = bare = capitals = long = size = at = 0
    seen, last = set(), None
    while at < len(data):
        cut = SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = cut.start() if cut else len(data)
        piece = data[at:end]
        words = piece.split()
        at = end
        if not words:
            continue
        n += len(words)
        seen.update(words)
        repeats += sum(map(bytes.__eq__, words, words[1:])) + (words[0] == last)
        last = words[-1]
        lengths = list(map(len, words))
        size += sum(lengths)
        short += sum(map((4).__gt__, lengths))
        long += sum(map((25).__lt__, lengths))
        bare += len(BARE.findall(piece))
        capitals += sum(map(bytes.isupper, words))
    lines = data.split(b"\n")
    w = max(n, 1)
    # The share of distinct words falls with the length of good texts too; against its usual course.
    usual = len(seen) / w**0.8
    rest = [np.log1p(n), size / w / 10, usual, repeats / w, short / w, bare / w, capitals / w, 1 - len(set(lines)) / len(lines), long / w]
    return np.concatenate([counts, rest])


def _features(batches):
    for batch in batches:
        found = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(NAMES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "f"])


class Model:
    """Mean, spread and weights of the features, and the threshold on the score."""

    def __init__(self, mean, spread, weights, threshold):
        self.mean, self.spread, self.weights, self.threshold = mean, spread, weights, threshold

    def raw(self, f: np.ndarray) -> np.ndarray:
        return np.clip((f - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(f) - self.threshold + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(f: np.ndarray, quality: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> Model:
    """Newton's method on the pairs; the threshold is the quantile of the scores with the fewest errors, mid-gap."""
    width = f.shape[1] if f.ndim == 2 else len(NAMES)
    good, bad = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), -1.0)
    mean, spread = f.mean(axis=0), f.std(axis=0) + 1e-9
    z = np.clip((f - mean) / spread, -8, 8)
    pick = np.random.default_rng(0)
    j = np.repeat(bad, PAIRS)
    d = z[pick.choice(good, len(j))] - z[j]
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        slope = d.T @ p / len(d) - penalty * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + (penalty + 1e-6) * np.eye(width)
        move = np.linalg.solve(curve, slope)
        w = w + move * min(1.0, 4 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    wrong = np.append(0, np.cumsum(np.where(quality[order] == 1, 1, -1))) + (quality == 0).sum()  # rows below the cut count as 0
    at = np.flatnonzero(wrong == wrong.min())
    at = int(at[len(at) // 2])
    ordered = s[order]
    cut = ordered[0] - 1 if at == 0 else ordered[-1] + 1 if at == len(s) else (ordered[at - 1] + ordered[at]) / 2
    return Model(mean, spread, w, cut)


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """A model from the labelled rows whose fold (crc32 of doc_id mod 5) is not 0; rows with contradicting labels are left out."""
    ship(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    sample = known.where("quality = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).select("doc_id", "quality")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # At most max_labels rows of two numbers, so this side may be broadcast.
    texts = texts.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(_features, "doc_id long, f array<double>").join(sample, "doc_id").orderBy("doc_id").collect()
    return fit(np.array([r["f"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["quality"] for r in rows]))


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _scores(model: Model, names: list[str], text: int):
    def run(batches):
        for batch in batches:
            f = np.array([features(t.as_py() or "") for t in batch.column(text)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(model.score(f)), *(batch[c] for c in names)], ["score", *names])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs with score (0 to 1) and predicted (1 if score >= 0.3).

    Null texts count as empty, which have a score too. Every row is scored alone, from its whole text however long, of
    which only the distinct words and one piece's words are held. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "score double" + "".join(f", `{c}` {fields[c]}" for c in keep)
    sent = list(dict.fromkeys([*keep, "text"]))  # the text goes once, as text or as a column to keep
    found = docs.select(*sent).mapInArrow(_scores(model, list(keep), sent.index("text")), schema)
    return found.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = score(docs, train(docs, load(spark, sf_dir, "labels")))
    return found.select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(1)) == 0).alias("held_out"), "score", "predicted")
