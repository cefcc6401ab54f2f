"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL-proximal updates.

Features of a text are the shares of its words, word pairs, word shapes and shape pairs, each
hashed into one of 2^18 places. A shape is the word with every run of small letters, capitals or
digits written as one sign, so a class of noise is known by its form when its words are new. A word
equal to the one before it has a shape of its own. The score is the logistic function of a sparse
dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import Words, mix64, pieces, window_hashes

BITS = 18
DIM = 1 << BITS
#: Labelled rows that the model is fitted on, at most; those with the smallest hash of doc_id.
SAMPLE_ROWS = 16_384
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
FAMILIES = 4
THRESHOLD = 0.7

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def shape_hashes(w: Words, words: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    kinds = _CLASS[w.data]
    keep = np.ones(len(kinds), dtype=bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[w.start] = True
    place = np.zeros(len(kinds) + 1, dtype=np.int64)
    np.cumsum(keep, out=place[1:])
    out = Words(kinds[keep], w.offsets, place[w.start], place[w.end], w.first).hashes()
    again = np.zeros(len(words), dtype=bool)
    again[1:] = words[1:] == words[:-1]
    again[w.first[:-1][w.counts > 0]] = False
    out[again] = mix64(out[again] + np.uint64(1))
    return out


def feature_places(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: place of each n-gram, and its share of the family in its text (0: crosses texts)."""
    words = w.hashes()
    out = []
    per = np.repeat(1.0 / np.maximum(w.counts, 1), w.counts)
    last = np.zeros(len(words), dtype=bool)
    last[w.first[1:][w.counts > 0] - 1] = True
    for family, h in enumerate((words, shape_hashes(w, words))):
        one = mix64(h + np.uint64(2 * family + 1)) >> np.uint64(64 - BITS)
        out.append((one.astype(np.int64), per))
        two = np.zeros(len(h), dtype=np.int64)
        if len(h) > 1:
            two[:-1] = (mix64(window_hashes(h, 2) + np.uint64(2 * family + 2)) >> np.uint64(64 - BITS)).astype(np.int64)
        out.append((two, np.where(last, 0.0, per)))
    return out


def margins(w: Words, weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(w.first) - 1, bias)
    some = np.flatnonzero(w.counts > 0)
    for place, share in feature_places(w):
        if len(some):  # each text's sum by itself, so that it doesn't depend on the texts around it
            total[some] += np.add.reduceat(weights[place] * share, w.first[some])
    return total


class Ftrl:
    """FTRL-proximal state: one (z, n) for each place, the bias at the end."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(DIM + 1) if z is None else z
        self.n = np.zeros(DIM + 1) if n is None else n

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(sample: DataFrame, epochs: int = EPOCHS) -> Ftrl:
    """Fit on the bounded table (text, quality): one task streams it once an epoch."""
    model = Ftrl()
    for epoch in range(epochs):
        state = (model.z, model.n)

        def learn(batches, state=state):
            m = Ftrl(*(s.copy() for s in state))
            for batch, w in pieces(batches, 0):
                families = feature_places(w)
                for i, y in enumerate(batch.column(1).to_pylist()):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    places = np.concatenate([p[a:b] for p, _ in families])
                    shares = np.concatenate([s[a:b] for _, s in families])
                    at, inverse = np.unique(places, return_inverse=True)
                    x = np.bincount(inverse, weights=shares, minlength=len(at))
                    m.update(np.r_[at, DIM], np.r_[x, 1.0], float(y))
            yield pa.RecordBatch.from_arrays([pa.array([m.z.tobytes()], pa.binary()), pa.array([m.n.tobytes()], pa.binary())], ["z", "n"])

        order = F.xxhash64("doc_id", F.lit(epoch))
        rows = sample.repartition(1).sortWithinPartitions(order, "doc_id").select("text", "quality")
        for z, n in rows.mapInArrow(learn, "z binary, n binary").collect():
            model = Ftrl(np.frombuffer(z), np.frombuffer(n))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, quality) of at most ``rows`` labelled rows outside the held-out quarter."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(d.join(F.broadcast(ids), "doc_id"), "classifier-sample")  # ids: at most ``rows``


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int):
    """A function from words to scores; the weights it broadcasts have a fixed size."""
    model = fit(training_sample(docs, labels, sample_rows, id_col, text_col))
    weights = docs.sparkSession.sparkContext.broadcast(model.weights())

    def scores(words: Words) -> np.ndarray:
        w = weights.value
        return 1.0 / (1.0 + np.exp(-np.clip(margins(words, w, w[DIM]), -35, 35)))

    return scores


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose score is at least THRESHOLD. Rows pass through in one scan, without a join."""
    scores = _scorer(docs, labels, id_col, text_col, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch, words in pieces(batches, at):
            yield batch.filter(pa.array(scores(words) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score is a function of the text alone; null and empty texts get the bias's score. Rows whose
    crc32 of the id leaves 2 modulo 4 are never learnt from; a null id is not held out. Without
    labels all scores are 0.5. Repeated rows get equal scores; an empty table gives an empty result;
    other columns are not read.
    """
    scores = _scorer(docs, labels, id_col, text_col, sample_rows)

    def score(batches):
        for batch, words in pieces(batches, 1):
            s = scores(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
