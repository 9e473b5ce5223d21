"""Quality classifier: random-indexing word vectors, pooled, and a small net.

Every word bucket and every bucket of three bytes has a sparse random index
vector.  A word's context vector is the sum of the index vectors of the two
words on either side over the training texts.  A text is the mean of its words'
context vectors beside the mean of the index vectors of the byte strings that
its words are made of, and how often two of these vectors agree.  Two numpy layers turn that into a logit, which a
temperature fitted on a fold left out of training calibrates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.grams import char_buckets, histogram, owner_of_bytes, word_buckets
from barloom.llm.labelled import adam, labelled_sample, scale_and_shift, sigmoid
from barloom.llm.textkit import Slice, slices

BITS, DIMS = 12, 64
HIDDEN = 24
SLICE = 1 << 20
#: Texts that are worked on at once: each has a row of 2**BITS counts.
TEXTS = 1 << 9


def index_vectors(seed: int, nonzero: int = 8) -> np.ndarray:
    """A sparse vector of +1 and -1 for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << BITS, DIMS), np.float32)
    place = rng.random((1 << BITS, DIMS)).argsort(axis=1)[:, :nonzero]
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], np.float32), place.shape), axis=1)
    return out


@dataclass
class QualityModel:
    contexts: np.ndarray | None
    layers: list[np.ndarray]
    temperature: float
    prior: float

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(pooled), float(sigmoid(np.float64(self.prior))))
        return sigmoid(_forward(self.layers, pooled)[1].astype(np.float64) / self.temperature + self.prior)


def _context_sums(part: Slice, index: np.ndarray) -> np.ndarray:
    bucket = word_buckets(part.hashes(), BITS)
    near = np.zeros((len(bucket), DIMS), np.float32)
    for d in (1, 2):
        same = part.doc[d:] == part.doc[:-d]
        near[d:][same] += index[bucket[:-d][same]]
        near[:-d][same] += index[bucket[d:][same]]
    return np.stack([np.bincount(bucket, near[:, j], minlength=1 << BITS) for j in range(DIMS)], axis=1)


def pooled_vectors(part: Slice, contexts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Mean context vector and mean form vector of each text's words, then how
    often two of its index vectors agree: any two words, any two forms, and
    words side by side; last the log of the number of words."""
    of_word = word_buckets(part.hashes(), BITS)
    words = histogram(part.doc, of_word, part.n, BITS).astype(np.float32)
    owner = owner_of_bytes(part)
    bucket = char_buckets(part.data, 3, BITS)
    inside = owner[: len(bucket)] == owner[2:] if len(bucket) else np.zeros(0, bool)
    forms = histogram(owner[: len(bucket)][inside], bucket[inside], part.n, BITS).astype(np.float32)
    sides = [h @ v / np.maximum(h.sum(axis=1, keepdims=True), 1) for h, v in ((words, contexts), (forms, index))]
    for h in (words, forms):
        n = h.sum(axis=1, dtype=np.float64)
        sides.append(np.sqrt(((h * h).sum(axis=1, dtype=np.float64) - n) / np.maximum(n * (n - 1), 1))[:, None])
    twin = (of_word[1:] == of_word[:-1]) & (part.doc[1:] == part.doc[:-1])
    sides.append(np.sqrt(np.bincount(part.doc[1:][twin], minlength=part.n) / np.maximum(part.counts - 1, 1))[:, None])
    sides.append(np.log1p(part.counts)[:, None])
    return np.concatenate(sides, axis=1).astype(np.float32)


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, scale, w1, b1, w2, b2 = layers
    hidden = np.tanh(((x - mean) * scale) @ w1 + b1)
    return hidden, hidden @ w2 + b2


def train_quality_model(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> QualityModel:
    """Fit on at most ``per_class`` labelled rows of each quality (sampled by
    hash).  Without rows of both qualities every text scores the one there is."""
    sample, totals = labelled_sample(docs, labels, "quality", per_class)
    if not totals.get(0) or not totals.get(1):
        return QualityModel(None, [], 1.0, -9.0 if totals.get(0) else 9.0)
    words, forms = index_vectors(5), index_vectors(6)
    sample = sample.select("doc_id", "text", "y")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS, DIMS))
        for b in batches:
            for _, _, part in slices(b.column(1), SLICE):
                total += _context_sums(part, words)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

    contexts = sum(
        np.frombuffer(r.sums, np.float32).astype(np.float64) for r in sample.mapInArrow(gather, "sums binary").collect()
    ).reshape(1 << BITS, DIMS)
    contexts = (contexts / np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-9)).round(5).astype(np.float32)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part in slices(b.column(1), SLICE, TEXTS):
                rows = [x.tobytes() for x in pooled_vectors(part, contexts, forms)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"]
                )

    rows = sorted(sample.mapInArrow(pool, "doc_id long, y int, x binary").collect())
    x, y = np.stack([np.frombuffer(r.x, np.float32) for r in rows]), np.array([r.y for r in rows])
    fold = np.arange(len(rows)) % 4 == 3
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.zeros(len(rows), bool)
    xt, yt = x[~fold], y[~fold].astype(np.float32)
    w = (0.5 / np.bincount(y[~fold], minlength=2))[y[~fold]].astype(np.float32)
    mean, scale = xt.mean(axis=0), 1 / (xt.std(axis=0) + 1e-4)
    scale[: 2 * DIMS] /= 4  # many weak inputs beside a few strong ones
    rng = np.random.default_rng(7)
    start = [
        (rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1])).astype(np.float32), np.zeros(HIDDEN, np.float32),
        (rng.normal(size=HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), np.float32(0)
    ]

    def grads(p):
        hidden, logit = _forward([mean, scale, *p], xt)
        error = (w * (sigmoid(logit) - yt)).astype(np.float32)
        back = error[:, None] * p[2][None, :] * (1 - hidden * hidden)
        z = (xt - mean) * scale
        return z.T @ back + 1e-3 * p[0], back.sum(axis=0), hidden.T @ error + 1e-3 * p[2], error.sum()

    layers = [mean, scale, *adam(start, grads, 500, 0.01)]
    held = fold if fold.any() else np.ones(len(y), bool)
    logit = _forward(layers, x[held])[1].astype(np.float64)
    balanced = (0.5 / np.maximum(np.bincount(y[held], minlength=2), 1))[y[held]]
    slope, _ = scale_and_shift(logit, y[held], balanced, slope_only=True)
    return QualityModel(contexts, layers, 1 / slope, float(np.log(totals[1] / totals[0])))


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id), ``score`` and ``predicted`` for whole texts,
    in Arrow batches.

    A null or empty text is scored as the zero vector; rows with a null doc_id
    and repeated rows are scored like any other.
    """
    forms, keep = index_vectors(6), keep or ["doc_id"]
    chosen = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = chosen.drop("__text").schema.add("score", "double").add("predicted", "integer")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part in slices(b.column(len(keep)), SLICE, TEXTS):
                pooled = pooled_vectors(part, model.contexts, forms) if model.layers else np.zeros((part.n, 1))
                score = model.probability(pooled)
                columns = [b.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"]
                )

    return chosen.mapInArrow(job, schema)


def held_out(doc_id="doc_id") -> F.Column:
    """True for the third of ids that training leaves out (null: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
