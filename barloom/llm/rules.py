"""Quality rules: countable signs of junk, then a calibrated n-gram model.

The model is a logistic regression over hashed words, word pairs, and strings
of three and of five characters (code points); an input is the square root of a
bucket's share of the text's grams of its kind, so that inputs of a kind have
length one and many different grams weigh more than few.  It is trained on a
bounded sample of labelled rows, calibrated (slope and offset) on a fold that
training leaves out, and scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.grams import char_buckets, word_buckets
from barloom.llm.labelled import adam, class_weights, labelled_sample, scale_and_shift, sigmoid
from barloom.llm.textkit import Slice, gram_hash, mix, slices, span_hash

#: Buckets of each kind: words, pairs of words, three and five characters.
BITS = 13
KINDS = 4
RIDGE = 1e-4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    min_words: int = 50
    repeat_percent: int = 50
    min_probability: float = 0.5


@dataclass
class NgramModel:
    """Weights by kind and bucket; ``slope`` and ``offset`` calibrate."""

    weights: np.ndarray
    slope: float
    offset: float


def _grams(part: Slice, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the text and the bucket of each gram."""
    yield part.doc, word_buckets(hashes, BITS)
    pairs = word_buckets(gram_hash(hashes, 2), BITS)
    inside = part.doc[: len(pairs)] == part.doc[1:]
    yield part.doc[: len(pairs)][inside], pairs[inside]
    chars = np.frombuffer(part.data.tobytes().decode().encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(part.n), part.per_text((part.data & 0xC0) != 0x80))
    for n in (3, 5):
        bucket = char_buckets(chars, n, BITS)
        inside = owner[: len(bucket)] == owner[len(owner) - len(bucket) :]
        yield owner[: len(bucket)][inside], bucket[inside]


def inputs(part: Slice, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, inputs (kind and bucket) and values that aren't zero, by text and kind."""
    rows, places, values = [], [], []
    for kind, (doc, bucket) in enumerate(_grams(part, hashes)):
        key, n = np.unique((doc.astype(np.int64) << BITS) + bucket, return_counts=True)
        row = key >> BITS
        rows.append(row)
        places.append((kind << BITS) + (key & (1 << BITS) - 1))
        values.append(np.sqrt(n / np.bincount(doc, minlength=part.n)[row]))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values).astype(np.float32)


def _logits(part: Slice, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    row, place, value = inputs(part, hashes)
    return np.bincount(row, weights.ravel()[place] * value, minlength=part.n)


def train_ngram_model(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most: int = 4096) -> NgramModel:
    """Fit on at most ``per_class`` labelled rows of each quality.

    Of each of these texts the driver gets the ``most`` largest inputs, six bytes
    each, so at most 74 MB; scoring takes all inputs.  Without rows of both
    qualities the model gives 1 to every text if there is no label 0, else 0.
    """
    sample, totals = labelled_sample(docs, labels, "quality", per_class)
    size = KINDS << BITS
    if not totals.get(0) or not totals.get(1):
        return NgramModel(np.zeros((KINDS, 1 << BITS), np.float32), 0.0, -9.0 if totals.get(0) else 9.0)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part in slices(b.column(1)):
                row, place, value = inputs(part, part.hashes())
                order = np.lexsort((place, -value, row))
                place, value = place[order].astype("<u2"), value[order].astype("<f4")
                cut = np.searchsorted(row[order], np.arange(part.n + 1))
                some = [(place[a:z].tobytes(), value[a:z].tobytes()) for a, z in zip(cut[:-1], np.minimum(cut[1:], cut[:-1] + most))]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([p for p, _ in some], pa.binary()),
                        pa.array([v for _, v in some], pa.binary())
                    ],
                    names=["doc_id", "y", "places", "values"],
                )

    rows = sorted(sample.select("doc_id", "text", "y").mapInArrow(job, "doc_id long, y int, places binary, values binary").collect())
    y = np.array([r.y for r in rows])
    texts = [(np.frombuffer(r.places, "<u2"), np.frombuffer(r["values"], "<f4")) for r in rows]
    fold = np.arange(len(rows)) % 4 == 3
    w, b = _fit(texts, y, ~fold, size)
    held = fold if len(set(y[fold])) == 2 else np.ones(len(y), bool)
    logit = np.array([w[place] @ value for place, value in texts]) + b
    slope, offset = scale_and_shift(logit[held], y[held], class_weights(y[held], totals))
    return NgramModel(w.reshape(KINDS, -1).astype(np.float32), slope, float(slope * b + offset))


def _fit(
    texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, use: np.ndarray, size: int, epochs: int = 24, batch: int = 128
) -> tuple[np.ndarray, float]:
    """Weights and offset of a balanced logistic regression on sparse inputs, by
    Adam over small batches (300 at least); the mean of the last third of the steps."""
    rng, use = np.random.default_rng(3), np.flatnonzero(use)
    epochs = max(epochs, -(-300 * batch // len(use)))
    share = (0.5 / np.maximum(np.bincount(y[use], minlength=2), 1))[y] * len(use)
    order = np.concatenate([rng.permutation(use) for _ in range(epochs)])
    batches = iter([order[a : a + batch] for a in range(0, len(order), batch)])
    steps = -(-len(order) // batch)
    mean, at = [np.zeros(size), 0.0], 0

    def grads(p):
        nonlocal at
        some = next(batches)
        place, value = (np.concatenate([texts[i][k] for i in some]) for k in range(2))
        row = np.repeat(np.arange(len(some)), [len(texts[i][0]) for i in some])
        if at >= steps - steps // 3:
            mean[0] += p[0] / (steps // 3)
            mean[1] += p[1] / (steps // 3)
        at += 1
        error = share[some] * (sigmoid(np.bincount(row, p[0][place] * value, minlength=len(some)) + p[1]) - y[some]) / len(some)
        return np.bincount(place, error[row] * value, minlength=size) + RIDGE * p[0], error.sum()

    adam([np.zeros(size), np.float64(0)], grads, steps, 0.03)
    return mean[0], float(mean[1])


def _repeats(part: Slice, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: repeated lines, and words in repeated 3-word windows."""
    starts, ends, doc = part.lines()
    solid = np.searchsorted(part.starts, ends) > np.searchsorted(part.starts, starts)
    starts, ends, doc = starts[solid], ends[solid], doc[solid]
    key = span_hash(part.data, starts, ends) + mix(doc.astype(np.uint64))
    _, seen = np.unique(key, return_index=True)
    lines = np.bincount(doc, minlength=part.n) - np.bincount(doc[seen], minlength=part.n)
    grams = gram_hash(hashes, 3)
    at = np.flatnonzero(part.doc[: len(grams)] == part.doc[2:]) if len(grams) else np.zeros(0, int)
    key = grams[at] + mix(part.doc[at].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    cover = np.zeros(len(hashes), bool)
    for j in range(3):
        cover[at[again] + j] = True
    return lines, np.bincount(part.doc[cover], minlength=part.n)


def quality_rules(docs: DataFrame, model: NgramModel, limits: Limits = Limits()) -> DataFrame:
    """Judge whole texts: the counts of the rules, ``probability`` and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has no words and
    fails the rules; its probability is that of no grams at all.  Rows with a
    null doc_id are judged like others; repeated rows come out repeated.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part in slices(b.column(1)):
                hashes = part.hashes()
                solid = np.zeros(len(part.data) + 1, np.int8)
                np.add.at(solid, part.starts, 1)
                np.add.at(solid, part.ends, -1)
                chars = part.per_text((np.cumsum(solid[:-1], dtype=np.int8) > 0) & ((part.data & 0xC0) != 0x80))
                lines, repeats = _repeats(part, hashes)
                n = part.counts
                failed = (n < limits.min_words) | (100 * repeats > limits.repeat_percent * n)
                probability = sigmoid(model.slope * _logits(part, hashes, model.weights) + model.offset)
                columns = [n, chars, part.per_text(_SYMBOL[part.data]), lines, repeats]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(failed),
                        pa.array(~failed & (probability >= limits.min_probability)), pa.array(probability)
                    ],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(job, schema)
