from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import classifier
from barloom.llm.classifier import held_out, score_quality, train_quality_model
from barloom.llm.labelled import scale_and_shift, sigmoid
from barloom.llm.grams import char_buckets
from barloom.llm.rules import BITS, KINDS, _logits, quality_rules, train_ngram_model
from barloom.llm.textkit import gram_hash, slices

from .cases import SCHEMA, documents
from .cases import texts as texts_of


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    cover = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(3)}
    n, r = len(words), len(cover)
    return n, sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), dup, r, n < 50 or 100 * r > 50 * n


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(60, 150))]
        bad = i % 4 == 0
        if bad:
            words = [w + rng.choice(["###", "$$$", "!!"]) for w in words]
        rows.append((i, " ".join(words), 0 if bad else 1))
    docs = spark.createDataFrame([(i, t, None, None, 0, None, None) for i, t, _ in rows], SCHEMA)
    return docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int"), {i: y for i, _, y in rows}


def test_base_counts_like_brute_force(spark):
    docs, rows = documents(spark)
    some, labels, _ = labelled(spark, 80)
    got = quality_rules(docs, train_ngram_model(some, labels, 30)).collect()
    want = {i: base(t) for i, t, *_ in rows}
    assert len(got) == len(rows) + 1
    for r in got:
        assert 0 <= r.probability <= 1 and not (r.kept and r.base_failed)
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id], r.doc_id


def test_logits_like_a_dictionary_count():
    """Words, pairs, three and five characters: roots of shares, by text."""
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(KINDS, 1 << BITS))
    texts = [t for t in texts_of(60) if t is None or len(t) < 3000] + ["日本語のテキスト 日本", "é", ""]
    for _, _, part in slices(pa.array(texts, pa.string())):
        hashes = part.hashes()
        got = _logits(part, hashes, weights)
        of_word = {}
        for i, (a, z) in enumerate(zip(part.starts, part.ends)):
            of_word[part.data[a:z].tobytes().decode()] = hashes[i]
        for i, text in enumerate(texts):
            w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            chars = np.array([ord(c) for c in text or ""], np.uint32)
            bags = [[int(of_word[x] >> np.uint64(64 - BITS)) for x in w], (gram_hash(np.array([of_word[x] for x in w], np.uint64), 2) >> np.uint64(64 - BITS)).tolist()]
            bags += [[int(char_buckets(chars[j : j + n], n, BITS)[0]) for j in range(len(chars) - n + 1)] for n in (3, 5)]
            want = sum(weights[k][x] * np.sqrt(bag.count(x) / len(bag)) for k, bag in enumerate(bags) for x in set(bag))
            assert got[i] == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_context_sums_and_pools_like_loops():
    """The classifier's word vectors and pooled inputs against plain loops."""
    index, forms = classifier.index_vectors(5), classifier.index_vectors(6)
    texts = ["a b c a é", "b", "", "日本 語 語 語 a b"]
    for _, _, part in slices(pa.array(texts)):
        bucket = (part.hashes() >> np.uint64(64 - classifier.BITS)).astype(int)
        want, at = np.zeros_like(index), 0
        want = want.astype(float)
        docs = []
        for text in texts:
            n = len(text.split())
            docs.append(bucket[at : at + n].tolist())
            at += n
        for doc in docs:
            for i, x in enumerate(doc):
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(doc):
                        want[x] += index[doc[j]]
        assert np.allclose(classifier._context_sums(part, index), want)
        got = classifier.pooled_vectors(part, want.astype(np.float32), forms)
        for i, (text, doc) in enumerate(zip(texts, docs)):
            data = np.frombuffer(text.encode(), np.uint8)
            grams = [int(char_buckets(data[j : j + 3], 3, classifier.BITS)[0]) for j in range(len(data) - 2)]
            mean = want[doc].mean(axis=0) if doc else np.zeros(classifier.DIMS)
            form = forms[grams].mean(axis=0) if grams else np.zeros(classifier.DIMS)
            assert np.allclose(got[i, : 2 * classifier.DIMS], np.concatenate([mean, form]), atol=1e-5)
            agree = [np.sqrt(np.mean([x == y for i, x in enumerate(b) for j, y in enumerate(b) if i != j])) if len(b) > 1 else 0 for b in (doc, grams)]
            twin = np.sqrt(np.mean([x == y for x, y in zip(doc, doc[1:])])) if len(doc) > 1 else 0
            assert np.allclose(got[i, 2 * classifier.DIMS :], [*agree, twin, np.log1p(len(doc))], atol=1e-5)


def test_model_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    model = train_ngram_model(docs.where("doc_id < 200"), labels, 100)
    got = [r for r in quality_rules(docs, model).collect() if r.doc_id >= 200]
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in got]) > 0.97


def test_classifier_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    model = train_quality_model(docs, labels.where(~held_out()), 100)
    got = score_quality(docs, model).join(labels.select("doc_id"), "doc_id").withColumn("out", held_out()).where("out").collect()
    assert len(got) > 90 and np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95


def test_one_class_or_none(spark):
    docs, labels, _ = labelled(spark, 20)
    for rows, want in ((labels.where("quality = 1"), 1), (labels.where("quality = 0"), 0), (labels.where("false"), 1)):
        assert {r.predicted for r in score_quality(docs, train_quality_model(docs, rows)).collect()} == {want}
    none = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.kept for r in quality_rules(docs, train_ngram_model(docs, none)).collect()} <= {True, False}


def test_awkward_texts_get_a_score(spark):
    docs, rows = documents(spark, 40)
    some, labels, _ = labelled(spark, 80)
    got = score_quality(docs, train_quality_model(some, labels, 30)).collect()
    assert len(got) == len(rows) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some, labels, _ = labelled(spark, 40)
    assert quality_rules(empty, train_ngram_model(some, labels, 10)).count() == 0
    assert score_quality(empty, train_quality_model(some, labels, 10)).count() == 0


def test_calibration():
    rng = np.random.default_rng(0)
    logit = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < sigmoid(0.5 * logit - 1)).astype(int)
    a, b = scale_and_shift(logit, y, np.ones(4000))
    assert a == pytest.approx(0.5, abs=0.08) and b == pytest.approx(-1, abs=0.12)
