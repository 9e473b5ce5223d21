"""Hashes of spans and grams, also on words that cancel out in polynomials."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from barloom.llm import vocabulary
from barloom.llm.rules import NgramModel, quality_rules
from barloom.llm.substring import substring_dedup
from barloom.llm.textkit import gram_hash, slices, span_hash


def opposed(n: int) -> tuple[str, str]:
    """A Thue-Morse word of 2**n letters and its complement."""
    word = "a"
    for _ in range(n):
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


def test_spans_that_differ_hash_apart():
    texts = [*opposed(3), *opposed(5), *opposed(8), *opposed(10), *opposed(11), "a" * 511, "a" * 512, "a" * 513, "a\0", "a", "a\0\0", "\0", "12345678", "123456789"]
    for _, _, part in slices(pa.array(texts)):
        for lane in range(2):
            assert len(set(span_hash(part.data, part.offsets[:-1], part.offsets[1:], lane).tolist())) == len(texts)
        assert not set(part.hashes().tolist()) & set(part.hashes(1).tolist())
    empty = np.zeros(0, np.uint8)
    assert len(span_hash(empty, np.zeros(2, int), np.zeros(2, int))) == 2


def test_grams_depend_on_words_and_order_alone():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 600).astype(np.uint64) * np.uint64(0x1234567890ABCDEF)
    for k in (1, 2, 3, 5, 12, 31, 50):
        got = gram_hash(words, k)
        assert len(got) == 601 - k
        of, back = {}, {}
        for i, h in enumerate(got.tolist()):
            key = tuple(words[i : i + k].tolist())
            assert of.setdefault(key, h) == h and back.setdefault(h, key) == key
    assert len(gram_hash(words[:2], 3)) == 0


def test_windows_of_opposed_words_are_not_alike(spark):
    a, b = opposed(10)
    tail = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{a} {tail[:100]}"), (2, f"{b} {tail[:100]}"), (3, " ".join([a, b] * 32)), (4, " ".join([b, a] * 32)[: 1025 * 61])], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    assert got[2].n_removed == 0 and got[4].n_removed == 61 and got[4].n_words == 61
    alone = spark.createDataFrame([(1, f"{a} " + " ".join(f"w{i}" for i in range(60))), (2, f"{b} " + " ".join(f"v{i}" for i in range(60)))], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(alone).collect()} == {0}


def test_cached_words_are_told_apart():
    import public_tokenizers

    a, b = opposed(10)
    encoder = vocabulary.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    got = [ids.tolist() for _, _, ids, _ in encoder.texts(pa.array([f"{a} x", f"{b} x", a]), None)]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in (f"{a} x", f"{b} x", a)]
    assert sum(got, []) == sum(want, [])
    cache = vocabulary.WordCache(4)
    h, c = np.array([5, 5, 21, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    assert cache.get(h, c, lambda i: i * 10).tolist() == [0, 10, 20, 0]
    assert cache.get(h[1:2], c[1:2], lambda i: i + 7).tolist() in ([10], [7])


def test_repeated_lines_of_opposed_words(spark):
    a, b = opposed(11)
    model = NgramModel(np.zeros((4, 1 << 13), np.float32), 0.0, 0.0)
    docs = spark.createDataFrame([(1, f"{a}\n{b}\n"), (2, f"{a}\n{b}\n{a}")], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality_rules(docs, model).collect()} == {1: 0, 2: 1}
