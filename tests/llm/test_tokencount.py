from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from barloom.llm.tokencount import Automaton, token_counts

from .cases import SCHEMA, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def tokenizer(vocab, fallback=True):
    return Tokenizer(Unigram(vocab, 0, fallback))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counted(t, text):
    return sum(len(t.encode("▁" + w, add_special_tokens=False).ids) for w in words(text))


def test_like_the_tokenizer(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = tokenizer([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())])
    docs, rows = documents(spark, 60)
    extra = ["<s> </s><unk>x <0x41>", "\U0001f469‍\U0001f680 ", "x" * 3000, " a b", "بسم 世界 ▁▁ a▁b", "\x00\x01 \x7f"]
    rows += [(10_000 + i, x, None, None, 0, None, None) for i, x in enumerate(extra)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {i: (len(words(x)), counted(t, x)) for i, x, *_ in rows}
    got = token_counts(docs, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_tokens) == want[r.doc_id], r.doc_id


def test_ties(spark):
    """Scores of few values, so that many cuts tie."""
    rng = random.Random(4)
    pieces = {"".join(rng.choice("abéc") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"▁", "▁a", "a"}
    vocab = [("<unk>", 0.0)] + [(p, -float(rng.randrange(1, 4) * len(p))) for p in sorted(pieces)]
    t = tokenizer(vocab, False)
    cutter = Automaton(vocab)
    for _ in range(300):
        word = "".join(rng.choice("abéc") for _ in range(rng.randrange(1, 30)))
        data = np.frombuffer(word.encode(), np.uint8)
        ids = t.encode("▁" + word, add_special_tokens=False).ids
        if 0 not in ids:  # without byte pieces unknown runs fuse
            assert cutter.counts(data, np.array([0]), np.array([len(data)]))[0] == len(ids), word


def test_text_without_spaces(spark):
    """Long words of any script, over block and stretch ends, like the library."""
    rng = random.Random(8)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = tokenizer([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())])
    pieces = [model.id_to_piece(i) for i in range(300, 9000)]
    runs = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)) for n in (43, 60, 700, 110_000)]
    runs += ["".join(rng.choice(pieces) for _ in range(n)).replace("▁", "") for n in (40, 90, 3000)]
    runs += ["ab" * 90, "=" * 2000, "é😀" * 200, "日" * 400 + "x" * 129]
    rows = [(i, x) for i, x in enumerate(runs)] + [(50, " ".join(rng.sample(runs, 5))), (None, runs[0])]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    want = {i: counted(t, x) for i, x in rows}
    assert len(got) == len(rows) and all(r.n_tokens == want[r.doc_id] for r in got)


def test_ties_in_long_words():
    rng = random.Random(5)
    pieces = {"".join(rng.choice("abéc") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"▁", "▁a", "a", "b", "c", "é"}
    vocab = [("<unk>", 0.0)] + [(p, -float(rng.randrange(1, 4) * len(p))) for p in sorted(pieces)]
    t, cutter = tokenizer(vocab, False), Automaton(vocab)
    words_ = ["".join(rng.choice("abéc") for _ in range(rng.randrange(120, 900))) for _ in range(40)]
    data = np.frombuffer("".join(words_).encode(), np.uint8)
    lengths = np.array([len(w.encode()) for w in words_])
    want = [len(t.encode("▁" + w, add_special_tokens=False).ids) for w in words_]
    assert cutter.counts(data, np.cumsum(lengths) - lengths, lengths).tolist() == want


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0
