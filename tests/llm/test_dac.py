from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm.dac import Codes, encode, read_tokens, write_tokens

from .cases import SCHEMA, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 7, 512, 5000])
def test_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    ids = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint32)
    codes = Codes(encode(ids))
    assert len(codes) == n and (codes.all() == ids).all()
    for i in rng.integers(0, n, min(n, 300)).tolist():
        assert codes[i] == int(ids[i])
    with pytest.raises(IndexError):
        codes[n]


def test_like_the_tokenizer(spark):
    t = Tokenizer.from_file(PATH)
    docs, rows = documents(spark, 60)
    rng = random.Random(5)
    chars = list("aZé'-<|>9.…–") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'re", "́", "≠", "≠", "ǅ", "İ", "Σς", " ", " ", "\n"]
    extra = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = rows + [(90_000 + i, x, None, None, 0, None, None) for i, x in enumerate(extra)]
    got = read_tokens(write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH)).orderBy("start").collect()
    want, at = [], 0
    for i, text, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_empty_table(spark):
    assert read_tokens(write_tokens(spark.createDataFrame([], SCHEMA), PATH)).count() == 0
