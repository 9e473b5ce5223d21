"""Crowded keys that are not dense, keys of very many blocks, and ids with several texts."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from barloom.llm import neardup
from barloom.llm.neardup import near_duplicate_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def pairs_on_a_template(n: int, seed: int = 3):
    """Pairs at similarity 0.84 whose texts share half of their words, at fixed
    places, with every other text (similarity about 0.35)."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(130)]
    rows = []
    for i in range(n):
        words = template + [f"w{rng.randrange(10**6)}" for _ in range(110)]
        other = list(words)
        for at in rng.sample(range(140, 230), 4):
            other[at] = f"x{i}-{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    return rows


@pytest.mark.parametrize("block, many", [(32, 64), (32, 2), (4096, 64)])
def test_recall_on_crowded_keys_does_not_depend_on_blocks(spark, monkeypatch, block, many):
    monkeypatch.setattr(neardup, "MANY", many)
    rows = pairs_on_a_template(500)
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(500)) / 500 >= 0.95
    assert all(got[i] in (i, i - 1) for i in got)


def test_an_id_with_several_texts_is_judged_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (7, c), (7, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows] + [(None, a, "en", "s", 1)], SCHEMA)
    kept = sorted((str(r.doc_id), str(r.text)) for r in cp.near_duplicates(spark, docs, "").collect())
    assert kept == sorted([("3", a), ("5", b), ("7", c), ("7", "None"), ("None", a)])
