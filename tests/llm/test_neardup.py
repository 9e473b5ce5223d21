from __future__ import annotations

import random

import corpus_pipeline as cp
from barloom.llm.neardup import near_duplicate_groups


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_edited_copies(spark):
    """One to nine words of 200 changed: similarity 0.95 to 0.6."""
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(0, 800, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        edited = list(words)
        for at in rng.sample(range(10, 190), i // 2 % 9 + 1):
            edited[at] = "changed"
        a, b = grams(" ".join(words)), grams(" ".join(edited))
        rows += [(i, " ".join(words), "en", "s", 1), (i + 1, " ".join(edited).upper(), "en", "s", 1)]
        want[i + 1] = len(a & b) / len(a | b) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(docs).collect()}
    assert all(got[i] in (i, i - 1) for i in want) and len(got) == 800
    near = [got[i] == i - 1 for i in want if want[i]]
    assert sum(near) / len(near) >= 0.97 and len(near) > 100
    assert not any(got[i] == i - 1 for i in want if not want[i])
    assert cp.near_duplicates(spark, docs, "").count() == 800 - sum(near)


def test_a_large_group_of_edited_copies_is_one(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(700):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_crowded_keys_are_dealt_in_blocks(spark):
    """Two dense groups and strangers, with blocks far smaller than a key."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        base = random.Random(i % 2).sample(range(9000), 200) if i < 800 else rng.sample(range(9000), 200)
        words = [f"w{w}" for w in base]
        for at in rng.sample(range(200), 2):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(docs, block=32).collect()}
    assert got == {i: i % 2 if i < 800 else i for i in range(900)}
