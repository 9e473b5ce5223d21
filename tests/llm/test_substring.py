from __future__ import annotations

import re

import pytest

from barloom.llm.substring import _leftmost_min, repeated_spans, substring_dedup

from .cases import SCHEMA, documents


def brute(rows, window):
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    first: dict[tuple, int] = {}
    for i in sorted(docs):
        for p in range(len(docs[i]) - window + 1):
            first.setdefault(tuple(docs[i][p : p + window]), i)
    out = {}
    for i, w in docs.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("window,k", [(50, 12), (20, 5)])
def test_like_brute_force(spark, window, k):
    docs, rows = documents(spark)
    want = brute(rows, window)
    got = substring_dedup(docs, window, k).collect()
    assert len(got) == len(rows) + 1
    assert sum(w[1] for w in want.values()) > 500
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.kept == "a row without an id, with some words"
        else:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id


def test_rows_of_one_id_with_different_texts(spark):
    w = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(w[:60])), (2, " ".join(["x"] + w[:60])), (2, " ".join(["y"] + w[100:190])), (2, " ".join(w[100:190])), (3, " ".join(w[90:200])), (None, " ".join(w))] + [(None, "")] * 3
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 0)] * 3 + [(0, 300, 0), (1, 60, 0), (2, 61, 60), (2, 90, 0), (2, 91, 0), (3, 110, 90)]


def test_repeats_are_maximal(spark):
    w = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(w)), (2, " ".join(["a"] * 7 + w[20:90] + ["b"] + w[200:249] + ["c"] + w[300:]))]
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.stop) for r in got) == [(2, 7, 77), (2, 128, 228)]


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_leftmost_min():
    import numpy as np

    v = np.random.default_rng(0).integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 39):
        assert [int(x) for x in _leftmost_min(v, width)] == [i + int(np.argmin(v[i : i + width])) for i in range(len(v) - width + 1)]
