from __future__ import annotations

import re

import numpy as np
import xxhash

from barloom.llm import simhash
from barloom.llm.simhash import simhash_groups

from .cases import SCHEMA, documents


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(marks):
    low = dict.fromkeys(marks)
    low = {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for i in marks:
            m = min(low[j] for j in marks if (marks[i] ^ marks[j]).bit_count() <= 3)
            if m < low[i]:
                low[i], changed = m, True
    return low


def check(got, rows):
    marks = {i: fingerprint(t) for i, t, *_ in rows}
    low = groups(marks)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (int(r.fingerprint, 16), r.component_id) == (marks[r.doc_id], low[r.doc_id])


def test_like_brute_force(spark):
    docs, rows = documents(spark)
    got = simhash_groups(docs).collect()
    assert len(got) == len(rows) + 1
    check(got, rows)


def test_dense_keys_take_all_levels(spark):
    """One dense ball of fingerprints: finer views find the same groups."""
    rng = np.random.default_rng(3)
    bits = np.zeros(400, np.uint64)
    for i in range(400):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            bits[i] ^= np.uint64(1) << np.uint64(b)
    marks = {i: int(x) for i, x in enumerate(bits)}
    low = groups(marks)
    frame = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in marks.items()], "doc_id long, bits long")
    real, simhash.fingerprints = simhash.fingerprints, lambda docs, shingle: docs
    try:
        got = simhash_groups(frame, most_in_key=8).collect()
    finally:
        simhash.fingerprints = real
    assert {r.doc_id: r.component_id for r in got} == low


def test_views_cover_any_three_bits():
    rng = np.random.default_rng(1)
    for blocks in simhash.LEVELS:
        masks = simhash._masks(blocks, 3)
        for _ in range(200):
            flips = np.uint64(0)
            for b in rng.choice(64, 3, replace=False):
                flips |= np.uint64(1) << np.uint64(b)
            assert ((masks & flips) == 0).any()


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0
