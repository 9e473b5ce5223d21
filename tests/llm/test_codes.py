"""Vector codes against a plain implementation with Python integers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import codes, queries
from barloom.llm.codes import code_vectors, nearest_entries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    wide = len(kept[0][1]) // parts
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    sums = defaultdict(int)
    for (_, _, label), f in zip(kept, found):
        sums[label] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), sums[label], sha) for (i, _, label), f in zip(kept, found))


def got_of(df):
    return sorted(tuple(r) for r in code_vectors(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def vectors(n, dims, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [float(np.float32(rng.gauss(0, 0.1))) for _ in range(dims)]
        if i % 5 == 0 and rows:
            v = list(rows[rng.randrange(len(rows))][1])  # copies and ties
        if i % 7 == 0:
            v = [float(round(x * 8) / 8) for x in v]
        rows.append((i * 3 - 40, v, None if i % 4 == 0 else i % 3))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("few", [100_000, 1])
@pytest.mark.parametrize("n, dims", [(400, 16), (300, 64), (9, 8)])
def test_codes_like_brute_force(spark, monkeypatch, n, dims, few):
    monkeypatch.setattr(codes, "FEW_LABELS", few)
    rows = vectors(n, dims, n)
    bad = [(10_001, None, 1), (-10_001, [None] + [0.0] * (dims - 1), 1), (10_003, [float("nan")] + [0.0] * (dims - 1), 2), (-9, [float("-inf")] * dims, None), (10_004, [], 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    more = df.withColumns({c: F.lit("clash") for c in ("kind", "codes", "error", "ints", "n")})
    assert got_of(more) == brute(rows)


def test_exponion_search_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(60):
        entries = rng.integers(-6, 6, (rng.integers(1, 17), 3))
        points = rng.integers(-7, 7, (200, 3))
        previous = rng.integers(0, len(entries), 200)
        far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        best, low = nearest_entries(points, entries, previous)
        assert best.tolist() == far.argmin(axis=1).tolist() and low.tolist() == far.min(axis=1).tolist()


def test_search_stays_inside_the_radius(monkeypatch):
    """Points near their previous entry compare few others."""
    entries = np.arange(16)[:, None] * 1000
    points = np.repeat(entries, 50, axis=0) + 1
    asked = []
    order, apart = codes.neighbour_lists(entries)
    assert order[:, 0].tolist() == list(range(16)) and (np.diff(apart, axis=1) >= 0).all()
    monkeypatch.setattr(codes, "neighbour_lists", lambda e: (asked.append(1), (order, apart))[1])
    best, _ = nearest_entries(points, entries, np.repeat(np.arange(16), 50))
    assert best.tolist() == np.repeat(np.arange(16), 50).tolist() and asked == [1]


def test_odd_lengths_huge_components_and_empty_tables(spark):
    rows = [(1, [0.5, 1.0, -2.0], 1), (2, [1e30, 0.0, 0.0], 1), (3, [0.25], 1), (None, [0.5, 1.0, -2.0], None), (1, [0.5, 1.0, -2.0], 1)]
    got = got_of(spark.createDataFrame(rows, SCHEMA).where("vec_id is not null"))
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (2, 0)]
    assert code_vectors(spark.createDataFrame(rows, SCHEMA)).count() == 4
    assert code_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert code_vectors(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_query_over_test_data(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op11_vector_codes(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows)
