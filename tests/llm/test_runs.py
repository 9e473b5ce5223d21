"""Periodic runs against brute force, and suffix arrays against sorting."""

from __future__ import annotations

import binascii
import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from barloom.llm import queries
from barloom.llm.runs import Extensions, find_runs, periodic_runs
from tests.llm.cases import documents


def brute_runs(words, least=24):
    """Every maximal stretch with its smallest period, by comparing all places."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 3 * p):
                found.setdefault((i, j - i + p), p)  # the smallest period comes first
            i = j
    return sorted((s, length, p) for (s, length), p in found.items())


def texts(seed, count, alphabet, size):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        words = [rng.randrange(alphabet) for _ in range(rng.randrange(size))]
        for _ in range(rng.randrange(3)):
            p, at = rng.randrange(1, 14), rng.randrange(len(words) + 1)
            unit = [rng.randrange(alphabet) for _ in range(p)]
            words[at:at] = (unit * 30)[: rng.randrange(10, 90)]
        out.append(words)
    return out


@pytest.mark.parametrize("alphabet, least", [(1, 24), (2, 24), (2, 3), (2, 5), (3, 10), (50, 24)])
def test_runs_like_brute_force(alphabet, least):
    some = texts(alphabet, 60, alphabet, 160)
    first = np.cumsum([0, *map(len, some)])
    got = find_runs(np.array(sum(some, []), np.int64), first, least)
    by_text = {}
    for t, *run in zip(*(x.tolist() for x in got)):
        by_text.setdefault(t, []).append(tuple(run))
    for t, words in enumerate(some):
        assert by_text.get(t, []) == brute_runs(words, least), (t, words)


def test_extensions_like_comparison():
    rng = np.random.default_rng(5)
    for trial in range(12):
        n = rng.integers(1, 400, 4)
        words = rng.integers(0, 1 + trial % 3, int(n.sum()))
        first = np.concatenate([[0], np.cumsum(n)])
        text = np.repeat(np.arange(4), n)
        lce = Extensions(words, text, first[1:][text])
        i, j, want = [], [], []
        for _ in range(300):
            t = rng.integers(0, 4)
            if n[t] > 1:
                a, b = rng.choice(n[t], 2, replace=False) + first[t]
                i.append(a)
                j.append(b)
                k = 0
                while max(a, b) + k < first[t + 1] and words[a + k] == words[b + k]:
                    k += 1
                want.append(k)
        assert lce(np.array(i, int), np.array(j, int)).tolist() == want


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text):
    words = words_of(text)
    h = binascii.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = set()
    for s, length, p in runs:
        gone.update(range(s + p, s + length))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_like_brute_force(spark, tmp_path):
    rng = random.Random(8)
    docs, rows = documents(spark, 150)
    more = []
    for i in range(150):
        unit = " ".join(rng.choice(["a", "b", "日本", "x y"]) for _ in range(rng.randrange(1, 9)))
        more.append((1000 + i, "head of it " + "\n".join([unit] * rng.randrange(1, 40)) + " tail"))
    rows = [r[:2] for r in rows if len(r[1] or "") < 9000] + more
    table = spark.createDataFrame(rows + [(None, "z " * 40), (None, None)], "doc_id long, text string").repartition(5)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())))
    want = [expected(*r[:2]) for r in rows] + [expected(None, "z " * 40), expected(None, None)]
    assert got == sorted(map(str, want))
    assert sum(r[1] > 0 for r in want) > 50


def test_planted_tables_of_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    small = [tuple(r) for r in docs.collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count()
    for doc_id, text in small:
        assert got[doc_id] == expected(doc_id, text)


def test_long_texts_and_other_columns(spark):
    one = "w " * 200_000
    two = " ".join(f"{i % 7} {i % 5}" for i in range(20_000))
    table = spark.createDataFrame([(1, one, "r", 1), (2, two, "s", 2)], "doc_id long, text string, runs string, best long")
    got = {r.doc_id: r for r in periodic_runs(table).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 200_000, 1)] and got[1].collapsed == "w"
    assert [tuple(x) for x in got[2].runs] == [(0, 40_000, 70)] and tuple(got[2].best) == (0, 40_000, 70)
    assert periodic_runs(table.limit(0)).count() == 0
