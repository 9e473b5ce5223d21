from __future__ import annotations

import re

import pytest

from barloom.llm.linededup import LineRuns, line_dedup, line_hashes, line_key

from .cases import SCHEMA, documents


def brute(rows):
    holds: dict[str, set[int]] = {}

    def key(line):
        k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holds.setdefault(key(line), set()).add(i)
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holds.get(key(x), set())) >= 3 and i != max(h))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_like_brute_force(spark, batches):
    docs, rows = documents(spark)
    want = brute(rows)
    assert sum(x[1] for x in want.values()) > 30
    got = line_dedup(docs, batches=batches).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.n_dropped == 0
        else:
            assert (r.n_lines, r.n_dropped, r.kept) == want[r.doc_id], r.doc_id


def test_runs_compact_by_level(spark):
    runs = LineRuns(spark)
    for k in range(5, 0, -1):
        rows = [(k * 10 + d, key, key) for d in range(3) for key in (7, k)]
        runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long"))
    assert [x is not None for x in runs.levels] == [True, False, True]
    got = {r.h1: (r.n, r.last) for r in runs.totals().collect()}
    assert got[7] == (15, 52) and got[2] == (3, 22) and got[5] == (3, 52)


def test_runs_are_merged_without_a_shuffle(spark):
    runs, plans = LineRuns(spark), []
    real = runs._bucketed

    def kept(rows, name):
        plans.append((name, rows._jdf.queryExecution().sparkPlan().toString(), rows._jdf.queryExecution().executedPlan().toString()))
        return real(rows, name)

    runs._bucketed = kept
    for k in (3, 2, 1):
        runs.add(spark.createDataFrame([(k * 10 + d, d, k) for d in range(40)], "doc_id long, h1 long, h2 long"))
    joins = [plan for _, _, plan in plans if "SortMergeJoin" in plan]
    assert len(joins) >= 4 and not any("Exchange" in plan for plan in joins)
    assert not any("Sort [h1" in plan for plan in joins)


def test_key_hashes_agree_with_the_tables(spark):
    lines = ["  Ünlike CASES and Spaces in a line\t", "x" * 19, "日本語" * 9, "\v" + "Y" * 20 + "\f"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.h1, r.h2) for r in line_hashes(docs, 20).collect()}
    assert got == {line_key(x, 20) for x in lines} - {None} and len(got) == 3


def test_keeps_columns(spark):
    docs, rows = documents(spark, 30)
    got = line_dedup(docs, keep=["source", "key"]).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_lines", "n_dropped", "kept", "source", "key"} and len(got) == len(rows) + 1


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
