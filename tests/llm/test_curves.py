from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm.curves import Curves, _Order, hilbert_bytes, hilbert_keys, nearest

QUERY = "vec_id % 50 = 0"


def brute(rows, k=5):
    ids, vectors = zip(*rows)
    x = np.array(vectors, float)
    norm = np.linalg.norm(x, axis=1)
    out = {}
    for i, q in enumerate(ids):
        if q % 50 == 0:
            s = x @ x[i] / (norm * norm[i])
            order = sorted((-round(v, 12), j) for v, j in zip(s.tolist(), ids) if j != q)
            out[q] = [j for _, j in order[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def test_keys_are_a_walk_through_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_recall(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 32)).astype(np.float32))]
    want, got = brute(rows), found(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), QUERY))
    assert np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want]) >= 0.9


def test_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(300)]
    bad = [(1000, None), (1050, [0.0] * 4), (1100, [1.0, None, 2.0, 3.0]), (1150, [1.0, float("nan"), 0.0, 0.0]), (1200, [float("inf"), 0.0, 0.0, 1.0]), (1250, []), (1300, [1.0])]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = found(nearest(df, QUERY))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        if q % 3 == 0:
            assert got[q] == [0, 3, 6, 9, 12, 15][:5] if q not in (0, 3, 6, 9, 12) else got[q] == [x for x in (0, 3, 6, 9, 12, 15) if x != q]
        else:
            assert len(set(got[q]) & set(want[q])) >= 4


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), QUERY).count() == 0
    assert nearest(spark.createDataFrame([(50, [1.0])], schema), QUERY).count() == 0
    assert found(nearest(spark.createDataFrame([(50, [1.0, 0.0]), (7, [1.0, 1.0])], schema), QUERY)) == {50: [7]}


def test_crowded_cells_keep_an_order_of_their_own():
    """A fine grid around one place, in cells that seven levels do not part."""
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 8), axis=-1).reshape(-1, 8) + (5 << 30)
    keys = [bytes(k) for k in hilbert_bytes(cells, 40)]
    assert len(set(keys)) == len(cells) and len({k[:7] for k in keys}) == 1
    small = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    assert np.array_equal(np.argsort([bytes(k) for k in hilbert_bytes(small, 3)]), np.argsort(hilbert_keys(small, 3)))


@pytest.mark.parametrize("jitter", [0.02, 1e-4])
def test_recall_in_a_third_of_near_copies(spark, jitter):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 32))
    x[::3] = x[0] + jitter * rng.normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute(rows), found(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), QUERY))
    share = {q: len(set(want[q]) & set(got[q])) / 5 for q in want}
    assert np.mean([s for q, s in share.items() if q % 3 == 0]) >= 0.9
    assert np.mean([s for q, s in share.items() if q % 3]) >= 0.85


def test_rescaled_copies_tie_by_id(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x[::3] = x[0] * rng.uniform(0.1, 9, size=(500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute(rows), found(nearest(spark.createDataFrame(rows + [(0, (7 * x[0]).tolist())], "vec_id long, embedding array<double>"), QUERY))
    assert all(want[q] == got[q] for q in want if q % 3 == 0)


def test_another_vector_of_the_querys_id_is_a_candidate(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.1]), (7, [1.0, 0.5]), (None, [1.0, 0.0]), (8, [0.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), QUERY).collect())
    near = round(1 / 1.01**0.5, 6)
    assert [g for g in got if g[1] == 1] == [(50, 1, 50, near)] * 2 and len(got) == 6
    assert {g[2] for g in got if g[1] == 2} == {7} and {g[2] for g in got if g[1] == 3} == {8}


def test_the_window_follows_the_data():
    """Clusters need a small share of the points, random directions a large one."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    loose = unit(rng.normal(size=(6000, 64)))
    tight = unit(np.repeat(rng.normal(size=(400, 64)), 15, axis=0) + 0.05 * rng.normal(size=(6000, 64)))
    shares = [_Order(x, 16, Curves()).window(x[rng.permutation(6000)], 5, 0.955) for x in (loose, tight)]
    assert shares[1] < 0.01 < shares[0] < 0.12
