"""Pairs of symbols: blocked correlations against pandas, warping against a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from barloom.operators import analytics
from barloom.operators.models import dtw
from barloom.sources.bars import BAR


@pytest.mark.parametrize("tile", [64, 5])
def test_correlations_like_pandas(spark, monkeypatch, tile):
    monkeypatch.setattr(analytics, "TILE", tile)
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2020-01-01", periods=150).date
    wide = pd.DataFrame(np.exp(np.cumsum(rng.normal(0, 0.01, (150, 23)) + rng.normal(0, 0.01, (150, 1)), axis=0)) * 50, index=days, columns=[f"s{k}" for k in range(23)])
    wide["flat"] = 7.0
    long = wide.stack().rename("close").reset_index().set_axis(["date", "symbol", "close"], axis=1)
    long = long[(rng.random(len(long)) < 0.9) & ~((long["symbol"] == "s3") & (long["date"] > days[8]))]  # gaps, and one short history
    bars = spark.createDataFrame(long.assign(open=1.0, high=1.0, low=1.0, adjusted_close=long["close"], volume=1)[BAR.fieldNames()], BAR)
    r = long.sort_values("date").groupby("symbol").apply(lambda f: f.set_index("date")["close"].pct_change().dropna(), include_groups=False)
    r = r.reset_index().pivot(index="date", columns="symbol", values="close")
    got = {(x.a, x.b): (x.n, x.correlation) for x in analytics.correlation_matrix(bars).collect()}
    names = sorted(r.columns)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = r[[a, b]].dropna()
            if len(both) == 0:
                assert (a, b) not in got
                continue
            n, rho = got[a, b]
            assert n == len(both)
            if n < 10:
                assert rho == 0
            elif "flat" in (a, b):
                assert rho is None
            else:
                assert rho == pytest.approx(both[a].corr(both[b]), abs=2e-6)
    some = analytics.correlation_matrix(bars, symbols=["s1", "s2"]).collect()
    assert [(x.a, x.b) for x in some] == [("s1", "s2")]


def test_warping_like_a_table():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = (rng.normal(size=(rng.integers(1, 12), 3)) for _ in range(2))
        cost = np.linalg.norm(a[:, None] - b[None], axis=2)
        table = np.full((len(a) + 1, len(b) + 1), np.inf)
        table[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = cost[i, j] + min(table[i, j], table[i, j + 1], table[i + 1, j])
        assert dtw(a, b) == pytest.approx(table[-1, -1], rel=1e-12)
