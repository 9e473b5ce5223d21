"""Months and indicators of a stream in several batches against the whole table."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest

from barloom.functions.recursive import INDICATORS, with_indicators
from barloom.operators import tails
from barloom.sources.bars import BAR
from barloom.streaming import bars as st


@pytest.fixture
def bars(spark):
    rng = np.random.default_rng(7)
    parts = []
    for symbol, first, n in (("A", "2020-01-01", 300), ("B", "2020-06-15", 120), ("C", "2020-12-28", 9)):
        close = np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), 2)
        parts.append(pd.DataFrame({"symbol": symbol, "date": pd.bdate_range(first, periods=n).date, "open": close, "high": close + 1, "low": close - 1, "close": close, "adjusted_close": close, "volume": 1}))
    return spark.createDataFrame(pd.concat(parts), BAR)


CUTS = ["2020-06-20", "2020-09-01", "2021-01-04"]


def test_indicators_go_on_from_batch_to_batch(spark, bars, tmp_path):
    stream = st.in_order(bars, f"{tmp_path}/in", "date", CUTS)
    got = {r.symbol: r for r in st.run_updates(st.running_indicators(stream), str(tmp_path), "symbol", "i").collect()}
    want = {r.symbol: r for r in with_indicators(bars, INDICATORS, 1).collect()}
    assert set(got) == set(want) and {s: r.i for s, r in got.items()} == {"A": 300, "B": 120, "C": 9}
    for s, r in got.items():
        assert r.date == want[s].date
        for x in tails.VIEW:
            a, b = r[x], want[s][x]
            assert (a is None or np.isnan(a)) and (b is None or np.isnan(b)) or a == pytest.approx(b, rel=1e-9), (s, x)


def test_months_of_a_stream(spark, bars, tmp_path):
    gap = bars.where("not (symbol = 'A' and month(date) = 5)").where("date <= '2021-01-21'")
    stream = st.in_order(gap, f"{tmp_path}/in", "date", CUTS)
    got = {(r.symbol, r.month): r for r in st.months_so_far(st.run_updates(st.monthly_closes(stream), str(tmp_path), ["symbol", "month"], "n")).collect()}
    f = gap.toPandas()
    f["month"] = [d.replace(day=1) for d in f["date"]]
    ends = f.sort_values("date").groupby(["symbol", "month"])["close"].agg(["last", "count"])
    assert set(got) == set(ends.index)
    for (s, month), r in got.items():
        assert (r.close, r.n) == (ends.loc[(s, month), "last"], ends.loc[(s, month), "count"])
        before = (month - datetime.timedelta(days=1)).replace(day=1)
        known = (s, before) in ends.index
        assert (r.return_percent is not None) == known
        if known:
            assert r.return_percent == pytest.approx((r.close / ends.loc[(s, before), "last"] - 1) * 100, abs=1e-6)
        assert r.is_complete == (month != datetime.date(2021, 1, 1)) or (s, month) == ("B", datetime.date(2020, 11, 1))
        assert (r.rank is not None) == (r.is_complete and known)
    assert got["A", datetime.date(2020, 6, 1)].return_percent is None  # May is missing


def test_state_partitions_follow_few_keys(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with st.few_keys(spark, 2):
        assert spark.conf.get(name) == "2"
    with st.few_keys(spark, 10_000):
        assert spark.conf.get(name) == before
    with pytest.raises(ValueError):
        with st.few_keys(spark, 3):
            raise ValueError
    assert spark.conf.get(name) == before
