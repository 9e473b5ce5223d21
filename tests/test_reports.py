"""Orderings with ties, evaluations of both rules, comparisons of paths, passage curves."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pandas as pd
import pytest

from barloom.operators import models as m
from barloom.operators import portfolio, quant, scans, technical
from barloom.sources.bars import BAR


def frame(spark, symbol, close, first="2019-01-01"):
    close = np.asarray(close, float)
    f = pd.DataFrame({"symbol": symbol, "date": pd.bdate_range(first, periods=len(close)).date, "open": close, "high": close, "low": close, "close": close, "adjusted_close": close, "volume": 1})
    return spark.createDataFrame(f, BAR)


def test_orderings(spark):
    flat, rising = frame(spark, "f", [5.0] * 60), frame(spark, "r", np.arange(1, 61))
    falling = frame(spark, "d", np.arange(100, 40, -1.0))
    dip = frame(spark, "x", [5.0] * 59 + [4.0])
    short = frame(spark, "s", [1.0] * 49)
    got = {r.symbol: (r.ordering, r.has_ties) for r in technical.sma_ordering(flat.union(rising).union(falling).union(dip).union(short)).collect()}
    assert got == {"f": ("Close = SMA10 = SMA25 = SMA50", True), "r": ("Close > SMA10 > SMA25 > SMA50", False), "d": ("SMA50 > SMA25 > SMA10 > Close", False), "x": ("SMA50 > SMA25 > SMA10 > Close", False)}


def test_both_rules_of_a_crash_evaluation(spark):
    rng = np.random.default_rng(4)
    bars = frame(spark, "a", 100 * np.exp(np.cumsum(rng.normal(0, 0.025, 900))))
    both = {(r.segment, r.rule): r for r in quant.crash_evaluation(bars).collect()}
    old = {r.segment: r for r in quant.crash_validation(bars).collect()}
    assert set(both) == {(s, r) for s in ("train", "test") for r in ("warning", "baseline")}
    for segment, o in old.items():
        new, base = both[segment, "warning"], both[segment, "baseline"]
        assert (new.tp, new.fp, new.fn, new.tn, new.episodes, new.detected, new.median_lead) == (o.tp, o.fp, o.fn, o.tn, o.episodes, o.detected, o.median_lead)
        assert (base.tp, base.fp, base.episodes, base.bars) == (o.base_tp, o.base_fp, o.episodes, new.bars)
        assert new.missed == new.episodes - new.detected
        if new.lift is not None:
            assert new.lift == pytest.approx(new.precision_percent / new.base_rate_percent, abs=0.006)
    assert quant.crash_evaluation(bars.limit(50)).count() == 0


def test_comparison_of_paths(spark):
    rng = np.random.default_rng(5)
    a, b = (np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.02, 500))), 4) for _ in range(2))
    bars = frame(spark, "A", a).union(frame(spark, "B", b))
    got = {r.path: r for r in portfolio.harvest_comparison(bars, {"A": 60.0, "B": 40.0}, cost=0.002).collect()}
    held = 0.6 * a / a[0] + 0.4 * b / b[0]
    days = pd.bdate_range("2019-01-01", periods=500).date
    fall = held / np.maximum.accumulate(held) - 1
    low = int(fall.argmin())
    r = held[1:] / held[:-1] - 1
    want = got["held"]
    assert want.final_value == pytest.approx(10000 * held[-1], abs=0.01) and want.drawdown_percent == pytest.approx(100 * fall[low], abs=1e-4)
    assert (want.trough, want.peak) == (days[low], days[int(held[: low + 1].argmax())])
    vol = r.std(ddof=1) * math.sqrt(252)
    assert want.volatility_percent == pytest.approx(100 * vol, abs=1e-4) and want.sharpe == pytest.approx((r.mean() * 252 - 0.045) / vol, abs=1e-4)
    assert want.cagr_percent == pytest.approx((held[-1] ** (365.25 / (days[-1] - days[0]).days) - 1) * 100, abs=1e-4)
    gap = got["difference"]
    assert gap.return_percent == pytest.approx(got["rebalanced"].return_percent - want.return_percent, abs=1e-9)
    assert gap.direction == ("Rebalanced ahead" if gap.return_percent > 0 else "Buy-and-hold ahead") and want.direction is None
    short = portfolio.harvest_comparison(bars.where("date < '2019-06-01'"), {"A": 1.0, "B": 1.0}).collect()
    assert {r.cagr_percent for r in short} == {None}


def test_passage_curves(spark):
    rng = np.random.default_rng(6)
    close = 100 * np.exp(np.cumsum(rng.normal(0.001, 0.01, 300)))
    bars = frame(spark, "A", close).union(frame(spark, "B", close[:100])).union(frame(spark, "C", [7.0] * 200))
    curve = m.first_passage_curve(bars).toPandas().sort_values("day")
    assert set(curve["symbol"]) == {"A"} and curve["day"].tolist() == list(range(1, 253))
    r = np.diff(np.log(close))[-252:]
    mu, sigma = r.mean(), r.std(ddof=1)
    assert np.allclose(curve["up"], m.passage_cdf(mu, sigma, math.log(1.1), 252)) and np.allclose(curve["down"], m.passage_cdf(mu, sigma, math.log(0.9), 252))
    assert (np.diff(curve["up"]) >= 0).all()
    last = m.first_passage(bars).first()
    assert (last.symbol, last.up_year) == ("A", curve["up"].iloc[-1])
    assert last.expected_days == pytest.approx((math.log(1.1) if mu > 0 else math.log(0.9)) / mu)
    assert m.first_passage_curve(bars.limit(0)).count() == 0


def test_universes(spark):
    members = spark.createDataFrame([("u", "A", True), ("u", "A", True), ("u", "Z", True), ("u", "B", False), ("v", "Z", True)], "universe string, symbol string, is_current boolean")
    bars = frame(spark, "A", [1.0, 2.0]).union(frame(spark, "B", [1.0] * 9))
    got = {r.universe: tuple(r)[1:] for r in scans.universe_summary(members, bars).collect()}
    assert got == {"u": (3, 2, 1, datetime.date(2019, 1, 2)), "v": (1, 1, 0, None)}


def test_a_pattern_does_not_form_across_a_dropped_candle(spark):
    """A falling market, then a green candle that engulfs the red one before it."""
    rows = [(100.0 - k, 100.2 - k, 98.8 - k, 99.0 - k) for k in range(40)]
    rows.append((58.9, 62.5, 58.5, 62.0))
    days = pd.bdate_range("2020-01-01", periods=41).date
    frames = []
    for symbol, gap in (("whole", 0), ("gap", 1)):
        for k, (o, h, low, close) in enumerate(rows):
            frames.append((symbol, days[k], o, h, low, close, close, 1, k + (gap if k == 40 else 0)))
    df = spark.createDataFrame(frames, "symbol string, date date, open double, high double, low double, close double, adjusted_close double, volume long, pos long")
    found = technical.candlestick_patterns(df)
    got = {(r.symbol, r.pattern) for r in found.where("pattern like '%Engulfing'").collect()}
    assert got == {("whole", "Bullish Engulfing")}
    assert {r.symbol for r in technical.candlestick_patterns(df.drop("pos")).where("pattern like '%Engulfing'").collect()} == {"whole", "gap"}
    counts = {(r.symbol, r.pattern): (r.n, r.last) for r in technical.pattern_counts(found, df).collect()}
    assert len(counts) == 22 and counts["whole", "Bullish Engulfing"] == (1, days[40]) and counts["gap", "Bullish Engulfing"] == (0, None)
