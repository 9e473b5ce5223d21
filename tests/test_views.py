"""Views that may not apply: equity funds, valuations with proxies, exposure, members, short windows."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd

from barloom.operators import analytics, views
from barloom.sources.bars import BAR
from barloom.sources.documents import components, parsed


def frame(spark, symbol, close, first="2020-01-01"):
    close = np.asarray(close, float)
    f = pd.DataFrame({"symbol": symbol, "date": pd.bdate_range(first, periods=len(close)).date, "open": close, "high": close, "low": close, "close": close, "adjusted_close": close, "volume": 1})
    return spark.createDataFrame(f, BAR)


def test_equity_funds(spark):
    rows = [("a", ["Equity"], None), ("b", None, "US EQUITY large"), ("c", ["equity", "Gold"], "Equity"), ("d", ["equity"], "Treasury bills"), ("e", ["growth"], "Broad"), ("f", None, None), ("g", ["equity"], "Cash reserve")]
    got = {r.symbol: (r.applicable, r.reason) for r in views.equity_applicable(spark.createDataFrame(rows, "symbol string, tags array<string>, asset_class string")).collect()}
    none, other = (False, "not known to be an equity fund"), (False, "not an equity fund")
    assert got == {"a": (True, None), "b": (True, None), "c": other, "d": other, "e": none, "f": none, "g": other}


def test_fed_report(spark):
    profiles = spark.createDataFrame([(s, ["equity"], "Equity") for s in "abcd"] + [("x", ["bond"], "Bonds")], "symbol string, tags array<string>, asset_class string")
    facts = spark.createDataFrame([("a", 20.0), ("b", -3.0), ("c", 25.0), ("x", 10.0)], "symbol string, pe double")
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    rates = [("t", day(k), 3.0 + k / 10, 0) for k in range(11)] + [("t", day(10), 4.0, 1), ("t", day(3), 99.0, 1), ("t", day(40), 1.0, 0)]
    rates = spark.createDataFrame(rates, "symbol string, date date, close double, arrival int")
    got = {r.symbol: r for r in views.fed_report(profiles, facts, rates, "2020-01-15").collect()}
    a = got["a"]
    assert (a.status, a.earnings_yield, a.treasury, a.spread, a.more_attractive) == ("OK", 5.0, 4.0, 1.0, "equities")
    assert (a.observations, a.dropped, a.low, a.high, a.share, a.days_apart) == (10, 1, 3.0, 4.0, 100.0, 4)
    assert (got["c"].spread, got["c"].more_attractive) == (0.0, "equal")
    assert [(got[s].status, got[s].reason, got[s].spread) for s in "bdx"] == [("UNAVAILABLE", "no positive P/E", None), ("UNAVAILABLE", "no positive P/E", None), ("NOT_APPLICABLE", "not an equity fund", None)]
    bad = rates.withColumn("close", rates.close * 10)
    got = {r.symbol: (r.status, r.reason) for r in views.fed_report(profiles, facts, bad, "2020-01-15").collect()}
    assert got["a"] == ("UNAVAILABLE", "no valid observations") and got["x"][0] == "NOT_APPLICABLE"
    assert {r.status for r in views.fed_report(profiles, facts, rates.limit(0), "2020-01-15").collect()} == {"UNAVAILABLE", "NOT_APPLICABLE"}


def test_graham_inputs_fall_back(spark):
    facts = spark.createDataFrame([("a", 2.0, 7), ("b", None, None), ("c", None, None), ("d", 1.0, None)], "symbol string, eps_now double, growth int")
    annual = spark.createDataFrame([("b", 2017, 1.0), ("b", 2018, None), ("b", 2019, 3.0), ("b", 2021, 4.0), ("d", 2019, 1.0), ("d", 2020, 2.0)], "symbol string, year long, eps double")
    got = {r.symbol: (r.eps_now, r.eps_basis, r.growth and round(r.growth, 6), r.growth_basis) for r in views.graham_inputs(facts, annual).collect()}
    assert got == {"a": (2.0, "trailing", 7.0, "forward estimate"), "b": (4.0, "FY2021", round((4 ** 0.25 - 1) * 100, 6), "historical proxy"), "c": (None, None, None, None), "d": (1.0, "trailing", None, None)}


def test_exposure_follows_the_share_of_scores(spark):
    bars = frame(spark, "A", np.linspace(100, 160, 40)).union(frame(spark, "B", np.linspace(100, 110, 40))).union(frame(spark, "C", np.linspace(100, 60, 40)))
    tags = spark.createDataFrame([("A", ["up", "all"]), ("B", ["all"]), ("C", ["down", "all"])], "symbol string, tags array<string>")
    got = {r.symbol: (r.share_at_or_below, r.exposure_percent, r.guidance) for r in views.factor_exposure(bars, tags).collect()}
    assert got == {"A": (100.0, 100.0, "Maintain / Increase Exposure"), "B": (66.67, 76.67, "Neutral"), "C": (33.33, 53.33, "Reduce Exposure")}


def test_components_of_an_index(spark):
    doc = '{"Components":{"10":{"Code":"brk.b","Name":"Late"},"2":{"Code":"BRK.B","Name":"Early","Sector":" "},"x":{"Name":"none"},"3":{"Code":" aa ","Exchange":"US"}}}'
    docs = parsed(spark.createDataFrame([("I", doc), ("J", "{}"), ("K", "no json")], "symbol string, doc string"))
    assert sorted(map(tuple, components(docs).collect()), key=str) == [("I", "AA", None, None, None, "US"), ("I", "BRK-B", "Early", None, None, None)]


def test_comparison_from_a_day_and_short_mixes(spark):
    bars = frame(spark, "A", [1.0, 2.0, 4.0, 8.0]).union(frame(spark, "B", [1.0, 1.0, 2.0, 2.0]))
    got = analytics.buy_and_hold_comparison(bars, "A", {"B": 1.0}, 100.0, "2020-01-02").orderBy("date").collect()
    assert [(r.single_value, r.split_value) for r in got] == [(100.0, 100.0), (200.0, 200.0), (400.0, 200.0)]
    assert analytics.buy_and_hold_comparison(bars, "A", {"B": 1.0}, 100.0, "2020-01-06").count() == 0
    assert [tuple(r) for r in analytics.allocation_mix(bars, {"A": 1.0, "B": 1.0}, zeros=True).collect()] == [(3, 0.0, 0.0, 0.0, 0.0, 0.0)]
    assert analytics.allocation_mix(bars, {"A": 1.0, "B": 1.0}).count() == 0
    long = frame(spark, "A", np.linspace(1, 2, 40)).union(frame(spark, "B", np.linspace(2, 3, 40)))
    assert analytics.allocation_mix(long, {"A": 1.0, "B": 1.0}, zeros=True).collect() == analytics.allocation_mix(long, {"A": 1.0, "B": 1.0}).collect()
