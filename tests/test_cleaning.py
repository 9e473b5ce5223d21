"""Cleaning of whole series against plain loops over dirty rows."""

from __future__ import annotations

import datetime
import math
import random

import pytest

from barloom.operators import cleaning as cl

SCHEMA = "symbol string, date date, open double, high double, low double, close double, adjusted_close double, volume long, arrival long"


def dirty(seed=1, n=400):
    rng = random.Random(seed)
    odd = [None, float("nan"), 0.0, -1.0, float("inf")]
    price = lambda p=0.1: rng.choice(odd) if rng.random() < p else round(rng.uniform(1, 9), 2)
    rows = []
    for k in range(n):
        date = None if rng.random() < 0.05 else datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(80))
        o, c = price(), price()
        high, low = (9.5, 0.5) if rng.random() < 0.8 else (price(), price())
        rows.append((rng.choice("abc"), date, o, high, low, c, price(0.4), rng.choice([None, 5, -2]), k))
    return rows


def by_day(rows, keep=lambda r: True):
    out = {}
    for r in sorted(rows, key=lambda r: r[8]):
        if r[1] is not None and keep(r):
            out[r[0], r[1]] = r
    return out


def fine(x):
    return x is not None and math.isfinite(x) and x > 0


@pytest.fixture
def table(spark):
    rows = dirty()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_price_series(table):
    rows, df = table
    want = {}
    for key, r in by_day(rows).items():
        adjusted = r[6]
        price = adjusted if adjusted not in (None, 0.0) and not math.isnan(adjusted) else r[5]
        if price is not None and not math.isnan(price) and price > 0:
            want[key] = (price, r[7] or 0)
    assert {(r.symbol, r.date): (r.price, r.volume) for r in cl.price_series(df).collect()} == want


@pytest.mark.parametrize("basis, at", [("adjusted_close", 6), ("close", 5)])
def test_basis_series(table, basis, at):
    rows, df = table
    want = {k: r[at] for k, r in by_day(rows, lambda r: fine(r[at])).items()}
    assert {(r.symbol, r.date): r.price for r in cl.basis_series(df, basis).collect()} == want


def test_candles_and_report(table):
    rows, df = table
    marked = cl.marked_candles(df)
    want, bad = {}, {s: [] for s in "abc"}
    days = by_day(rows)
    for s in "abc":
        for pos, date in enumerate(sorted(d for x, d in days if x == s)):
            _, _, o, h, low, c, _, volume, _ = days[s, date]
            ok = all(map(fine, (o, h, low, c))) and h >= max(o, c, low) - 1e-9 * max(h, 1) and low <= min(o, c, h) + 1e-9 * max(h, 1)
            if ok:
                want[s, date] = (pos, o, max(h, o, c), min(low, o, c), c, volume if volume and volume >= 0 else None)
            else:
                bad[s].append(date)
    assert {(r.symbol, r.date): (r.pos, r.open, r.high, r.low, r.close, r.volume) for r in cl.candles(marked).collect()} == want
    for r in cl.candle_report(df, marked, 5).collect():
        mine = [x for x in rows if x[0] == r.symbol]
        none = sum(x[1] is None for x in mine)
        assert (r.source_rows, r.without_date, r.repeated_dates) == (len(mine), none, len(mine) - none - sum(s == r.symbol for s, _ in days))
        assert (r.invalid, r.invalid_dates) == (len(bad[r.symbol]), bad[r.symbol][:5])


def test_yields_out_of_range_are_refused(spark):
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    rows = [("fine", day(k), 4.0 if k % 5 else 45.0, k) for k in range(20)] + [("scaled", day(k), 45.0 if k % 3 == 0 else 4.0, k) for k in range(20)]
    rows += [("none", day(0), float("nan"), 0), ("none", None, 4.0, 1), ("zero", day(0), 0.0, 0), ("twice", day(0), 45.0, 0), ("twice", day(0), 20.0, 1)]
    kept, verdict = cl.yield_series(spark.createDataFrame(rows, "symbol string, date date, close double, arrival long"))
    got = {r.symbol: (r.observations, r.dropped, r.status) for r in verdict.collect()}
    assert got == {"fine": (20, 4, "OK"), "scaled": (20, 7, "UNAVAILABLE"), "none": (0, 0, "UNAVAILABLE"), "zero": (1, 1, "UNAVAILABLE"), "twice": (1, 0, "OK")}
    assert sorted({r.symbol for r in kept.collect()}) == ["fine", "twice"] and kept.count() == 17
    assert {r.reason for r in verdict.collect()} == {None, "7 of 20 observations out of range", "no valid observations"}


def test_windows_include_both_ends(spark):
    df = spark.createDataFrame([("a", datetime.date(2020, 1, k)) for k in range(1, 6)], "symbol string, date date")
    days = lambda *w: sorted(r.date.day for r in cl.date_window(df, *w).collect())
    assert days() == [1, 2, 3, 4, 5] and days("2020-01-02") == [2, 3, 4, 5] and days(None, "2020-01-03") == [1, 2, 3] and days("2020-01-02", "2020-01-03") == [2, 3]
