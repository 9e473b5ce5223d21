"""Cuts, payouts in other currencies, the fund screen and a simulation's window."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pandas as pd
import pytest

from barloom.operators import cuts as cu
from barloom.operators import fund_screen as fs
from barloom.operators import models as m
from barloom.sources.bars import BAR

AS_OF = datetime.date(2020, 6, 30)
PAY = "symbol string, ex_date date, amount double, period string, currency string, is_special boolean"
INTERVAL = {12: 30.4, 4: 91.3, 2: 182.6, 1: 365.2}
LABEL = {"monthly": 12, "quarterly": 4, "annual": 1}


def payments(seed):
    rng, rows = random.Random(seed), []
    for k in range(40):
        symbol, amount, every = f"s{k}", 1.0, rng.choice([91, 182, 365, 30])
        label = rng.choice([None, " Quarterly", "Annual", ""])
        day = datetime.date(2013, 1, 10) + datetime.timedelta(days=rng.randrange(1500))
        for _ in range(rng.randrange(1, 40)):
            if day > datetime.date(2020, 9, 1) or rng.random() < 0.02:
                break
            rows.append((symbol, day, round(amount, 4), label if rng.random() < 0.9 else "Monthly", "USD", rng.random() < 0.06))
            amount *= rng.choice([1, 1, 1, 1.05, 0.7, 1.5, 0.92])
            day += datetime.timedelta(days=every + rng.randrange(-12, 12) + (0 if rng.random() < 0.95 else 500))
    return rows


def expected(rows):
    past = sorted(r for r in rows if r[1] <= AS_OF)
    if not past:
        return None
    regular = [r for r in past if not r[5]]
    label = lambda r: (r[3] or "").strip().lower() or None
    events = []
    for j in range(1, len(regular)):
        a, b = regular[j - 1], regular[j]
        if label(a) and label(b) and label(a) != label(b) or (b[1] - a[1]).days > 400:
            continue
        if b[2] <= a[2] * 0.9:
            events.append((b[1], any(x[2] <= a[2] * 0.95 for x in regular[j + 1 : j + 3])))
    recent = [e for e in events if e[0] >= AS_OF - datetime.timedelta(days=729)]
    table = [(y, round(sum(r[2] for r in regular if r[1].year == y), 6), sum(r[1].year == y for r in regular)) for y in range(past[0][1].year, AS_OF.year)]
    paying, modal = [t[2] for t in table if t[2] > 0][-5:], None
    if paying:
        top = max(Counter(paying).values())
        modal = next(n for n in reversed(paying) if Counter(paying)[n] == top)
    usual = [t[2] == modal for t in table]
    fell = alike = False
    if len(table) > 1 and table[-2][1] > 0:
        fell = table[-1][1] < table[-2][1] * 0.995
        alike = fell and (usual[-1] and usual[-2] or table[-1][2] == 0)
    cut = "observed" if any(e[1] for e in recent) or alike else "possible" if recent or fell else "none"
    excluded = sum(a[1] > 0 and not (u and v) and not (b[2] == 0 and a[2] > 0) for a, b, u, v in zip(table, table[1:], usual, usual[1:]))
    anchor = regular[-1] if regular else past[-1]
    days = (AS_OF - anchor[1]).days
    wait = INTERVAL.get(modal, 365.2 / modal if modal else None) if modal else INTERVAL.get(LABEL.get(label(anchor)))
    late = "none"
    if not any(r[1] > AS_OF for r in rows):
        if wait is None:
            late = "possible_suspension" if days > 730 else "none"
        else:
            late = "possible_suspension" if days > max(2 * wait, wait + 90) else "possible_delay" if days > 1.35 * wait + 15 else "none"
    return cut, len(events), len(recent), sum(e[1] for e in recent), fell, "Regular" if len(table) >= 3 and all(usual[-3:]) else "Irregular", excluded, late, days


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_status_like_loops(spark, seed):
    rows = payments(seed)
    got = {r.symbol: tuple(r)[1:10] for r in cu.cut_status(spark.createDataFrame(rows, PAY).repartition(3), str(AS_OF)).collect()}
    want = {s: expected([r for r in rows if r[0] == s]) for s in {r[0] for r in rows}}
    assert got == {s: w for s, w in want.items() if w}
    assert {w[0] for w in want.values() if w} == {"observed", "possible", "none"} and len({w[7] for w in want.values() if w}) == 3


def test_payout_needs_one_currency(spark):
    from barloom.operators.facts import payout_bases
    from barloom.sources.documents import parsed

    doc = '{"General":{"CurrencyCode":"%s"},"SplitsDividends":{"PayoutRatio":"%s"},"Earnings":{"Annual":{"%s":{"epsActual":"2"}}}}'
    docs = [("same", doc % ("usd", "0.5", "2019-12-31")), ("other", doc % ("EUR", "NA", "2019-12-31")), ("old", doc % ("USD", "1", "2018-06-30")), ("unpaid", doc % ("USD", "", "2019-12-31")), ("untold", doc % ("", "0.1", "2019-12-31"))]
    docs = parsed(spark.createDataFrame(docs, "symbol string, doc string"))
    day = datetime.date(2019, 9, 1)
    pays = [("same", day, 1.0, None, " Usd ", False), ("other", day, 1.0, None, None, False), ("other", datetime.date(2019, 3, 1), 1.0, None, "usd", False), ("old", datetime.date(2018, 1, 5), 1.5, None, "USD", False), ("untold", day, 3.0, None, "GBP", False), ("unpaid", datetime.date(2021, 1, 1), 1.0, None, "USD", False)]
    pays = spark.createDataFrame(pays, PAY)
    got = {r.symbol: r for r in cu.payout_report(payout_bases(docs, pays, str(AS_OF)), docs, pays, str(AS_OF)).collect()}
    assert {s: (r.status, r.payout_percent, r.stale, r.provider_percent) for s, r in got.items()} == {
        "same": ("available", 50.0, False, 50.0), "other": ("not_meaningful", None, False, None), "old": ("available", 75.0, True, 100.0), "unpaid": ("no_history", None, False, None), "untold": ("available", 150.0, False, 10.0),
    }
    assert got["other"].reason == "paid in USD, reported in EUR" and got["untold"].band == "Exceeds earnings"


def test_fund_screen_and_ranking(spark):
    schema = "symbol string, close double, high double, low double, sma200 double, earnings_growth double, revenue_growth double, roe double, float_shares long, institutional double"
    rows = [("a", 90.0, 100.0, 60.0, 80.0, 0.25, 0.2, 0.17, 499_999_999, 0.3), ("b", 84.0, 100.0, 70.0, 84.0, 0.2, None, 0.3, 500_000_000, 0.86), ("c", None, None, 0.0, None, None, None, None, None, None), ("d", 90.0, 0.0, 60.0, 80.0, 0.25, 0.2, 0.17, 1, 0.85)]
    scores = fs.scored(spark.createDataFrame(rows, schema))
    got = {r.symbol: (r.score, r.evaluated, r.unavailable, r.meets_minimum) for r in scores.collect()}
    assert got == {"a": (7, 7, "", True), "b": (0, 6, "a", False), "c": (0, 0, "c,a,n,s,l,i,m", False), "d": (6, 6, "n", True)}
    members = spark.createDataFrame([("c",), ("b",), ("a",), ("d",), ("z",)], "symbol string")
    order = {r.symbol: (r.rank, r.status) for r in fs.ranked(scores, members).collect()}
    assert order == {"a": (1, "OK"), "d": (2, "OK"), "b": (3, "OK"), "c": (4, "OK"), "z": (None, "UNAVAILABLE")}


def test_simulation_windows(spark):
    days = pd.bdate_range("2020-01-01", periods=60).date
    one = pd.DataFrame({"symbol": "A", "date": days, "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "adjusted_close": [10.0 + k for k in range(60)], "volume": 1})
    two = one.iloc[[0, 10, 50]].assign(symbol="B", adjusted_close=[5.0, 7.0, 9.0])
    bars = spark.createDataFrame(pd.concat([one, two, two.iloc[1:].assign(symbol="L")]), BAR)
    r = m.simulation_window(bars, "A", "B", capital=1000.0, rate=0.0).first()
    assert (r.status, r.days, r.hold_final, r.benchmark_final, r.notes) == ("OK", 60, 100 * 69.0, 200 * 9.0, "shorter than a year")
    r = m.simulation_window(bars, "A", "B", str(days[20]), "2030-01-01", capital=1000.0, rate=0.0).first()
    assert (r.days, r.benchmark_final, r.notes) == (40, 142 * 9.0 + 6.0, "ends at the last price; shorter than a year")
    assert m.simulation_window(bars, "A", "L").first().notes.endswith("benchmark starts later") and m.simulation_window(bars, "A", "Q").first().notes.endswith("benchmark has no prices")
    r = m.simulation_window(bars, "A", "B", None, str(days[18])).first()
    assert (r.status, r.reason, r.hold_final) == ("UNAVAILABLE", "19 days in the window, 20 are needed", None)
