"""Readers and company documents against plain expectations."""

from __future__ import annotations

import datetime
import json

import pytest

from barloom.operators import facts
from barloom.sources import documents as d

DAY = datetime.date


def put(path, rows):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    return str(path)


def test_bars_of_json_lines(spark, tmp_path):
    rows = [
        {"symbol": "A", "date": "2021-01-04T00:00", "open": 1, "high": "2.5", "low": 0.5, "close": 2, "volume": 7},
        {"symbol": "A", "date": "2021-01-05", "close": "3", "adjusted_close": "NaN"},
        {"symbol": "A", "date": "bad", "close": 3},
        {"symbol": "A", "date": "2021-01-06", "close": "-"},
        {"symbol": "B", "date": "2021-01-06", "close": 0},
        "{not json",
    ]
    bars, quality = d.read_bars(spark, put(tmp_path / "bars.json", rows))
    got = sorted(tuple(r) for r in bars.collect())
    assert got == [("A", DAY(2021, 1, 4), 1.0, 2.5, 0.5, 2.0, 2.0, 7), ("A", DAY(2021, 1, 5), 0.0, 0.0, 0.0, 3.0, 3.0, 0)]
    assert {r.symbol: (r.received, r.refused) for r in quality.collect()} == {"A": (4, 2), "B": (1, 1), None: (1, 1)}


def test_dividends_and_their_quality(spark, tmp_path):
    rows = [
        {"symbol": "A", "date": "2021-03-01", "value": 0.5, "period": " Quarterly ", "currency": "usd", "paymentDate": "2021-03-20"},
        {"symbol": "A", "date": "2021-03-01", "value": "0.5000001"},
        {"symbol": "A", "date": "2021-03-01", "value": 0.5, "period": "Special"},
        {"symbol": "A", "date": "2021-06-01", "value": "NA", "unadjustedValue": "0.7"},
        {"symbol": "A", "date": "2021-09-01", "value": -1},
        {"symbol": "A", "date": None, "value": 1},
    ]
    raw = d.read_dividends(spark, put(tmp_path / "dividends.json", rows))
    got = sorted((r.ex_date, r.is_special, r.amount) for r in d.parse_dividends(raw).collect())
    assert got == [(DAY(2021, 3, 1), False, 0.5), (DAY(2021, 3, 1), True, 0.5), (DAY(2021, 6, 1), False, 0.7)]
    assert tuple(d.dividend_quality(raw).first()) == ("A", 6, 2, 1, 1, 1)


def company(**parts):
    return {"General": {"Sector": "Tech", "CurrencyCode": "USD"}, **parts}


def docs_of(spark, tmp_path, **companies):
    path = put(tmp_path / "docs.json", [{"symbol": k, "doc": v} for k, v in companies.items()] + [{"symbol": "BAD", "doc": "no object"}])
    return d.parsed(d.read_documents(spark, path))


def test_statements_take_one_period(spark, tmp_path):
    sheet = {"2020-12-31": {"totalCurrentAssets": "10", "cash": 2}, "2021-12-31": {"totalCurrentAssets": "None", "inventory": 5}, "x": {"date": "2019-12-31", "cash": 1}}
    income = {"2021-12-31": {"ebit": "NA", "operatingIncome": "4"}, "2020-12-31": {"ebit": "9"}}
    docs = docs_of(spark, tmp_path, A=company(Financials={"Balance_Sheet": {"yearly": sheet}, "Income_Statement": {"yearly": income}}), B=company())
    (row,) = facts.balance(docs).collect()
    assert (row.symbol, row.balance_day, row.current_assets, row.cash, row.net_ppe) == ("A", DAY(2020, 12, 31), 10.0, 2.0, None)
    (row,) = facts.ebit(docs).collect()
    assert (row.ebit, row.ebit_day, row.ebit_item) == (4.0, DAY(2021, 12, 31), "operatingIncome")
    table = {r.symbol: r for r in facts.valuation(docs).collect()}
    assert table["A"].cash == 2.0 and table["B"].ebit is None and table["BAD"].sector is None and len(table) == 3


def test_quarter_a_year_before(spark, tmp_path):
    quarter = lambda *days: company(Earnings={"History": {x: {"epsActual": e} for x, e in days}})
    docs = docs_of(
        spark, tmp_path,
        A=quarter(("2021-12-31", 4), ("2021-09-30", 3), ("2021-01-11", 2), ("2020-12-23", 1)),  # 10 days late, 9 days early
        B=quarter(("2021-12-31", 4), ("2020-11-01", 1)),
        C=quarter(("2022-03-31", None), ("2021-12-31", "5"), ("2020-12-11", 1), ("2021-01-22", 2)),  # 21 days either way
        D=quarter(("2021-12-31", "n/a")),
    )
    got = {r.symbol: (r.eps_now, r.eps_ago) for r in facts.quarters(docs).collect()}
    assert got == {"A": (4.0, 1.0), "B": (4.0, None), "C": (5.0, 2.0)}


def test_payout_has_three_bases(spark, tmp_path):
    year = {"2021-12-31": {"epsActual": 4}, "2022-12-31": {"epsActual": 9}}
    four = {x: {"epsActual": 0.5} for x in ("2021-03-31", "2021-06-30", "2021-09-30", "2021-12-31")}
    gaps = {x: {"epsActual": 0.5} for x in ("2020-03-31", "2021-06-30", "2021-09-30", "2021-12-31")}
    cash = {"Cash_Flow": {"yearly": {"2021-12-31": {"dividendsPaid": "-30"}, "2020-12-31": {"dividendsPaid": -1, "netIncome": 1}}}, "Income_Statement": {"yearly": {"2021-12-31": {"netIncome": "50"}}}}
    docs = docs_of(
        spark, tmp_path,
        A=company(Earnings={"Annual": year, "History": four}), B=company(Earnings={"History": four}, Financials=cash), C=company(Earnings={"History": gaps}, Financials=cash),
        D=company(Earnings={"Annual": {"2021-12-31": {"epsActual": -1}}}, Financials=cash), E=company(),
    )
    pays = spark.createDataFrame([(s, x, 0.6) for s in "ABCDE" for x in (DAY(2020, 12, 31), DAY(2021, 1, 1), DAY(2021, 12, 31), DAY(2022, 3, 1))], "symbol string, ex_date date, amount double")
    got = {r.symbol: (r.status, r.basis, r.payout_percent, r.band) for r in facts.payout_bases(docs, pays, "2022-06-30").collect()}
    assert got["A"] == ("available", "fiscal_year", 30.0, "Moderate") and got["B"] == ("available", "trailing_twelve_months", 60.0, "Moderate")
    assert got["C"] == ("available", "aggregate_cash_basis", 60.0, "Moderate")
    assert got["D"] == ("not_meaningful", None, None, None) and got["E"] == ("unavailable", None, None, None)


@pytest.mark.parametrize("text,want", [("1.5", 1.5), (" 2 ", 2.0), ("NaN", None), ("inf", None), ("None", None), ("", None), ("x", None), ("-", None), ("-3e2", -300.0)])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(d.number("x").alias("y")).first().y == want
