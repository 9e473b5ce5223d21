"""Bars from trades: their memory follows the days, not the trades, and every order of a day is exact."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest

import __spark_entry__
from barloom.sources import bars as b

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans by name of the tables that are stored, with parts too many to broadcast."""
    found, real = {}, b.stored

    def spy(spark, name, sources, make, **settings):
        def noted():
            rows = make()
            found[name] = rows._jdf.queryExecution().executedPlan().toString()
            return rows

        return real(spark, name, sources, noted, **settings)

    b.drop_stored(spark)
    monkeypatch.setattr(b, "stored", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield found
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    b.drop_stored(spark)


@pytest.mark.parametrize("query", ["graham_valuation", "snapshots_for_bars", "composite_score", "snapshot_refreshes"])
def test_trades_are_not_sorted(spark, plans, query):
    __spark_entry__.queries()[query](spark, SMOKE)
    read = {name: plan for name, plan in plans.items() if "lineitem" in plan}
    assert "stocks" in read
    # all trades meet hash tables only; what is sorted are the trades at both ends of a day
    assert all("Sort" not in plan or "LeftSemi" in plan for plan in read.values())


def _semi(plan):
    """The kinds of join by which trades at the ends of a day are found."""
    return re.findall(r"(\w+Join) .*LeftSemi", plan)


@pytest.mark.parametrize("query", ["snapshots_for_bars", "composite_score", "snapshot_refreshes"])
def test_ends_of_days_meet_unsorted_trades(spark, plans, query):
    # a threshold below the days' size must not lead to a merge join, which sorts all trades
    __spark_entry__.queries()[query](spark, SMOKE)
    assert _semi(plans["stocks"]) == ["BroadcastHashJoin"]


def _dealt(plan):
    """The numbers of partitions that all trades are dealt to by part."""
    return {int(n) for n in re.findall(r"hashpartitioning\(l_partkey#\d+L?, (\d+)\)", plan)}


@pytest.mark.parametrize("query", ["composite_score", "snapshot_refreshes"])
def test_trades_are_not_gathered_by_a_shuffle_to_many_partitions(spark, plans, query):
    # a shuffle to over 200 partitions holds and sorts what a task has read
    name, made = "spark.sql.shuffle.partitions", lambda: __spark_entry__.queries()[query](spark, SMOKE)
    few = {tuple(x) for x in made().collect()}
    before = spark.conf.get(name)
    assert _dealt(plans["stock_days"]) == _dealt(plans["stocks"]) == {int(before)}
    b.drop_stored(spark)
    spark.conf.set(name, "203")
    try:
        assert {tuple(x) for x in made().collect()} == few
        assert _dealt(plans["stock_days"]) == _dealt(plans["stocks"]) == {200}
        assert spark.conf.get(name) == "203"
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("first", ["200", "500"])
def test_first_number_of_partitions_is_bounded_and_put_back(spark, first):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert spark.conf.get(name, None) is None
    spark.conf.set(name, first)
    try:
        with pytest.raises(ZeroDivisionError), b.written_as_they_come(spark):
            assert spark.conf.get(name) == "200"
            1 / 0
        assert spark.conf.get(name) == first
    finally:
        spark.conf.unset(name)


DAYS = [dt.datetime(1998, 5, 30, 12), dt.datetime(1998, 6, 1), dt.datetime(1998, 6, 2, 23), None]


@pytest.fixture
def trades(spark, tmp_path):
    """A few days with many trades each: keys that tie in all columns but the last, and nulls."""
    r = random.Random(7)
    rows = [
        (r.choice([None, 1, 2, 3]), r.choice([None, 1, 2]), r.choice([None, 1, 2, 3, 4]), r.choice([1, 2]), float(r.randint(1, 50)), r.randint(1000, 99999) / 10,
         r.choice("AR"), r.choice("FO"), r.choice(DAYS))
        for _ in range(400)
    ]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    brands = [(1, "B1"), (2, "B2"), (3, None), (4, "B1"), (4, "B2")]
    spark.createDataFrame(brands, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    yield str(tmp_path), rows, brands
    b.drop_stored(spark)


def _walk(named):
    """Bars by a plain loop; a null comes first in a key."""
    groups = {}
    for symbol, (order, line, part, supplier, quantity, amount, _, _, at) in named:
        key = tuple((x is not None, x or 0) for x in (order, line, part, supplier, amount))
        groups.setdefault((symbol, at and at.date()), []).append((key, (10000 + int(amount / 10 // 1)) / 100, quantity))
    out = set()
    for (symbol, date), found in groups.items():
        first, last = min(found), max(found)
        prices = [p for _, p, _ in found]
        factor = b.SPLIT_FACTOR if date and date < dt.date(1998, 6, 1) else 1.0
        out.add((symbol, date, first[1], max(prices), min(prices), last[1], round(last[1] * factor, 4), int(sum(q for *_, q in found))))
    return out


def test_stock_bars_with_ties_and_nulls(spark, trades):
    sf_dir, rows, brands = trades
    want = _walk([(brand, x) for x in rows for part, brand in brands if part == x[2]])
    got = [tuple(x) for x in b.bars_stock(spark, sf_dir).collect()]
    assert len(got) == len(want) == 12 and set(got) == want


def test_fund_bars_with_ties_and_nulls(spark, trades):
    sf_dir, rows, _ = trades
    want = _walk([(x[6] + x[7], x) for x in rows])
    got = [tuple(x) for x in b.bars(spark, sf_dir).collect()]
    assert len(got) == len(want) == 16 and set(got) == want


@pytest.mark.parametrize("most, join", [(0, "ShuffledHashJoin"), (1000, "BroadcastHashJoin")])
def test_many_and_few_days(spark, plans, trades, monkeypatch, most, join):
    sf_dir, rows, brands = trades
    monkeypatch.setattr(b, "FEW_DAYS", most)
    stocks, funds = ({tuple(x) for x in f(spark, sf_dir).collect()} for f in (b.bars_stock, b.bars))
    assert stocks == _walk([(brand, x) for x in rows for part, brand in brands if part == x[2]])
    assert funds == _walk([(x[6] + x[7], x) for x in rows])
    assert _semi(plans["stocks"]) == _semi(plans["bars"]) == [join]
