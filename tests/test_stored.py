"""Stored states, year partitions, keyed results, versions of nested folders, and outcomes."""

from __future__ import annotations

import datetime
import io
import os
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.recursive import INDICATORS, with_indicators
from barloom.operators import models as m
from barloom.operators import tails
from barloom.operators.scans import for_ranges
from barloom.plans.results import Results, canonical, fingerprint
from barloom.sources import bars as sb
from barloom.sources.bars import BAR


def series(n, seed, symbol, first="2018-01-01"):
    rng = np.random.default_rng(seed)
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), 2)
    days = pd.bdate_range(first, periods=n).date
    return pd.DataFrame({"symbol": symbol, "date": days, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "adjusted_close": close, "volume": 5})


@pytest.fixture
def bars(spark):
    some = [series(700, 1, "A"), series(260, 2, "B", "2019-06-03"), series(20, 3, "C"), series(1, 4, "D"), series(33, 5, "E")]
    return spark.createDataFrame(pd.concat(some), BAR)


@pytest.mark.parametrize("n", [1, 30, 180])
def test_tails_equal_a_walk_over_all_bars(spark, bars, n):
    states = tails.month_states(bars).cache()
    got = tails.chart_tail(bars, states, n).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    want = with_indicators(bars, INDICATORS, n).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    assert got["date"].tolist() == want["date"].tolist() and len(got) == sum(min(n, k) for k in (700, 260, 20, 1, 33))
    for name in tails.VIEW:
        assert np.allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, equal_nan=True), name


def test_states_extend_like_one_walk(spark, bars):
    whole = {tuple(r)[:3]: r for r in tails.month_states(bars).collect()}
    early = tails.month_states(bars.where("date < '2019-08-20'"))
    new = tails.month_states(bars, early)
    both = early.unionByName(new).collect()
    # symbols that begin later get their empty state when they are seen first
    assert {tuple(r)[:3] for r in both} == set(whole)
    for r in both:
        for x in tails.NUMBERS:
            a, b = r[x], whole[tuple(r)[:3]][x]
            assert (a is None and b is None) or np.isnan(a) and np.isnan(b) or a == pytest.approx(b, rel=1e-12)


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_ranges_prune_years(spark, bars, tmp_path):
    bars.withColumn("year", F.year("date")).write.partitionBy("year").parquet(f"{tmp_path}/y")
    ranges = [("A", datetime.date(2018, 12, 20), datetime.date(2019, 1, 10), 1), ("B", datetime.date(2019, 7, 1), datetime.date(2019, 7, 1), 1), ("A", datetime.date(2019, 1, 9), datetime.date(2019, 1, 10), 1), ("A", datetime.date(2020, 1, 1), datetime.date(2019, 1, 1), 1), ("A", datetime.date(2020, 1, 1), datetime.date(2020, 9, 1), 2)]
    spark.createDataFrame(ranges, "symbol string, start date, stop date, k int").write.parquet(f"{tmp_path}/r")
    stored = spark.read.parquet(f"{tmp_path}/y")
    found = for_ranges(stored, spark.read.parquet(f"{tmp_path}/r").where("k = 1"))
    rows = [(r.symbol, r.date) for r in bars.collect()]
    want = sorted((s, d, a) for s, a, z, k in ranges if k == 1 for x, d in rows if x == s and a <= d <= z)
    assert sorted((r.symbol, r.date, r.start) for r in found.collect()) == want and len(want) > 10
    assert "dynamicpruning" in plan_of(found)


def test_a_tail_reads_late_partitions_alone(spark, bars, tmp_path):
    late = bars.where("symbol in ('A', 'B')")
    late.withColumn("year", F.year("date")).write.partitionBy("year").parquet(f"{tmp_path}/y")
    states = tails.month_states(late)
    stored = spark.read.parquet(f"{tmp_path}/y")
    found = tails.chart_tail(stored, states, 20, partitioned=True)
    assert found.count() == 40
    assert "year" in plan_of(found) and ">= 2020" in plan_of(found)  # the newest bars are of 2020


def test_fingerprints():
    one = {"gate": 5, "spans": (1, 2), "on": datetime.date(2020, 1, 2), "names": {"b", "a"}}
    same = {"names": {"a", "b"}, "on": "2020-01-02", "spans": [1, 2], "gate": 5.0}
    assert fingerprint(one) == fingerprint(same) and len(fingerprint(one)) == 16
    others = [one | {"gate": 6}, one | {"spans": (2, 1)}, one | {"more": None}, one | {"gate": 5.5}, one | {"gate": "5"}, one | {"gate": True}]
    assert len({fingerprint(x) for x in [one, *others]}) == 7
    assert canonical({"b": 1, "a": [1.0, (2,)]}) == {"a": [1, [2]], "b": 1}
    with pytest.raises(TypeError):
        fingerprint({"x": object()})


def test_results_are_found_again(spark, tmp_path):
    results, made = Results(spark, f"{tmp_path}/r"), []

    def make(k):
        made.append(k)
        return spark.range(k)

    get = lambda newest, settings, k, **age: results.get_or_compute("x", newest, settings, lambda: make(k), **age).count()
    assert get("2020-01-01", {"a": 1, "b": 2}, 3) == 3 and get("2020-01-01", {"b": 2, "a": 1}, 9) == 3
    assert get("2020-01-02", {"a": 1, "b": 2}, 4) == 4  # a newer bar
    assert get("2020-01-01", {"a": 1, "b": 3}, 5) == 5
    assert (made, results.hits, results.misses) == ([3, 4, 5], 1, 3)
    assert get("2020-01-01", {"a": 1, "b": 2}, 6, most_age=-1) == 6 and get("2020-01-01", {"a": 1, "b": 2}, 7) == 6  # expired
    with pytest.raises(ZeroDivisionError):
        results.get_or_compute("y", "2020-01-01", {}, lambda: spark.range(1 // 0))
    assert results.get_or_compute("y", "2020-01-01", {}, lambda: make(8)).count() == 8  # the failure wasn't stored
    results.drop("x", "2020-01-01")
    assert get("2020-01-01", {"a": 1, "b": 3}, 2) == 2 and get("2020-01-02", {"a": 1, "b": 2}, 1) == 4


def test_nested_new_files_make_a_new_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    one = sb._version(spark, path)
    assert one == sb._version(spark, path)
    spark.range(10, 11).withColumn("p", F.col("id") % 2).write.mode("append").partitionBy("p").parquet(path)
    assert sb._version(spark, path) != one


def test_stored_tables_are_dropped(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/src")
    rows = lambda: spark.createDataFrame(series(30, 1, "A"), BAR)
    sb.stored(spark, "probe", [f"{tmp_path}/src"], rows, by_year=True).count()
    names = [v for k, v in sb._STORE.items() if k[1] == "probe"]
    assert len(names) == 1 and spark.catalog.tableExists(names[0])
    where = f"{sb.shared_dir(spark)}/{names[0]}".removeprefix("file://")
    assert os.path.isdir(where)
    assert sb.drop_stored(spark) >= 1
    assert not spark.catalog.tableExists(names[0]) and not os.path.isdir(where)


def test_one_bad_series_costs_its_own_row(spark):
    broken = series(300, 6, "X")
    broken.loc[5, "close"] = -1.0
    df = spark.createDataFrame(pd.concat([series(300, 1, "A"), series(40, 2, "B"), broken]), BAR)
    members = spark.createDataFrame([("A",), ("B",), ("X",), ("Q",)], "symbol string")
    got = {r.symbol: (r.status, r.reason) for r in m.with_absent(m.hmm_regime(df, explain=True), members).collect()}
    assert got == {"A": ("OK", None), "B": ("UNAVAILABLE", "120 bars are needed, there are 40"), "X": ("UNAVAILABLE", "1 closes are no positive numbers"), "Q": ("UNAVAILABLE", "no bars")}
    assert [r.symbol for r in m.hmm_regime(df).collect()] == ["A"]

    def fails(f):
        if f["symbol"].iloc[0] == "A":
            raise ValueError("inside")
        return {"x": 1.0}

    got = {r.symbol: (r.x, r.status, r.reason) for r in m.per_symbol(df, fails, "symbol string, x double", explain=True).collect()}
    assert got["A"] == (None, "ERROR", "calculation failed: ValueError") and got["B"] == (1.0, "OK", None)
    with pytest.raises(Exception, match="inside"):
        m.per_symbol(df, fails, "symbol string, x double").collect()
