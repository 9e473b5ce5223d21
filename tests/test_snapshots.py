"""Two-time reads against plain loops, and refreshes that fail."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from barloom.operators import snapshots as sn

SCHEMA = "symbol string, valid_from date, recorded_at timestamp, ok boolean, eps double, n long"
DAY = datetime.timedelta(days=1)
BEGIN = datetime.datetime(2020, 1, 1)


def rows(seed=1, n=300):
    rng, out = random.Random(seed), []
    for k in range(n):
        valid, late = rng.randrange(40), rng.randrange(60)
        ok = rng.random() < 0.8
        out.append((rng.choice("abc"), (BEGIN + valid * DAY).date(), BEGIN + (valid + late) * DAY + datetime.timedelta(seconds=k), ok, float(k) if ok else None, k if ok else None))
    return out


def seen(snaps, symbol, valid, recorded):
    known = [s for s in snaps if s[0] == symbol and s[3] and s[1] <= valid and s[2] <= recorded]
    return max(known, key=lambda s: (s[1], s[2])) if known else None


def test_reads_as_of_two_times(spark):
    snaps = rows()
    df = spark.createDataFrame(snaps, SCHEMA).repartition(3)
    moments = [((BEGIN + v * DAY).date(), BEGIN + r * DAY) for v, r in ((0, 1), (10, 20), (35, 12), (39, 200), (20, 20))]
    got = {(r.symbol, r.moment): (r.valid_from, r.eps) for r in sn.as_of(df, [(str(v), str(r)) for v, r in moments]).collect()}
    want = {(s, k): seen(snaps, s, v, r) for s in "abc" for k, (v, r) in enumerate(moments)}
    assert got == {k: (s[1], s[4]) for k, s in want.items() if s}
    rng = random.Random(2)
    asks = [(rng.choice("abcd"), (BEGIN + rng.randrange(50) * DAY).date(), BEGIN + rng.randrange(90) * DAY, k) for k in range(200)]
    found = sn.as_of_join(spark.createDataFrame(asks, "symbol string, valid date, recorded timestamp, k long"), df).collect()
    assert len(found) == len(asks)
    for r in found:
        s = seen(snaps, *asks[r.k][:3])
        assert (r.valid_from, r.recorded_at, r.eps) == ((s[1], s[2], s[4]) if s else (None, None, None))
    assert {(r.symbol, r.eps) for r in sn.latest(df).collect()} == {(s, seen(snaps, s, datetime.date(2030, 1, 1), datetime.datetime(2030, 1, 1))[4]) for s in "abc"}


def test_a_failed_refresh_keeps_the_last_value(spark):
    members = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "symbol string")
    first = spark.createDataFrame([("a", datetime.date(2020, 3, 31), 1.0, 2), ("b", datetime.date(2020, 3, 31), None, None), ("z", datetime.date(2020, 3, 31), 9.0, 9)], "symbol string, valid_from date, eps double, n long")
    one = sn.refreshed(first, members, F.lit("2020-05-01"), ["eps", "n"])
    two = sn.refreshed(first.where("symbol = 'z'"), members, F.lit("2020-06-01"), ["eps", "n"])
    both = one.unionByName(two)
    assert sorted((r.symbol, r.ok, r.eps) for r in one.collect()) == [("a", True, 1.0), ("b", False, None), ("c", False, None)]
    assert [(r.symbol, r.eps) for r in sn.latest(both).collect()] == [("a", 1.0)]
    counts = sn.refresh_counts(both, F.date_format("recorded_at", "yyyy-MM")).orderBy("run").collect()
    assert [tuple(r) for r in counts] == [("2020-05", 1, 2), ("2020-06", 0, 3)]
    assert sn.as_of(both.limit(0), [("2020-01-01", "2020-01-01")]).count() == 0
