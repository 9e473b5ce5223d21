"""Versioned bars: replays, crashes, readers during a change, pruning, the audit."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barloom.sources import versions
from barloom.sources.bars import BAR
from barloom.sources.versions import BarStore, valid_bars
from barloom.streaming import bars as st


def bar(symbol, day, close=10.0, adjusted=None, high=None, low=None):
    return (symbol, day, close, high, low, close, adjusted, 5)


def frame(spark, rows):
    return spark.createDataFrame(rows, BAR)


def day(y, m, d):
    return datetime.date(y, m, d)


def contents(df):
    return {(r.symbol, r.date): (r.open, r.high, r.low, r.close, r.adjusted_close, r.volume) for r in df.collect()}


def counts(store):
    return [tuple(r[c] for c in versions.COUNTS) for r in store.runs().orderBy("version").collect()]


def test_upserts_like_a_dictionary(spark, tmp_path):
    """Random batches with repeated keys, bad rows and corrections, against plain Python."""
    rng = random.Random(4)
    store, held = BarStore(spark, f"{tmp_path}/s"), {}
    for number in range(4):
        rows, good, received = [], {}, 0
        for _ in range(60):
            close = rng.choice([1.5, 2.5, 3.0, None, -1.0, 0.0])
            high, low = rng.choice([(None, None), (4.0, 1.0), (1.0, 4.0)])
            r = bar(rng.choice(["A", "B", None, "C"]), rng.choice([None, day(1999 + rng.randrange(3), 1 + rng.randrange(4), 3)]), close, rng.choice([None, 0.5, 0.25]), high, low)
            rows.append(r)
            if r[0] and r[1] and close is not None and close > 0 and (high is None or high >= low):
                good.setdefault(r[:2], []).append(r)
        before = len(held)
        inserted = restated = unchanged = 0
        for key, some in good.items():
            none_first = lambda x: (x is not None, x or 0)
            last = max(some, key=lambda r: [none_first(r[5]), none_first(r[2]), none_first(r[3]), none_first(r[4]), none_first(r[6])])
            new = (last[2] or 0.0, last[3] or 0.0, last[4] or 0.0, last[5], last[6] if last[6] is not None else last[5], last[7])
            if key not in held:
                held[key] = new
                inserted += 1
            elif held[key][4] != new[4]:
                held[key] = (*held[key][:4], new[4], held[key][5])
                restated += 1
            else:
                unchanged += 1
        received = len(rows)
        store.upsert(frame(spark, rows).repartition(3), "s", number)
        assert contents(store.read()) == held
        n_good = sum(map(len, good.values()))
        assert counts(store)[-1] == (received, received - n_good, n_good - len(good), inserted, restated, unchanged, before, len(held))


def test_replay_and_first_write_wins(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/s")
    assert store.read().count() == 0 and store.runs().count() == 0
    store.upsert(frame(spark, [bar("A", day(2000, 1, 3), 10.0, 5.0)]), "x", 0)
    again = store.upsert(frame(spark, [bar("A", day(2000, 1, 3), 10.0, 7.0)]), "x", 0)
    assert again.number == 1 and contents(store.read())[("A", day(2000, 1, 3))][4] == 5.0
    store.upsert(frame(spark, [bar("A", day(2000, 1, 3), 99.0, 7.0), bar("B", day(2000, 1, 3))]), "x", 1, restate=False)
    got = contents(store.read())
    assert got[("A", day(2000, 1, 3))][3:5] == (10.0, 5.0) and len(got) == 2
    store.upsert(frame(spark, []), "x", 2)
    assert store.version().number == 3 and store.read().count() == 2


def test_a_crash_leaves_the_old_version_and_a_trace(spark, tmp_path, monkeypatch):
    store = BarStore(spark, f"{tmp_path}/s")
    store.upsert(frame(spark, [bar("A", day(2000, 1, 3))]), "x", 0)
    real = BarStore._put

    def fail(self, name, content):
        if name.startswith("versions/"):
            raise OSError("lost")
        real(self, name, content)

    monkeypatch.setattr(BarStore, "_put", fail)
    with pytest.raises(OSError):
        store.upsert(frame(spark, [bar("B", day(2000, 1, 4))]), "x", 1)
    assert store.version().number == 1 and store.read().count() == 1
    assert [r.status for r in store.runs().orderBy("version").collect()] == ["success", "running"]
    monkeypatch.setattr(BarStore, "_put", real)
    store.upsert(frame(spark, [bar("B", day(2000, 1, 4))]), "x", 1)
    assert store.read().count() == 2 and [r.status for r in store.runs().collect()] == ["success"] * 2


def test_readers_keep_their_version(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/s")
    store.upsert(frame(spark, [bar("A", day(y, 1, 3)) for y in (1999, 2000, 2001)]))
    early = store.read()
    store.upsert(frame(spark, [bar("A", day(2000, 1, 3), 10.0, 1.0)]))
    assert {r.adjusted_close for r in early.collect()} == {10.0}
    assert sorted(r.adjusted_close for r in store.read().collect()) == [1.0, 10.0, 10.0]
    assert sorted(r.adjusted_close for r in store.read(1).collect()) == [10.0] * 3
    # only the touched partition has a new folder
    one, two = store.version(1).parts, store.version(2).parts
    assert [k for k in two if one[k] != two[k]] == [k for k in two if k.startswith("2000-")]
    assert {f.split("part=")[1][:4] for f in store.read(years=(2000, 2000)).inputFiles()} == {"2000"}
    assert store.expire(2) == [] and store.expire(1) == []  # both folders are still in use
    store.upsert(frame(spark, [bar("A", day(y, 1, 3), 10.0, 2.0) for y in (1999, 2000, 2001)]))
    assert len(store.expire(1)) == 2 and store.read().count() == 3


def test_stream_of_corrections_restarts(spark, tmp_path):
    """Files that come later go on from the checkpoint; a second start without files adds no version."""
    first = [bar("A", day(2000, 1, d)) for d in (3, 4, 5)]
    frame(spark, first).coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(BAR).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = st.restating_sink(read(), f"{tmp_path}/s", f"{tmp_path}/state")
    assert store.version().number == 1
    st.restating_sink(read(), f"{tmp_path}/s", f"{tmp_path}/state")
    assert store.version().number == 1
    frame(spark, [bar("A", day(2000, 1, 4), 10.0, 2.0), bar("A", day(2000, 1, 6))]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    st.restating_sink(read(), f"{tmp_path}/s", f"{tmp_path}/state")
    assert counts(store) == [(3, 0, 0, 3, 0, 0, 0, 3), (2, 0, 0, 1, 1, 0, 3, 4)]


def test_valid_bars(spark):
    rows = [bar("A", day(2000, 1, 3)), bar("A", day(2000, 1, 3), float("nan")), bar("A", None), bar(None, day(2000, 1, 3)), bar("A", day(2000, 1, 3), 1.0, None, 1.0, 2.0), bar("A", day(2000, 1, 3), 1.0, None, None, 2.0)]
    assert [r.ok for r in frame(spark, rows).select(valid_bars(None).alias("ok")).collect()] == [True, False, False, False, False, True]


def test_updates_of_several_batches(spark, tmp_path):
    rows = [(k, f"e{k % 2}", float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, kind string, x double")
    stream = st.in_order(df, f"{tmp_path}/in", "id", [7, 20, 33])
    sums = stream.groupBy("kind").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    got = {r.kind: (r.n, r.total) for r in st.run_updates(sums, str(tmp_path), "kind", "n").collect()}
    assert got == {f"e{p}": (20, sum(float(k) for k in range(40) if k % 2 == p)) for p in (0, 1)}
