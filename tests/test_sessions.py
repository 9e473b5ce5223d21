"""Sessions over clock changes, days off, sessions across midnight, and timers."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from barloom.streaming import bars as st
from barloom.streaming import sessions as ss

UTC = datetime.timezone.utc
HOURS = {"NY": ("America/New_York", "09:30", "16:00"), "SYD": ("Australia/Sydney", "10:00", "16:00"), "HK": ("Asia/Hong_Kong", "09:30", "16:00")}


def clock(text):
    return datetime.time(*map(int, text.split(":")))


def test_intraday_bars_like_plain_python(spark):
    rng = random.Random(2)
    rows = []
    for k in range(6000):
        ts = datetime.datetime(2024, 3, 7, tzinfo=UTC) + datetime.timedelta(seconds=rng.randrange(40 * 86400))
        rows.append((rng.choice(list(HOURS)), rng.choice("ab"), ts, k, float(rng.randrange(1, 90)) if k % 50 else None))
    edge = datetime.datetime(2024, 3, 11, 13, 30, tzinfo=UTC)  # New York opens an hour earlier in UTC than on the 8th
    rows += [("NY", "a", edge, 9001, 5.0), ("NY", "a", edge - datetime.timedelta(microseconds=1), 9002, 7.0), ("NY", "a", edge.replace(hour=20, minute=0), 9003, 9.0)]
    off = [("NY", datetime.date(2024, 3, 29)), ("HK", datetime.date(2024, 3, 29))]
    want = defaultdict(list)
    for x, s, ts, k, price in rows:
        zone, opens, closes = HOURS[x]
        here = ts.astimezone(ZoneInfo(zone))
        if price is not None and here.weekday() < 5 and clock(opens) <= here.time() < clock(closes) and (x, here.date()) not in off:
            begin = here.replace(hour=clock(opens).hour, minute=clock(opens).minute, second=0, microsecond=0)
            want[x, s, here.date(), int((here - begin).total_seconds() // 1800)].append((ts, k, price))
    exchanges = spark.createDataFrame([(x, *h) for x, h in HOURS.items()], "exchange string, zone string, opens string, closes string")
    sessions = ss.calendar(exchanges, "2024-03-01", "2024-04-30", spark.createDataFrame(off, "exchange string, date date"))
    trades = spark.createDataFrame(rows, "exchange string, symbol string, ts timestamp, id long, price double")
    got = {(r.exchange, r.symbol, r.date, r.slot): (r.open, r.high, r.low, r.close, r.volume) for r in ss.intraday_bars(trades, sessions, 30).collect()}
    assert got == {k: (min(v)[2], max(p for *_, p in v), min(p for *_, p in v), max(v)[2], len(v)) for k, v in want.items()}
    assert ("NY", "a", datetime.date(2024, 3, 11), 0) in got


def test_an_open_session_is_incomplete(spark):
    rows = [("A", datetime.date(2024, 3, d)) for d in (7, 8, 11)]
    bars = spark.createDataFrame(rows, "symbol string, date date")
    kept = lambda now: [r.date.day for r in ss.complete_bars(bars, now).orderBy("date").collect()]
    assert kept("2024-03-08 20:59:59") == [7, 11]  # 15:59:59 in New York
    assert kept("2024-03-08 21:00:00") == [7, 8, 11]
    assert kept("2024-03-11 19:59:59") == [7, 8] and kept("2024-03-11 20:00:00") == [7, 8, 11]  # summer time began
    assert kept("2024-03-12 03:00:00") == [7, 8, 11]


def test_closed_bars_of_a_stream_like_the_table(spark, tmp_path):
    rng = random.Random(3)
    begin = datetime.datetime(2024, 3, 7, 12, tzinfo=UTC)
    rows = [(rng.choice("ab"), begin + datetime.timedelta(seconds=i * 400 + rng.randrange(300)), i, float(rng.randrange(1, 50))) for i in range(1540)]
    trades = spark.createDataFrame(rows, "symbol string, ts timestamp, id long, price double")
    stream = st.in_order(trades, f"{tmp_path}/in", "ts", [begin + datetime.timedelta(days=d) for d in (1, 2, 4)])
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with ss.timers(spark):
        got = sorted(map(tuple, st.run_to_table(ss.closed_bars(stream, "1 hours"), str(tmp_path)).collect()))
    assert spark.conf.get(key) == before
    last = max(r[1] for r in rows) - ss.closing_delay("1 hours")
    want = sorted(map(tuple, ss.session_bars(trades, last).collect()))
    assert got == want and len(want) < ss.session_bars(trades).count()
    assert trades.where(F.col("symbol") == "a").count() > 100
