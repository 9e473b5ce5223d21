"""Sessions of exchanges: intraday bars of a table, and bars of closed sessions from a stream.

A session is a date of an exchange between its opening and closing time on the
exchange's clock, so its bounds in UTC move with the clock changes.  A calendar
has a row for each exchange and date; trades meet it on the exchange and the UTC
days that a session touches, so the join is on equal keys.  In a stream a bar is
held in state and emitted by a timer once the watermark has passed the closing
time; a session that may still take trades emits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ZONE, OPENS, CLOSES = "America/New_York", "09:30", "16:00"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "symbol string, date date, open double, high double, low double, close double, volume long"
STATE = "open double, high double, low double, close double, volume long, first_ts timestamp, first_id long, last_ts timestamp, last_id long"


def _utc(date: Column, clock: str | Column, zone: str | Column) -> Column:
    clock = F.lit(clock) if isinstance(clock, str) else clock
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), clock, F.lit(":00"))), zone)


def calendar(exchanges: DataFrame, first: str, last: str, holidays: DataFrame | None = None) -> DataFrame:
    """``exchange, zone, opens, closes`` (clock times as HH:mm) -> ``exchange, date, open_utc,
    close_utc`` for each weekday from ``first`` to ``last`` that isn't among ``holidays``
    (exchange, date)."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    rows = exchanges.withColumn("date", days).where(F.weekday("date") < 5)
    if holidays is not None:
        rows = rows.join(holidays.select("exchange", "date"), ["exchange", "date"], "left_anti")
    return rows.select(
        "exchange", "date", _utc(F.col("date"), F.col("opens"), F.col("zone")).alias("open_utc"),
        _utc(F.col("date"), F.col("closes"), F.col("zone")).alias("close_utc")
    )


def in_sessions(trades: DataFrame, sessions: DataFrame) -> DataFrame:
    """Trades ``exchange, ts, ...`` inside a session (from its opening to just before its
    closing time), with its ``date`` and ``open_utc``."""
    days = F.explode(F.sequence(F.to_date("open_utc"), F.to_date("close_utc")))
    rows = trades.withColumn("__day", F.to_date("ts")).join(sessions.withColumn("__day", days), ["exchange", "__day"])
    return rows.where((F.col("ts") >= F.col("open_utc")) & (F.col("ts") < F.col("close_utc"))).drop("__day", "close_utc")


def intraday_bars(trades: DataFrame, sessions: DataFrame, minutes: int = 60) -> DataFrame:
    """Bars of ``minutes`` counted from each session's opening: ``exchange, symbol, date,
    slot, ts, open, high, low, close, volume``; ``ts`` is the slot's start in UTC."""
    rows = in_sessions(trades.where(F.col("price").isNotNull()), sessions)
    slot = F.floor((F.unix_micros("ts") - F.unix_micros("open_utc")) / (minutes * 60_000_000))
    start = F.timestamp_micros(F.unix_micros("open_utc") + slot * (minutes * 60_000_000))
    key = F.struct("ts", "id")
    rows = rows.select("exchange", "symbol", "date", slot.alias("slot"), start.alias("start"), "price", key.alias("k"))
    return rows.groupBy("exchange", "symbol", "date", "slot", F.col("start").alias("ts")).agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"), F.count("*").alias("volume")
    )


def is_incomplete(date: str | Column, now: str | Column, zone: str = ZONE, closes: str = CLOSES) -> Column:
    """Whether a daily bar may still change at ``now`` (UTC): it is of the exchange's
    current date, and the session hasn't closed."""
    date = F.col(date) if isinstance(date, str) else date
    return (F.to_date(F.from_utc_timestamp(now, zone)) == date) & (now < _utc(date, closes, zone))


def complete_bars(bars: DataFrame, now: str | Column, **clock: str) -> DataFrame:
    """Daily bars without the one that may still be forming."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return bars.where(~is_incomplete("date", now, **clock))


def session_trades(trades: DataFrame, zone: str = ZONE, opens: str = OPENS, closes: str = CLOSES) -> DataFrame:
    """``symbol, ts, id, price`` trades inside sessions, with ``date`` and ``closing``."""
    local = F.from_utc_timestamp("ts", zone)
    clock, date = F.date_format(local, "HH:mm"), F.to_date(local)
    inside = (clock >= opens) & (clock < closes)
    return trades.where(inside & F.col("price").isNotNull()).select(
        "symbol", "ts", "id", "price", date.alias("date"), _utc(date, closes, zone).alias("closing")
    )


def session_bars(trades: DataFrame, as_of: str | datetime | None = None, **hours: str) -> DataFrame:
    """Bars of sessions in a table of trades; with ``as_of`` only sessions closed by then."""
    rows = session_trades(trades, **hours)
    key = F.struct("ts", "id")
    bars = rows.groupBy("symbol", "date", "closing").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.count("*").alias("volume")
    )
    bars = bars if as_of is None else bars.where(F.col("closing") <= F.lit(as_of).cast("timestamp"))
    return bars.select("symbol", "date", "open", "high", "low", "close", "volume")


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Use the state store that keeps timers, for the streams started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class ClosedBar(StatefulProcessor):
    """The bar of one symbol and session; emitted when its timer expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["ts", "id"])
        first, last = f.iloc[0], f.iloc[-1]
        held = self.bar.get() if self.bar.exists() else None
        if held is None:
            closing = first["closing"]
            self.handle.registerTimer(int(closing.timestamp() * 1000))
            held = (first["price"], first["price"], first["price"], first["price"], 0, first["ts"], first["id"], first["ts"], first["id"])
        opened, high, low, close, volume, first_ts, first_id, last_ts, last_id = held
        if (first["ts"], first["id"]) < (pd.Timestamp(first_ts), first_id):
            opened, first_ts, first_id = first["price"], first["ts"], first["id"]
        if (last["ts"], last["id"]) >= (pd.Timestamp(last_ts), last_id):
            close, last_ts, last_id = last["price"], last["ts"], last["id"]
        stamps = [pd.Timestamp(t).to_pydatetime() for t in (first_ts, last_ts)]
        self.bar.update(
            (
                float(opened), float(max(high, f["price"].max())), float(min(low, f["price"].min())), float(close), int(volume + len(f)), stamps[0],
                int(first_id), stamps[1], int(last_id)
            )
        )
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened, high, low, close, volume = self.bar.get()[:5]
        self.bar.clear()
        yield pd.DataFrame(
            {"symbol": [key[0]], "date": [key[1]], "open": [opened], "high": [high], "low": [low], "close": [close], "volume": [volume]}
        )

    def close(self) -> None:
        pass


def closed_bars(trades: DataFrame, late: str = "2 hours", **hours: str) -> DataFrame:
    """Bars of closed sessions from a stream ``symbol, ts, id, price``; trades later than
    the watermark are left out.  Start it inside ``timers``."""
    rows = session_trades(trades.withWatermark("ts", late), **hours)
    return rows.groupBy("symbol", "date").transformWithStateInPandas(ClosedBar(), outputStructType=BAR, outputMode="Append", timeMode="EventTime")


def closing_delay(late: str) -> timedelta:
    """The watermark's delay as a span of time."""
    n, unit = late.split()
    return pd.Timedelta(f"{n} {unit}").to_pytimedelta()
