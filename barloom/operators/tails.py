"""Chart tails from stored state: the last bars with indicators, without walking the history.

Exponential means need all bars before them, or one number that stands for those.
A table keeps these numbers (``STATE``) for each symbol at the end of each month, and
where its history begins.  A tail starts from the newest state that lies far enough
back, so it reads its own bars and those of a month or two before; the table is
extended from its own newest states in the same way.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
#: After ``i`` bars: the last close, EMAs by span, Wilder means of range, rises and falls, and the MACD's signal.
NUMBERS = ["close", "e8", "e12", "e21", "e26", "e50", "range", "up", "down", "signal"]
STATE = T.StructType(
    [
        T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), T.StructField("i", T.LongType())
    ] + [T.StructField(x, T.DoubleType()) for x in NUMBERS]
)
SPANS = (8, 12, 21, 26, 50)
VIEW = ["ema8", "ema21", "ema50", "rsi", "atr", "macd", "signal", "hist"]


def _mean(before: float | None, x: pd.Series, alpha: float) -> pd.Series:
    """The exponential mean of ``x`` that goes on from ``before``."""
    first = pd.Series([before], dtype=float)
    return pd.concat([first, x]).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().iloc[1:] if before is not None and before == before else x.ewm(alpha=alpha, adjust=False).mean()


def walk(f: pd.DataFrame, state: dict) -> pd.DataFrame:
    """Bars in date order that follow a state, with its numbers after each of them."""
    f = f.sort_values("date").reset_index(drop=True)
    out = pd.DataFrame({"date": f["date"], "i": state["i"] + 1 + f.index, "close": f["close"]})
    before = f["close"].shift()
    if len(f) and state["i"] > 0:
        before.iloc[0] = state["close"]
    for n in SPANS:
        out[f"e{n}"] = _mean(state[f"e{n}"], f["close"], 2 / (n + 1))
    spread = pd.concat([f["high"] - f["low"], (f["high"] - before).abs(), (f["low"] - before).abs()], axis=1).max(axis=1)
    out["range"] = _mean(state["range"], spread, 1 / 14)
    change = f["close"] - before
    out["up"] = _mean(state["up"], change.clip(lower=0), 1 / 14)
    out["down"] = _mean(state["down"], -change.clip(upper=0), 1 / 14)
    out["signal"] = _mean(state["signal"], (out["e12"] - out["e26"]).where(out["i"] >= 26), 0.2)
    return out


def view(w: pd.DataFrame) -> pd.DataFrame:
    """Indicators from the numbers; null until their window is full."""
    i, macd = w["i"], w["e12"] - w["e26"]
    rsi = (100 - 100 / (1 + w["up"] / w["down"].where(w["down"] > 0))).where(w["down"] != 0, 100.0)
    columns = {f"ema{n}": w[f"e{n}"].where(i >= n) for n in (8, 21, 50)}
    columns |= {
        "rsi": rsi.where(i >= 15), "atr": w["range"].where(i >= 14), "macd": macd.where(i >= 26), "signal": w["signal"].where(i >= 34),
        "hist": (macd - w["signal"]).where(i >= 34)
    }
    return pd.DataFrame(columns)


def first_states(bars: DataFrame) -> DataFrame:
    """The empty state of each symbol, dated the day before its first bar."""
    none = [F.lit(None).cast("double").alias(x) for x in NUMBERS]
    return bars.groupBy("symbol").agg(F.date_sub(F.min("date"), 1).alias("date")).select("symbol", "date", F.lit(0).cast("long").alias("i"), *none)


def newest(states: DataFrame, back: int = 0) -> DataFrame:
    """Each symbol's newest state that has at least ``back`` bars before its last known one."""
    last = F.max("i").over(Window.partitionBy("symbol"))
    some = states.withColumn("__last", last).where((c("i") == 0) | (c("i") <= c("__last") - back))
    return some.groupBy("symbol").agg(F.max_by(F.struct(*STATE.fieldNames()[1:]), "i").alias("s")).select("symbol", "s.*")


def _after(bars: DataFrame, starts: DataFrame, partitioned: bool) -> DataFrame:
    """Bars after each symbol's state, beside it; of a table in partitions of the year
    only those from the earliest state on are read (one date comes to the driver)."""
    if partitioned:
        early = starts.agg(F.min("date")).first()[0]
        bars = bars.where(c("year") >= early.year) if early else bars
    side = starts.select("symbol", F.struct(*STATE.fieldNames()[1:]).alias("state"))
    return bars.select("symbol", "date", "high", "low", "close").join(side, "symbol").where(c("date") > c("state.date"))


def month_states(bars: DataFrame, states: DataFrame | None = None, partitioned: bool = False) -> DataFrame:
    """States at the end of each month that isn't in ``states`` yet, whose last bar is known
    to be its last (a later month has begun); with the empty ones if there are none."""
    old = first_states(bars) if states is None else states
    schema = STATE

    def job(f: pd.DataFrame) -> pd.DataFrame:
        w = walk(f.drop(columns="state"), f["state"].iloc[0])
        month = pd.to_datetime(w["date"]).dt.to_period("M")
        w = w[month != month.shift(-1, fill_value=month.iloc[-1])]
        return w.assign(symbol=f["symbol"].iloc[0])[schema.fieldNames()]

    new = _after(bars, newest(old), partitioned).groupBy("symbol").applyInPandas(job, schema)
    return old.unionByName(new) if states is None else new


def chart_tail(bars: DataFrame, states: DataFrame, n: int = 180, partitioned: bool = False) -> DataFrame:
    """The last ``n`` bars of every symbol with EMA 8, 21 and 50, RSI 14, ATR 14 and MACD
    12/26/9, equal to those of a walk over the whole history."""
    schema = T.StructType(
        [
            T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), T.StructField("close", T.DoubleType())
        ] + [T.StructField(x, T.DoubleType()) for x in VIEW]
    )

    def job(f: pd.DataFrame) -> pd.DataFrame:
        w = walk(f.drop(columns="state"), f["state"].iloc[0])
        out = pd.concat([w[["date", "close"]], view(w)], axis=1).tail(n)
        return out.assign(symbol=f["symbol"].iloc[0])[schema.fieldNames()]

    return _after(bars, newest(states, n), partitioned).groupBy("symbol").applyInPandas(job, schema)
