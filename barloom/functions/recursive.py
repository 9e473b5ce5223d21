"""Series that depend on their own past, one symbol's history at a time.

Catalyst has no recursive window, so these run as grouped pandas functions:
Spark deals the symbols, and one group is the history of one symbol (bounded by
its trading days).  Exponential means use pandas' vectorised ``ewm``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ema(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(span=n, adjust=False, min_periods=n).mean()


def wilder(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def rsi(close: pd.Series, n: int = 14) -> pd.Series:
    change = close.diff()
    up, down = wilder(change.clip(lower=0), n), wilder(-change.clip(upper=0), n)
    out = 100 - 100 / (1 + up / down.where(down > 0))
    return out.where(~(down == 0), 100.0).where(down.notna())


def atr(f: pd.DataFrame, n: int = 14) -> pd.Series:
    before = f["close"].shift()
    spread = pd.concat([f["high"] - f["low"], (f["high"] - before).abs(), (f["low"] - before).abs()], axis=1).max(axis=1)
    return wilder(spread, n)


def supertrend(f: pd.DataFrame, n: int, k: float) -> tuple[np.ndarray, np.ndarray]:
    """Line and direction (+1, -1; 0 and NaN before the first full ATR)."""
    middle, band = ((f["high"] + f["low"]) / 2).to_numpy(), k * atr(f, n).to_numpy()
    close = f["close"].to_numpy()
    line, side = np.full(len(f), np.nan), np.zeros(len(f), int)
    up = down = np.nan
    for i in np.flatnonzero(~np.isnan(band)):
        top, bottom = middle[i] + band[i], middle[i] - band[i]
        if i == 0 or side[i - 1] == 0:
            up, down, side[i] = top, bottom, 1 if close[i] >= middle[i] else -1
        else:
            up = top if top < up or close[i - 1] > up else up
            down = bottom if bottom > down or close[i - 1] < down else down
            side[i] = 1 if side[i - 1] < 0 and close[i] > up else -1 if side[i - 1] > 0 and close[i] < down else side[i - 1]
        line[i] = down if side[i] > 0 else up
    return line, side


INDICATORS = ["ema8", "ema21", "ema50", "rsi", "atr", "macd", "signal", "hist"]


def with_indicators(bars: DataFrame, names: list[str] | None = None, last: int | None = None) -> DataFrame:
    """Bars with the indicators ``names`` (all): EMA 8, 21 and 50, RSI 14, ATR 14
    and MACD 12/26/9 of the close; with ``last``, only that many rows a symbol
    come back.

    Values are null until their window is full.
    """
    names = names or INDICATORS

    def job(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("date", ignore_index=True)
        close = f["close"]
        for n in (8, 21, 50):
            if f"ema{n}" in names:
                f[f"ema{n}"] = ema(close, n)
        if "rsi" in names:
            f["rsi"] = rsi(close)
        if "atr" in names:
            f["atr"] = atr(f)
        if {"macd", "signal", "hist"} & set(names):
            f["macd"] = ema(close, 12) - ema(close, 26)
            f["signal"] = ema(f["macd"], 9)
            f["hist"] = f["macd"] - f["signal"]
        return (f if last is None else f.tail(last))[kept]

    schema = T.StructType(list(bars.schema.fields))
    for name in names:
        schema = schema.add(name, "double")
    kept = schema.fieldNames()
    return bars.groupBy("symbol").applyInPandas(job, schema)


def with_supertrend(bars: DataFrame, n: int, k: float) -> DataFrame:
    """Bars with the Supertrend ``line`` and ``side``, and Heikin-Ashi candles."""

    def job(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("date", ignore_index=True)
        f["line"], f["side"] = supertrend(f, n, k)
        f["ha_close"] = (f["open"] + f["high"] + f["low"] + f["close"]) / 4
        first = (f["open"] + f["close"]).iloc[:1] / 2
        # the open is halfway between the last open and close: a mean with weight 1/2
        f["ha_open"] = pd.concat([first, f["ha_close"].iloc[:-1]], ignore_index=True).ewm(alpha=0.5, adjust=False).mean()
        return f

    schema = T.StructType(list(bars.schema.fields))
    for name, kind in (("line", "double"), ("side", "integer"), ("ha_close", "double"), ("ha_open", "double")):
        schema = schema.add(name, kind)
    return bars.groupBy("symbol").applyInPandas(job, schema)


def with_ema(df: DataFrame, x: str, n: int, out: str, order: str = "date") -> DataFrame:
    """Adds the EMA of a column; it starts at the column's first value."""

    def job(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, ignore_index=True)
        f[out] = ema(f[x], n)
        return f

    return df.groupBy("symbol").applyInPandas(job, T.StructType(list(df.schema.fields)).add(out, "double"))


def adx(f: pd.DataFrame, n: int = 14) -> pd.Series:
    """Wilder's directional index: how one-sided highs and lows move."""
    up, down = f["high"].diff(), -f["low"].diff()
    plus = wilder(up.where((up > down) & (up > 0), 0.0), n)
    minus = wilder(down.where((down > up) & (down > 0), 0.0), n)
    total = (plus + minus).where(lambda x: x > 0)
    return wilder(100 * (plus - minus).abs() / total, n)


def with_weekly_indicators(weeks: DataFrame) -> DataFrame:
    """Weekly bars (in ``date``) with RSI 14, MACD histogram, PPO and ADX 14."""

    def job(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("date", ignore_index=True)
        fast, slow = ema(f["close"], 12), ema(f["close"], 26)
        f["rsi"] = rsi(f["close"])
        f["macd_hist"] = (fast - slow) - ema(fast - slow, 9)
        f["ppo"] = (fast - slow) / slow * 100
        f["adx"] = adx(f)
        return f

    schema = T.StructType(list(weeks.schema.fields))
    for name in ("rsi", "macd_hist", "ppo", "adx"):
        schema = schema.add(name, "double")
    return weeks.groupBy("symbol").applyInPandas(job, schema)
