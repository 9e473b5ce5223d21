"""Technical views: one row for each symbol, at its latest bar.

Each takes bars of all symbols and returns a small flat row for every symbol
with enough history (``gate`` rows; others give no row).  Where windows are finite
only the last rows that they reach are kept.  Descriptive only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.recursive import with_ema, with_indicators, with_supertrend
from barloom.functions.series import lag, latest, numbered, r6, rolling, rows, run_length, sma, so_far, std, tail, true_range, whole

c = F.col


def colour(close="close", open_="open") -> F.Column:
    return F.when(c(close) > c(open_), "Green").when(c(close) < c(open_), "Red").otherwise("Neutral")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, gate: int = 30) -> DataFrame:
    """Mean +/- k sample deviations, breakout status and band width."""
    df = numbered(tail(bars, max(gate, n))).withColumn("middle", sma("close", n)).withColumn("sd", std("close", n))
    df = latest(df, gate).withColumn("upper", c("middle") + k * c("sd")).withColumn("lower", c("middle") - k * c("sd"))
    status = F.when(c("close") > c("upper"), "Above Upper Band").when(c("close") < c("lower"), "Below Lower Band").otherwise("Within Bands")
    near = lambda x: (F.abs(c("close") / c(x) - 1) * 100 <= 1.0).alias(f"near_{x}")
    return df.select(
        "symbol", "date", "close", *[r6(x).alias(x) for x in ("middle", "upper", "lower")],
        r6((c("upper") - c("lower")) / c("middle") * 100).alias("width_percent"), status.alias("status"), near("upper"), near("lower")
    )


def better_breakout(bars: DataFrame, gate: int = 53) -> DataFrame:
    """Close against the last close plus the mean of three larger wicks."""
    df = numbered(tail(bars, max(gate, 41))).withColumn("offset", F.greatest(c("high") - c("close"), c("close") - c("low")))
    df = df.withColumn("level", lag("close") + sma("offset", 3, 1)).withColumn("sma40", sma("close", 40))
    return latest(df, gate).select(
        "symbol", "date", "close", r6("level").alias("breakout_level"), (c("close") > c("level")).alias("is_breakout"),
        r6(c("close") - c("sma40")).alias("momentum")
    )


def sma_trend(bars: DataFrame, gate: int = 210) -> DataFrame:
    """SMA 20, 50, 100 and 200, their order, and golden and death crosses."""
    df = numbered(tail(bars, max(gate, 201)))
    for n in (20, 50, 100, 200):
        df = df.withColumn(f"sma{n}", sma("close", n))
    df = df.withColumn("gap", c("sma50") - c("sma200")).withColumn("last_gap", lag("gap"))
    up = (c("close") > c("sma200")) & (c("sma50") > c("sma200"))
    down = (c("close") < c("sma200")) & (c("sma50") < c("sma200"))
    trend = F.when(up, "Bullish").when(down, "Bearish").otherwise("Neutral")
    return latest(df, gate).select(
        "symbol", "date", "close", *[r6(f"sma{n}").alias(f"sma{n}") for n in (20, 50, 100, 200)], trend.alias("trend"),
        ((c("gap") > 0) & (c("last_gap") <= 0)).alias("golden_cross"), ((c("gap") < 0) & (c("last_gap") >= 0)).alias("death_cross"),
    )


def _position(a, b) -> F.Column:
    return F.when(F.abs(c(a) - c(b)) <= 1e-12, "Equal").when(c(a) > c(b), "Above").otherwise("Below")


def traffic_light(bars: DataFrame, gate: int = 50) -> DataFrame:
    """Order of close and SMA 10, 25 and 50, slopes over 5 bars, and the close
    against closes 10, 25 and 50 bars before (null where there is none)."""
    df = numbered(tail(bars, max(gate, 56)))
    for n in (10, 25, 50):
        df = df.withColumn(f"sma{n}", sma("close", n))
    for n in (10, 25, 50):
        slope = (c(f"sma{n}") / lag(f"sma{n}", 5) - 1) * 100
        df = df.withColumn(f"slope{n}", slope).withColumn(f"change{n}", (c("close") / lag("close", n) - 1) * 100)
    up = (c("close") > c("sma10")) & (c("sma10") > c("sma25")) & (c("sma25") > c("sma50"))
    down = (c("close") < c("sma10")) & (c("sma10") < c("sma25")) & (c("sma25") < c("sma50"))
    df = df.withColumn("state", F.when(up, "Bullish").when(down, "Bearish").otherwise("Mixed"))
    out = latest(df, gate)
    direction = lambda n: F.when(c(f"slope{n}") > 0.05, "Rising").when(c(f"slope{n}") < -0.05, "Falling").when(c(f"slope{n}").isNotNull(), "Flat")
    return out.select(
        "symbol", "date", "state", *[_position("close", f"sma{n}").alias(f"position{n}") for n in (10, 25, 50)],
        *[direction(n).alias(f"direction{n}") for n in (10, 25, 50)], *[r6(f"change{n}").alias(f"change{n}") for n in (10, 25, 50)]
    )


def sma_ordering(bars: DataFrame, gate: int = 50) -> DataFrame:
    """Close and SMA 10, 25 and 50 from high to low, as ``A > B = C`` (equal up to 1e-12;
    equal ones in this order), and whether any are equal."""
    df = numbered(tail(bars, max(gate, 56)))
    for n in (10, 25, 50):
        df = df.withColumn(f"sma{n}", sma("close", n))
    named = F.array(
        *[
            F.struct((-c(x.lower())).alias("v"), F.lit(k).alias("k"), F.lit(x).alias("name")) for k,
            x in enumerate(("Close", "SMA10", "SMA25", "SMA50"))
        ]
    )
    df = latest(df, gate).withColumn("order", F.array_sort(named))
    tied = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.abs(F.get("order", k)["v"] - F.get("order", k - 1)["v"]) <= 1e-12)
    steps = F.transform(
        F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat(F.when(F.get("tied", k - 1), " = ").otherwise(" > "), F.get("order", k)["name"])
    )
    df = df.withColumn("tied", tied)
    return df.select(
        "symbol", "date", F.concat(F.get("order", F.lit(0))["name"], F.array_join(steps, "")).alias("ordering"),
        F.exists("tied", lambda x: x).alias("has_ties")
    )


def sma_crossovers(bars: DataFrame, within: int = 10) -> DataFrame:
    """Changes of sign of fast - slow SMA (10/25, 10/50, 25/50) in the last bars."""
    df = numbered(tail(bars, within + 51))
    for n in (10, 25, 50):
        df = df.withColumn(f"sma{n}", sma("close", n))
    df = df.withColumn("n", F.count("*").over(whole()))
    pairs = [(10, 25), (10, 50), (25, 50)]
    gaps = F.array(
        *[
            F.struct(
                F.lit(f"{a}/{b}").alias("pair"), (c(f"sma{a}") - c(f"sma{b}")).alias("gap"), lag(c(f"sma{a}") - c(f"sma{b}")).alias("before")
            ) for a,
            b in pairs
        ]
    )
    out = df.withColumn("bars_ago", c("n") - c("i")).withColumn("gaps", gaps).where(c("bars_ago") < within).select("symbol", "date", "bars_ago", F.explode("gaps").alias("g"))
    crossed = ((c("g.gap") > 0) & (c("g.before") <= 0)) | ((c("g.gap") < 0) & (c("g.before") >= 0))
    return out.where(crossed).select(
        "symbol", c("g.pair").alias("pair"), "date", "bars_ago", F.when(c("g.gap") > 0, "up").otherwise("down").alias("direction")
    )


def td_setup(bars: DataFrame, gate: int = 13) -> DataFrame:
    """Runs of closes above (bearish) or below (bullish) the close four bars
    before; nine complete a setup."""
    df = numbered(bars).withColumn("before", lag("close", 4))
    df = df.withColumn(
        "above", F.coalesce(c("close") > c("before"), F.lit(False))
    ).withColumn("below", F.coalesce(c("close") < c("before"), F.lit(False)))
    df = run_length(run_length(df, "below", "bullish"), "above", "bearish")
    done = F.when(
        c("bearish") == 9, F.struct(F.lit("Bearish").alias("kind"), "date")
    ).when(c("bullish") == 9, F.struct(F.lit("Bullish").alias("kind"), "date"))
    df = latest(df.withColumn("done", F.last(done, True).over(so_far())), gate)
    kind = F.when(c("bearish") > 0, "Bearish").when(c("bullish") > 0, "Bullish").otherwise("None")
    run = F.greatest("bearish", "bullish")
    state = F.when(
        (run >= 9) & (c("bearish") > 0), "Potential Upside Exhaustion"
    ).when(run >= 9, "Potential Downside Exhaustion").when(run > 0, "Setup In Progress").otherwise("No Active Setup")
    return df.select(
        "symbol", "date", kind.alias("setup"), run.alias("run"), F.least(run, F.lit(9)).cast("long").alias("count"), (run >= 9).alias("completed"),
        state.alias("state"), c("done.kind").alias("last_completed"), c("done.date").alias("last_completed_date")
    )


def pivot_levels(bars: DataFrame, gate: int = 5) -> DataFrame:
    """Floor pivots of the bar before, and the nearest levels around the close."""
    df = numbered(tail(bars, max(gate, 2)))
    for x in ("high", "low", "close"):
        df = df.withColumn(f"p{x}", lag(x))
    df = latest(df, gate).withColumn("pp", (c("phigh") + c("plow") + c("pclose")) / 3)
    span = c("phigh") - c("plow")
    df = df.withColumn("r1", 2 * c("pp") - c("plow")).withColumn("s1", 2 * c("pp") - c("phigh")).withColumn("r2", c("pp") + span).withColumn("s2", c("pp") - span)
    df = df.withColumn("r3", c("phigh") + 2 * (c("pp") - c("plow"))).withColumn("s3", c("plow") - 2 * (c("phigh") - c("pp")))
    names = ["pp", "r1", "r2", "r3", "s1", "s2", "s3"]
    levels = F.array(*names)
    up = F.array_min(F.filter(levels, lambda x: x > c("close")))
    down = F.array_max(F.filter(levels, lambda x: x <= c("close")))
    zone = F.when(c("close") > c("r1"), "Upper Zone").when(c("close") < c("s1"), "Lower Zone").otherwise("Middle Zone")
    away = lambda x: r6(F.abs(x - c("close")) / c("close") * 100)
    return df.select(
        "symbol", "date", "close", *[r6(x).alias(x) for x in names], r6(up).alias("resistance"), away(up).alias("to_resistance_percent"),
        r6(down).alias("support"), away(down).alias("to_support_percent"), zone.alias("zone"), (c("close") > c("pp")).alias("above_pivot")
    )


def central_pivot_range(bars: DataFrame, n: int = 60, gate: int = 61) -> DataFrame:
    """Central pivot range of the bar before; its width's mid-rank over n bars."""
    df = numbered(tail(bars, max(gate, n + 1)))
    pivot, middle = (lag("high") + lag("low") + lag("close")) / 3, (lag("high") + lag("low")) / 2
    df = df.withColumn("pivot_point", pivot).withColumn("bottom", F.least(middle, 2 * pivot - middle)).withColumn("top", F.greatest(middle, 2 * pivot - middle))
    df = df.withColumn("width", (c("top") - c("bottom")) / c("pivot_point") * 100).withColumn("widths", F.collect_list("width").over(rows(n)))
    df = latest(df, gate)
    below, same = (F.size(F.filter("widths", lambda x: x < c("width") - 1e-9)), F.size(F.filter("widths", lambda x: F.abs(x - c("width")) <= 1e-9)))
    df = df.withColumn("rank", (below + 0.5 * same) / F.size("widths"))
    kind = F.when(c("rank") <= 0.25, "Narrow").when(c("rank") >= 0.75, "Wide").otherwise("Normal")
    bias = F.when(c("close") > c("top"), "Bullish Day Bias").when(c("close") < c("bottom"), "Bearish Day Bias").otherwise("Neutral")
    return df.select(
        "symbol", "date", *[r6(x).alias(x) for x in ("pivot_point", "bottom", "top", "width", "rank")], kind.alias("kind"), bias.alias("bias")
    )


def candle_confirmation(bars: DataFrame, gate: int = 20) -> DataFrame:
    """Colour of the last candle; setups that it would confirm are not defined."""
    return latest(numbered(tail(bars, gate)), gate).select(
        "symbol", "date", colour().alias("candle"), F.lit(False).alias("setup"), F.lit(False).alias("confirmed")
    )


def squeeze(bars: DataFrame, n: int = 20, gate: int = 40) -> DataFrame:
    """Bollinger bands (population deviation) inside Keltner channels, release,
    and momentum: the fitted end of a line through close - middle."""
    df = numbered(tail(bars, max(gate, 2 * n + 2))).withColumn("tr", true_range())
    df = df.withColumn("mean", sma("close", n)).withColumn("sd", rolling(F.stddev_pop("close"), "close", n)).withColumn("range", sma("tr", n))
    df = df.withColumn("on", 2 * c("sd") < 1.5 * c("range")).withColumn("off", 2 * c("sd") > 1.5 * c("range"))
    middle = (rolling(F.max("high"), "high", n) + rolling(F.min("low"), "low", n)) / 2
    df = df.withColumn("y", c("close") - (middle + c("mean")) / 2)
    x = c("i").cast("double")
    line = F.regr_intercept(c("y"), x).over(rows(n)) + F.regr_slope(c("y"), x).over(rows(n)) * x
    df = df.withColumn("momentum", F.when(F.count("y").over(rows(n)) == n, line))
    df = df.withColumn("was_on", lag("on")).withColumn("before", lag("momentum"))
    up = c("momentum") > c("before")
    state = F.when(c("on"), "Squeeze On").when(c("off"), "Squeeze Released").otherwise("No Squeeze")
    side = F.when(
        c("momentum") > 0, F.when(up, "Bullish Momentum (Strengthening)").otherwise("Bullish Momentum (Weakening)")
    ).otherwise(F.when(up, "Bearish Momentum (Weakening)").otherwise("Bearish Momentum (Strengthening)"))
    return latest(df, gate).select(
        "symbol", "date", state.alias("squeeze_state"), (c("was_on") & c("off")).alias("released_today"), r6("momentum").alias("momentum"),
        F.when(up, "Rising").when(c("momentum") < c("before"), "Falling").otherwise("Flat").alias("direction"), side.alias("momentum_state"),
        *[
            r6(c("mean") + k * c(z)).alias(a) for a, k,
            z in (("upper_bb", 2, "sd"), ("lower_bb", -2, "sd"), ("upper_kc", 1.5, "range"), ("lower_kc", -1.5, "range"))
        ]
    )


# Recursive averages


def ema50_rsi_pullback(bars: DataFrame, gate: int = 74) -> DataFrame:
    df = numbered(with_indicators(bars, ["ema50", "rsi"], gate)).withColumn("last_rsi", lag("rsi"))
    df = latest(df, gate).withColumn("distance", (c("close") / c("ema50") - 1) * 100)
    above = c("close") > c("ema50")
    return df.select(
        "symbol", "date", "close", r6("ema50").alias("ema50"), r6("rsi").alias("rsi"), r6("distance").alias("distance_percent"),
        F.when(above, "Bullish").otherwise("Bearish").alias("trend"), (c("rsi") > c("last_rsi")).alias("rsi_turning_up"),
        (above & (F.abs(c("distance")) <= 2)).alias("is_pullback")
    )


def ema8_21_pullback(bars: DataFrame, gate: int = 31) -> DataFrame:
    df = numbered(with_indicators(bars, ["ema8", "ema21"], gate)).withColumn("gap", c("ema8") - c("ema21")).withColumn("last_gap", lag("gap"))
    df = latest(df, gate)
    both = (c("close") > c("ema8")) & (c("close") > c("ema21"))
    return df.select(
        "symbol", "date", r6("ema8").alias("ema8"), r6("ema21").alias("ema21"), ((c("gap") > 0) & (c("last_gap") <= 0)).alias("cross_up"),
        ((c("gap") < 0) & (c("last_gap") >= 0)).alias("cross_down"), F.when(c("gap") > 0, "Bullish").otherwise("Bearish").alias("trend"),
        both.alias("above_both"), (both & (F.abs((c("close") / c("ema8") - 1) * 100) <= 1.0)).alias("is_pullback")
    )


def macd(bars: DataFrame, gate: int = 45) -> DataFrame:
    df = numbered(with_indicators(bars, ["macd", "signal", "hist"], gate)).withColumn("last_hist", lag("hist"))
    return latest(df, gate).select(
        "symbol", "date", *[r6(x).alias(x) for x in ("macd", "signal", "hist")], ((c("hist") > 0) & (c("last_hist") <= 0)).alias("cross_up"), ((c("hist") < 0) & (c("last_hist") >= 0)).alias("cross_down"),
        F.when(c("macd") > c("signal"), "Bullish").otherwise("Bearish").alias("trend"),
    )


def triple_ma_pullback(bars: DataFrame, gate: int = 84) -> DataFrame:
    """SMA 20 of itself three times; entries and exits in ATRs off the 5-bar mean."""
    df = numbered(with_indicators(bars, ["atr"], gate)).withColumn("ma1", sma("close", 20))
    df = df.withColumn("ma2", sma("ma1", 20)).withColumn("ma3", sma("ma2", 20)).withColumn("mean5", sma("close", 5))
    df = latest(df, gate).withColumn("entry", c("mean5") - c("atr")).withColumn("exit", c("mean5") + 0.5 * c("atr"))
    up = (c("ma1") > c("ma2")) & (c("ma2") > c("ma3")) & (c("close") > c("ma3"))
    label = F.when(up & (c("close") < c("entry")), "Pullback Entry Zone").when(up & (c("close") > c("exit")), "Uptrend - Exit Zone").when(up, "Uptrend - No Pullback").otherwise("No Confirmed Uptrend")
    return df.select(
        "symbol", "date", *[r6(x).alias(x) for x in ("ma1", "ma2", "ma3", "mean5", "atr", "entry", "exit")], up.alias("uptrend"),
        (c("close") > c("exit")).alias("exit_zone"), label.alias("label")
    )


def supertrend_confirmation(bars: DataFrame, n: int = 10, k: float = 3.0, gate: int = 30) -> DataFrame:
    """Supertrend, confirmed by two candles before in the direction's colour."""
    df = numbered(with_supertrend(bars, n, k)).withColumn("colour", colour())
    df = df.withColumn("c1", lag("colour", 1)).withColumn("c2", lag("colour", 2)).withColumn("last_side", lag("side"))
    up = (c("side") == 1) & (c("c1") == "Green") & (c("c2") == "Green") & (c("close") > c("line"))
    down = (c("side") == -1) & (c("c1") == "Red") & (c("c2") == "Red") & (c("close") < c("line"))
    return latest(df, gate).select(
        "symbol", "date", r6("line").alias("line"), c("side").cast("long").alias("side"), (c("side") != c("last_side")).alias("flipped"),
        up.alias("confirmed_up"), down.alias("confirmed_down")
    )


def heikin_ashi_setup(bars: DataFrame, gate: int = 50) -> DataFrame:
    """Supertrend(6, 2) flips with both candle colours; stop and 1:1.5 target."""
    df = numbered(with_supertrend(bars, 6, 2.0)).withColumn("last_side", lag("side"))
    df = df.withColumn("ha", colour("ha_close", "ha_open")).withColumn("colour", colour())
    flip = (c("side") != c("last_side")) & (c("last_side") != 0)
    kind = F.when(
        flip & (c("side") == 1) & (c("ha") == "Green") & (c("colour") == "Green"), "long"
    ).when(flip & (c("side") == -1) & (c("ha") == "Red") & (c("colour") == "Red"), "short")
    setup = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), c("date").alias("on"), c("close").alias("entry"), c("line").alias("stop")))
    df = latest(df.withColumn("setup", F.last(setup, True).over(so_far())), gate)
    s = lambda x: c(f"setup.{x}")
    risk = F.when(s("kind") == "long", s("entry") - s("stop")).otherwise(s("stop") - s("entry"))
    ok = lambda x: r6(F.when(risk > 0, x))
    return df.select(
        "symbol", "date", "ha", s("kind").alias("setup"), s("on").alias("setup_date"), ok(s("entry")).alias("entry"), ok(s("stop")).alias("stop"),
        ok(s("entry") + 1.5 * (s("entry") - s("stop"))).alias("target")
    )


def ta_candles(bars: DataFrame, gate: int = 74) -> DataFrame:
    """Trend by EMA 21 and 50, momentum by ROC 10, ATR percent against its rolling
    median, the colours of the last ten candles, and how these agree."""
    df = numbered(with_indicators(bars)).withColumn("roc", (c("close") / lag("close", 10) - 1) * 100)
    df = df.withColumn("atr_percent", c("atr") / c("close") * 100)
    df = df.withColumn("usual", F.when(F.count("atr_percent").over(rows(50)) >= 14, F.percentile("atr_percent", F.lit(0.5)).over(rows(50))))
    df = df.withColumn("candle", colour())
    for name in ("Green", "Red"):
        share = F.sum(F.when(c("candle") == name, 1).otherwise(0)).over(rows(10)) / 10.0
        df = df.withColumn(f"is_{name}", c("candle") == name).withColumn(name, share)
        df = run_length(df, f"is_{name}", f"run_{name}")
    gap = (c("ema21") / c("ema50") - 1) * 100
    df = latest(df, gate)
    df = df.withColumn(
        "trend",
        F.when((gap >= 0.25) & (c("close") > c("ema21")), "Bullish").when((gap <= -0.25) & (c("close") < c("ema21")), "Bearish").otherwise("Mixed")
    )
    df = df.withColumn("momentum", F.when(c("roc") > 0, "Positive").when(c("roc") < 0, "Negative").otherwise("Flat"))
    ratio = c("atr_percent") / c("usual")
    calm = F.when(ratio >= 1.25, "Expanding").when(ratio <= 0.75, "Contracting").otherwise("Normal")
    health = F.lit("Choppy - Caution")
    for side, sign, share in (("Bearish", "Negative", "Red"), ("Bullish", "Positive", "Green")):
        own = c("trend") == side
        weak = (c("momentum") != sign) | (c(share) < 0.5)
        health = F.when(
            own & (c("momentum") == sign) & (c(share) >= 0.6), f"Healthy Trend ({side})"
        ).when(own & weak, f"Weakening {side} Trend").otherwise(health)
    return df.select(
        "symbol", "date", "trend", "momentum", r6("roc").alias("roc10"), r6("atr_percent").alias("atr_percent"), calm.alias("volatility"),
        c("Green").alias("green_ratio"), c("Red").alias("red_ratio"), F.greatest("run_Green", "run_Red").alias("streak"),
        c("candle").alias("streak_colour"), health.alias("health")
    )


def swing_momentum(bars: DataFrame, index: str | None = None, gate: int = 69) -> DataFrame:
    """Percent over 20 bars plus percent over 50, its EMA 9, SMA 50 of the close,
    crosses, and strength against an index's own value."""
    df = bars.withColumn("swing", (c("close") / lag("close", 20) - 1) * 100 + (c("close") / lag("close", 50) - 1) * 100)
    df = numbered(with_ema(df, "swing", 9, "average")).withColumn("gap", c("swing") - c("average"))
    df = df.withColumn("s1", lag("swing")).withColumn("g1", lag("gap")).withColumn("sma50", sma("close", 50))
    above, strong, high = c("swing") > 0, c("swing") > c("average"), c("close") > c("sma50")
    state = F.when(above & strong, "Strong bullish momentum").when(above, "Weakening bullish momentum").when(strong, "Recovering bearish momentum").otherwise("Bearish momentum")
    df = latest(df, gate)
    own = df.where(c("symbol") == index).select(c("swing").alias("index_swing"))  # one row at most
    df = df.join(own, F.lit(True), "left")
    crosses = {
        "zero_up": (c("s1") <= 0) & above, "zero_down": (c("s1") >= 0) & (c("swing") < 0), "ema_up": (c("g1") <= 0) & strong,
        "ema_down": (c("g1") >= 0) & (c("gap") < 0)
    }
    return df.select(
        "symbol", "date", *[r6(x).alias(x) for x in ("swing", "average", "sma50")], state.alias("state"),
        *[F.coalesce(x, F.lit(False)).alias(k) for k, x in crosses.items()], (above & strong & high).alias("bullish"),
        (~above | ~high | (c("swing") >= 4)).alias("exit"), r6(c("swing") - c("index_swing")).alias("relative_strength")
    )


#: Patterns by the number of their candles.
ONE = ("Doji", "Hammer", "Hanging Man", "Shooting Star")
TWO = ("Bullish Engulfing", "Bearish Engulfing", "Bullish Harami", "Bearish Harami")
THREE = ("Morning Star", "Evening Star", "Three Black Crows")


def candlestick_patterns(bars: DataFrame, lookback: int = 120) -> DataFrame:
    """Patterns of one to three candles in the last bars (trend by ATR).  Where bars have ``pos``, their
    place before invalid ones went, the candles of a pattern must be neighbours there."""
    placed = "pos" in bars.columns
    df = numbered(with_indicators(bars, ["atr"], lookback + 14)).withColumn("body", F.abs(c("close") - c("open"))).withColumn("span", c("high") - c("low"))
    df = df.withColumn("upper", c("high") - F.greatest("open", "close")).withColumn("lower", F.least("open", "close") - c("low"))
    df = df.withColumn("move", lag("close") - lag("close", 6)).withColumn("one_atr", lag("atr")).withColumn("usual", sma("body", 10, 1))
    df = df.withColumn("up", c("move") >= c("one_atr")).withColumn("down", c("move") <= -c("one_atr"))
    for k in (1, 2):
        for x in ("open", "close", "body", "usual", "low", "span", "up", "down"):
            df = df.withColumn(f"{x}{k}", lag(x, k))
        df = df.withColumn(f"near{k}", c("pos") - lag("pos", k) == k if placed else F.lit(True))
    df = df.withColumn("n", F.count("*").over(whole())).where(c("n") - c("i") < lookback)
    doji = (c("span") > 0) & (c("body") <= 0.1 * c("span"))
    solid = c("body") > 0.1 * c("span")
    hammer = solid & (c("lower") >= 2 * c("body")) & (c("upper") <= 0.1 * c("span"))
    star = solid & (c("upper") >= 2 * c("body")) & (c("lower") <= 0.1 * c("span"))
    green, red = [c("close") > c("open")], [c("close") < c("open")]
    for k in (1, 2):
        green.append(c(f"close{k}") > c(f"open{k}"))
        red.append(c(f"close{k}") < c(f"open{k}"))
    long = [None, (c("body1") > 0) & (c("body1") >= c("usual1")), (c("body2") > 0) & (c("body2") >= c("usual2"))]
    inside = (c("body") < c("body1")) & (
        F.greatest("open", "close") < F.greatest("open1", "close1")
    ) & (F.least("open", "close") > F.least("open1", "close1"))
    small1 = c("body1") <= 0.5 * c("usual1")
    middle = (c("open2") + c("close2")) / 2
    crow = lambda k: (c(f"close{k}") < c(f"open{k}")) & (c(f"body{k}") >= 0.5 * c(f"span{k}")) & (c(f"close{k}") - c(f"low{k}") <= 0.25 * c(f"span{k}"))
    falling = (c("close") < c("close1")) & (c("close1") < c("close2"))
    opens = c("open1").between(c("close2"), c("open2")) & c("open").between(c("close1"), c("open1"))
    engulf = c("body") > c("body1")
    found = [
        ("Doji", doji), ("Hammer", hammer & c("down")), ("Hanging Man", hammer & c("up")), ("Shooting Star", star & c("up")),
        ("Bullish Engulfing", green[0] & red[1] & (c("open") <= c("close1")) & (c("close") >= c("open1")) & engulf & c("down1")),
        ("Bearish Engulfing", red[0] & green[1] & (c("open") >= c("close1")) & (c("close") <= c("open1")) & engulf & c("up1")),
        ("Bullish Harami", red[1] & long[1] & green[0] & inside & c("down1")), ("Bearish Harami", green[1] & long[1] & red[0] & inside & c("up1")),
        ("Morning Star", red[2] & long[2] & small1 & (F.greatest("open1", "close1") <= c("close2")) & green[0] & (c("close") > middle) & c("down2")),
        ("Evening Star", green[2] & long[2] & small1 & (F.least("open1", "close1") >= c("close2")) & red[0] & (c("close") < middle) & c("up2")),
        ("Three Black Crows", crow("") & crow(1) & crow(2) & falling & opens & c("up2")),
    ]
    several = {name: c("near2") if name in THREE else c("near1") for name, _ in found if name in (*TWO, *THREE)}
    rules = [(name, rule & several[name] if name in several else rule) for name, rule in found]
    hits = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules]), lambda x: x.isNotNull())
    return df.select("symbol", "date", F.explode(hits).alias("pattern"))


def pattern_counts(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """How often each symbol shows each pattern (0 for the others) and when last."""
    names = F.explode(F.array(*map(F.lit, (*ONE, *TWO, *THREE))))
    g = found.groupBy("symbol", "pattern").agg(F.count("*").alias("n"), F.max("date").alias("last"))
    every = symbols.select("symbol").distinct().withColumn("pattern", names)
    return every.join(g, ["symbol", "pattern"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
