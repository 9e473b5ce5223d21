"""Statistical views of each symbol's returns, in windows and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.recursive import with_indicators
from barloom.functions.series import lag, latest, numbered, r6, rows, sma, so_far, std, tail, w, whole

c = F.col


def evar_risk(bars: DataFrame, gate: int = 180) -> DataFrame:
    """Tail risk from rolling moments of log returns, and its rolling rank.

    Spark's kurtosis is the population's; the sample-corrected one feeds q.
    """
    # the rank sees 120 values of windows of 252 returns
    df = numbered(tail(bars, max(gate, 372))).withColumn("r", F.log("close") - F.log(lag("close")))
    over, n = rows(252), F.count("r").over(rows(252)).cast("double")
    g2 = F.kurtosis("r").over(over)
    k = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    ok = n >= 60
    df = df.withColumn("q", F.when(ok, F.least(1 + F.greatest(k, F.lit(0.0)) / (F.greatest(k, F.lit(0.0)) + 3), F.lit(1.8))))
    z = 1.645 * (1 + 1.5 * (c("q") - 1))
    df = df.withColumn("evar", F.when(ok, F.greatest(F.lit(0.0), (z * F.stddev_samp("r").over(over) - F.avg("r").over(over)) * 100)))
    df = df.withColumn("seen", F.collect_list("evar").over(rows(120)))
    below, same = F.size(F.filter("seen", lambda x: x < c("evar"))), F.size(F.filter("seen", lambda x: x == c("evar")))
    df = latest(df, gate).where(F.size("seen") == 120).withColumn("rank", (below + (same + 1) / 2) / 120 * 100)
    band = lambda *names: F.when(c("rank") < 33, names[0]).when(c("rank") < 66, names[1]).when(c("rank") < 85, names[2]).otherwise(names[3])
    exposure = F.greatest(F.lit(20.0), F.least(F.lit(100.0), 100 - 0.8 * c("rank")))
    return df.select(
        "symbol", "date", r6("evar").alias("evar_percent"), r6("q").alias("tsallis_q"), r6("rank").alias("percentile"),
        band("Low", "Moderate", "Elevated", "High").alias("level"), band("Calm", "Normal", "Elevated", "Stressed").alias("regime"),
        r6(exposure).alias("exposure")
    )


def momentum_reversal(bars: DataFrame, gate: int = 15) -> DataFrame:
    """A fall of more than 0.1% turns the position long, a rise short; else it
    stays (flat before the first signal)."""
    df = numbered(bars).withColumn("r", c("close") / lag("close") - 1)
    side = F.when(c("r") < -0.001, "Long").when(c("r") > 0.001, "Short")
    df = df.withColumn("side", side).withColumn("position", F.coalesce(F.last("side", True).over(so_far()), F.lit("Flat")))
    df = df.withColumn("before", lag("position"))
    signal = F.when(c("side") == "Long", "Bullish Reversal").when(c("side") == "Short", "Bearish Reversal").otherwise("No Signal")
    return latest(df, gate).select(
        "symbol", "date", r6(c("r") * 100).alias("return_percent"), signal.alias("signal"), "position",
        (c("position") != c("before")).alias("changed_today")
    )


def avalanches(bars: DataFrame) -> DataFrame:
    """Deepest fall in percent of each run below the running peak: ``symbol, start,
    size``."""
    df = bars.withColumn("peak", F.max("close").over(so_far())).withColumn("fall", (1 - c("close") / c("peak")) * 100)
    df = df.withColumn("run", F.sum(F.when(c("fall") == 0, 1).otherwise(0)).over(so_far()))
    return df.where("fall > 0").groupBy("symbol", "run").agg(F.min("date").alias("start"), F.max("fall").alias("size")).select("symbol", "start", "size")


def avalanche_power_law(bars: DataFrame, bins: int = 12, at_least: int = 15, gate: int = 300) -> DataFrame:
    """Slope of log density on log size over log-spaced bins of avalanche sizes,
    and the fall from the peak at the last bar.  Symbols with fewer bars than
    ``gate`` or fewer avalanches than ``at_least`` give no row."""
    now = bars.groupBy("symbol").agg(
        F.count("close").alias("bars"), ((F.max_by("close", "date") / F.max("close") - 1) * 100).alias("drawdown")
    ).where(c("bars") >= gate)
    a = avalanches(bars).withColumn("x", F.log10("size"))
    edges = a.groupBy("symbol").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")
    ).where((c("n") >= at_least) & (c("hi") > c("lo")))
    step = (c("hi") - c("lo")) / bins
    b = a.join(edges, "symbol").withColumn("bin", F.least(F.floor((c("x") - c("lo")) / step), F.lit(bins - 1)))
    b = b.groupBy("symbol", "bin", "lo", "hi", "n").agg(F.count("*").alias("k"))
    left = F.pow(F.lit(10.0), c("lo") + c("bin") * step)
    right = F.pow(F.lit(10.0), c("lo") + (c("bin") + 1) * step)
    b = b.withColumn("lx", (F.log10(left) + F.log10(right)) / 2).withColumn("ly", F.log10(c("k") / (right - left)))
    g = b.groupBy("symbol", "n").agg(
        F.count("*").alias("bins"), F.regr_slope("ly", "lx").alias("slope"), F.regr_r2("ly", "lx").alias("r2")
    ).where("bins >= 3")
    alpha = -c("slope")
    regime = F.when(alpha >= 2.8, "Gaussian").when(alpha >= 1.8, "Transitional").when(alpha >= 1.0, "Critical").otherwise("Super-critical")
    g = g.join(now, "symbol")
    return g.select(
        "symbol", c("n").alias("avalanches"), c("bins"), r6(alpha).alias("alpha"), r6("r2").alias("r_squared"), regime.alias("regime"),
        r6("drawdown").alias("drawdown_percent")
    )


def ricker(scale: int) -> list[float]:
    """Causal kernel (1 - t^2) exp(-t^2 / 2), t = lag / scale, over 3 scales."""
    return [(1 - (k / scale) ** 2) * math.exp(-((k / scale) ** 2) / 2) for k in range(3 * scale)]


def wavelet_trend(bars: DataFrame, scales: tuple[int, ...] = (5, 10, 20), gate: int = 90) -> DataFrame:
    """Returns filtered at three scales, in rolling deviations of returns."""
    df = numbered(bars).withColumn("r", F.log("close") - F.log(lag("close")))
    for s in scales:
        kernel = ricker(s)
        over = rows(len(kernel))
        dot = F.aggregate(
            F.zip_with(F.reverse(F.collect_list("r").over(over)), F.array(*map(F.lit, kernel)), lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x
        )
        df = df.withColumn(f"f{s}", F.when(F.count("r").over(over) == len(kernel), dot) / std("r", len(kernel)))
    up, down = F.lit(True), F.lit(True)
    for s in scales:
        up, down = up & (c(f"f{s}") > 0), down & (c(f"f{s}") <= 0)
    middle = c(f"f{scales[1]}")
    state = F.when(up, "Strong Uptrend").when(down, "Strong Downtrend").when(middle > 0, "Uptrend (Mixed Confirmation)").when(middle < 0, "Downtrend (Mixed Confirmation)").otherwise("Transitional / Mixed")
    return latest(df, gate).select("symbol", "date", *[r6(f"f{s}").alias(f"filter{s}") for s in scales], state.alias("state"))


def with_crash_flags(bars: DataFrame, last: int | None = None) -> DataFrame:
    """Bars with five warning flags, their count and the drawdown from the high
    of 252 bars (60 at least); with ``last``, only that many rows a symbol."""
    df = numbered(with_indicators(bars, ["rsi", "signal", "hist"], last)).withColumn("sma50", sma("close", 50)).withColumn("sma200", sma("close", 200))
    df = df.withColumn("h1", lag("hist")).withColumn("h2", lag("hist", 2)).withColumn("h3", lag("hist", 3))
    df = df.withColumn("cross", F.when((c("hist") < 0) & (c("h1") >= 0), 1).otherwise(0))
    df = df.withColumn("crossed", F.max("cross").over(rows(10)) == 1)
    usable = c("sma200").isNotNull() & c("signal").isNotNull() & c("rsi").isNotNull()
    # swing highs (the top of five bars on either side) count once confirmed
    top = (c("close") == F.max("close").over(w().rowsBetween(-5, 5))) & (F.count("close").over(w().rowsBetween(-5, 5)) == 11) & c("rsi").isNotNull()
    df = df.withColumn("swing", F.when(top, F.struct("i", "close", "rsi"))).withColumn(
        "swings", F.collect_list("swing").over(w().rowsBetween(-59, -5))
    )
    df = df.withColumn("new", F.try_element_at("swings", F.lit(-1)))
    df = df.withColumn("old", F.try_element_at(F.filter("swings", lambda x: c("new.i") - x["i"] >= 5), F.lit(-1)))
    flags = {
        "below_sma200": c("close") < c("sma200"),
        "death_cross": c("sma50") < c("sma200"),
        "macd_down": (c("hist") < 0) & c("crossed"),
        "fading": (c("hist") < c("h1")) & (c("h1") < c("h2")) & (c("h2") < c("h3")),
        "divergence": (c("new.close") > c("old.close")) & (c("new.rsi") < c("old.rsi")),
    }
    df = df.withColumn("usable", usable)
    for name, rule in flags.items():
        df = df.withColumn(name, F.coalesce(usable & rule, F.lit(False)))
    df = df.withColumn("flags", sum((c(x).cast("long") for x in flags), F.lit(0).cast("long")))
    high = F.when(F.count("close").over(rows(252)) >= 60, F.max("close").over(rows(252)))
    return df.withColumn("drawdown", (c("close") / high - 1) * 100)


def crash_warning(bars: DataFrame, gate: int = 260) -> DataFrame:
    """Flags at the last bar; three or more are a warning."""
    level = F.when(c("flags") <= 1, "Low").when(c("flags") <= 3, "Elevated").otherwise("High")
    names = ["below_sma200", "death_cross", "macd_down", "fading", "divergence"]
    return latest(with_crash_flags(bars, max(gate, 252)), gate).select(
        "symbol", "date", *names, "flags", level.alias("level"), (c("flags") >= 3).alias("warning"), r6("drawdown").alias("drawdown_percent")
    )


def _evaluable(bars: DataFrame, fall: float, horizon: int, train: float, least: int) -> DataFrame:
    """Bars that count in an evaluation of warnings, with ``label`` (a fall follows), ``breach`` (after
    how many bars) and ``segment``."""
    df = with_crash_flags(bars).withColumn("n", F.count("*").over(whole()))
    breach = F.coalesce(*[F.when(F.lead("close", k).over(w()) <= c("close") * (1 - fall), k) for k in range(1, horizon + 1)])
    df = df.withColumn("breach", breach).withColumn("label", breach.isNotNull())
    fit = F.when(c("usable") & (c("i") + horizon <= c("n")), c("i"))
    df = df.withColumn("a", F.min(fit).over(whole())).withColumn("z", F.max(fit).over(whole())).withColumn("fits", F.count(fit).over(whole()))
    cut = c("a") + F.floor((c("z") - c("a") + 1) * train)
    part = F.when(c("i") < F.greatest(c("a") + 1, cut - horizon), "train").when(c("i") >= cut, "test")
    return df.where((c("fits") >= least) & c("i").between(c("a"), c("z"))).withColumn("segment", part).where("segment is not null")


def crash_evaluation(bars: DataFrame, fall: float = 0.10, horizon: int = 20, train: float = 0.6, least: int = 100, few: int = 5) -> DataFrame:
    """``crash_validation`` for the warning and for the baseline alike, a row for each symbol,
    segment and ``rule``: counts, rates in percent, episodes found and missed, the median
    lead, the precision over the base rate (``lift``), and whether the test segment has
    too ``few`` episodes to be believed."""
    rules = F.array(
        F.struct(F.lit("warning").alias("rule"), (c("flags") >= 3).alias("warn")),
        F.struct(F.lit("baseline").alias("rule"), c("below_sma200").alias("warn"))
    )
    df = _evaluable(bars, fall, horizon, train, least).select("symbol", "segment", "i", "label", "breach", F.explode(rules).alias("x"))
    df = df.select("symbol", "segment", "i", "label", "breach", "x.rule", "x.warn")
    key = ["symbol", "segment", "rule"]
    so_far_in = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("run", F.when(c("label"), F.sum(F.when(c("label"), 0).otherwise(1)).over(so_far_in)))
    runs = df.where("label").groupBy(*key, "run").agg(F.min_by("breach", F.when(c("warn"), c("i"))).alias("lead"), F.max("warn").alias("hit"))
    runs = runs.groupBy(*key).agg(
        F.count("*").alias("episodes"), F.count_if("hit").alias("detected"),
        F.percentile(F.when(c("hit"), c("lead")), F.lit(0.5)).alias("median_lead")
    )
    counts = {"tp": c("warn") & c("label"), "fp": c("warn") & ~c("label"), "fn": ~c("warn") & c("label"), "tn": ~c("warn") & ~c("label")}
    g = df.groupBy(*key).agg(F.count("*").alias("bars"), *[F.count_if(x).alias(k) for k, x in counts.items()])
    zero = F.lit(0).cast("long")
    g = g.join(runs, key, "left").withColumn("episodes", F.coalesce("episodes", zero)).withColumn("detected", F.coalesce("detected", zero))
    percent = lambda a, b: F.when(b > 0, F.round(a / b * 100, 1))
    g = g.withColumn("base_rate_percent", percent(c("tp") + c("fn"), c("bars"))).withColumn("precision_percent", percent(c("tp"), c("tp") + c("fp")))
    return g.select(
        *key, "bars", *counts, "episodes", "detected", (c("episodes") - c("detected")).alias("missed"), "median_lead", "base_rate_percent", "precision_percent",
        percent(c("tp"), c("tp") + c("fn")).alias("recall_percent"), percent(c("fp"), c("fp") + c("tn")).alias("false_rate_percent"),
        F.when(
            c("base_rate_percent") > 0, F.round(c("precision_percent") / c("base_rate_percent"), 2)
        ).alias("lift"), ((c("segment") == "test") & (c("episodes") < few)).alias("too_few_episodes"),
    )


def crash_validation(bars: DataFrame, fall: float = 0.10, horizon: int = 20, train: float = 0.6, least: int = 100) -> DataFrame:
    """How warnings foretold falls of ``fall`` within ``horizon`` bars, beside a
    baseline that warns below the 200-day mean.

    Bars count from the first with all indicators to the last with a whole
    horizon after it (``least`` of them at least): the first ``train`` of that
    span but for a gap as long as the horizon, and the rest.  Episodes are runs of
    bars before a fall; one is detected if any of its bars warns, and its lead is
    the number of bars from the first such bar to the fall.
    """
    df = _evaluable(bars, fall, horizon, train, least)
    df = df.withColumn("warn", c("flags") >= 3)
    inside = Window.partitionBy("symbol", "segment").orderBy("i")
    df = df.withColumn("run", F.when(c("label"), F.sum(F.when(c("label"), 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    episodes = df.where("label").groupBy("symbol", "segment", "run").agg(
        F.min_by("breach", F.when(c("warn"), c("i"))).alias("lead"), F.max("warn").alias("hit")
    )
    episodes = episodes.groupBy("symbol", "segment").agg(
        F.count("*").alias("episodes"), F.count_if("hit").alias("detected"),
        F.percentile(F.when(c("hit"), c("lead")), F.lit(0.5)).alias("median_lead")
    )
    counts = {"tp": (c("warn"), c("label")), "fp": (c("warn"), ~c("label")), "fn": (~c("warn"), c("label")), "tn": (~c("warn"), ~c("label"))}
    base = {"base_tp": (c("below_sma200"), c("label")), "base_fp": (c("below_sma200"), ~c("label"))}
    g = df.groupBy("symbol", "segment").agg(*[F.count_if(x & y).alias(k) for k, (x, y) in (counts | base).items()])
    g = g.join(episodes, ["symbol", "segment"], "left").withColumn("episodes", F.coalesce("episodes", F.lit(0).cast("long"))).withColumn("detected", F.coalesce("detected", F.lit(0).cast("long")))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return g.select(
        "*",
        ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        ratio(c("fp"), c("fp") + c("tn")).alias("false_rate"),
        ratio(c("base_tp"), c("base_tp") + c("base_fp")).alias("base_precision"),
    )


def autocorrelation(bars: DataFrame, lags: int = 10, squared: bool = True) -> DataFrame:
    """Autocorrelation of (squared) log returns at each lag, and Ljung-Box's Q up
    to it (global mean, full denominator)."""
    df = numbered(bars).withColumn("r", F.log("close") - F.log(lag("close"))).where("r is not null").withColumn("x", c("r") * c("r") if squared else c("r"))
    df = df.withColumn("m", c("x") - F.avg("x").over(Window.partitionBy("symbol")))
    sums = [F.sum(c("m") * F.col(f"m{k}")).alias(f"s{k}") for k in range(1, lags + 1)]
    for k in range(1, lags + 1):
        df = df.withColumn(f"m{k}", lag("m", k))
    g = df.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(c("m") * c("m")).alias("s0"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), (c(f"s{k}") / c("s0")).alias("acf")) for k in range(1, lags + 1)]))
    g = g.select("symbol", "n", each.alias("e")).select("symbol", "n", "e.lag", "e.acf")
    along = Window.partitionBy("symbol").orderBy("lag")
    q = c("n") * (c("n") + 2) * F.sum(c("acf") * c("acf") / (c("n") - c("lag"))).over(along)
    return g.select("symbol", "lag", r6("acf").alias("acf"), F.round(q, 4).alias("ljung_box"))


def shock_asymmetry(bars: DataFrame, sigmas: float = 1.0, horizon: int = 5) -> DataFrame:
    """Volatility after falls, rises and quiet days: next day and over a horizon."""
    df = numbered(bars).withColumn("r", F.log("close") - F.log(lag("close"))).where("r is not null")
    df = df.withColumn("r2", c("r") * c("r")).withColumn("limit", sigmas * F.stddev_samp("r").over(Window.partitionBy("symbol")))
    df = df.withColumn("next", F.lead("r2").over(w())).withColumn(
        "ahead", F.when(F.count("r2").over(w().rowsBetween(1, horizon)) == horizon, F.avg("r2").over(w().rowsBetween(1, horizon)))
    )
    kind = F.when(c("r") < -c("limit"), "negative").when(c("r") > c("limit"), "positive").otherwise("quiet")
    vol = lambda x: F.round(F.sqrt(F.avg(x) * 252) * 100, 6)
    g = df.withColumn("kind", kind).groupBy("symbol", "kind").agg(
        F.count("*").alias("n"), r6(F.avg("r") * 100).alias("mean_percent"), vol("next").alias("next_vol"), vol("ahead").alias("forward_vol")
    )
    return g.withColumn("sufficient", c("n") >= 10)


def leverage_correlations(bars: DataFrame, lags: int = 5) -> DataFrame:
    """Correlation of a return with squared returns 1 to ``lags`` bars later."""
    df = numbered(bars).withColumn("r", F.log("close") - F.log(lag("close"))).where("r is not null").withColumn("r2", c("r") * c("r"))
    for k in range(1, lags + 1):
        df = df.withColumn(f"a{k}", F.lead("r2", k).over(w()))
    return df.groupBy("symbol").agg(*[r6(F.corr("r", f"a{k}")).alias(f"corr{k}") for k in range(1, lags + 1)])


def rolling_volatility_rank(bars: DataFrame, n: int = 21) -> DataFrame:
    """Annual volatility of the last n log returns and the share of past values
    at or below it."""
    df = numbered(bars).withColumn("r", F.log("close") - F.log(lag("close")))
    df = df.withColumn("vol", std("r", n) * F.sqrt(F.lit(252.0)) * 100).where("vol is not null")
    now = F.max_by("vol", "date").over(Window.partitionBy("symbol"))
    return df.withColumn("now", now).groupBy("symbol").agg(
        r6(F.max("now")).alias("volatility_percent"), r6(F.count_if(c("vol") <= c("now")) / F.count("*")).alias("share_below")
    )


def linear_channel(bars: DataFrame, n: int = 20) -> DataFrame:
    """Fitted end of a line through the last n closes, for every bar."""
    df = numbered(bars)
    x = c("i").cast("double")
    fit = F.regr_intercept(c("close"), x).over(rows(n)) + F.regr_slope(c("close"), x).over(rows(n)) * x
    return df.select("symbol", "date", r6(F.when(F.count("close").over(rows(n)) == n, fit)).alias("fitted"))
