"""Portfolios that are rebalanced now and then, in closed form.

Between rebalances the value is the last base value times the weighted price
relatives; a rebalance multiplies by one less the cost of its trades.  So the
path is a product over rebalances and needs windows only, no loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import r6
from barloom.operators.analytics import common_dates

c = F.col
FREQUENCIES = ("month", "quarter", "half", "year")


def period_key(frequency: str) -> F.Column:
    month = F.year("date") * 12 + F.month("date") - 1
    return F.floor(month / {"month": 1, "quarter": 3, "half": 6, "year": 12}[frequency])


def harvest(bars: DataFrame, weights: dict[str, float], frequency: str = "quarter", cost: float = 0.0) -> DataFrame:
    """``date, rebalanced, held, is_rebalance, turnover``: values per unit put in.

    Rebalances fall on the first row of a new period, never on the first or the
    last row; the first purchase is free.
    """
    total = sum(weights.values())
    w = {s: v / total for s, v in weights.items()}
    names = list(w)
    df = common_dates(bars, names).groupBy("date").pivot("symbol", names).agg(F.first("adjusted_close")).withColumn("one", F.lit(1))
    by = Window.partitionBy("one").orderBy("date")  # one mix is one series of days
    df = df.withColumn("key", period_key(frequency))
    first, last = F.lag("date").over(by).isNull(), F.lead("date").over(by).isNull()
    df = df.withColumn("first", first).withColumn("turn", ~first & ~last & (c("key") != F.lag("key").over(by)))
    df = df.withColumn("base", c("first") | c("turn"))
    to_now, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    for s in names:
        df = df.withColumn(
            f"now_{s}", F.last(F.when(c("base"), c(s)), True).over(to_now)
        ).withColumn(f"old_{s}", F.last(F.when(c("base"), c(s)), True).over(before)).withColumn(f"start_{s}", F.first(c(s)).over(to_now))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    df = df.withColumn("grown", add([w[s] * c(s) / c(f"old_{s}") for s in names]))
    df = df.withColumn("traded", F.when(c("turn"), add([F.abs(w[s] - w[s] * c(s) / c(f"old_{s}") / c("grown")) for s in names])))
    step = F.when(c("turn"), F.log(c("grown") * (1 - cost * c("traded")))).otherwise(0.0)
    df = df.withColumn("level", F.exp(F.sum(step).over(to_now)))
    rebalanced = c("level") * add([w[s] * c(s) / c(f"now_{s}") for s in names])
    held = add([w[s] * c(s) / c(f"start_{s}") for s in names])
    return df.select("date", rebalanced.alias("rebalanced"), held.alias("held"), c("turn").alias("is_rebalance"), (c("traded") / 2).alias("turnover"))


def harvest_path(bars: DataFrame, weights: dict[str, float], frequency: str = "quarter", cost: float = 0.0) -> DataFrame:
    df = harvest(bars, weights, frequency, cost)
    return df.select(
        "date", r6(F.log("rebalanced")).alias("log_rebalanced"), r6(F.log("held")).alias("log_held"), "is_rebalance", r6("turnover").alias("turnover")
    )


def harvest_metrics(bars: DataFrame, weights: dict[str, float], frequency: str = "quarter", cost: float = 0.0) -> DataFrame:
    """Growth, volatility and drawdown of both paths, one row."""
    df = harvest(bars, weights, frequency, cost).withColumn("one", F.lit(1))
    by = Window.partitionBy("one").orderBy("date")
    for x in ("rebalanced", "held"):
        df = df.withColumn(f"r_{x}", c(x) / F.lag(x).over(by) - 1).withColumn(f"fall_{x}", c(x) / F.max(x).over(by) - 1)
    out = [F.count_if("is_rebalance").alias("rebalances"), r6(F.sum("turnover")).alias("turnover")]
    for x in ("rebalanced", "held"):
        out += [
            r6(F.log(F.max_by(x, "date"))).alias(f"{x}_log_growth"),
            r6(F.stddev_samp(f"r_{x}") * F.sqrt(F.lit(252.0)) * 100).alias(f"{x}_volatility"), r6(F.min(f"fall_{x}") * 100).alias(f"{x}_drawdown")
        ]
    return df.agg(*out)


#: Fixed values of comparisons: fewest years of a growth rate, and what counts as no difference.
LEAST_YEARS, FLAT_POINTS, NO_VOLATILITY = 1.0, 0.005, 1e-12
_UNITS = {"final_value": 2, "return_percent": 4, "cagr_percent": 4, "volatility_percent": 4, "sharpe": 4, "drawdown_percent": 4}


def _path_metrics(df: DataFrame, x: str, initial: float, rf_percent: float) -> DataFrame:
    """One row on the path ``x``; the peak is the first highest value up to the trough."""
    by = Window.partitionBy("one").orderBy("date")
    high = F.struct(c(x), -F.unix_date("date"))  # the first of equal peaks
    df = df.withColumn("r", c(x) / F.lag(x).over(by) - 1).withColumn("top", F.max(high).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("fall", c(x) / F.col(f"top.{x}") - 1)
    trough = F.struct("fall", "date")
    g = df.agg(
        F.max_by(x, "date").alias("last"), F.min_by(x, "date").alias("first"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"),
        F.min("fall").alias("fall"), F.min_by("date", trough).alias("trough"), F.min_by(
            F.date_from_unix_date((-c("top.col2")).cast("int")), trough
        ).alias("peak"),
    )
    years = c("days") / 365.25
    vol = F.when(c("sd") > NO_VOLATILITY, c("sd") * F.sqrt(F.lit(252.0)))
    return g.select(
        F.lit(x).alias("path"), F.round(initial * c("last"), 2).alias("final_value"), F.round((c("last") / c("first") - 1) * 100, 4).alias("return_percent"),
        F.when(
            years >= LEAST_YEARS, F.round((F.pow(c("last") / c("first"), 1 / years) - 1) * 100, 4)
        ).alias("cagr_percent"), F.round(vol * 100, 4).alias("volatility_percent"),
        F.round((c("mean") * 252 - rf_percent / 100) / vol, 4).alias("sharpe"), F.round(c("fall") * 100, 4).alias("drawdown_percent"), "peak", "trough",
    )


def harvest_comparison(
    bars: DataFrame, weights: dict[str, float], frequency: str = "quarter", cost: float = 0.0, initial: float = 10000.0, rf_percent: float = 4.5
) -> DataFrame:
    """The rebalanced path, the held one and their difference, a row each: value, return,
    growth a year (from one year on), volatility, Sharpe ratio, deepest fall with its peak
    and trough, and which of the two is ahead.  A portfolio is one series of days."""
    df = harvest(bars, weights, frequency, cost).withColumn("one", F.lit(1))
    a, b = (_path_metrics(df, x, initial, rf_percent) for x in ("rebalanced", "held"))
    both = a.select(*[c(x).alias(f"a_{x}") for x in _UNITS]).join(b.select(*[c(x).alias(f"b_{x}") for x in _UNITS]), F.lit(True))  # one row each
    gap = [F.round(c(f"a_{x}") - c(f"b_{x}"), digits).alias(x) for x, digits in _UNITS.items()]
    gap = both.select(F.lit("difference").alias("path"), *gap, F.lit(None).cast("date").alias("peak"), F.lit(None).cast("date").alias("trough"))
    ahead = F.when(
        c("path") == "difference",
        F.when(
            F.abs("return_percent") < FLAT_POINTS, "No material difference"
        ).when(c("return_percent") > 0, "Rebalanced ahead").otherwise("Buy-and-hold ahead")
    )
    return a.unionByName(b).unionByName(gap).withColumn("direction", ahead)


def frequency_grid(bars: DataFrame, weights: dict[str, float], cost: float = 0.001) -> DataFrame:
    parts = [harvest_metrics(bars, weights, f, cost).withColumn("frequency", F.lit(f)) for f in FREQUENCIES]
    return reduce(DataFrame.unionByName, parts)


def cost_grid(bars: DataFrame, weights: dict[str, float], costs: tuple[float, ...] = (0.0, 0.001, 0.005)) -> DataFrame:
    parts = [harvest_metrics(bars, weights, "quarter", x).withColumn("cost", F.lit(x)) for x in costs]
    return reduce(DataFrame.unionByName, parts)


def covariances(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Annual mean and covariance of log returns on common dates: ``a, b, n,
    covariance, mean_a``."""
    from barloom.functions.series import lag

    r = common_dates(bars, symbols).select("symbol", "date", (F.log("close") - F.log(lag("close"))).alias("r")).where("r is not null")
    pairs = r.select("date", c("symbol").alias("a"), c("r").alias("x")).join(r.select("date", c("symbol").alias("b"), c("r").alias("y")), "date")
    return pairs.groupBy("a", "b").agg(
        F.count("*").alias("n"), (F.covar_samp("x", "y") * 252).alias("covariance"), (F.avg("x") * 252).alias("mean_a")
    )


def whole_shares(bars: DataFrame, initial: float, rate: float, flat: float) -> DataFrame:
    """Whole shares that ``initial`` buys on the first day, with costs, and what
    they and the rest are worth on the last."""
    g = bars.groupBy("symbol").agg(
        F.min_by("adjusted_close", "date").alias("first"), F.max_by("adjusted_close", "date").alias("last"),
        F.datediff(F.max("date"), F.min("date")).alias("days")
    )
    shares = F.floor(F.greatest(F.lit(initial - flat), F.lit(0.0)) / (c("first") * (1 + rate)))
    g = g.withColumn("shares", shares).withColumn(
        "cash", initial - F.when(c("shares") > 0, c("shares") * c("first") * (1 + rate) + flat).otherwise(0.0)
    )
    g = g.withColumn("final", c("cash") + c("shares") * c("last"))
    years = c("days") / 365.25
    return g.select(
        "symbol", "shares", r6("cash").alias("cash"), r6("final").alias("final"),
        r6((F.pow(F.greatest(c("final") / initial, F.lit(0.0)), 1 / years) - 1) * 100).alias("annual_percent")
    )
