"""Snapshots, performance, risk and portfolio mixes on adjusted closes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import lag, latest, numbered, r6, so_far, tail, w, whole

c = F.col
DAYS = 252
RISK_FREE = 4.5


def snapshot(bars: DataFrame, points: int = 30) -> DataFrame:
    """Latest price, change from the one before, and the last prices in order."""
    df = numbered(tail(bars, max(points, 2))).withColumn("previous", lag("adjusted_close"))
    df = df.withColumn("spark", F.collect_list("adjusted_close").over(w().rowsBetween(-(points - 1), 0)))
    change = c("adjusted_close") - c("previous")
    return latest(df, 2).select(
        "symbol", "date", c("adjusted_close").alias("price"), r6(change).alias("change"), r6(change / c("previous") * 100).alias("change_percent"),
        F.array_join(F.transform("spark", lambda x: x.cast("decimal(18,4)").cast("string")), " ").alias("sparkline")
    )


def quote(bars: DataFrame) -> DataFrame:
    """The last bar against the adjusted close before it."""
    df = numbered(tail(bars, 2)).withColumn("previous_close", lag("adjusted_close"))
    return latest(df).select(
        "symbol", "date", "open", "high", "low", "close", "volume", "previous_close",
        r6((c("adjusted_close") / c("previous_close") - 1) * 100).alias("change_percent")
    )


RANGES = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12, "5Y": 60}


def performance_series(bars: DataFrame, points: int = 30) -> DataFrame:
    """Prices since so many months before the last date, every ceil(n/points)-th
    row and the last one."""
    end = F.max("date").over(Window.partitionBy("symbol"))
    ranges = F.explode(F.array(*[F.struct(F.lit(k).alias("range"), F.lit(m).alias("months")) for k, m in RANGES.items()]))
    df = bars.withColumn("end", end).withColumn("r", ranges).where(c("date") >= F.add_months("end", -c("r.months")))
    inside = Window.partitionBy("symbol", "r").orderBy("date")
    df = df.withColumn("k", F.row_number().over(inside)).withColumn("n", F.count("*").over(Window.partitionBy("symbol", "r")))
    step = F.ceil(c("n") / points)
    return df.where(((c("k") - 1) % step == 0) | (c("k") == c("n"))).select(
        "symbol", c("r.range").alias("range"), "date", c("adjusted_close").alias("price")
    )


def performance_stats(bars: DataFrame) -> DataFrame:
    """Returns since the last observation before the year began and 1, 3 and 5
    years ago (else since the first), and the growth rate over five years."""
    df = bars.select("symbol", "date", c("adjusted_close").alias("p"), F.max("date").over(Window.partitionBy("symbol")).alias("end"))
    starts = {"ytd": F.trunc("end", "year"), "y1": F.add_months("end", -12), "y3": F.add_months("end", -36), "y5": F.add_months("end", -60)}
    bases = [F.coalesce(F.max_by("p", F.when(c("date") < s, c("date"))), F.min_by("p", "date")).alias(k) for k, s in starts.items()]
    first = [F.min_by(x, F.when(c("date") >= starts["y5"], c("date"))).alias(a) for x, a in (("p", "p5"), ("date", "d5"))]
    g = df.groupBy("symbol").agg(F.max_by("p", "date").alias("last"), F.max("date").alias("date"), *bases, *first)
    years = F.datediff("date", "d5") / 365.25
    rate = F.when(years > 0, (F.pow(c("last") / c("p5"), 1 / years) - 1) * 100)
    return g.select("symbol", *[r6((c("last") / c(k) - 1) * 100).alias(f"{k}_percent") for k in starts], r6(rate).alias("cagr_percent"))


def max_drawdown(bars: DataFrame) -> DataFrame:
    """Deepest fall below the running peak, in percent."""
    df = bars.withColumn("fall", c("adjusted_close") / F.max("adjusted_close").over(so_far()) - 1)
    return df.groupBy("symbol").agg(r6(F.min("fall") * 100).alias("max_drawdown_percent"))


def returns(bars: DataFrame, price: str = "adjusted_close") -> DataFrame:
    """``symbol, date, r``: simple returns from bar to bar."""
    return bars.select("symbol", "date", (c(price) / lag(price) - 1).alias("r")).where("r is not null")


def risk_metrics(bars: DataFrame, benchmark: str) -> DataFrame:
    """Volatility, beta, Sharpe ratio and risk score over the last 252 returns.

    Beta needs more than 20 dates in common with the benchmark; the benchmark's
    returns are one symbol's days, so the join broadcasts where Spark finds
    them small.
    """
    df = numbered(bars).withColumn("r", c("adjusted_close") / lag("adjusted_close") - 1).withColumn("n", F.count("*").over(whole()))
    last = df.where((c("n") - c("i") < DAYS) & c("r").isNotNull()).select("symbol", "date", "r")
    own = last.groupBy("symbol").agg((F.stddev_samp("r") * F.sqrt(F.lit(DAYS)) * 100).alias("vol"), (F.avg("r") * DAYS * 100).alias("mean"))
    b = last.where(c("symbol") == benchmark).select("date", c("r").alias("b"))
    beta = last.join(b, "date").groupBy("symbol").agg(F.when(F.count("*") > 20, F.covar_samp("r", "b") / F.var_samp("b")).alias("beta"))
    score = F.lit(10)
    for k, limit in reversed(list(enumerate((3, 6, 9, 12, 15, 18, 22, 27, 33), 1))):
        score = F.when(c("vol") < limit, k).otherwise(score)
    return own.join(beta, "symbol", "left").select(
        "symbol", r6("vol").alias("volatility_percent"), r6("beta").alias("beta"), r6((c("mean") - RISK_FREE) / c("vol")).alias("sharpe"),
        score.cast("long").alias("risk_score")
    )


#: Symbols and days on the sides of a tile of returns.
TILE = 64


def _tile(symbols: list[str], days: list[int], values: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tile's symbols, and its days by symbols: values (0 where absent) and presence."""
    names, at = np.unique(np.array(symbols, object), return_inverse=True)
    x, there = np.zeros((TILE, len(names))), np.zeros((TILE, len(names)))
    x[days, at], there[days, at] = values, 1
    return names, x, there


def pair_moments(r: DataFrame, blocks: int) -> DataFrame:
    """``a, b, n, x, y, xx, yy, xy``: for each pair a < b of ``r(symbol, date, r)`` the number of common
    dates and sums of both returns, their squares and products.

    Returns lie in tiles of about 64 symbols by 64 days; tiles of the same days meet, and
    the sums of all their pairs are matrix products.  So a row goes out once for each
    block of symbols, and a pair makes a row for each 64 days, not for each day.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    rows = r.select(
        "symbol", F.floor(day / TILE).alias("t"), F.pmod(day, F.lit(TILE)).alias("d"), "r",
        F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("home")
    )
    tiles = rows.groupBy("t", "home").agg(F.collect_list("symbol").alias("s"), F.collect_list("d").alias("d"), F.collect_list("r").alias("r"))
    dealt = tiles.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ).withColumn("i", F.least("home", "other")).withColumn("j", F.greatest("home", "other"))
    left = dealt.where("home = i").select("t", "i", "j", c("s").alias("s1"), c("d").alias("d1"), c("r").alias("r1"))
    right = dealt.where("home = j").select("t", "i", "j", c("s").alias("s2"), c("d").alias("d2"), c("r").alias("r2"))
    names = ["a", "b", "n", "x", "y", "xx", "yy", "xy"]

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for row in f.itertuples(index=False):
                one, x, p = _tile(row.s1, row.d1, row.r1)
                two, y, q = _tile(row.s2, row.d2, row.r2)
                sums = [p.T @ q, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), x.T @ y]
                u, v = np.nonzero((sums[0] > 0) & ((one[:, None] < two[None, :]) if row.i == row.j else (one[:, None] != two[None, :])))
                a, b, flip = one[u], two[v], one[u] > two[v]
                n, sx, sy, sxx, syy, sxy = (m[u, v] for m in sums)
                yield pd.DataFrame(
                    dict(
                        zip(
                            names,
                            (
                                np.where(flip, b, a), np.where(flip, a, b), n.astype(int), np.where(flip, sy, sx), np.where(flip, sx, sy),
                                np.where(flip, syy, sxx), np.where(flip, sxx, syy), sxy
                            )
                        )
                    )
                )

    parts = left.join(right, ["t", "i", "j"]).mapInPandas(job, "a string, b string, n long, x double, y double, xx double, yy double, xy double")
    return parts.groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in names[2:]])


def correlation_matrix(bars: DataFrame, at_least: int = 10, symbols: list[str] | None = None) -> DataFrame:
    """Correlation of returns for each pair a < b of ``symbols`` (all) on their common dates;
    0 on fewer than ``at_least`` dates, null where one of the two doesn't move."""
    r = returns(bars if symbols is None else bars.where(c("symbol").isin(symbols)))
    count = len(set(symbols)) if symbols is not None else bars.agg(F.approx_count_distinct("symbol")).first()[0]
    g = pair_moments(r, max(1, -(-count // TILE)))
    spread = lambda s, ss: ss - c(s) * c(s) / c("n")
    x, y = spread("x", c("xx")), spread("y", c("yy"))
    rho = F.when((x > 1e-14 * c("xx")) & (y > 1e-14 * c("yy")), (c("xy") - c("x") * c("y") / c("n")) / F.sqrt(x * y))
    return g.select("a", "b", "n", r6(F.when(c("n") >= at_least, rho).otherwise(0.0)).alias("correlation"))


def common_dates(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Bars of the symbols on the dates that all of them have."""
    df = bars.where(c("symbol").isin(symbols))
    full = df.groupBy("date").agg(F.count_distinct("symbol").alias("k")).where(c("k") == len(symbols)).select("date")
    return df.join(full, "date", "left_semi")


def mix_returns(bars: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Daily rebalanced returns of a mix on common dates."""
    total = sum(weights.values())
    share = F.create_map(*[F.lit(x) for s, v in weights.items() for x in (s, v / total)])
    df = returns(common_dates(bars, list(weights)))
    return df.groupBy("date").agg(F.sum(c("r") * share[c("symbol")]).alias("r"))


def allocation_mix(bars: DataFrame, weights: dict[str, float], zeros: bool = False) -> DataFrame:
    """Growth, volatility, Sharpe ratio and drawdown of a daily rebalanced mix.

    A mix is one series of days, so its window is one task's.  Under 30 common
    dates there is no row, or with ``zeros`` one of zeros.
    """
    df = mix_returns(bars, weights).withColumn("mix", F.lit("mix"))
    along = Window.partitionBy("mix").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("growth", F.exp(F.sum(F.log1p("r")).over(along)))
    df = df.withColumn("fall", c("growth") / F.greatest(F.max("growth").over(along), F.lit(1.0)) - 1)
    g = df.groupBy("mix").agg(
        F.count("*").alias("n"), F.max_by("growth", "date").alias("growth"), F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"),
        F.min("fall").alias("fall")
    )
    vol = c("sd") * F.sqrt(F.lit(DAYS)) * 100
    if zeros:
        short = common_dates(bars, list(weights)).agg((F.count_distinct("date") - 1).alias("n")).where("n < 29")  # one row
        none = [F.lit(0.0).alias(x) for x in ("log_growth", "cagr_percent", "volatility_percent", "sharpe", "max_drawdown_percent")]
        return allocation_mix(bars, weights).unionByName(short.select(F.greatest("n", F.lit(0)).alias("n"), *none))
    return g.where("n >= 29").select(
        "n", r6(F.log("growth")).alias("log_growth"), r6((F.pow("growth", DAYS / c("n")) - 1) * 100).alias("cagr_percent"),
        r6(vol).alias("volatility_percent"), r6((c("mean") * DAYS * 100 - RISK_FREE) / vol).alias("sharpe"),
        r6(c("fall") * 100).alias("max_drawdown_percent")
    )


def buy_and_hold_comparison(bars: DataFrame, one: str, split: dict[str, float], initial: float = 10000.0, start: str | None = None) -> DataFrame:
    """Value by date of one symbol against a split that is never rebalanced, bought on
    the first common date from ``start`` on; under two such dates there is no row."""
    prices = common_dates(
        bars if start is None else bars.where(c("date") >= F.lit(start).cast("date")), [one, *split]
    ).groupBy("date").pivot("symbol", [one, *split]).agg(F.first("adjusted_close")).withColumn("k", F.lit(1))
    first = prices.agg(F.count("*").alias("days"), *[F.min_by(s, "date").alias(f"{s}_0") for s in (one, *split)]).where("days >= 2")
    df = prices.crossJoin(F.broadcast(first))  # one row
    held = sum((initial * v * c(s) / c(f"{s}_0") for s, v in split.items()), F.lit(0.0))
    return df.select("date", r6(initial * c(one) / c(f"{one}_0")).alias("single_value"), r6(held).alias("split_value"))


def details(bars: DataFrame, benchmark: str) -> DataFrame:
    """One wide row a symbol: price and change, returns, risk and drawdown."""
    out = snapshot(bars).select("symbol", "date", "price", "change", "change_percent")
    for part in (performance_stats(bars), risk_metrics(bars, benchmark), max_drawdown(bars)):
        out = out.join(part, "symbol")
    return out


def compare(bars: DataFrame, symbols: list[str], benchmark: str) -> DataFrame:
    """The details of two to four symbols, each beside its correlations with the
    others as ``symbol value`` in their order."""
    if not 2 <= len(set(symbols)) <= 4:
        raise ValueError("compare two to four different symbols")
    rho = correlation_matrix(bars, symbols=symbols).select("a", "b", "correlation")
    both = rho.unionByName(rho.select(c("b").alias("a"), c("a").alias("b"), "correlation"))
    line = F.transform(
        F.array_sort(F.collect_list(F.struct("b", "correlation"))), lambda x: F.concat_ws(" ", x["b"], x["correlation"].cast("decimal(8,4)"))
    )
    lists = both.groupBy(c("a").alias("symbol")).agg(F.array_join(line, ", ").alias("correlations"))
    wanted = bars.where(c("symbol").isin([*symbols, benchmark]))
    return details(wanted, benchmark).where(c("symbol").isin(symbols)).join(lists, "symbol", "left")


def listed(bars: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Price and change of the symbols that carry a tag, in order of the symbol."""
    some = tags.where(F.array_contains("tags", tag)).select("symbol", F.array_join(F.array_sort("tags"), ", ").alias("tags"))
    return snapshot(bars).select("symbol", "price", "change_percent").join(some, "symbol").orderBy("symbol")


def movers(bars: DataFrame) -> DataFrame:
    """Best and worst change of the last bar, and the mean change."""
    s = snapshot(bars)
    return s.agg(
        F.max_by("symbol", F.struct("change_percent", "symbol")).alias("top"), F.max("change_percent").alias("top_percent"),
        F.min_by("symbol", F.struct("change_percent", "symbol")).alias("worst"), F.min("change_percent").alias("worst_percent"),
        F.count("*").alias("n")
    )
