"""Cross-sectional screens over a universe.  Missing inputs stay unknown: a
criterion is true, false or null, and a null never counts as passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import latest, numbered, r6, sma, whole

c = F.col
EXCLUDED = ("Financials", "Financial Services", "Utilities")


def price_inputs(bars: DataFrame, days: int = 252, gate: int = 252) -> DataFrame:
    """Last close, high, low and return of the last 252 bars, and SMA 200."""
    df = numbered(bars).withColumn("n", F.count("*").over(whole())).withColumn("sma200", sma("close", 200))
    last = df.where(c("n") - c("i") < days).groupBy("symbol", "n").agg(
        F.max("date").alias("date"), F.max_by("close", "date").alias("close"), F.max("close").alias("high"), F.min("close").alias("low"),
        (F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("ret"), F.max_by("sma200", "date").alias("sma200"),
    )
    return last.where(c("n") >= gate).drop("n")


def canslim_etf(bars: DataFrame) -> DataFrame:
    """Price parts of the growth screen for funds: new highs, leadership, market."""
    p = price_inputs(bars)
    near, lead, market = c("close") >= 0.85 * c("high"), c("close") >= 1.3 * c("low"), c("close") > c("sma200")
    df = p.select("symbol", "date", "close", near.alias("n"), lead.alias("l"), market.alias("m"))
    return df.withColumn("score", sum((F.coalesce(c(x).cast("long"), F.lit(0)) for x in "nlm"), F.lit(0)).cast("long"))


def relative_strength(bars: DataFrame) -> DataFrame:
    """Rank of the trailing return and the share of the universe behind it."""
    p = price_inputs(bars).select("symbol", "ret")
    order = Window.orderBy(F.desc("ret"), "symbol")  # one row for each symbol
    p = p.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy()))
    return p.select(
        "symbol", r6("ret").alias("ret"), "rank",
        F.round(F.when(c("n") > 1, (c("n") - c("rank")) / (c("n") - 1) * 100).otherwise(100.0), 1).alias("percentile")
    )


def market_direction(bars: DataFrame, index: str) -> DataFrame:
    """Whether the index closes above its own SMA 200."""
    df = latest(numbered(bars.where(c("symbol") == index)).withColumn("sma200", sma("close", 200)))
    return df.select("symbol", "date", "close", r6("sma200").alias("sma200"), (c("close") > c("sma200")).alias("confirmed_up"))


def annual_growth(eps: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """Growth from the first to the last of the latest years of earnings."""
    known = eps.where("eps is not null").withColumn(
        "k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("year")))
    ).where(c("k") <= most)
    g = known.groupBy("symbol").agg(
        F.count("*").alias("years"), F.min_by("eps", "year").alias("first"), F.max_by("eps", "year").alias("last"), F.min("year").alias("y0"),
        F.max("year").alias("y1")
    )
    ok = (c("years") >= least) & (c("first") > 0)
    rate = F.when(ok & (c("last") > 0), F.pow(c("last") / c("first"), 1 / (c("y1") - c("y0"))) - 1)
    return g.select("symbol", "years", "first", F.when(ok, c("last") / c("first") - 1).alias("growth"), rate.alias("cagr"))


def _status(rule, known, applies=None) -> F.Column:
    out = F.when(~known, "UNAVAILABLE")
    if applies is not None:
        out = out.when(~applies, "NOT_APPLICABLE")
    return out.when(rule, "PASS").otherwise("FAIL")


def canslim_stocks(bars: DataFrame, facts: DataFrame, eps: DataFrame, members: DataFrame, index_up: DataFrame) -> DataFrame:
    """Seven criteria for each member; members without any data stay, unknown."""
    strength = relative_strength(bars).select("symbol", "percentile")
    growth = annual_growth(eps).select("symbol", c("growth").alias("eps_growth"), c("years").alias("eps_years"), c("first").alias("eps_first"))
    df = members.join(facts, "symbol", "left").join(price_inputs(bars).select("symbol", "close", "high"), "symbol", "left")
    df = df.join(strength, "symbol", "left").join(growth, "symbol", "left")
    df = df.join(index_up.select("confirmed_up"), F.lit(True), "left")  # at most one row
    both = c("eps_now").isNotNull() & c("eps_ago").isNotNull()
    checks = {
        "c": _status((c("eps_now") / c("eps_ago") - 1) >= 0.25, both, c("eps_ago") > 0),
        "a": _status(
            (c("eps_growth") >= 0.25) & (c("roe") >= 0.17), F.coalesce(c("eps_years") >= 3, F.lit(False)) & c("roe").isNotNull(), c("eps_first") > 0
        ),
        "n": _status(c("close") / c("high") >= 0.85, c("close").isNotNull()),
        "s": _status(c("shares_float") < 25000000, c("shares_float").isNotNull()),
        "l": _status(c("percentile") >= 80, c("percentile").isNotNull()),
        "i": _status(c("holders") >= 3, c("holders").isNotNull()),
        "m": _status(c("confirmed_up"), c("confirmed_up").isNotNull()),
    }
    df = df.select("symbol", "sector", *[x.alias(k) for k, x in checks.items()])
    how_many = lambda s: F.size(F.filter(F.array(*checks), lambda x: x == s)).cast("long")
    df = df.withColumn("passed", how_many("PASS")).withColumn("unavailable", how_many("UNAVAILABLE") + how_many("NOT_APPLICABLE"))
    quality = F.when(c("unavailable") == 0, "COMPLETE").when(c("unavailable") < len(checks), "PARTIAL").otherwise("INSUFFICIENT")
    return df.withColumn("quality", quality).withColumn("qualifies", c("passed") >= 5)


def page(scan: DataFrame, least: int, offset: int, limit: int, sectors: list[str] | None = None, complete_only: bool = False) -> DataFrame:
    """A page of a scan with the number of rows that match in all; ``sectors``
    and ``complete_only`` narrow it."""
    if sectors:
        scan = scan.where(F.lower("sector").isin([x.lower() for x in sectors]))
    if complete_only:
        scan = scan.where(c("quality") == "COMPLETE")
    df = scan.where(c("passed") >= least).withColumn("total", F.count("*").over(Window.partitionBy()))
    return df.orderBy(F.desc("passed"), "symbol").offset(offset).limit(limit).select("symbol", "passed", "total")


def magic_formula(facts: DataFrame) -> DataFrame:
    """Earnings yield and return on capital, ranked; excluded rows say why."""
    ev = F.coalesce(c("enterprise_value"), c("market_cap") + c("total_debt") - c("total_cash"))
    capital = (c("current_assets") - c("cash")) - (c("current_liabilities") - c("current_debt")) + c("net_ppe")
    df = facts.withColumn("ev", ev).withColumn("capital", F.when(c("net_ppe") >= 0, capital))
    df = df.withColumn("ey", F.when(c("ev") > 0, F.round(c("ebit") / c("ev"), 6))).withColumn(
        "roc", F.when(c("capital") > 0, F.round(c("ebit") / c("capital"), 6))
    )
    reason = (
        F.when(c("ebit").isNull(), "no data").when(c("sector").isin(*EXCLUDED), "sector").when(c("price_currency") != c("financial_currency"), "currency").when(c("ey").isNull() | c("roc").isNull(), "invalid")
    )
    df = df.withColumn("excluded", reason)
    ok = df.where("excluded is null")
    rank = lambda x: F.rank().over(Window.orderBy(F.desc(F.round(x, 10)))).cast("long")
    ok = ok.withColumn("ey_rank", rank("ey")).withColumn("roc_rank", rank("roc")).withColumn("combined", c("ey_rank") + c("roc_rank"))
    ok = ok.withColumn("place", F.row_number().over(Window.orderBy("combined", "ey_rank", "roc_rank", "symbol")).cast("long"))
    out = ["symbol", "ey", "roc", "ey_rank", "roc_rank", "combined", "place", "excluded"]
    gone = df.where("excluded is not null")
    for x in ("ey_rank", "roc_rank", "combined", "place"):
        gone = gone.withColumn(x, F.lit(None).cast("long"))
    return ok.select(*out).unionByName(gone.select(*out))


def magic_formula_top(ranked: DataFrame, n: int = 25, also: list[str] | None = None) -> DataFrame:
    """The first ``n`` places, and the rows of the symbols asked for."""
    return ranked.where((c("place") <= n) | c("symbol").isin(also or []))


def distribution(scan: DataFrame, column: str) -> DataFrame:
    """How many rows have each value of a column, and their share in percent."""
    g = scan.groupBy(c(column).alias("value")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(c("n") / F.sum("n").over(Window.partitionBy()) * 100, 6))


def graham(facts: DataFrame, prices: DataFrame, aaa_yield: float = 4.8) -> DataFrame:
    """EPS x (8.5 + 2g) x 4.4 / Y with growth capped at 15, the upside, the price
    with a margin of safety, and the value at half and no growth."""
    df = facts.join(prices, "symbol", "left")
    value = lambda g: F.when((c("eps_now") > 0) & g.isNotNull(), c("eps_now") * (8.5 + 2 * g) * (4.4 / aaa_yield))
    g = F.least(c("growth"), F.lit(15)).cast("double")
    df = df.withColumn("value", value(g))
    reason = F.when(c("eps_now").isNull(), "no earnings").when(c("eps_now") <= 0, "earnings not positive").when(c("growth").isNull(), "no growth").when(c("close").isNull(), "no price")
    return df.select(
        "symbol", r6("value").alias("value"), r6(value(g / 2)).alias("half_growth"), r6(value(F.lit(0.0))).alias("no_growth"),
        r6(c("value") * 0.7).alias("with_margin"), r6((c("value") - c("close")) / c("close") * 100).alias("upside_percent"),
        reason.alias("unavailable")
    )


def fed_model(facts: DataFrame, rates: DataFrame, band: float = 0.25) -> DataFrame:
    """Earnings yield against the latest treasury yield, and where that yield
    stands in its own history (only yields in (0, 20] count)."""
    y = rates.where((c("y") > 0) & (c("y") <= 20))
    now = y.agg(
        F.max_by("y", "date").alias("now"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("y").alias("mean"), F.collect_list("y").alias("all")
    )
    share = F.size(F.filter("all", lambda x: x <= c("now"))) / F.size("all")
    now = now.select("now", "lo", "hi", "mean", share.alias("share"))
    df = facts.join(now, F.lit(True)).withColumn("ey", F.when(c("pe") > 0, 100 / c("pe"))).withColumn("spread", c("ey") - c("now"))
    kind = F.when(c("spread") > band, "above").when(c("spread") < -band, "below").when(c("spread").isNotNull(), "near")
    return df.select(
        "symbol", r6("ey").alias("earnings_yield"), r6("now").alias("treasury"), r6("spread").alias("spread"), kind.alias("kind"),
        r6("mean").alias("treasury_mean"), r6("share").alias("treasury_share")
    )


def wilder_last(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI seeded with the plain mean of the first n changes; flat gives null."""
    df = bars.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("p"))
    change = F.transform(F.sequence(F.lit(2), F.size("p")), lambda i: F.element_at("p", i) - F.element_at("p", i - 1))
    df = df.where(F.size("p") > n).withColumn("d", change)

    def fold(sign: int) -> F.Column:
        part = F.transform("d", lambda x: F.greatest(sign * x, F.lit(0.0)))
        seed = F.aggregate(F.slice(part, 1, n), F.lit(0.0), lambda a, x: a + x) / n
        return F.aggregate(F.slice(part, n + 1, F.greatest(F.size("d") - n, F.lit(0))), seed, lambda a, x: (a * (n - 1) + x) / n)

    df = df.withColumn("up", fold(1)).withColumn("down", fold(-1))
    rsi = F.when((c("up") == 0) & (c("down") == 0), None).when(c("down") == 0, 100.0).otherwise(100 - 100 / (1 + c("up") / c("down")))
    return df.select("symbol", rsi.alias("rsi"))


def composite(bars: DataFrame, facts: DataFrame) -> DataFrame:
    """Price above SMA 200, RSI below 70, forward P/E below 25, debt to equity
    below 1.5: 0 to 4 points, with what is unknown or not meaningful."""
    p = latest(numbered(bars).withColumn("sma200", sma("close", 200))).select("symbol", "close", "sma200")
    df = facts.select("symbol", "forward_pe", "debt_to_equity").join(p, "symbol", "left").join(wilder_last(bars), "symbol", "left")
    rule = lambda ok, known, meaningful=F.lit(True): F.when(~known, "unavailable").when(~meaningful, "not_meaningful").when(ok, "pass").otherwise("fail")
    checks = {
        "above_ma": rule(c("close") > c("sma200"), c("sma200").isNotNull()),
        "rsi_below": rule(c("rsi") < 70, c("rsi").isNotNull()),
        "pe_below": rule(c("forward_pe") < 25, c("forward_pe").isNotNull(), c("forward_pe") > 0),
        "de_below": rule(c("debt_to_equity") < 1.5, c("debt_to_equity").isNotNull(), c("debt_to_equity") >= 0),
    }
    df = df.select("symbol", r6("rsi").alias("rsi"), *[x.alias(k) for k, x in checks.items()], (c("rsi") < 30).alias("oversold"))
    how_many = lambda s: F.size(F.filter(F.array(*checks), lambda x: x == s)).cast("long")
    df = df.withColumn("score", how_many("pass")).withColumn("unknown", how_many("unavailable"))
    return df.withColumn("status", F.when(c("unknown") == 0, "complete").when(c("unknown") < 4, "partial").otherwise("unavailable"))
