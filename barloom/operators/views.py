"""Views that say for each symbol whether they apply, and if not, why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.calendars import factor_momentum, symbol_factor_scores
from barloom.operators.cleaning import date_window, yield_series
from barloom.operators.screeners import annual_growth

c = F.col
#: Tags and words of funds that hold no equity.
OTHER_TAGS = ("treasury", "gold", "bond", "commodity")
OTHER_WORDS = ("treasur", "bond", "fixed income", "commodit", "gold", "cash")
#: Least and greatest exposure in percent.
LEAST, MOST = 30.0, 100.0


def equity_applicable(profiles: DataFrame) -> DataFrame:
    """``profiles(symbol, tags, asset_class)`` with ``applicable`` and ``reason``: an earnings yield
    means something for equity funds alone."""
    kind, tags = F.lower(F.coalesce("asset_class", F.lit(""))), F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    equity = F.array_contains(tags, "equity") | F.contains(kind, F.lit("equity"))
    other = F.arrays_overlap(tags, F.array(*map(F.lit, OTHER_TAGS)))
    for word in OTHER_WORDS:
        other = other | F.contains(kind, F.lit(word))
    reason = F.when(other, "not an equity fund").when(~equity, "not known to be an equity fund")
    return profiles.select("symbol", (equity & ~other).alias("applicable"), reason.alias("reason"))


def fed_report(profiles: DataFrame, facts: DataFrame, rates: DataFrame, as_of: str, lookback: str | None = None, band: float = 0.25) -> DataFrame:
    """Earnings yield against one treasury series for every fund, with ``status`` and ``reason``.

    ``facts(symbol, pe)`` are as of a day, ``rates(symbol, date, close, arrival)`` one dirty series of
    yields in percent.  NOT_APPLICABLE: no equity fund; UNAVAILABLE: no positive P/E, or
    yields that can't be trusted; else OK with the spread in points and what it
    says, the yields' range, mean and the share at or below the newest, how many were
    dropped, and the days between the two observations.
    """
    day = F.lit(as_of).cast("date")
    kept, verdict = yield_series(date_window(rates, lookback, as_of))
    now = kept.agg(F.max_by("y", "date").alias("now"), F.max("date").alias("newest"))
    stats = kept.join(now, F.lit(True)).agg(  # one series of days, one row
        F.first("now").alias("treasury"), F.first("newest").alias("newest"), F.count("*").alias("observations"), F.min("y").alias("low"), F.max("y").alias("high"), F.avg("y").alias("mean"), (
            F.try_divide(F.count_if(c("y") <= c("now")), F.count("*")) * 100
        ).alias("share"),
    )
    told = verdict.agg(F.max("dropped").alias("dropped"), F.min("status").alias("rates_ok"), F.max("reason").alias("rates_reason"))
    df = equity_applicable(profiles).join(facts.select("symbol", "pe"), "symbol", "left").join(stats, F.lit(True), "left").join(told, F.lit(True), "left")
    pe = F.coalesce((c("pe") > 0) & ~F.isnan("pe") & (c("pe") < float("inf")), F.lit(False))
    rates_ok = F.coalesce(c("rates_ok") == "OK", F.lit(False))
    status = F.when(~c("applicable"), "NOT_APPLICABLE").when(~pe | ~rates_ok, "UNAVAILABLE").otherwise("OK")
    why = F.when(~c("applicable"), c("reason")).when(~pe, "no positive P/E").when(~rates_ok, F.coalesce("rates_reason", F.lit("no treasury yields")))
    df = df.withColumn("status", status).withColumn("why", why).withColumn("ey", F.when(c("status") == "OK", 100 / c("pe"))).withColumn("spread", c("ey") - c("treasury"))
    kind = F.when(c("spread") > band, "equities").when(c("spread") < -band, "bonds").when(c("spread").isNotNull(), "equal")
    ok = lambda x: F.when(c("status") == "OK", x)
    return df.select(
        "symbol", "status", c("why").alias("reason"), F.round("ey", 4).alias("earnings_yield"), ok(F.round("treasury", 4)).alias("treasury"), F.round("spread", 4).alias("spread"), kind.alias("more_attractive"),
        ok(c("observations")).alias("observations"), ok(F.round("low", 4)).alias("low"), ok(F.round("high", 4)).alias("high"), ok(F.round("mean", 4)).alias("mean"), ok(F.round("share", 2)).alias("share"), ok(c("dropped")).alias("dropped"), ok(F.datediff(day, "newest")).alias("days_apart"),
    )


def factor_exposure(bars: DataFrame, tags: DataFrame) -> DataFrame:
    """Each symbol's score, the share of scores at or below it, the exposure between 30% and
    100% that follows, and what holding a tag of the leading or lagging factor suggests."""
    factors = factor_momentum(bars, tags)
    ends = factors.agg(F.min_by("tag", "rank").alias("leading"), F.max_by("tag", "rank").alias("lagging"))
    scores = symbol_factor_scores(bars, tags)
    share = F.cume_dist().over(Window.orderBy("score"))  # a row for each symbol
    df = scores.withColumn("share", share * 100).join(tags.select("symbol", "tags"), "symbol").join(ends, F.lit(True))
    has = lambda x: F.array_contains(c("tags"), c(x))
    advice = F.when(has("leading"), "Maintain / Increase Exposure").when(has("lagging"), "Reduce Exposure").otherwise("Neutral")
    return df.select(
        "symbol", "month_percent", "score", F.round("share", 2).alias("share_at_or_below"),
        F.round(LEAST + (MOST - LEAST) * c("share") / 100, 2).alias("exposure_percent"), advice.alias("guidance")
    )


def graham_inputs(facts: DataFrame, annual: DataFrame) -> DataFrame:
    """``facts`` with ``eps_now`` and ``growth`` completed and their bases named: earnings fall back to
    the latest year's, growth (percent) to what yearly earnings grew by, which is no
    forecast and says so."""
    last = annual.where("eps is not null").groupBy("symbol").agg(F.max_by("eps", "year").alias("last_eps"), F.max("year").alias("last_year"))
    past = annual_growth(annual, most=1000).select("symbol", (c("cagr") * 100).alias("past"))
    df = facts.join(last, "symbol", "left").join(past, "symbol", "left")
    eps_basis = F.when(c("eps_now").isNotNull(), "trailing").when(c("last_eps").isNotNull(), F.concat(F.lit("FY"), c("last_year").cast("string")))
    growth_basis = F.when(c("growth").isNotNull(), "forward estimate").when(c("past").isNotNull(), "historical proxy")
    return df.withColumns({"eps_basis": eps_basis, "growth_basis": growth_basis}).withColumns(
        {"eps_now": F.coalesce("eps_now", "last_eps"), "growth": F.coalesce(c("growth").cast("double"), "past")}
    ).drop("last_eps", "last_year", "past")
