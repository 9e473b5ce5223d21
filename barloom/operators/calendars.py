"""Calendar views: months, quarters, years, weeks and rotations by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.recursive import with_weekly_indicators
from barloom.functions.series import lag, latest, numbered, r6, rows, std

c = F.col


def month_returns(bars: DataFrame, as_of: str, price: str = "adjusted_close") -> DataFrame:
    """``symbol, m, r, status`` (m = 12 * year + month - 1) for every month from
    the first to the last.

    A return needs the month just before; the first month has no base, a month
    after a gap lacks its prior, and the last is partial unless ``as_of`` is past
    its end and its last bar is at most four days before its last weekday.
    """
    m = F.year("date") * 12 + F.month("date") - 1
    ends = bars.groupBy("symbol", m.alias("m")).agg(F.max_by(price, "date").alias("p"), F.max("date").alias("last"))
    by_m = Window.partitionBy("symbol").orderBy("m")
    ends = ends.withColumn("before", F.lag("p").over(by_m)).withColumn("before_m", F.lag("m").over(by_m)).withColumn("is_last", F.lead("m").over(by_m).isNull())
    span = ends.groupBy("symbol").agg(F.min("m").alias("a"), F.max("m").alias("z"))
    spine = span.select("symbol", F.explode(F.sequence("a", "z")).alias("m"))
    end = F.last_day("last")
    weekday = F.dayofweek(end)  # 1 is Sunday
    last_weekday = F.when(weekday == 1, F.date_sub(end, 2)).when(weekday == 7, F.date_sub(end, 1)).otherwise(end)
    whole = (F.lit(as_of).cast("date") > end) & (c("last") >= F.date_sub(last_weekday, 4))
    df = spine.join(ends, ["symbol", "m"], "left")
    status = (
        F.when(c("p").isNull(), "missing").when(c("before").isNull(), "no_base").when(c("before_m") != c("m") - 1, "prior_month_missing").when(c("is_last") & ~whole, "partial_month").otherwise("ok")
    )
    return df.withColumn("status", status).select(
        "symbol", "m", "status", F.when(c("status").isin("ok", "partial_month"), c("p") / c("before") - 1).alias("r")
    )


def seasonal_months(bars: DataFrame, as_of: str) -> DataFrame:
    df = month_returns(bars, as_of)
    return df.select(
        "symbol", F.floor(c("m") / 12).alias("year"), (c("m") % 12 + 1).cast("long").alias("month"), "status",
        r6(c("r") * 100).alias("return_percent")
    )


def seasonal_periods(bars: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    """Linked returns of quarters (3) or years (12) whose months are all ok."""
    df = month_returns(bars, as_of).where("status = 'ok'").withColumn("k", F.floor(c("m") / months))
    g = df.groupBy("symbol", "k").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("r")).where(c("n") == months)
    return g.select(
        "symbol", F.floor(c("k") * months / 12).alias("year"), (c("k") % int(12 / months) + 1).cast("long").alias("part"),
        r6(c("r") * 100).alias("return_percent")
    )


def seasonal_summary(bars: DataFrame, as_of: str) -> DataFrame:
    """Per calendar month: mean, median, share of rises, best and worst."""
    df = month_returns(bars, as_of).where("status = 'ok'").withColumn("month", (c("m") % 12 + 1).cast("long"))
    return df.groupBy("symbol", "month").agg(
        F.count("*").alias("n"), r6(F.avg("r") * 100).alias("mean_percent"), r6(F.percentile("r", F.lit(0.5)) * 100).alias("median_percent"),
        r6(F.count_if(c("r") > 0) / F.count("*") * 100).alias("positive_percent"), r6(F.max("r") * 100).alias("best_percent"), r6(F.min("r") * 100).alias("worst_percent"),
    )


def annual_cells(bars: DataFrame, as_of: str, price: str = "adjusted_close") -> DataFrame:
    """``symbol, year, status, r``: calendar-year returns on the year before.

    A year is complete if ``as_of`` is past it and its last bar is at most four
    days before the year's last weekday, else partial.
    """
    ends = bars.groupBy("symbol", F.year("date").alias("year")).agg(F.max_by(price, "date").alias("p"), F.max("date").alias("last"))
    by_year = Window.partitionBy("symbol").orderBy("year")
    ends = ends.withColumn("before", F.lag("p").over(by_year)).withColumn("before_year", F.lag("year").over(by_year))
    years = ends.select("year").distinct()
    grid = ends.select("symbol").distinct().join(years, F.lit(True))  # symbols by years
    df = grid.join(ends, ["symbol", "year"], "left")
    first = F.min(F.when(c("p").isNotNull(), c("year"))).over(Window.partitionBy("symbol"))
    end = F.make_date("year", F.lit(12), F.lit(31))
    last_weekday = F.when(F.dayofweek(end) == 1, F.date_sub(end, 2)).when(F.dayofweek(end) == 7, F.date_sub(end, 1)).otherwise(end)
    status = (
        F.when(c("p").isNull(), F.when(c("year") < first, "not_listed").otherwise("missing"))
        .when(c("before").isNull(), "no_base")
        .when(c("before_year") != c("year") - 1, "prior_year_missing")
        .when((end >= F.lit(as_of).cast("date")) | (c("last") < F.date_sub(last_weekday, 4)), "partial")
        .otherwise("complete")
    )
    df = df.withColumn("status", status)
    return df.select(
        "symbol", c("year").cast("long").alias("year"), "status", F.when(c("status").isin("complete", "partial"), c("p") / c("before") - 1).alias("r")
    )


def diversification(bars: DataFrame, weights: dict[str, float], as_of: str) -> DataFrame:
    """Complete years ranked in each year, with a PORTFOLIO row where every
    weighted symbol is complete (weights reset each year)."""
    done = annual_cells(bars, as_of).where("status = 'complete'").select("symbol", "year", "r")
    total = sum(weights.values())
    share = F.create_map(*[F.lit(x) for s, v in weights.items() for x in (s, v / total)])
    mix = done.where(c("symbol").isin(list(weights))).groupBy("year").agg(F.count("*").alias("k"), F.sum(c("r") * share[c("symbol")]).alias("r"))
    mix = mix.where(c("k") == len(weights)).select(F.lit("PORTFOLIO").alias("symbol"), "year", "r")
    both = done.unionByName(mix)
    rank = F.rank().over(Window.partitionBy("year").orderBy(F.desc(F.round("r", 10))))
    return both.select("symbol", "year", r6(c("r") * 100).alias("return_percent"), rank.cast("long").alias("rank"))


def adjustment_warnings(bars: DataFrame, most: float = 0.20) -> DataFrame:
    """Jumps of more than ``most`` in adjusted to raw close, or a ratio that never
    moves over two years; symbols with fewer than three such ratios give no row."""
    df = numbered(bars.where("close > 0 and adjusted_close > 0")).withColumn("ratio", c("adjusted_close") / c("close"))
    df = df.withColumn("jump", F.abs(c("ratio") / lag("ratio") - 1))
    g = df.groupBy("symbol").agg(
        F.count_if(c("jump") > most).alias("jumps"), r6(F.max("jump") * 100).alias("largest_percent"),
        (F.max("ratio") - F.min("ratio")).alias("spread"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.count("*").alias("n")
    )
    return g.where("n >= 3").select("symbol", "jumps", "largest_percent", ((c("spread") < 1e-9) & (c("days") > 730)).alias("constant_ratio"))


def monthly_cycle(bars: DataFrame, gate: int = 5) -> DataFrame:
    """Where the last bar is in the month's business days: short in the first
    three, long in the last five, flat between; and the next change."""
    df = latest(numbered(bars), gate)
    weekdays = lambda a, z: F.filter(F.sequence(a, z), lambda d: F.weekday(d) < 5)
    df = df.withColumn("days", weekdays(F.trunc("date", "month"), F.last_day("date"))).withColumn("n", F.size("days").cast("long"))
    soon = F.date_add(F.last_day("date"), 1)
    df = df.withColumn("next_first", F.array_min(weekdays(soon, F.date_add(soon, 6)))).withColumn(
        "k", (F.size(F.filter("days", lambda d: d < c("date"))) + 1).cast("long")
    )
    df = df.withColumn("enter", F.least(F.greatest(c("n") - 4, F.lit(4)), c("n")))
    phase = F.when(c("k") <= 3, "Short Window (Start of Month)").when(c("k") < c("enter"), "Mid-Month (No Position)").when(c("k") <= c("n"), "Long Window (End of Month)").otherwise("Post Long-Exit (No Position)")
    position = F.when(c("k") <= 3, "Short").when((c("k") >= c("enter")) & (c("k") <= c("n")), "Long").otherwise("Flat")
    action = F.when(c("k") < 3, "Exit Short").when(c("k") < c("enter"), "Enter Long").when(c("k") < c("n"), "Exit Long").otherwise("Enter Short")
    at = lambda i: F.element_at("days", i.cast("int"))
    when = F.when(c("k") < 3, at(F.lit(3))).when(c("k") < c("enter"), at(c("enter"))).when(c("k") < c("n"), at(c("n"))).otherwise(c("next_first"))
    return df.select(
        "symbol", "date", c("k").alias("business_day"), c("n").alias("business_days"), phase.alias("phase"), position.alias("position"),
        action.alias("next_action"), when.alias("next_date")
    )


def factor_momentum(bars: DataFrame, tags: DataFrame) -> DataFrame:
    """Mean 21-bar return of each tag, its rank, and the share of tags below."""
    df = numbered(bars).withColumn("month", (c("close") / lag("close", 21) - 1) * 100)
    own = latest(df, 26).select("symbol", "month")
    t = own.join(
        tags.select("symbol", F.explode("tags").alias("tag")), "symbol"
    ).groupBy("tag").agg(F.avg("month").alias("mean"), F.count("*").alias("n"))
    order = Window.orderBy(F.desc("mean"), "tag")  # a row for each tag
    return t.select(
        "tag", "n", r6("mean").alias("mean_percent"), F.row_number().over(order).cast("long").alias("rank"),
        r6(F.cume_dist().over(Window.orderBy("mean"))).alias("share_below")
    )


def symbol_factor_scores(bars: DataFrame, tags: DataFrame) -> DataFrame:
    """Each symbol's mean of its tags' means."""
    df = numbered(bars).withColumn("month", (c("close") / lag("close", 21) - 1) * 100)
    own = latest(df, 26).select("symbol", "month")
    long = own.join(tags.select("symbol", F.explode("tags").alias("tag")), "symbol")
    means = long.groupBy("tag").agg(F.avg("month").alias("mean"))
    return long.join(means, "tag").groupBy("symbol").agg(
        r6(F.max("month")).alias("month_percent"), r6(F.avg("mean")).alias("score"), F.count("*").alias("n_tags")
    )


FEATURES = {"rsi": 1, "macd_hist": 1, "ppo": 1, "cmf": 1, "percent_b": 1, "volatility": -1, "downside": -1, "scaled_return": 1, "adx": 0}


def weekly_features(weeks: DataFrame, benchmark: str) -> DataFrame:
    """Nine features of weekly bars: ``symbol, week`` and the keys of FEATURES.

    The scaled return is a week's return over its volatility less the
    benchmark's (zero for the benchmark itself, null where it has no such week).
    """
    df = with_weekly_indicators(weeks.withColumnRenamed("week", "date")).withColumn("r", c("close") / lag("close") - 1)
    span = c("high") - c("low")
    df = df.withColumn("flow", F.when(span > 0, ((c("close") - c("low")) - (c("high") - c("close"))) / span).otherwise(0.0) * c("volume"))
    volume = F.sum("volume").over(rows(20))
    cmf = F.when((F.count("flow").over(rows(20)) == 20) & (volume > 0), F.sum("flow").over(rows(20)) / volume)
    mean, sd = F.when(F.count("close").over(rows(20)) == 20, F.avg("close").over(rows(20))), std("close", 20)
    band = F.when(sd > 0, (c("close") - (mean - 2 * sd)) / (4 * sd))
    down = F.least("r", F.lit(0.0))
    downside = F.when(F.count("r").over(rows(12)) == 12, F.sqrt(F.avg(down * down).over(rows(12))) * F.sqrt(F.lit(52.0)))
    df = df.withColumn("cmf", cmf).withColumn("percent_b", band).withColumn("volatility", std("r", 12) * F.sqrt(F.lit(52.0))).withColumn("downside", downside)
    df = df.withColumn("own", F.when(c("volatility") > 0, c("r") / c("volatility")))
    base = df.where(c("symbol") == benchmark).select("date", c("own").alias("base"))
    df = df.join(base, "date", "left").withColumn("scaled_return", F.when(c("symbol") == benchmark, 0.0).otherwise(c("own") - c("base")))
    return df.select("symbol", c("date").alias("week"), *FEATURES)


def standardized(features: DataFrame, gate: int = 90) -> DataFrame:
    """Features as z-scores over each symbol's own history (no variance: zero),
    and ``composite``: the mean of signed scores, ADX with MACD's sign."""
    every = Window.partitionBy("symbol")
    df = features.withColumn("n_weeks", F.count("*").over(every)).where(c("n_weeks") >= gate)
    for name in FEATURES:
        sd = F.stddev_samp(name).over(every)
        df = df.withColumn(f"z_{name}", F.when(sd > 0, (c(name) - F.avg(name).over(every)) / sd).when(c(name).isNotNull(), 0.0))
    signed = [c(f"z_{x}") * k for x, k in FEATURES.items() if k] + [c("z_adx") * F.when(c("z_macd_hist") >= 0, 1.0).when(c("z_macd_hist") < 0, -1.0)]
    kept = F.filter(F.array(*signed), lambda x: x.isNotNull())
    return df.withColumn("composite", F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)))


def composite_scores(features: DataFrame) -> DataFrame:
    """The composite at each symbol's last week and its logistic score."""
    df = standardized(features)
    df = df.withColumn("is_last", F.lead("week").over(Window.partitionBy("symbol").orderBy("week")).isNull()).where("is_last")
    score = 100 / (1 + F.exp(-3 * c("composite")))
    return df.select(
        "symbol", "week", r6("composite").alias("composite"), r6(score).alias("score"),
        F.when(score >= 50, "Risk-On").otherwise("Risk-Off").alias("regime")
    )


def composite_chart(features: DataFrame, weeks: int = 104) -> DataFrame:
    """Mean composite and volatility across symbols in the last weeks."""
    df = standardized(features).groupBy("week").agg(
        F.avg("composite").alias("composite"), F.avg("volatility").alias("volatility"), F.count("composite").alias("n")
    )
    df = df.where("n > 0").orderBy(F.desc("week")).limit(weeks)
    return df.select("week", r6("composite").alias("composite"), r6("volatility").alias("volatility"), "n")
