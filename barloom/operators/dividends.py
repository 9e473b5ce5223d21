"""Dividends: yearly totals, yield, growth, cuts, payout and risk signs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import r6

c = F.col


def upcoming(pays: DataFrame, as_of: str) -> DataFrame:
    """Payments with ``upcoming``: whether the ex-date is after ``as_of``."""
    return pays.withColumn("upcoming", c("ex_date") > F.lit(as_of).cast("date"))


def annual_table(pays: DataFrame, as_of: str) -> DataFrame:
    """A row for every complete year from the first payment on."""
    last = F.year(F.lit(as_of).cast("date")) - 1
    y = pays.withColumn("year", F.year("ex_date"))
    span = y.groupBy("symbol").agg(F.min("year").alias("a")).where(c("a") <= last)
    spine = span.select("symbol", F.explode(F.sequence(c("a"), last)).alias("year"))
    g = y.groupBy("symbol", "year").agg(
        F.sum(F.when(~c("is_special"), c("amount"))).alias("total"), F.count_if(~c("is_special")).alias("n"),
        F.count_if("is_special").alias("n_special")
    )
    df = spine.join(g, ["symbol", "year"], "left")
    return df.select(
        "symbol", c("year").cast("long").alias("year"), r6(F.coalesce("total", F.lit(0.0))).alias("total"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("n_special", F.lit(0)).cast("long").alias("n_special")
    )


def modal_counts(table: DataFrame) -> DataFrame:
    """The most common number of payments in the last five paying years (ties:
    the one met last)."""
    paid = table.where("n > 0").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("year")))).where("k <= 5")
    g = paid.groupBy("symbol", "n").agg(F.count("*").alias("times"), F.max("year").alias("last"))
    return g.groupBy("symbol").agg(F.max_by("n", F.struct("times", "last")).alias("modal"))


def yields(pays: DataFrame, bars: DataFrame, as_of: str) -> DataFrame:
    """Payments of the last 365 days over the last close, and the latest regular
    payment times the modal count."""
    day = F.lit(as_of).cast("date")
    price = bars.where(c("date") <= day).groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    past = pays.where(c("ex_date") <= day)
    g = past.groupBy("symbol").agg(
        F.sum(F.when(c("ex_date") > F.date_sub(day, 365), c("amount"))).alias("ttm"),
        F.max_by("amount", F.when(~c("is_special"), c("ex_date"))).alias("latest")
    )
    df = price.join(g, "symbol", "left").join(modal_counts(annual_table(pays, as_of)), "symbol", "left")
    return df.select(
        "symbol", "close", r6("ttm").alias("ttm"), r6(c("ttm") / c("close") * 100).alias("yield_percent"),
        r6(c("latest") * c("modal") / c("close") * 100).alias("forward_percent")
    )


def growth(table: DataFrame) -> DataFrame:
    """Change on the year before, growth rates over 3, 5 and 10 years, and the runs
    of increases and of years with payments, for each year."""
    by = Window.partitionBy("symbol").orderBy("year")
    df = table.withColumn("before", F.lag("total").over(by))
    df = df.withColumn("change", F.when(c("before") > 0, (c("total") / c("before") - 1) * 100))
    for n in (3, 5, 10):
        old = F.lag("total", n).over(by)
        df = df.withColumn(f"cagr{n}", F.when((old > 0) & (c("total") > 0), (F.pow(c("total") / old, F.lit(1.0 / n)) - 1) * 100))
    df = df.withColumn("up", F.coalesce(c("change") > 0, F.lit(False)))
    df = df.withColumn("isle", F.sum(F.when(c("up"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.when(c("up"), 1).otherwise(0)).over(Window.partitionBy("symbol", "isle").orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("gap", F.sum(F.when(c("n") > 0, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    paid = F.sum(F.when(c("n") > 0, 1).otherwise(0)).over(
        Window.partitionBy("symbol", "gap").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    )
    kind = F.when(c("change") > 0.5, "Positive").when(c("change") < -0.5, "Negative").when(c("change").isNotNull(), "Flat")
    return df.select(
        "symbol", "year", r6("change").alias("change_percent"), kind.alias("kind"), *[r6(f"cagr{n}").alias(f"cagr{n}") for n in (3, 5, 10)],
        run.cast("long").alias("increases"), paid.cast("long").alias("paying_years")
    )


#: Share of changes that must be rises, with no fall, for a rising trend.
INCREASING = 0.6


def trend(table: DataFrame) -> DataFrame:
    """Class of the last five usable changes.

    A change is usable where both years have the usual number of payments, or
    where payments stop.  Fewer than three paying years, or fewer than two usable
    changes, are too little history; where half of the last six years or more
    have another number of payments the trend is irregular.
    """
    by = Window.partitionBy("symbol").orderBy("year")
    df = table.join(modal_counts(table), "symbol", "left").withColumn("usual", F.coalesce(c("n") == c("modal"), F.lit(False)))
    df = df.withColumn("before", F.lag("total").over(by)).withColumn("change", (c("total") / c("before") - 1) * 100)
    stop = (c("n") == 0) & (F.lag("n").over(by) > 0)
    df = df.withColumn("usable", (c("before") > 0) & ((c("usual") & F.lag("usual").over(by)) | stop))
    back = Window.partitionBy("symbol").orderBy(F.desc("year"))
    df = df.withColumn("nth", F.row_number().over(back)).withColumn("kth", F.when(c("usable"), F.count(F.when(c("usable"), 1)).over(back)))
    recent = c("kth") <= 5
    g = df.groupBy("symbol").agg(
        F.count_if(c("n") > 0).alias("paying"),
        F.count_if(recent).alias("changes"),
        F.count_if(recent & (c("change") > 0.5)).alias("up"),
        F.count_if(recent & (c("change") < -0.5)).alias("down"),
        F.avg(F.when(c("nth") <= 6, F.when(c("usual"), 0.0).otherwise(1.0))).alias("unusual"),
    )
    kind = F.when(
        c("down") == 0, F.when(c("up") >= INCREASING * c("changes"), "Increasing").otherwise("Stable")
    ).when(c("up") == 0, "Decreasing").otherwise("Irregular")
    kind = F.when(c("paying") < 3, "Insufficient History").when(c("unusual") >= 0.5, "Irregular").when(c("changes") < 2, "Insufficient History").otherwise(kind)
    return g.select("symbol", "changes", "up", "down", kind.alias("trend"))


def cut_events(pays: DataFrame) -> DataFrame:
    """Regular payments at most 90% of the one before (400 days or less ago);
    confirmed if one of the next two is at most 95% of it."""
    by = Window.partitionBy("symbol").orderBy("ex_date")
    df = pays.where(~c("is_special")).withColumn("before", F.lag("amount").over(by)).withColumn("gap", F.datediff("ex_date", F.lag("ex_date").over(by)))
    df = df.withColumn("next", F.least(F.lead("amount", 1).over(by), F.lead("amount", 2).over(by)))
    df = df.where((c("gap") <= 400) & (c("amount") <= 0.9 * c("before")))
    return df.select(
        "symbol", "ex_date", "before", "amount", r6((c("amount") / c("before") - 1) * 100).alias("change_percent"),
        F.coalesce(c("next") <= 0.95 * c("before"), F.lit(False)).alias("confirmed")
    )


#: Days between payments by their number a year; others are 365.2 over the number.
INTERVALS = {12: 30.4, 4: 91.3, 2: 182.6, 1: 365.2}


def payment_status(pays: DataFrame, as_of: str) -> DataFrame:
    """Days since the last regular payment against the expected interval."""
    day = F.lit(as_of).cast("date")
    modal = modal_counts(annual_table(pays, as_of))
    g = pays.where(~c("is_special")).groupBy("symbol").agg(
        F.max(F.when(c("ex_date") <= day, c("ex_date"))).alias("last"), F.count_if(c("ex_date") > day).alias("upcoming")
    )
    df = g.join(modal, "symbol", "left").withColumn("days", F.datediff(day, "last").cast("long")).withColumn(
        "expected", F.coalesce(*[F.when(c("modal") == n, days) for n, days in INTERVALS.items()], 365.2 / c("modal"))
    )
    late = F.when(c("upcoming") > 0, "declared").when(
        c("days") > F.greatest(2 * c("expected"), c("expected") + 90), "suspended"
    ).when(c("days") > 1.35 * c("expected") + 15, "delayed").otherwise("on time")
    return df.select("symbol", "last", "days", r6("expected").alias("expected_days"), late.alias("status"))


def payout(pays: DataFrame, eps: DataFrame) -> DataFrame:
    """Payments in each fiscal year over its earnings, and the band."""
    y = pays.groupBy("symbol", F.year("ex_date").cast("long").alias("year")).agg(F.sum("amount").alias("paid"))
    df = eps.join(y, ["symbol", "year"], "left").withColumn("ratio", F.when(c("eps") > 0, F.coalesce("paid", F.lit(0.0)) / c("eps") * 100))
    band = F.when(c("ratio") <= 60, "low").when(c("ratio") <= 80, "moderate").when(c("ratio") <= 100, "high").when(c("ratio").isNotNull(), "above earnings").otherwise("unavailable")
    return df.select("symbol", "year", r6("ratio").alias("payout_percent"), band.alias("band"))


def sustainability(paid_out: DataFrame, statements: DataFrame) -> DataFrame:
    """Five factors of the latest year, each supportive, neutral, a concern or
    null where it can't be told: payout, earnings, revenue, cover of payments by
    free cash flow, and net debt over EBITDA.

    ``statements``: symbol, year, eps, revenue, fcf, paid, ebitda, net_debt.
    """
    by = Window.partitionBy("symbol").orderBy("year")
    df = statements.withColumn("eps1", F.lag("eps").over(by)).withColumn("revenue1", F.lag("revenue").over(by))
    df = df.withColumn("fell", F.when(c("eps") < c("eps1"), 1).otherwise(0)).withColumn("falls", F.sum("fell").over(by.rowsBetween(-2, 0)))
    df = df.withColumn("last", F.lead("year").over(by).isNull()).where("last")
    df = df.join(paid_out.select("symbol", "year", c("payout_percent").alias("payout")), ["symbol", "year"], "left")
    change = lambda x: F.when(c(f"{x}1") > 0, (c(x) / c(f"{x}1") - 1) * 100)
    df = df.withColumn("eps_change", change("eps")).withColumn("revenue_change", change("revenue"))
    df = df.withColumn("cover", F.when((c("paid") > 0) & (c("fcf") > 0), c("fcf") / c("paid"))).withColumn(
        "leverage", F.when((c("net_debt") > 0) & (c("ebitda") > 0), c("net_debt") / c("ebitda"))
    )
    rate = lambda *cases: F.coalesce(*[F.when(rule, name) for rule, name in cases])
    factors = {
        "payout_factor": rate((c("payout") <= 60, "supportive"), (c("payout") <= 80, "neutral"), (c("payout") > 80, "concern")),
        "earnings_factor": F.when(
            c("eps1").isNotNull(),
            rate(
                (c("eps") <= 0, "concern"), (c("eps_change") <= -20, "concern"), ((c("eps_change") >= 0) & (c("falls") == 0), "supportive"),
                (F.lit(True), "neutral")
            )
        ),
        "revenue_factor": rate(
            (c("revenue_change") <= -10, "concern"), (c("revenue_change") >= 0, "supportive"), (c("revenue_change").isNotNull(), "neutral")
        ),
        "cash_factor": F.when(
            c("paid") > 0,
            rate((c("fcf") <= 0, "concern"), (c("cover") >= 1.5, "supportive"), (c("cover") >= 1.0, "neutral"), (F.lit(True), "concern"))
        ),
        "debt_factor": F.when(
            c("net_debt").isNotNull() & c("ebitda").isNotNull(),
            rate(
                (c("net_debt") <= 0, "supportive"), (c("ebitda") <= 0, "concern"), (c("leverage") <= 2, "supportive"),
                (c("leverage") <= 4, "neutral"), (F.lit(True), "concern")
            )
        ),
    }
    df = df.select(
        "symbol", "year", "eps", r6("payout").alias("payout"), r6("eps_change").alias("eps_change"), r6("cover").alias("cover"),
        r6("leverage").alias("leverage"), *[x.alias(k) for k, x in factors.items()]
    )
    how_many = lambda name: F.size(F.filter(F.array(*factors), lambda x: x == name)).cast("long")
    df = df.withColumn("concerns", how_many("concern")).withColumn("supports", how_many("supportive"))
    n = F.size(F.filter(F.array(*factors), lambda x: x.isNotNull()))
    overall = F.when(n < 2, "Insufficient Data").when(c("concerns") >= 2, "Weak").when((c("concerns") == 0) & (c("supports") >= 2), "Supportive").otherwise("Mixed")
    return df.withColumn("assessment", overall)


def cut_risk(pays: DataFrame, health: DataFrame, as_of: str) -> DataFrame:
    """Nine signs of a cut, their severities, and a level from their counts.

    ``health`` comes from ``sustainability``.  Three signs at least must be
    known, one of them from the statements.
    """
    day = F.lit(as_of).cast("date")
    recent = cut_events(pays).where(
        (c("ex_date") > F.date_sub(day, 729)) & (c("ex_date") <= day)
    ).groupBy("symbol").agg(F.count("*").alias("cuts"), F.max("confirmed").alias("sure"))
    df = payment_status(pays, as_of).join(
        trend(annual_table(pays, as_of)).select("symbol", "trend"), "symbol", "left"
    ).join(recent, "symbol", "left").join(health, "symbol", "left")
    severity = lambda high: F.when(high, "high").otherwise("medium")
    signs = {
        "payout_high": (c("payout") > 80, severity(c("payout") > 100)),
        "no_earnings": (c("eps") <= 0, F.lit("high")),
        "earnings_down": (
            F.when(c("earnings_factor").isNotNull(), (c("earnings_factor") == "concern") & F.coalesce(c("eps_change") <= -20, F.lit(False))),
            F.lit("medium")
        ),
        "cash_short": (c("cash_factor") == "concern", severity(c("cover").isNull() | (c("cover") < 0.75))),
        "debt_high": (c("debt_factor") == "concern", F.lit("medium")),
        "revenue_down": (c("revenue_factor") == "concern", F.lit("low")),
        "recent_cut": (F.coalesce("cuts", F.lit(0)) > 0, severity(F.coalesce("sure", F.lit(False)))),
        "irregular": (c("trend") == "Irregular", F.lit("medium")),
        "overdue": (c("status").isin("suspended", "delayed"), severity(c("status") == "suspended")),
    }
    facts = list(signs)[:6]
    df = df.select("symbol", *[rule.alias(k) for k, (rule, _) in signs.items()], *[sev.alias(f"s_{k}") for k, (_, sev) in signs.items()])
    total = lambda names, test: sum((F.when(test(k), 1).otherwise(0) for k in names), F.lit(0)).cast("long")
    df = df.withColumn("known", total(signs, lambda k: c(k).isNotNull())).withColumn("from_facts", total(facts, lambda k: c(k).isNotNull()))
    for level in ("high", "medium"):
        df = df.withColumn(level, total(signs, lambda k, level=level: c(k) & (c(f"s_{k}") == level)))
    level = (
        F.when((c("known") < 3) | (c("from_facts") == 0), "Insufficient Data")
        .when((c("high") >= 2) | ((c("high") >= 1) & (c("medium") >= 2)), "Elevated risk indicators")
        .when((c("high") == 1) | (c("medium") >= 2), "Moderate risk indicators")
        .otherwise("Few risk indicators")
    )
    return df.select("symbol", *signs, "known", "high", "medium", level.alias("level"))


def analysis(pays: DataFrame, bars: DataFrame, health: DataFrame, as_of: str) -> DataFrame:
    """The whole dividend picture, one row a symbol: yield, growth of the last
    complete year, trend, status, sustainability and risk of a cut."""
    table = annual_table(pays, as_of)
    years = growth(table)
    last = years.groupBy("symbol").agg(
        F.max_by(F.struct("year", "change_percent", "kind", "cagr3", "cagr5", "cagr10", "increases", "paying_years"), "year").alias("g")
    ).select("symbol", "g.*")
    out = yields(pays, bars, as_of).join(last, "symbol", "left")
    for part in (
        trend(table).select("symbol", "trend"), payment_status(pays, as_of).select("symbol", "last", "days", "status"),
        health.select("symbol", "assessment"), cut_risk(pays, health, as_of).select("symbol", "level")
    ):
        out = out.join(part, "symbol", "left")
    return out
