"""Whether a dividend was cut, stopped or delayed, and whether a payout can be told.

Payments are ``symbol, ex_date, amount, period, currency, is_special``; those after
``as_of`` are announced and never history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import r6
from barloom.operators.dividends import INTERVALS, annual_table, modal_counts

c = F.col
#: Payments a year by the provider's label.
LABELS = {"monthly": 12, "quarterly": 4, "semiannual": 2, "semi-annual": 2, "semi annual": 2, "annual": 1}
RECENT_DAYS, GAP_DAYS, NO_INTERVAL_DAYS = 729, 400, 730
CUT, PERSISTS, FLAT = 0.9, 0.95, 0.995
STALE_DAYS = 548


def cut_events(pays: DataFrame, as_of: str) -> DataFrame:
    """Regular payments at most 90% of the one before, 400 days or less earlier and of
    the same period label where both have one; ``confirmed`` if one of the next two
    is at most 95% of the level before."""
    by = Window.partitionBy("symbol").orderBy("ex_date", "amount")
    label = F.lower(F.trim("period"))
    df = pays.where((c("ex_date") <= F.lit(as_of).cast("date")) & ~c("is_special")).withColumn("label", F.when(label != "", label))
    df = df.select(
        "symbol", "ex_date", "amount", "label", *[F.lag(x).over(by).alias(f"last_{x}") for x in ("ex_date", "amount", "label")],
        F.least(F.lead("amount", 1).over(by), F.lead("amount", 2).over(by)).alias("next")
    )
    comparable = ~F.coalesce(c("label") != c("last_label"), F.lit(False)) & (F.datediff("ex_date", "last_ex_date") <= GAP_DAYS)
    df = df.where(comparable & (c("amount") <= CUT * c("last_amount")))
    return df.select(
        "symbol", "ex_date", c("last_amount").alias("before"), "amount",
        F.coalesce(c("next") <= PERSISTS * c("last_amount"), F.lit(False)).alias("confirmed")
    )


def _years(pays: DataFrame, as_of: str) -> DataFrame:
    """What the yearly totals say: a decline of the last complete year (``fell``) and
    whether its count of payments can be compared (``fell_alike``), regularity, and
    changes that can't be used."""
    table = annual_table(pays.where(c("ex_date") <= F.lit(as_of).cast("date")), as_of)
    by = Window.partitionBy("symbol").orderBy("year")
    df = table.join(modal_counts(table), "symbol", "left").withColumn("usual", F.coalesce(c("n") == c("modal"), F.lit(False)))
    df = df.select(
        "*", *[F.lag(x).over(by).alias(f"last_{x}") for x in ("total", "n", "usual")],
        F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("year"))).alias("nth")
    )
    stopped = (c("n") == 0) & (c("last_n") > 0)
    fell = (c("nth") == 1) & (c("last_total") > 0) & (c("total") < FLAT * c("last_total"))
    alike = (c("usual") & c("last_usual")) | (c("n") == 0)
    return df.groupBy("symbol").agg(
        F.max("modal").alias("modal"), F.max(F.coalesce(fell, F.lit(False))).alias("fell"), F.max(F.coalesce(fell & alike, F.lit(False))).alias("fell_alike"),
        (F.count_if((c("nth") <= 3) & c("usual")) == 3).alias("regular"), F.count_if(
            (c("last_total") > 0) & ~(c("usual") & c("last_usual")) & ~stopped
        ).alias("excluded"),
    )


def _expected(modal: Column, label: Column) -> Column:
    """Days between payments, by their usual number a year, else by the label."""
    by_label = F.coalesce(*[F.when(label == name, INTERVALS[n]) for name, n in LABELS.items()])
    return F.coalesce(*[F.when(modal == n, days) for n, days in INTERVALS.items()], 365.2 / modal, by_label)


def cut_status(pays: DataFrame, as_of: str) -> DataFrame:
    """One row for each symbol with history: ``cut_status`` observed, possible or none, the events
    behind it, regularity, excluded changes, and ``suspension`` possible_suspension,
    possible_delay or none.

    A cut is observed where a reduced level of the last 24 months persisted or the last
    complete year fell on a like-for-like count; else a recent reduction or a decline
    makes it possible.  Late data is never a cut.
    """
    day = F.lit(as_of).cast("date")
    events = cut_events(pays, as_of).withColumn("recent", c("ex_date") >= F.date_sub(day, RECENT_DAYS))
    events = events.groupBy("symbol").agg(
        F.count("*").alias("cut_events"), F.count_if("recent").alias("recent_events"),
        F.count_if(c("recent") & c("confirmed")).alias("confirmed_events")
    )
    past = pays.withColumn("past", c("ex_date") <= day)
    order = F.struct(~c("is_special"), "ex_date", "amount")  # a regular payment before any special one
    label = F.lower(F.trim("period"))
    last = past.groupBy("symbol").agg(
        F.max_by(F.struct("ex_date", label.alias("label")), F.when(c("past"), order)).alias("last"), F.count_if(~c("past")).alias("upcoming")
    ).where("last.ex_date is not null")
    df = last.join(_years(pays, as_of), "symbol", "left").join(events, "symbol", "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    df = df.select(
        "symbol", "last", "upcoming", "modal",
        *[F.coalesce(x, zero).alias(x) for x in ("cut_events", "recent_events", "confirmed_events", "excluded")],
        *[F.coalesce(x, no).alias(x) for x in ("fell", "fell_alike", "regular")]
    )
    cut = F.when((c("confirmed_events") > 0) | c("fell_alike"), "observed").when((c("recent_events") > 0) | c("fell"), "possible").otherwise("none")
    days = F.datediff(day, "last.ex_date").cast("long")
    expected = _expected(c("modal"), c("last.label"))
    late = F.when(days > F.greatest(2 * expected, expected + 90), "possible_suspension").when(days > 1.35 * expected + 15, "possible_delay")
    late = F.coalesce(late, F.when(expected.isNull() & (days > NO_INTERVAL_DAYS), "possible_suspension"), F.lit("none"))
    return df.select(
        "symbol", cut.alias("cut_status"), "cut_events", "recent_events", "confirmed_events", c("fell").alias("annual_decline"), F.when(c("regular"), "Regular").otherwise("Irregular").alias("regularity"),
        c("excluded").alias("excluded_changes"), F.when(c("upcoming") > 0, "none").otherwise(late).alias("suspension"), days.alias("days_since"), r6(expected).alias("expected_days"),
    )


def payout_report(bases: DataFrame, docs: DataFrame, pays: DataFrame, as_of: str) -> DataFrame:
    """``bases`` (of ``facts.payout_bases``) with the final ``status`` and ``reason``: not meaningful where
    dividends are paid in another currency than the statements', since none is
    converted; ``stale`` where the last fiscal year with earnings ended over 548 days
    ago; and the provider's own ratio in percent."""
    from barloom.sources.documents import earnings, number

    day = F.lit(as_of).cast("date")
    money = F.when(F.trim("currency") != "", F.upper(F.trim("currency")))
    paid = pays.where(c("ex_date") <= day).groupBy("symbol").agg(
        F.max_by(money, F.when(money.isNotNull(), F.struct("ex_date", "amount"))).alias("paid_in"), F.count("*").alias("payments")
    )
    told = docs.select(
        "symbol", F.upper(F.nullif(c("d.General")["CurrencyCode"], F.lit(""))).alias("reported_in"),
        (number(c("d.SplitsDividends")["PayoutRatio"]) * 100).alias("provider")
    )
    year = earnings(docs, "Annual").where(c("day") <= day).groupBy("symbol").agg(F.max("day").alias("fiscal_end"))
    df = bases.join(told, "symbol", "left").join(paid, "symbol", "left").join(year, "symbol", "left")
    mixed = F.coalesce(c("paid_in") != c("reported_in"), F.lit(False))
    none = F.coalesce(c("payments"), F.lit(0)) == 0
    status = F.when(none, "no_history").when(mixed, "not_meaningful").otherwise(c("status"))
    reason = F.when(none, "no dividend history").when(mixed, F.concat(F.lit("paid in "), "paid_in", F.lit(", reported in "), "reported_in"))
    usable = ~none & ~mixed
    return df.select(
        "symbol", status.alias("status"), reason.alias("reason"), F.when(usable, c("basis")).alias("basis"), F.when(usable, c("payout_percent")).alias("payout_percent"), F.when(usable, c("band")).alias("band"),
        F.coalesce(F.datediff(day, "fiscal_end") > STALE_DAYS, F.lit(False)).alias("stale"), F.round("provider", 2).alias("provider_percent"),
    )
