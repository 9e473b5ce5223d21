"""Whole series cleaned: one row a date, one price basis, and counts of what went.

``arrival`` orders rows of one symbol and date; the last one counts.  Whether a bad
last row hides a good one before it differs between the series and is stated for
each, since the results do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Fixed values of yields: percent, and the share of bad ones that makes a series useless.
YIELD_MOST, BAD_SHARE = 20.0, 0.2


def good(x: str | Column) -> Column:
    """Positive and finite; false for null."""
    x = c(x) if isinstance(x, str) else x
    return F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))


def last_of_day(rows: DataFrame, arrival: str = "arrival", by: str = "symbol") -> DataFrame:
    """The last row of each key and date, without a window or a sort; rows without a date go."""
    rest = [x for x in rows.columns if x not in (by, "date")]
    kept = rows.where(c("date").isNotNull()).groupBy(by, "date").agg(F.max_by(F.struct(*rest), arrival).alias("__row"))
    return kept.select(by, "date", "__row.*")


def price_series(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """``symbol, date, price, close, volume``: the adjusted close where it is there (not null,
    zero or NaN), else the close.  The last row of a date counts even if its price is
    bad, and then the date has none."""
    last = last_of_day(rows, arrival)
    there = F.coalesce((c("adjusted_close") != 0) & ~F.isnan("adjusted_close"), F.lit(False))
    price = F.when(there, c("adjusted_close")).otherwise(c("close"))
    return last.select(
        "symbol", "date", price.alias("price"), "close", F.coalesce("volume", F.lit(0)).alias("volume")
    ).where(F.coalesce((c("price") > 0) & ~F.isnan("price"), F.lit(False)))


def basis_series(rows: DataFrame, basis: str = "adjusted_close", arrival: str = "arrival") -> DataFrame:
    """``symbol, date, price`` of one basis alone; the last good row of a date counts."""
    return last_of_day(rows.where(good(basis)).select("symbol", "date", c(basis).alias("price"), arrival), arrival).select("symbol", "date", "price")


def date_window(rows: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``stop``, both included; None leaves an end open."""
    rows = rows if start is None else rows.where(c("date") >= F.lit(start).cast("date"))
    return rows if stop is None else rows.where(c("date") <= F.lit(stop).cast("date"))


def _valid_candle(tolerance: float = 1e-9) -> Column:
    room = tolerance * F.greatest(c("high"), F.lit(1.0))
    ok = (c("high") >= F.greatest("open", "close", "low") - room) & (c("low") <= F.least("open", "close", "high") + room)
    for x in ("open", "high", "low", "close"):
        ok = good(x) & ok
    return F.coalesce(ok, F.lit(False))


def marked_candles(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The last row of each date with ``pos``, its place among the symbol's dates from 0,
    and ``ok``; a bad last row spoils its date."""
    order = Window.partitionBy("symbol").orderBy("date")
    return last_of_day(rows, arrival).withColumn("pos", F.row_number().over(order).cast("long") - 1).withColumn("ok", _valid_candle())


def candles(marked: DataFrame) -> DataFrame:
    """Valid candles: highs and lows take in open and close, bad volumes are null.
    Neighbours in the source have consecutive ``pos``."""
    volume = F.when((c("volume") >= 0), c("volume"))
    return marked.where("ok").select(
        "symbol", "date", "pos", "open", F.greatest("high", "open", "close").alias("high"), F.least("low", "open", "close").alias("low"), "close",
        volume.alias("volume")
    )


def candle_report(rows: DataFrame, marked: DataFrame, most: int = 20) -> DataFrame:
    """For each symbol: source rows, rows without a date, repeated dates, invalid candles and
    the first ``most`` of their dates.  Counts add up in both halves before they meet."""
    source = rows.groupBy("symbol").agg(F.count("*").alias("source_rows"), F.count_if(c("date").isNull()).alias("without_date"))
    bad = Window.partitionBy("symbol", "ok").orderBy("date")
    kept = marked.withColumn("nth", F.row_number().over(bad)).groupBy("symbol").agg(
        F.count("*").alias("dates"), F.count_if(~c("ok")).alias("invalid"), F.array_sort(
            F.collect_list(F.when(~c("ok") & (c("nth") <= most), c("date")))
        ).alias("invalid_dates")
    )
    both = source.join(kept, "symbol", "left").withColumn("dates", F.coalesce("dates", F.lit(0)))
    return both.select(
        "symbol", "source_rows", "without_date", (c("source_rows") - c("without_date") - c("dates")).alias("repeated_dates"),
        F.coalesce("invalid", F.lit(0)).cast("long").alias("invalid"), F.coalesce("invalid_dates", F.array().cast("array<date>")).alias("invalid_dates"),
    )


def yield_series(rows: DataFrame, arrival: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """Yields in percent from ``symbol, date, close``: the good values ``symbol, date, y`` (above 0, at
    most 20) of series that can be trusted, and the verdict on each series: ``symbol,
    observations, dropped, status, reason``.

    A series of whose values over a fifth are out of range looks mis-scaled and gives
    no row; so does one without good values.  Null and NaN aren't observations.
    """
    last = last_of_day(rows, arrival).where(c("close").isNotNull() & ~F.isnan("close"))
    ok = (c("close") > 0) & (c("close") <= YIELD_MOST)
    counts = last.groupBy("symbol").agg(F.count("*").alias("observations"), F.count_if(~ok).alias("dropped"))
    counts = rows.select("symbol").distinct().join(counts, "symbol", "left").select(
        "symbol", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("observations", "dropped")]
    )
    none = c("observations") == c("dropped")
    off = F.try_divide("dropped", "observations") > BAD_SHARE
    reason = F.when(none, "no valid observations").when(off, F.format_string("%d of %d observations out of range", "dropped", "observations"))
    verdict = counts.withColumn("status", F.when(none | off, "UNAVAILABLE").otherwise("OK")).withColumn("reason", reason)
    trusted = verdict.where("status = 'OK'").select("symbol")
    return last.where(ok).join(trusted, "symbol", "left_semi").select("symbol", "date", c("close").alias("y")), verdict
