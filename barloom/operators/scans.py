"""Scans, cleaning, resampling, joins in time, and ingestion into stored bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import numbered, r6, w, whole

c = F.col


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The n most recent bars of every symbol."""
    df = numbered(bars).withColumn("n", F.count("*").over(whole()))
    return df.where(c("n") - c("i") < n).select("symbol", "date", "close", "volume")


def for_symbols(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bars of the listed symbols; a symbol without bars keeps one empty row."""
    return symbols.select("symbol").distinct().join(bars, "symbol", "left")


def for_ranges(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bars of ``symbol`` from ``start`` to ``stop`` (both included) for each row of ``ranges``.

    ``bars`` are in partitions of ``year``; a range meets them on symbol and year, so
    Spark prunes the years that no range touches while it runs.  Ranges of a symbol
    that overlap give a bar once for each."""
    years = F.explode(F.sequence(F.year("start"), F.year("stop")))
    wanted = ranges.where(c("start") <= c("stop")).withColumn("year", years)
    return bars.join(wanted, ["symbol", "year"]).where((c("date") >= c("start")) & (c("date") <= c("stop"))).drop("year")


def clean_candles(bars: DataFrame) -> DataFrame:
    """Valid candles with their place ``pos`` before the invalid ones went.

    Prices must be positive and finite, the high (low) at least (at most) open
    and close up to a tolerance, within which they are clamped.
    """
    df = numbered(bars).withColumnRenamed("i", "pos")
    tolerance = 1e-9 * F.greatest(c("high"), F.lit(1.0))
    prices = ["open", "high", "low", "close"]
    ok = F.lit(True)
    for x in prices:
        ok = ok & c(x).isNotNull() & ~F.isnan(x) & (c(x) > 0) & (c(x) < float("inf"))
    ok = ok & (c("high") >= F.greatest("open", "close", "low") - tolerance) & (c("low") <= F.least("open", "close", "high") + tolerance)
    df = df.where(ok)
    return df.select(
        "symbol", "date", "pos", "open", F.greatest("high", "open", "close").alias("high"), F.least("low", "open", "close").alias("low"), "close",
        "volume"
    )


def weekly(bars: DataFrame) -> DataFrame:
    """Weeks that end on Friday: high, low, last close and volume."""
    week = F.next_day(F.date_sub("date", 1), "FRI")
    return bars.groupBy("symbol", week.alias("week")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    )


def ingest(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Valid new bars that aren't stored yet (existing keys are left alone); of
    several for one key the last in the order of their prices."""
    order = F.struct("close", "open", "high", "low", "adjusted_close", "volume")
    others = [x for x in new.columns if x not in ("symbol", "date")]
    valid = new.where((c("close") > 0) & (c("high") >= c("low"))).groupBy("symbol", "date").agg(F.max_by(F.struct(*others), order).alias("bar")).select("symbol", "date", "bar.*")
    for x in ("open", "high", "low"):
        valid = valid.withColumn(x, F.coalesce(x, F.lit(0.0)))
    valid = valid.withColumn("volume", F.coalesce("volume", F.lit(0))).withColumn("adjusted_close", F.coalesce("adjusted_close", "close"))
    return valid.join(stored, ["symbol", "date"], "left_anti")


def backfill(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored bars with restated adjusted closes, and bars that were missing."""
    a, b = stored.alias("a"), new.alias("b")
    both = a.join(b, ["symbol", "date"], "full_outer")
    keep = [F.coalesce(f"a.{x}", f"b.{x}").alias(x) for x in ("open", "high", "low", "close")]
    return both.select(
        "symbol", "date", *keep, F.coalesce("b.adjusted_close", "a.adjusted_close").alias("adjusted_close"),
        F.coalesce("a.volume", "b.volume").alias("volume")
    )


def refresh_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members with ``is_current``: those that are gone stay, marked false."""
    both = old.select("universe", "symbol").withColumn("was", F.lit(True)).join(
        new.select("universe", "symbol").withColumn("now", F.lit(True)), ["universe", "symbol"], "full_outer"
    )
    return both.select("universe", "symbol", F.coalesce("now", F.lit(False)).alias("is_current"), c("was").isNull().alias("is_new"))


def universe_summary(members: DataFrame, bars: DataFrame) -> DataFrame:
    """For each universe: all and current members, current ones with bars, and the last day
    that any of them has.  Bars are one row a symbol before they meet members."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last"))
    df = members.select("universe", "symbol", "is_current").distinct().join(last, "symbol", "left")
    now = c("is_current")
    return df.groupBy("universe").agg(
        F.count("*").alias("members"), F.count_if(now).alias("current"), F.count_if(now & c("last").isNotNull()).alias("with_bars"),
        F.max(F.when(now, c("last"))).alias("last")
    )


def aligned_returns(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Returns of several symbols between dates that all of them have."""
    from barloom.operators.analytics import common_dates, returns

    return returns(common_dates(bars, symbols), "close").select("symbol", "date", r6("r").alias("r"))


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before each row's ``on``.

    Both sides are put in one order per key and the value carried forward: one
    shuffle, one sort and no range join.
    """
    order = Window.partitionBy(*by).orderBy(on, "__side") if by else Window.partitionBy(F.lit(0)).orderBy(on, "__side")
    rest = [x for x in left.columns if x not in (*by, on)]
    a = right.select(
        *by, on, c(value).alias("__value"), F.lit(0).alias("__side"), *[F.lit(None).cast(left.schema[x].dataType).alias(x) for x in rest]
    )
    b = left.select(*by, on, F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.lit(1).alias("__side"), *rest)
    both = a.unionByName(b).withColumn(value, F.last("__value", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("__side = 1").select(*left.columns, value)


def nearest_before(df: DataFrame, days: int = 364, tolerance: int = 45) -> DataFrame:
    """``symbol, period, value``: each row with the row nearest to ``days`` before
    it, within the tolerance (ties: the earlier).  Rows meet in buckets as wide
    as the tolerance, so the join is on equal keys."""
    width = tolerance
    day = F.datediff("period", F.lit("1970-01-01").cast("date"))
    a = df.withColumn("want", day - days)
    a = a.withColumn("bucket", F.explode(F.array(*[F.floor(c("want") / width) + k for k in (-1, 0, 1)])))
    b = df.select(
        "symbol", c("period").alias("before"), c("value").alias("before_value"), day.alias("day")
    ).withColumn("bucket", F.floor(c("day") / width))
    hits = a.join(b, ["symbol", "bucket"]).where(F.abs(c("day") - c("want")) <= tolerance)
    best = F.min_by(F.struct("before", "before_value"), F.struct(F.abs(c("day") - c("want")), c("before")))
    found = hits.groupBy("symbol", "period").agg(best.alias("m")).select("symbol", "period", "m.before", "m.before_value")
    return df.join(found, ["symbol", "period"], "left").select("symbol", "period", "value", "before", "before_value")


def interval_sums(windows: DataFrame, payments: DataFrame) -> DataFrame:
    """Sum of ``amount`` with ``start < ex_date <= stop`` for each window.

    Windows and payments of a symbol meet on the symbol; both are a few hundred
    rows for each.
    """
    hits = windows.join(payments, "symbol").where((c("ex_date") > c("start")) & (c("ex_date") <= c("stop")))
    sums = hits.groupBy("symbol", "stop").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    return windows.join(sums, ["symbol", "stop"], "left").select(
        "symbol", "stop", r6(F.coalesce("total", F.lit(0.0))).alias("total"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def union_registries(*registries: DataFrame) -> DataFrame:
    """One row a symbol; later registries win."""
    parts = [r.select("symbol", "kind").withColumn("k", F.lit(k)) for k, r in enumerate(registries)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("symbol").agg(F.max_by("kind", "k").alias("kind"))


def misaligned_dates(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Dates that some but not all of the symbols have."""
    df = bars.where(c("symbol").isin(symbols)).groupBy("date").agg(F.count_distinct("symbol").alias("n_symbols"))
    return df.where(c("n_symbols") < len(symbols))


def freshness(bars: DataFrame, as_of: str, days: int = 4) -> DataFrame:
    """Rows, last date and whether it is too old at ``as_of``."""
    g = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.max("date").alias("last"))
    return g.withColumn("stale", F.datediff(F.lit(as_of).cast("date"), "last") > days)


def downsample(bars: DataFrame, points: int) -> DataFrame:
    """Evenly spaced bars of each symbol, the first and last among them."""
    df = numbered(bars).withColumn("n", F.count("*").over(whole()))
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.rint(k * (c("n") - 1) / (points - 1)).cast("long"))
    return df.where(F.array_contains(at, c("i") - 1)).select("symbol", "date", "close")


def month_ends(bars: DataFrame) -> DataFrame:
    """The last bar of each month."""
    df = bars.withColumn("next", F.lead("date").over(w()))
    return df.where(c("next").isNull() | (F.trunc("next", "month") != F.trunc("date", "month"))).select("symbol", "date", "close")


def gaps(bars: DataFrame, days: int = 7) -> DataFrame:
    """Pauses of more than ``days`` between bars."""
    df = bars.withColumn("previous", F.lag("date").over(w()))
    return df.where(F.datediff("date", "previous") > days).select(
        "symbol", "previous", "date", F.datediff("date", "previous").cast("long").alias("days")
    )
