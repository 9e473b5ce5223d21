"""Window helpers over one symbol's history, and the rounding of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def w(order: str = "date", by: str = "symbol") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def rows(n: int, shift: int = 0) -> WindowSpec:
    """The n rows that end ``shift`` rows before the current one."""
    return w().rowsBetween(-(n - 1) - shift, -shift)


def so_far() -> WindowSpec:
    return w().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def rolling(agg: Column, x, n: int, shift: int = 0) -> Column:
    """An aggregate over a full window of n non-null values, else null."""
    over = rows(n, shift)
    return F.when(F.count(col(x)).over(over) == n, agg.over(over))


def sma(x, n: int, shift: int = 0) -> Column:
    return rolling(F.avg(col(x)), x, n, shift)


def std(x, n: int) -> Column:
    return rolling(F.stddev_samp(col(x)), x, n)


def lag(x, n: int = 1) -> Column:
    return F.lag(col(x), n).over(w())


def lead(x, n: int = 1) -> Column:
    return F.lead(col(x), n).over(w())


def r6(x) -> Column:
    return F.round(col(x), 6)


def true_range() -> Column:
    """Greatest of high - low and the distances to the last close."""
    before = lag("close")
    return F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``i`` (from 1) and ``is_last`` in date order, in one pass."""
    return df.withColumn("i", F.row_number().over(w()).cast("long")).withColumn("is_last", F.lead("date").over(w()).isNull())


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each symbol, before any window runs over the rest."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return df.withColumn("__back", back).where(F.col("__back") <= n).drop("__back")


def latest(df: DataFrame, gate: int = 1) -> DataFrame:
    """The last row of each symbol with at least ``gate`` rows."""
    return df.where(F.col("is_last") & (F.col("i") >= gate))


def run_length(df: DataFrame, flag: str, out: str) -> DataFrame:
    """Length of the current run of true flags (0 where false)."""
    island = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(so_far())
    df = df.withColumn("__island", island)
    inside = Window.partitionBy("symbol", "__island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(F.col(flag), 1).otherwise(0)).over(inside).cast("long")).drop("__island")
