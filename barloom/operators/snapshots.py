"""Snapshots of company facts in two times: when they hold, and when they were recorded.

A snapshot is never changed: a refresh appends what it got, and a refresh that
failed appends a row without values, so the last value stays in force and the
failure can be counted.  A read as of (valid, recorded) sees what was known then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["symbol", "valid_from", "recorded_at"]


def refreshed(fetched: DataFrame, members: DataFrame, recorded_at: Column, values: list[str]) -> DataFrame:
    """Rows to append after a refresh of ``members(symbol)``: what was ``fetched(symbol,
    valid_from, values...)``, and a row without values (``ok`` false) for each member of
    whom nothing came or nothing but nulls."""
    got = members.select("symbol").distinct().join(fetched.select("symbol", "valid_from", *values), "symbol", "left")
    ok = F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(True)) for v in values], F.lit(False)) & F.col("valid_from").isNotNull()
    return got.select(
        "symbol", "valid_from", recorded_at.cast("timestamp").alias("recorded_at"), ok.alias("ok"), *[F.when(ok, F.col(v)).alias(v) for v in values]
    )


def _last(snapshots: DataFrame, seen: Column) -> Column:
    """The values of the last snapshot that holds: latest ``valid_from``, of these the one
    recorded last."""
    rest = [c for c in snapshots.columns if c not in ("symbol", "ok")]
    return F.max_by(F.when(seen, F.struct(*rest)), F.when(seen, F.struct("valid_from", "recorded_at")))


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest good snapshot of each symbol."""
    rows = snapshots.where("ok")
    return rows.groupBy("symbol").agg(_last(rows, F.lit(True)).alias("s")).select("symbol", "s.*")


def as_of(snapshots: DataFrame, moments: list[tuple[str, str]]) -> DataFrame:
    """Each symbol at each of a few moments (valid, recorded): ``symbol, moment`` (its place in
    the list) and the snapshot that was in force and known then.  One pass over the
    snapshots and one shuffle of a row for each symbol, for all moments."""
    rows = snapshots.where("ok")
    seen = [(F.col("valid_from") <= F.lit(v).cast("date")) & (F.col("recorded_at") <= F.lit(r).cast("timestamp")) for v, r in moments]
    per = rows.groupBy("symbol").agg(*[_last(rows, s).alias(f"m{k}") for k, s in enumerate(seen)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("moment"), F.col(f"m{k}").alias("s")) for k in range(len(moments))]))
    return per.select("symbol", each.alias("e")).where("e.s is not null").select("symbol", "e.moment", "e.s.*")


def as_of_join(asks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``asks(symbol, valid, recorded, ...)`` with the snapshot that each would have seen
    (nulls: none).

    A symbol's snapshots come as one sorted list (bounded by its refreshes), so asks
    meet one row of their symbol and neither side is multiplied."""
    rows = snapshots.where("ok")
    rest = [c for c in rows.columns if c not in (*KEYS, "ok")]
    lists = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("valid_from", "recorded_at", *rest))).alias("__all"))
    known = F.filter("__all", lambda s: (s["valid_from"] <= F.col("valid")) & (s["recorded_at"] <= F.col("recorded")))
    found = asks.join(lists, "symbol", "left").withColumn("s", F.try_element_at(known, F.lit(-1)))
    return found.select(*asks.columns, "s.valid_from", "s.recorded_at", *[F.col(f"s.{c}") for c in rest])


def refresh_counts(snapshots: DataFrame, run: Column) -> DataFrame:
    """Succeeded and failed symbols of each ``run``."""
    return snapshots.groupBy(run.alias("run")).agg(
        F.count_distinct(F.when(F.col("ok"), F.col("symbol"))).alias("succeeded"),
        F.count_distinct(F.when(~F.col("ok"), F.col("symbol"))).alias("failed")
    )
