"""The seven-part growth screen of funds over given inputs, and its ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import r6

c = F.col
#: The inputs each criterion needs, and its rule.
CRITERIA = {
    "c": (["earnings_growth"], "earnings_growth >= 0.25"),
    "a": (["revenue_growth", "roe"], "revenue_growth >= 0.20 AND roe >= 0.17"),
    "n": (["close", "high"], "close / high >= 0.85"),
    "s": (["float_shares"], "float_shares < 500000000"),
    "l": (["close", "low"], "(close - low) / low * 100 >= 30"),
    "i": (["institutional"], "institutional BETWEEN 0.30 AND 0.85"),
    "m": (["close", "sma200"], "close > sma200"),
}
MINIMUM = 5
#: Inputs that stand under a fraction: zero counts as missing.
BELOW = ("high", "low")


def scored(inputs: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """``inputs(symbol, close, high, low, sma200, earnings_growth, revenue_growth, roe,
    float_shares, institutional)`` -> each criterion true, false or null (an input is
    missing), the score, how many could be told, which couldn't, and whether the score
    reaches the minimum."""
    df = inputs
    for x, (needs, rule) in CRITERIA.items():
        known = F.lit(True)
        for n in needs:
            known = known & c(n).isNotNull() & ((c(n) != 0) if n in BELOW else F.lit(True))
        df = df.withColumn(f"{x}_pass", F.when(known, F.expr(rule)))
    flags = [f"{x}_pass" for x in CRITERIA]
    total = lambda test: sum((F.when(test(c(f)), 1).otherwise(0) for f in flags), F.lit(0)).cast("long")
    unknown = F.concat_ws(",", *[F.when(c(f"{x}_pass").isNull(), x) for x in CRITERIA])
    return df.select(
        "symbol", *flags, total(lambda f: f).alias("score"), total(lambda f: f.isNotNull()).alias("evaluated"), unknown.alias("unavailable"),
        (total(lambda f: f) >= minimum).alias("meets_minimum"), r6(F.when(c("high") != 0, c("close") / c("high"))).alias("to_high"), r6(
            F.when(c("low") != 0, (c("close") - c("low")) / c("low") * 100)
        ).alias("from_low_percent"),
    )


def ranked(scores: DataFrame, members: DataFrame) -> DataFrame:
    """All members by score (ties by symbol), those without a score last with no rank.  The
    order is a count of those ahead: eight scores at most, so the counts are broadcast."""
    at = scores.groupBy("score").agg(F.count("*").alias("n"))
    ahead = at.alias("a").join(
        F.broadcast(at.alias("b")), c("b.score") > c("a.score"), "left"
    ).groupBy("a.score").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("score").orderBy("symbol"))
    ranks = scores.withColumn("inside", inside).join(F.broadcast(ahead), "score").withColumn("rank", (c("ahead") + c("inside")).cast("long")).drop("ahead", "inside")
    return members.select("symbol").distinct().join(ranks, "symbol", "left").withColumn(
        "status", F.when(c("score").isNull(), "UNAVAILABLE").otherwise("OK")
    )
