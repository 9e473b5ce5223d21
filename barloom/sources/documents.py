"""Files of bars, dividends and company documents in JSON, with declared schemas.

A company document is one JSON object with nested sections; statements are maps
from a fiscal date to items, whose numbers may be texts or marks of absence.
Readers keep rows that don't parse apart and count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
#: Texts that stand for no number.
ABSENT = ("", "none", "null", "na", "n/a", "nan", "-")
_ITEMS = "map<string,map<string,string>>"
_STATEMENT = f"struct<yearly:{_ITEMS},quarterly:{_ITEMS}>"
DOCUMENT = (
    "struct<General:map<string,string>,Highlights:map<string,string>,Valuation:map<string,string>,SharesStats:map<string,string>,"
    "SplitsDividends:map<string,string>,Holders:map<string,string>,"
    f"Financials:struct<Income_Statement:{_STATEMENT},Balance_Sheet:{_STATEMENT},Cash_Flow:{_STATEMENT}>,"
    f"Earnings:struct<History:{_ITEMS},Annual:{_ITEMS},Trend:{_ITEMS}>,Components:{_ITEMS}>"
)
BAR_FILE = "symbol string, date string, open string, high string, low string, close string, adjusted_close string, volume string"
DIVIDEND_FILE = "symbol string, date string, paymentDate string, declarationDate string, recordDate string, value string, unadjustedValue string, period string, currency string"


def number(x: str | Column) -> Column:
    """A finite number from a text, else null."""
    text = F.trim(c(x) if isinstance(x, str) else x)
    value = F.when(~F.lower(text).isin(*ABSENT), text.try_cast("double"))
    return F.when((F.abs(value) < float("inf")) & ~F.isnan(value), value)


def day(x: str | Column) -> Column:
    """The date that a text begins with, else null."""
    return F.try_to_date(F.substring(c(x) if isinstance(x, str) else x, 1, 10), "yyyy-MM-dd")


def read_bars(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bars of JSON lines ``{symbol, date, open, ...}``, and per symbol how many
    lines came and how many were refused (no date, or no positive close).

    A missing adjusted close is the close; missing opens, highs and lows are 0.
    """
    raw = spark.read.schema(f"{BAR_FILE}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = raw.select(
        "symbol", day("date").alias("date"), *[number(x).alias(x) for x in ("open", "high", "low", "close", "adjusted_close")],
        number("volume").cast("long").alias("volume")
    )
    rows = rows.withColumn("good", c("symbol").isNotNull() & c("date").isNotNull() & F.coalesce(c("close") > 0, F.lit(False)))
    quality = rows.groupBy("symbol").agg(F.count("*").alias("received"), F.count_if(~c("good")).alias("refused"))
    zero = [F.coalesce(x, F.lit(0.0)).alias(x) for x in ("open", "high", "low")]
    bars = rows.where("good").select(
        "symbol", "date", *zero, "close", F.coalesce("adjusted_close", "close").alias("adjusted_close"),
        F.coalesce("volume", F.lit(0).cast("long")).alias("volume")
    )
    return bars, quality


def read_dividends(spark: SparkSession, path: str) -> DataFrame:
    """Dividend lines as they come, for ``parse_dividends``."""
    return spark.read.schema(DIVIDEND_FILE).json(path)


def parse_dividends(raw: DataFrame) -> DataFrame:
    """``symbol, ex_date, payment_date, declaration_date, record_date, amount,
    unadjusted_amount, period, currency, is_special``: one row for each date, amount
    (six places) and kind, the smallest if they differ beyond that.

    The unadjusted value stands in for a missing one; rows without a date or a
    positive amount are left out.
    """
    period = F.when(F.trim("period") != "", F.trim("period"))
    currency = F.when(F.trim("currency") != "", F.upper(F.trim("currency")))
    rows = raw.select(
        "symbol", day("date").alias("ex_date"), *[
            day(x).alias(y) for x, y in (("paymentDate", "payment_date"), ("declarationDate", "declaration_date"), ("recordDate", "record_date"))
        ],
        F.coalesce(number("value"), number("unadjustedValue")).alias("amount"), number("unadjustedValue").alias("unadjusted_amount"),
        period.alias("period"), currency.alias("currency"), F.coalesce(
            F.contains(F.lower(period), F.lit("special")), F.lit(False)
        ).alias("is_special"),
    ).where("ex_date is not null and amount > 0")
    others = [x for x in rows.columns if x not in ("symbol", "ex_date", "is_special")]
    key = [c("symbol"), c("ex_date"), c("is_special"), F.round("amount", 6).alias("__amount")]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct("amount", *[x for x in others if x != "amount"])).alias("row"))
    return first.select("symbol", "ex_date", "row.*", "is_special").select(*rows.columns)


def dividend_quality(raw: DataFrame) -> DataFrame:
    """Per symbol: lines received, refused, repeated, and with the unadjusted value."""
    amount = F.coalesce(number("value"), number("unadjustedValue"))
    good = day("date").isNotNull() & F.coalesce(amount > 0, F.lit(False))
    rows = raw.withColumn("good", good).withColumn("stand_in", good & number("value").isNull())
    g = rows.groupBy("symbol").agg(
        F.count("*").alias("received"), F.count_if(~c("good")).alias("refused"), F.count_if("stand_in").alias("unadjusted")
    )
    kept = parse_dividends(raw).groupBy("symbol").agg(F.count("*").alias("kept"), F.count_if("is_special").alias("special"))
    g = g.join(kept, "symbol", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long"))).withColumn("special", F.coalesce("special", F.lit(0).cast("long")))
    return g.select("symbol", "received", "refused", (c("received") - c("refused") - c("kept")).alias("repeated"), "unadjusted", "special")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, doc`` of JSON lines ``{"symbol": ..., "doc": {...}}``."""
    return spark.read.text(path).select(
        F.get_json_object("value", "$.symbol").alias("symbol"), F.get_json_object("value", "$.doc").alias("doc")
    ).where("symbol is not null")


def parsed(docs: DataFrame) -> DataFrame:
    """``symbol, d``: the document as nested columns (null if it isn't JSON)."""
    return docs.select("symbol", F.from_json("doc", DOCUMENT).alias("d"))


def _dated(docs: DataFrame, section: str, *names: str) -> DataFrame:
    """``symbol, <names>, day, items`` of a map from dates to items; an item
    ``date`` goes before the key."""
    rows = docs.select("symbol", *names, F.explode(section).alias("key", "items"))
    return rows.select("symbol", *names, F.coalesce(day(c("items")["date"]), day("key")).alias("day"), "items").where("day is not null")


def statements(docs: DataFrame, name: str, part: str = "yearly") -> DataFrame:
    """``symbol, day, items`` of one statement of parsed documents."""
    return _dated(docs, f"d.Financials.{name}.{part}")


def earnings(docs: DataFrame, part: str = "History") -> DataFrame:
    """``symbol, day, eps`` that have been reported: quarters (History) or years
    (Annual)."""
    return _dated(docs, f"d.Earnings.{part}").select("symbol", "day", number(c("items")["epsActual"]).alias("eps")).where("eps is not null")


def components(docs: DataFrame) -> DataFrame:
    """``symbol, code, name, sector, industry, exchange`` of the members that parsed documents of
    indices list; codes are upper case with a hyphen for a dot, the first of each counts,
    and members without one are left out."""
    rows = docs.select("symbol", F.explode("d.Components").alias("key", "m"))
    text = lambda k: F.nullif(F.trim(c("m")[k]), F.lit(""))
    rows = rows.select(
        "symbol", F.replace(F.upper(text("Code")), F.lit("."), F.lit("-")).alias("code"), number("key").alias("n"), "key",
        *[text(k).alias(k.lower()) for k in ("Name", "Sector", "Industry", "Exchange")]
    )
    first = rows.where("code is not null").groupBy("symbol", "code").agg(
        F.min_by(F.struct("name", "sector", "industry", "exchange"), F.struct("n", "key")).alias("m")
    )
    return first.select("symbol", "code", "m.*")
