"""Queries over cleaned series, ranges of dates, stored states and results, and outcomes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.series import numbered, so_far
from barloom.operators import analytics as a
from barloom.operators import cleaning as cl
from barloom.operators import cuts as cu
from barloom.operators import facts as fx
from barloom.operators import fund_screen as fs
from barloom.operators import models as m
from barloom.operators import portfolio as p
from barloom.operators import quant as q
from barloom.operators import scans as s
from barloom.operators import screeners as sc
from barloom.operators import tails
from barloom.operators import technical as t
from barloom.operators import views as v
from barloom.plans.oracles_analytics import MIX
from barloom.plans.results import Results, newest_date
from barloom.sources.bars import bars, bars_by_year, bars_stock, table
from barloom.sources.documents import components, parse_dividends, parsed, read_bars, read_dividends
from barloom.sources.fundamentals import annual_eps, fund_documents, fundamentals
from barloom.sources.scratch import shared_dir
from barloom.streaming.sessions import complete_bars

c = F.col


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with bad closes, missing and zero adjusted closes, missing dates, and some
    dates twice; ``arrival`` orders the rows of a date."""
    b = numbered(bars(spark, sf_dir))
    i = c("i")
    adjusted = F.when(i % 17 != 0, F.when(i % 19 == 0, 0.0).otherwise(c("adjusted_close")))
    first = b.select(
        "symbol", F.when(i % 97 != 0, c("date")).alias("date"), "open", "high", "low", F.when(i % 31 == 0, -1.0).otherwise(c("close")).alias("close"),
        adjusted.alias("adjusted_close"), "volume", F.lit(0).alias("arrival")
    )
    again = b.where(i % 29 == 0).select(
        "symbol", "date", "open", "high", "low", (c("close") * 2).alias("close"), F.lit(None).cast("double").alias("adjusted_close"), "volume",
        F.lit(1).alias("arrival")
    )
    return first.unionByName(again)


def tags(b: DataFrame) -> DataFrame:
    from barloom.plans.catalogue import tags as made

    return made(b)


def candle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    found = cl.candle_report(rows, cl.marked_candles(rows), 5)
    return found.withColumn("invalid_dates", F.array_join(F.transform("invalid_dates", lambda d: d.cast("string")), ","))


def _yields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Closes as yields on three scales, of which the largest is out of range."""
    rows = dirty(spark, sf_dir).where("symbol in ('AF', 'NO')")
    scale = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("x")) for n, x in (("low", 40.0), ("edge", 10.0), ("high", 8.0))]))
    rows = rows.withColumn("scale", scale).select(
        F.concat_ws(".", "symbol", "scale.n").alias("symbol"), "date", (c("close") / c("scale.x")).alias("close"), "arrival"
    )
    return cl.yield_series(rows)


def clean_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, verdict = _yields(spark, sf_dir)
    sums = kept.groupBy("symbol").agg(F.count("*").alias("kept"), F.max("date").alias("last"))
    return verdict.join(sums, "symbol", "left")


def wanted_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of 200 days for some of the nations, on a symbol each."""
    n = table(spark, sf_dir, "nation").where("n_nationkey < 6")
    symbol = F.element_at(F.array(*map(F.lit, ("AF", "NO", "RF"))), (c("n_nationkey") % 3 + 1).cast("int"))
    start = F.make_date((1993 + c("n_nationkey") % 3).cast("int"), F.lit(9), (1 + c("n_nationkey")).cast("int"))
    return n.select("n_name", symbol.alias("symbol"), start.alias("start"), F.date_add(start, 200).alias("stop"))


def bars_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.for_ranges(bars_by_year(spark, sf_dir), wanted_ranges(spark, sf_dir)).select("n_name", "symbol", "date", "close", "volume")


def chart_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail from states of the first months, extended to the others as a nightly run would."""
    b, folder = bars_by_year(spark, sf_dir), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    tails.month_states(b.where("date < '1997-01-01'")).write.parquet(folder)
    states = spark.read.schema(tails.STATE).parquet(folder)
    new = tails.month_states(b, states, partitioned=True)
    new.write.parquet(f"{folder}-more")
    states = states.unionByName(spark.read.schema(tails.STATE).parquet(f"{folder}-more"))
    found = tails.chart_tail(b, states, 180, partitioned=True)
    return found.select("symbol", "date", "close", *[F.round(x, 6).alias(x) for x in tails.VIEW])


def keyed_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving averages as a stored result, asked for twice under the same settings."""
    b = bars(spark, sf_dir)
    results = Results(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    newest = newest_date(b)
    results.get_or_compute("sma_trend", newest, {"spans": (20, 50, 100, 200), "gate": 210}, lambda: t.sma_trend(b))
    return results.get_or_compute("sma_trend", newest, {"gate": 210.0, "spans": [20, 50, 100, 200]}, lambda: t.sma_trend(b).limit(0))


def drifting(b: DataFrame) -> DataFrame:
    """Bars whose closes take the source's as daily steps around a slow rise, so that
    they reach new peaks again and again; each bar opens at the last close."""
    step = (c("close") / 150.0 - 1) * 0.02 + 0.0015
    close = F.round(100 * F.exp(F.sum(step).over(so_far())), 4)
    df = b.select("symbol", "date", close.alias("close"), "volume")
    before = F.coalesce(F.lag("close").over(s.w()), c("close"))
    df = df.withColumn("open", before)
    return df.select(
        "symbol", "date", "open", F.round(F.greatest("open", "close") * 1.003, 4).alias("high"),
        F.round(F.least("open", "close") * 0.997, 4).alias("low"), "close", c("close").alias("adjusted_close"), "volume"
    )


def model_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of two models for each symbol: one history is cut short, one has bad
    closes, one symbol has no bars."""
    b = numbered(bars(spark, sf_dir)).drop("is_last")
    b = b.where("symbol <> 'RF' or i <= 90").withColumn("close", F.when((c("symbol") == "NO") & (c("i") % 100 == 0), 0.0).otherwise(c("close")))
    members = b.select("symbol").distinct().unionByName(spark.createDataFrame([("ZZ",)], "symbol string"))
    parts = [
        m.with_absent(made.select("symbol", "status", "reason"), members).withColumn("model", F.lit(name)) for name,
        made in (("hmm", m.hmm_regime(b, explain=True)), ("garch", m.garch(b, explain=True)))
    ]
    return parts[0].unionByName(parts[1])


def labelled_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funds' payments with period labels and currencies: some funds pay half from a
    date on, one changes its label then, one has stopped, one pays in another currency."""
    from barloom.plans.catalogue import payments

    late = c("ex_date") >= "1997-01-01"
    paid = payments(bars(spark, sf_dir)).where((c("symbol") != "RO") | (c("ex_date") < "1996-01-01"))
    half = late & c("symbol").isin("AF", "NF")
    period = F.when((c("symbol") == "NF") & late, "Semi-Annual").when(c("symbol") != "AO", "Quarterly")
    return paid.withColumn("amount", F.when(half, c("amount") / 2).otherwise(c("amount"))).withColumn("period", period).withColumn(
        "currency", F.when(c("symbol") == "NO", "eur").when(c("symbol") != "RF", "USD")
    )


#: Days on which payments are looked at: after a cut, and long after.
CUT_DAYS = ("1998-03-31", "2001-06-30")


def dividend_cut_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = labelled_payments(spark, sf_dir)
    parts = [cu.cut_status(paid, d).withColumn("as_of", F.lit(d)) for d in CUT_DAYS]
    return parts[0].unionByName(parts[1])


def payout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payouts where the statements of some funds name a currency and the provider's ratio."""
    b = bars(spark, sf_dir)
    more = F.expr("concat('{\"General\":{\"CurrencyCode\":\"usd\"},\"SplitsDividends\":{\"PayoutRatio\":\"0.4567\"},', substring(doc, 2))")
    docs = parsed(fund_documents(b).withColumn("doc", F.when(c("symbol").isin("AF", "NO", "RF"), more).otherwise(c("doc"))))
    paid = labelled_payments(spark, sf_dir)
    return cu.payout_report(fx.payout_bases(docs, paid, PAYOUT_DAY), docs, paid, PAYOUT_DAY)


PAYOUT_DAY = "2001-06-30"


def fund_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the stocks as funds, and inputs made from their parts, some of them missing."""
    prices = sc.price_inputs(bars_stock(spark, sf_dir)).select("symbol", "close", "high", "low", "sma200")
    size = table(spark, sf_dir, "part").groupBy(c("p_brand").alias("symbol")).agg(F.sum(c("p_size").cast("long")).alias("s"))
    some = lambda k, x, name: F.expr(f"CASE WHEN s % {k} <> 0 THEN {x} END").alias(name)
    return prices.join(size, "symbol").select("symbol", "close", "high", "low", "sma200", *[some(k, x, name) for name, (k, x) in FUND_FIELDS.items()])


#: Inputs of the funds over a brand's total size ``s``; missing where s is a multiple of the number.
FUND_FIELDS = {
    "earnings_growth": (5, "CAST(s % 60 AS DOUBLE) / 100"),
    "revenue_growth": (7, "CAST(s % 45 AS DOUBLE) / 100"),
    "roe": (4, "CAST(s % 33 AS DOUBLE) / 100"),
    "float_shares": (6, "(s % 100) * 10000000"),
    "institutional": (9, "CAST(s % 100 AS DOUBLE) / 100"),
}


def fund_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = fund_inputs(spark, sf_dir)
    members = table(spark, sf_dir, "part").select(c("p_brand").alias("symbol")).distinct().unionByName(spark.createDataFrame([("Nobody",)], "symbol string"))
    return fs.ranked(fs.scored(inputs), members)


def simulation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows inside the history, wider than it, too short, and with a benchmark without prices."""
    b = bars(spark, sf_dir)
    asks = [
        ("NO", "AF", "1994-01-01", "1996-12-31"), ("NO", "AF", "1990-01-01", "2010-01-01"), ("NO", "NO", "1995-01-01", "1995-01-15"),
        ("RF", "ZZ", None, "1995-12-31")
    ]
    parts = [m.simulation_window(b, x, y, start, stop, flat=1.0).withColumn("ask", F.lit(k)) for k, (x, y, start, stop) in enumerate(asks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def magic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the value screen by the reason that keeps them out, ranked ones among them."""
    found = sc.magic_formula(fundamentals(spark, sf_dir))
    return sc.distribution(found.withColumn("outcome", F.coalesce("excluded", F.lit("ranked"))), "outcome")


def universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each universe with its members, how many of them have bars, and their last day."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("r_regionkey") == c("n_regionkey"))
    symbol = F.element_at(F.array(*map(F.lit, ("AF", "NO", "RF", "RO", "ZZ"))), (c("n_nationkey") % 5 + 1).cast("int"))
    members = n.select(c("r_name").alias("universe"), symbol.alias("symbol"), (c("n_nationkey") % 7 != 0).alias("is_current"))
    return s.universe_summary(members, bars(spark, sf_dir))


def bars_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty bars written as a provider's lines and read back."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = dirty(spark, sf_dir).drop("arrival")
    text = [F.when(c(x).isNull(), "NA").otherwise(c(x).cast("string")).alias(x) for x in ("open", "high", "low", "close", "adjusted_close", "volume")]
    rows.select("symbol", F.concat(c("date").cast("string"), F.lit("T00:00:00")).alias("date"), *text).write.json(folder)
    found, quality = read_bars(spark, folder)
    sums = found.groupBy("symbol").agg(
        F.count("*").alias("kept"), F.count_if(c("adjusted_close") == c("close")).alias("stand_in"), F.sum("volume").alias("volume"),
        F.max("close").alias("highest")
    )
    return quality.join(sums, "symbol")


def dividends_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funds' payments as a provider's lines, every fifth twice, and read back."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    paid, day = labelled_payments(spark, sf_dir), F.dayofmonth("ex_date")
    lines = paid.select(
        "symbol", F.when(day != 28, c("ex_date").cast("string")).otherwise("unknown").alias("date"), F.when(day == 30, "NA").otherwise(c("amount").cast("string")).alias("value"), c("amount").cast("string").alias("unadjustedValue"),
        F.when(c("is_special"), "Special cash").otherwise(c("period")).alias("period"), F.concat(F.lit(" "), "currency").alias("currency"),
    )
    lines.unionByName(lines.where(F.dayofmonth(F.try_to_date("date")) % 5 == 0)).write.json(folder)
    found = parse_dividends(read_dividends(spark, folder))
    return found.select("symbol", "ex_date", F.round("amount", 6).alias("amount"), "period", "currency", "is_special")


#: The day of the valuation report.
REPORT_DAY = "2001-06-30"


def fed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stocks as funds of several kinds against a dirty series of yields."""
    f = fundamentals(spark, sf_dir)
    n = F.crc32(c("symbol").cast("binary"))
    tags = F.array(F.when(n % 4 == 0, "Bond").when(n % 4 == 1, "growth").otherwise("EQUITY"))
    profiles = f.select(
        "symbol", tags.alias("tags"), F.when(n % 3 == 0, "US Equity").when(n % 5 == 0, "Gold trust").otherwise("Broad").alias("asset_class")
    )
    rates = dirty(spark, sf_dir).where("symbol = 'AF'").withColumn("close", c("close") / 40)
    return v.fed_report(profiles, f, rates, REPORT_DAY, "1996-01-01")


def graham_with_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.graham_inputs(fundamentals(spark, sf_dir), annual_eps(spark, sf_dir))
    price = numbered(bars_stock(spark, sf_dir)).where("is_last").select("symbol", "close")
    return sc.graham(f, price).join(f.select("symbol", "eps_basis", "growth_basis"), "symbol")


def index_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region as an index, with its nations as members."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("r_regionkey") == c("n_regionkey"))
    code = F.when(c("n_nationkey") % 8 == 0, " ").otherwise(
        F.concat(F.lower(F.substring("n_name", 1, 3)), F.lit("."), (c("n_nationkey") % 2).cast("string"))
    )
    item = F.create_map(
        F.lit("Code"), code, F.lit("Name"), "n_name", F.lit("Sector"), F.when(c("n_nationkey") % 5 != 0, "Trade"), F.lit("Exchange"), F.lit("US")
    )
    docs = n.groupBy(c("r_name").alias("symbol")).agg(F.map_from_entries(F.collect_list(F.struct(c("n_nationkey").cast("string"), item))).alias("m"))
    return components(parsed(docs.select("symbol", F.to_json(F.struct(c("m").alias("Components"))).alias("doc"))))


def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of corrections into a store that never restates."""
    from barloom.plans import stored

    return stored.corrected(spark, sf_dir, restate=False).read()


#: A moment in the last session of most funds, in UTC.
NOW = "1998-11-27 20:59:00"


def _clean_patterns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = cl.date_window(dirty(spark, sf_dir), None, "1998-11-27")
    whole = complete_bars(cl.candles(cl.marked_candles(rows)), NOW).withColumn("adjusted_close", c("close"))
    return t.candlestick_patterns(whole), rows


def patterns_of_clean_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns in cleaned candles up to a moment when the last session was still open."""
    return _clean_patterns(spark, sf_dir)[0]


QUERIES = {
    "patterns_of_clean_candles": patterns_of_clean_candles,
    "pattern_counts": lambda spark, d: t.pattern_counts(*_clean_patterns(spark, d)),
    "fed_report": fed_report,
    "graham_with_proxy": graham_with_proxy,
    "index_components": index_components,
    "stream_first_write": first_write_wins,
    "factor_exposure": lambda spark, d: v.factor_exposure(bars(spark, d), tags(bars(spark, d))),
    "vt_comparison_from": lambda spark, d: a.buy_and_hold_comparison(bars(spark, d), one="AF", split={"NO": 0.6, "RF": 0.4}, start="1996-06-01"),
    "allocation_of_few_days": lambda spark, d: a.allocation_mix(bars(spark, d).where("date between '1998-12-01' and '1998-12-20'"), MIX, zeros=True),
    "composite_counts": lambda spark, d: sc.distribution(sc.composite(bars_stock(spark, d), fundamentals(spark, d)), "status"),
    "magic_formula_counts": magic_counts,
    "universes": universes,
    "bars_from_json": bars_from_json,
    "dividends_from_json": dividends_from_json,
    "sma_ordering": lambda spark, d: t.sma_ordering(bars(spark, d)),
    "crash_evaluation": lambda spark, d: q.crash_evaluation(bars(spark, d)),
    "harvest_comparison": lambda spark, d: p.harvest_comparison(bars(spark, d), MIX, cost=0.001),
    "first_passage_curve": lambda spark, d: m.first_passage_curve(bars(spark, d)),
    "dividend_cut_status": dividend_cut_status,
    "payout_report": payout_report,
    "fund_ranking": fund_ranking,
    "simulation_windows": simulation_windows,
    "clean_prices": lambda spark, d: cl.price_series(dirty(spark, d)),
    "clean_basis": lambda spark, d: cl.basis_series(dirty(spark, d)),
    "clean_candles": lambda spark, d: cl.candles(cl.marked_candles(dirty(spark, d))),
    "candle_report": candle_report,
    "clean_yields": clean_yields,
    "date_window": lambda spark, d: cl.date_window(bars(spark, d), "1995-03-01", "1996-02-29"),
    "bars_ranges": bars_ranges,
    "chart_tails": chart_tails,
    "keyed_trend": keyed_trend,
    "model_outcomes": model_outcomes,
    "soc_avalanche": lambda spark, d: q.avalanche_power_law(drifting(bars(spark, d))),
    "ema_bollinger_atr_trades": lambda spark, d: m.band_trades(drifting(bars(spark, d))),
}
