"""Queries of the market operators over the test tables, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import analytics as a
from barloom.operators import calendars as k
from barloom.operators import dividends as dv
from barloom.operators import facts as fx
from barloom.operators import models as m
from barloom.operators import portfolio as p
from barloom.operators import quant as q
from barloom.operators import scans as s
from barloom.operators import screeners as sc
from barloom.operators import technical as t
from barloom.plans import cleaned, oracles_analytics, oracles_calendar, oracles_cleaned, oracles_portfolio, oracles_quant, oracles_stored, oracles_stream, oracles_technical, stored
from barloom.plans.oracles_analytics import MIX, TRIO
from barloom.plans.oracles_calendar import AS_OF
from barloom.plans.oracles_portfolio import STATEMENTS
from barloom.sources.bars import bars, bars_hourly, bars_stock, table
from barloom.sources.documents import parse_dividends, parsed
from barloom.sources.fundamentals import annual_eps, documents, fund_documents, fundamentals
from barloom.sources.scratch import shared_dir
from barloom.streaming import bars as st

Query = Callable[[SparkSession, str], DataFrame]


def on_bars(operator: Callable[..., DataFrame], **settings) -> Query:
    return lambda spark, sf_dir: operator(bars(spark, sf_dir), **settings)


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_hourly(spark, sf_dir).select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("hour"), "open", "high", "low", "close", "volume"
    )


def _for_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("AF",), ("ZZ",), ("RO",)], "symbol string")
    return s.for_symbols(bars(spark, sf_dir), wanted).groupBy("symbol").agg(F.count("date").alias("n"), F.max("date").alias("last"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.functions.series import numbered

    raw = numbered(bars(spark, sf_dir))  # spoil some candles
    raw = raw.withColumn("high", F.when(F.col("i") % 37 == 0, F.col("low") - 1).otherwise(F.col("high")))
    raw = raw.withColumn("open", F.when(F.col("i") % 53 == 0, 0.0).otherwise(F.col("open")))
    return s.clean_candles(raw.drop("i", "is_last"))


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return s.ingest(b.where("date < '2000-01-01'"), b)


def _backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    new = b.where("date >= '1999-01-01'").withColumn("adjusted_close", F.round(F.col("close") / 2, 6))
    return s.backfill(b.where("date < '2000-01-01'"), new)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    members = nation.select(F.col("r_name").alias("universe"), F.col("n_name").alias("symbol"), "n_nationkey")
    return s.refresh_members(members.where("n_nationkey % 3 <> 0"), members.where("n_nationkey % 2 = 0"))


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return s.asof(b.select("symbol", "date", "close"), s.month_ends(b).withColumnRenamed("close", "month_close"), ["symbol"], "date", "month_close")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.trunc("date", "quarter")
    q = bars(spark, sf_dir).groupBy("symbol", quarter.alias("q")).agg(F.max("date").alias("period"), F.max_by("close", "date").alias("value"))
    return s.nearest_before(q.drop("q"))


def _interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    pays = s.month_ends(b).select("symbol", F.col("date").alias("ex_date"), (F.floor("close") / 100.0).alias("amount"))
    y = F.year("date")
    wins = b.select("symbol", F.make_date(y - 1, F.lit(12), F.lit(31)).alias("start"), F.make_date(y, F.lit(12), F.lit(31)).alias("stop")).distinct()
    return s.interval_sums(wins, pays)


def _registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [("customer", "c_mktsegment", "segment"), ("part", "p_brand", "brand"), ("part", "p_type", "type"), ("region", "r_name", "region")]
    return s.union_registries(*[table(spark, sf_dir, n).select(F.col(x).alias("symbol"), F.lit(k).alias("kind")) for n, x, k in named])


def tags(b: DataFrame) -> DataFrame:
    """A small registry of tags for each symbol."""
    kind = F.when(F.col("symbol").endswith("F"), "fixed").otherwise("open")
    return b.select("symbol").distinct().withColumn("tags", F.array(kind, F.concat(F.lit("letter "), F.substring("symbol", 1, 1)), F.lit("all")))


def _tagged(operator) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = bars(spark, sf_dir)
        return operator(b, tags(b))

    return run


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.weekly_features(s.weekly(bars(spark, sf_dir)), "NO")


def _annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.annual_cells(bars(spark, sf_dir), AS_OF).select("symbol", "year", "status", F.round(F.col("r") * 100, 6).alias("return_percent"))


def payments(b: DataFrame) -> DataFrame:
    """Quarterly payments made from the last bar of every third month."""
    ends = b.groupBy("symbol", F.trunc("date", "month").alias("m")).agg(F.max("date").alias("ex_date"), F.max_by("close", "date").alias("close"))
    special = (F.month("ex_date") == 6) & (F.year("ex_date") % 3 == 0)
    return ends.where(F.month("ex_date") % 3 == 0).select(
        "symbol", "ex_date", (F.floor("close") / 100.0).alias("amount"), special.alias("is_special")
    )


def fund_eps(b: DataFrame) -> DataFrame:
    return b.groupBy("symbol", F.year("date").cast("long").alias("year")).agg((F.floor(F.max("close")) / 50.0).alias("eps"))


def _health(b: DataFrame) -> DataFrame:
    y = F.year("date").cast("long")
    g = b.groupBy("symbol", y.alias("year")).agg(F.floor(F.max("close")).alias("m"), F.floor(F.avg("close")).alias("k"))
    g = g.withColumn("m", F.col("m") + F.col("year") % 17).withColumn("k", F.col("k") + F.col("year") % 7)
    return dv.sustainability(dv.payout(payments(b), fund_eps(b)), g.selectExpr("symbol", "year", *[f"{x} AS {n}" for n, x in STATEMENTS.items()]))


def on_payments(operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(payments(bars(spark, sf_dir)))


def on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(parsed(documents(spark, sf_dir)))


def _payout_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return fx.payout_bases(parsed(fund_documents(b)), payments(b), AS_OF)


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return dv.analysis(payments(b), b, _health(b), AS_OF)


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return a.details(b, benchmark="NO")


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.compare(bars(spark, sf_dir), TRIO, benchmark="NO")


def _canslim(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_stock(spark, sf_dir)
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    members = members.unionByName(spark.createDataFrame([("Nobody",)], "symbol string"))
    return sc.canslim_stocks(b, fundamentals(spark, sf_dir), annual_eps(spark, sf_dir), members, sc.market_direction(b, "Brand#1"))


def _graham(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.functions.series import latest, numbered

    return sc.graham(fundamentals(spark, sf_dir), latest(numbered(bars_stock(spark, sf_dir))).select("symbol", "close"))


def _fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = bars(spark, sf_dir).where("symbol = 'AF'").select("date", (F.col("close") / 40).alias("y"))
    return sc.fed_model(fundamentals(spark, sf_dir), rates)


def _eps_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sc.annual_growth(annual_eps(spark, sf_dir))
    return g.select("symbol", "years", F.round("growth", 6).alias("growth"), F.round("cagr", 6).alias("cagr"))


def _streamed(operator, view: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(st.run_to_table(operator(st.event_stream(spark, sf_dir)), shared_dir(spark)))

    return run


def _stamp(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.run_updates(st.running_average(st.event_stream(spark, sf_dir)), shared_dir(spark), "symbol", "n")
    return out.select("symbol", F.round("average", 6).alias("average"), "n")


def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    value = F.when(F.col("c_custkey") % 5 == 0, "NA").when(F.col("c_custkey") % 7 == 0, None).otherwise((F.col("c_custkey") % 40).cast("string"))
    date = F.when(F.col("c_custkey") % 11 == 0, "bad").otherwise(
        F.concat(F.lit("2001-0"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit("-15T00:00"))
    )
    unadjusted = (F.col("c_custkey") % 30).cast("string").alias("unadjustedValue")
    period = F.when(F.col("c_custkey") % 13 == 0, "Special").alias("period")
    rows = c.select(F.col("c_mktsegment").alias("symbol"), date.alias("date"), value.alias("value"), unadjusted, period)
    none = [F.lit(None).cast("string").alias(x) for x in ("paymentDate", "declarationDate", "recordDate", "currency")]
    found = parse_dividends(rows.select("*", *none)).select("symbol", "ex_date", F.round("amount", 6).alias("amount"), "is_special")
    return dv.upcoming(found, "2001-06-30")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = spark.createDataFrame([(a, b) for a in m.STOPS for b in m.TARGETS], "stop double, target double")
    return m.band_backtest(bars(spark, sf_dir), settings)


def _rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two portfolios of three symbols each."""
    rows = [("first", "AF", "NO", "RF"), ("second", "RF", "AF", "NO")]
    named = spark.createDataFrame(rows, "portfolio string, risky string, hedge string, shelter string")
    return m.rotation_backtests(bars(spark, sf_dir), named)


QUERIES: dict[str, Query] = {
    "bars_daily": lambda spark, d: bars(spark, d),
    "bars_stock_daily": lambda spark, d: bars_stock(spark, d).drop("adjusted_close"),
    "bars_hourly": _hourly,
    "bars_last_n": on_bars(s.last_bars, n=30),
    "bars_for_symbols": _for_symbols,
    "bars_clean_candles": _clean,
    "bars_weekly_fri": on_bars(s.weekly),
    "ingest_anti_join": _ingest,
    "backfill_upsert": _backfill,
    "universe_soft_delete": _members,
    "date_aligned_returns": on_bars(s.aligned_returns, symbols=TRIO),
    "asof_month_end": _asof,
    "nearest_year_ago": _nearest,
    "interval_dividend_sum": _interval,
    "union_registries": _registries,
    "misaligned_dates": on_bars(s.misaligned_dates, symbols=TRIO),
    "bars_freshness": on_bars(s.freshness, as_of="2001-11-07"),
    "downsample": on_bars(s.downsample, points=50),
    "month_ends": on_bars(s.month_ends),
    "bar_gaps": on_bars(s.gaps, days=2),
    "snapshot": on_bars(a.snapshot),
    "quote": on_bars(a.quote),
    "performance_series": on_bars(a.performance_series),
    "performance_stats": on_bars(a.performance_stats),
    "max_drawdown": on_bars(a.max_drawdown),
    "risk_metrics": on_bars(a.risk_metrics, benchmark="NO"),
    "correlation_matrix": on_bars(a.correlation_matrix),
    "allocation_mix": on_bars(a.allocation_mix, weights=MIX),
    "vt_comparison": on_bars(a.buy_and_hold_comparison, one="AF", split={"NO": 0.6, "RF": 0.4}),
    "dashboard_movers": on_bars(a.movers),
    "bollinger_latest": on_bars(t.bollinger),
    "better_breakout": on_bars(t.better_breakout),
    "sma_trend": on_bars(t.sma_trend),
    "sma_traffic_light": on_bars(t.traffic_light),
    "sma_crossovers": on_bars(t.sma_crossovers),
    "td_setup": on_bars(t.td_setup),
    "pivot_levels": on_bars(t.pivot_levels),
    "cpr": on_bars(t.central_pivot_range),
    "candle_confirmation": on_bars(t.candle_confirmation),
    "squeeze_momentum": on_bars(t.squeeze),
    "ema50_rsi_pullback": on_bars(t.ema50_rsi_pullback),
    "ema8_21_pullback": on_bars(t.ema8_21_pullback),
    "macd": on_bars(t.macd),
    "triple_ma_pullback": on_bars(t.triple_ma_pullback),
    "supertrend_confirmation": on_bars(t.supertrend_confirmation),
    "heikin_ashi_setup": on_bars(t.heikin_ashi_setup),
    "ta_candles": on_bars(t.ta_candles),
    "mswing": on_bars(t.swing_momentum, index="NO"),
    "candlestick_patterns": on_bars(t.candlestick_patterns),
    "evar_risk": on_bars(q.evar_risk),
    "momentum_reversal": on_bars(q.momentum_reversal),
    "avalanches": lambda spark, d: q.avalanches(bars(spark, d)).withColumn("size", F.round("size", 6)),
    "wavelet_trend": on_bars(q.wavelet_trend),
    "crash_warning": on_bars(q.crash_warning),
    "crash_validation": on_bars(q.crash_validation),
    "acf_squared_returns": on_bars(q.autocorrelation),
    "shock_asymmetry": on_bars(q.shock_asymmetry),
    "leverage_correlations": on_bars(q.leverage_correlations),
    "volatility_rank": on_bars(q.rolling_volatility_rank),
    "linear_channel": on_bars(q.linear_channel),
    "seasonal_months": on_bars(k.seasonal_months, as_of=AS_OF),
    "seasonal_quarters": on_bars(k.seasonal_periods, as_of=AS_OF, months=3),
    "seasonal_years": on_bars(k.seasonal_periods, as_of=AS_OF, months=12),
    "seasonal_summary": on_bars(k.seasonal_summary, as_of=AS_OF),
    "diversification_annual": _annual,
    "diversification_ranking": on_bars(k.diversification, weights=MIX, as_of=AS_OF),
    "corporate_action_warnings": on_bars(k.adjustment_warnings),
    "tlt_cycle": on_bars(k.monthly_cycle),
    "factor_momentum": _tagged(k.factor_momentum),
    "factor_scores": _tagged(k.symbol_factor_scores),
    "regime_features": lambda spark, d: features(spark, d).select("symbol", "week", *[F.round(x, 6).alias(x) for x in k.FEATURES]),
    "regime_composite_chart": lambda spark, d: k.composite_chart(features(spark, d)),
    "volatility_report": on_bars(m.volatility_report),
    "efficient_frontier": on_bars(m.frontier, symbols=list(MIX)),
    "volatility_harvesting": on_bars(p.harvest_path, weights=MIX, frequency="quarter", cost=0.001),
    "vol_harvest_frequency_grid": on_bars(p.frequency_grid, weights=MIX),
    "vol_harvest_cost_grid": on_bars(p.cost_grid, weights=MIX),
    "covariances": lambda spark, d: p.covariances(bars(spark, d), list(MIX)).withColumns({x: F.round(x, 6) for x in ("covariance", "mean_a")}),
    "canslim_etf": on_bars(sc.canslim_etf),
    "relative_strength_rank": lambda spark, d: sc.relative_strength(bars_stock(spark, d)),
    "market_direction": lambda spark, d: sc.market_direction(bars_stock(spark, d), "Brand#1"),
    "annual_eps_growth": _eps_growth,
    "canslim_stock": _canslim,
    "canslim_page": lambda spark, d: sc.page(_canslim(spark, d), 2, 5, 10),
    "magic_formula": lambda spark, d: sc.magic_formula(fundamentals(spark, d)),
    "graham_valuation": _graham,
    "fed_model": _fed,
    "composite_score": lambda spark, d: sc.composite(bars_stock(spark, d), fundamentals(spark, d)),
    "dividend_annual_table": on_payments(lambda x: dv.annual_table(x, AS_OF)),
    "dividend_modal_count": on_payments(lambda x: dv.modal_counts(dv.annual_table(x, AS_OF))),
    "dividend_yield": lambda spark, d: dv.yields(payments(bars(spark, d)), bars(spark, d), AS_OF),
    "dividend_growth": on_payments(lambda x: dv.growth(dv.annual_table(x, AS_OF))),
    "dividend_trend": on_payments(lambda x: dv.trend(dv.annual_table(x, AS_OF))),
    "dividend_cut_events": on_payments(dv.cut_events),
    "dividend_status": on_payments(lambda x: dv.payment_status(x, AS_OF)),
    "facts_quarters": on_documents(fx.quarters),
    "facts_ebit": on_documents(fx.ebit),
    "facts_balance": on_documents(fx.balance),
    "facts_valuation": fundamentals,
    "payout_bases": _payout_bases,
    "dividend_analysis": _analysis,
    "details": _details,
    "compare": _compare,
    "listed_by_tag": _tagged(lambda b, tagged: a.listed(b, tagged, "fixed")),
    "magic_formula_top": lambda spark, d: sc.magic_formula_top(sc.magic_formula(fundamentals(spark, d)), 5, ["Brand#1"]),
    "canslim_filtered": lambda spark, d: sc.page(_canslim(spark, d), 1, 0, 50, sectors=["Technology", "Energy"], complete_only=False),
    "canslim_quality_counts": lambda spark, d: sc.distribution(_canslim(spark, d), "quality"),
    "payout_ratio": lambda spark, d: dv.payout(payments(bars(spark, d)), fund_eps(bars(spark, d))),
    "sustainability": lambda spark, d: _health(bars(spark, d)),
    "cut_risk": lambda spark, d: dv.cut_risk(payments(bars(spark, d)), _health(bars(spark, d)), AS_OF),
    "buy_and_hold_shares": on_bars(p.whole_shares, initial=10000.0, rate=0.001, flat=1.0),
    "dividend_parse": _parse,
    "hmm_regime": on_bars(m.hmm_regime),
    "garch_fit": on_bars(m.garch),
    "garch_leverage_test": on_bars(m.leverage_test),
    "first_passage_time": on_bars(m.first_passage),
    "ema_bollinger_atr_backtest": _grid,
    "rotation_backtest": _rotations,
    "rotation_summary": lambda spark, d: m.rotation_summary(_rotations(spark, d)),
    "randomized_simulation": lambda spark, d: m.random_portfolios(bars(spark, d), "NO", flat=1.0).drop("path"),
    "simulation_paths": lambda spark, d: m.simulation_paths(m.random_portfolios(bars(spark, d), "NO", flat=1.0)),
    "simulation_summary": lambda spark, d: m.simulation_summary(m.random_portfolios(bars(spark, d), "NO")),
    "portfolio_optimization": on_bars(m.optimize, symbols=list(MIX)),
    "portfolio_statistics": on_bars(m.portfolio_statistics, symbols=list(MIX)),
    "market_regime": lambda spark, d: m.market_regime(k.standardized(features(spark, d))),
    "stream_hourly_ohlcv": _streamed(st.hourly_bars, _stamp("ts")),
    "stream_dedup_ingest": _streamed(st.unique_events, lambda df: df.select("event_id", "user_id", "event_type", "value")),
    "stream_session_users": _streamed(st.user_sessions, _stamp("start", "stop")),
    "stream_ema_state": _averages,
    "regime_composite": lambda spark, d: k.composite_scores(features(spark, d)),
    **stored.QUERIES,
    **cleaned.QUERIES,
}
ORACLES: dict[str, str] = {
    **oracles_analytics.ORACLES, **oracles_technical.ORACLES, **oracles_quant.ORACLES, **oracles_calendar.ORACLES, **oracles_portfolio.ORACLES,
    **oracles_stream.ORACLES, **oracles_stored.ORACLES, **oracles_cleaned.ORACLES
}
