"""DuckDB SQL for scans, joins in time and the analytics queries."""

from __future__ import annotations

from barloom.plans.oracles_technical import W, lag, steps
from barloom.sources.bars import BARS_SQL, HOURS_SQL, STOCKS_SQL

TRIO = ["AF", "NO", "RF"]
MIX = {"AF": 50.0, "NO": 30.0, "RO": 20.0}


def _in(symbols) -> str:
    return "symbol IN (" + ", ".join(f"'{s}'" for s in symbols) + ")"


def common(symbols) -> str:
    return f"common AS (SELECT * FROM bars WHERE {_in(symbols)} AND date IN (SELECT date FROM bars WHERE {_in(symbols)} GROUP BY date HAVING count(DISTINCT symbol) = {len(symbols)}))"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


RETURNS = f"rets AS (SELECT * FROM (SELECT symbol, date, adjusted_close / {lag('adjusted_close')} - 1 AS r FROM bars {W}) WHERE r IS NOT NULL)"
STARTS = {
    "ytd": "CAST(date_trunc('year', last_date) AS DATE)",
    "y1": "CAST(last_date - INTERVAL 12 MONTH AS DATE)",
    "y3": "CAST(last_date - INTERVAL 36 MONTH AS DATE)",
    "y5": "CAST(last_date - INTERVAL 60 MONTH AS DATE)",
}
_SCORE = "CASE " + " ".join(f"WHEN vol < {x} THEN {k}" for k, x in enumerate((3, 6, 9, 12, 15, 18, 22, 27, 33), 1)) + " ELSE 10 END"
_RANGES = ", ".join(f"('{k}', {m})" for k, m in (("1M", 1), ("3M", 3), ("6M", 6), ("1Y", 12), ("5Y", 60)))
_QUARTERS = "q AS (SELECT symbol, max(date) AS period, arg_max(close, date) AS value FROM bars GROUP BY symbol, date_trunc('quarter', date))"
MONTH_ENDS = f"ends AS (SELECT symbol, date, close FROM (SELECT *, lead(date) OVER w AS nxt FROM bars {W}) WHERE nxt IS NULL OR date_trunc('month', nxt) <> date_trunc('month', date))"

_sum_r = " + ".join(f"{v / 100}::DOUBLE * max(CASE WHEN symbol = '{s}' THEN r END)" for s, v in MIX.items())
_held = " + ".join(f"10000 * {v}::DOUBLE * {s} / first_value({s}) OVER (ORDER BY date)" for s, v in (("NO", 0.6), ("RF", 0.4)))

ORACLES = {
    "bars_daily": _with(BARS_SQL, "SELECT * FROM bars"),
    "bars_stock_daily": _with(STOCKS_SQL, "SELECT symbol, date, open, high, low, close, volume FROM stocks"),
    "bars_hourly": _with(HOURS_SQL, "SELECT symbol, CAST(ts AS VARCHAR) AS hour, open, high, low, close, volume FROM hours"),
    "bars_last_n": steps("SELECT symbol, date, close, volume FROM numbered WHERE n - i < 30"),
    "bars_for_symbols": _with(
        BARS_SQL, "wanted(symbol) AS (VALUES ('AF'), ('ZZ'), ('RO'))", "SELECT w.symbol, count(b.date) AS n, max(b.date) AS last FROM wanted w LEFT JOIN bars b USING (symbol) GROUP BY w.symbol"
    ),
    "bars_clean_candles": steps(
        "raw AS (SELECT * REPLACE (CASE WHEN i % 37 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN i % 53 = 0 THEN 0 ELSE open END AS open) FROM numbered)",
        """SELECT symbol, date, i AS pos, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, volume FROM raw
        WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close, low) - 1e-9 * greatest(high, 1) AND low <= least(open, close, high) + 1e-9 * greatest(high, 1)""",
    ),
    "bars_weekly_fri": _with(
        BARS_SQL, "SELECT symbol, CAST(date + (12 - isodow(date))::INTEGER % 7 AS DATE) AS week, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ALL"
    ),
    "ingest_anti_join": _with(
        BARS_SQL, "stored AS (SELECT * FROM bars WHERE date < DATE '2000-01-01')", "SELECT * FROM bars b WHERE close > 0 AND high >= low AND NOT EXISTS (FROM stored s WHERE s.symbol = b.symbol AND s.date = b.date)"
    ),
    "backfill_upsert": _with(
        BARS_SQL, "SELECT symbol, date, open, high, low, close, CASE WHEN date >= DATE '1999-01-01' THEN round(close / 2, 6) ELSE adjusted_close END AS adjusted_close, volume FROM bars"
    ),
    "universe_soft_delete": """WITH o AS (SELECT r_name AS universe, n_name AS symbol FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 <> 0),
        m AS (SELECT r_name AS universe, n_name AS symbol FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0)
        SELECT coalesce(o.universe, m.universe) AS universe, coalesce(o.symbol, m.symbol) AS symbol, m.symbol IS NOT NULL AS is_current, o.symbol IS NULL AS is_new
        FROM o FULL JOIN m ON o.universe = m.universe AND o.symbol = m.symbol""",
    "date_aligned_returns": _with(BARS_SQL, common(TRIO), f"a AS (SELECT symbol, date, round(close / {lag('close')} - 1, 6) AS r FROM common {W})", "SELECT * FROM a WHERE r IS NOT NULL"),
    "asof_month_end": _with(
        BARS_SQL, MONTH_ENDS, "SELECT b.symbol, b.date, b.close, e.close AS month_close FROM bars b ASOF LEFT JOIN ends e ON b.symbol = e.symbol AND b.date >= e.date"
    ),
    "nearest_year_ago": _with(
        BARS_SQL, _QUARTERS,
        """m AS (SELECT a.symbol, a.period, a.value, b.period AS before, b.value AS before_value,
            row_number() OVER (PARTITION BY a.symbol, a.period ORDER BY abs((b.period - a.period) + 364), b.period) AS k
            FROM q a LEFT JOIN q b ON a.symbol = b.symbol AND abs((b.period - a.period) + 364) <= 45)""",
        "SELECT symbol, period, value, before, before_value FROM m WHERE k = 1",
    ),
    "interval_dividend_sum": _with(
        BARS_SQL, MONTH_ENDS, "pays AS (SELECT symbol, date AS ex_date, CAST(floor(close) / 100.0 AS DOUBLE) AS amount FROM ends)",
        "wins AS (SELECT DISTINCT symbol, make_date(year(date)::INTEGER - 1, 12, 31) AS start, make_date(year(date)::INTEGER, 12, 31) AS stop FROM bars)",
        "SELECT w.symbol, w.stop, round(coalesce(sum(p.amount), 0), 6) AS total, count(p.amount) AS n FROM wins w LEFT JOIN pays p ON p.symbol = w.symbol AND p.ex_date > w.start AND p.ex_date <= w.stop GROUP BY w.symbol, w.stop",
    ),
    "union_registries": """WITH u AS (SELECT c_mktsegment AS symbol, 'segment' AS kind, 0 AS k FROM customer UNION ALL SELECT p_brand, 'brand', 1 FROM part UNION ALL SELECT p_type, 'type', 2 FROM part
        UNION ALL SELECT r_name, 'region', 3 FROM region) SELECT symbol, arg_max(kind, k) AS kind FROM u GROUP BY symbol""",
    "misaligned_dates": _with(BARS_SQL, f"SELECT date, count(DISTINCT symbol) AS n_symbols FROM bars WHERE {_in(TRIO)} GROUP BY date HAVING count(DISTINCT symbol) < 3"),
    "bars_freshness": _with(BARS_SQL, "SELECT symbol, count(*) AS n, max(date) AS last, DATE '2001-11-07' - max(date) > 4 AS stale FROM bars GROUP BY symbol"),
    "downsample": steps("SELECT symbol, date, close FROM numbered WHERE i - 1 IN (SELECT CAST(round_even(k * (n - 1)::DOUBLE / 49, 0) AS BIGINT) FROM range(50) t(k))"),
    "month_ends": _with(BARS_SQL, MONTH_ENDS, "SELECT * FROM ends"),
    "bar_gaps": _with(BARS_SQL, f"a AS (SELECT symbol, {lag('date')} AS previous, date FROM bars {W})", "SELECT *, CAST(date - previous AS BIGINT) AS days FROM a WHERE date - previous > 2"),
    "snapshot": steps(
        f"a AS (SELECT *, {lag('adjusted_close')} AS previous, list(adjusted_close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS s FROM numbered {W})",
        """SELECT symbol, date, adjusted_close AS price, round(adjusted_close - previous, 6) AS change, round((adjusted_close - previous) / previous * 100, 6) AS change_percent,
        array_to_string(list_transform(s, lambda x: CAST(CAST(x AS DECIMAL(18, 4)) AS VARCHAR)), ' ') AS sparkline FROM a WHERE is_last AND i >= 2""",
    ),
    "quote": steps(
        f"a AS (SELECT *, {lag('adjusted_close')} AS previous_close FROM numbered {W})",
        "SELECT symbol, date, open, high, low, close, volume, previous_close, round((adjusted_close / previous_close - 1) * 100, 6) AS change_percent FROM a WHERE is_last",
    ),
    "performance_series": _with(
        BARS_SQL, f"ranges(range, months) AS (VALUES {_RANGES})", "ends_ AS (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol)",
        "a AS (SELECT b.symbol, r.range, b.date, b.adjusted_close AS price FROM bars b JOIN ends_ USING (symbol) CROSS JOIN ranges r WHERE b.date >= CAST(last_date - to_months(r.months) AS DATE))",
        "k AS (SELECT *, row_number() OVER (PARTITION BY symbol, range ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol, range) AS n FROM a)",
        "SELECT symbol, range, date, price FROM k WHERE (k - 1) % CAST(ceil(n / 30.0) AS BIGINT) = 0 OR k = n",
    ),
    "performance_stats": _with(
        BARS_SQL, "e AS (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol)", "b AS (SELECT * FROM bars JOIN e USING (symbol))",
        "g AS (SELECT symbol, arg_max(adjusted_close, date) AS last, max(date) AS date, " + ", ".join(f"coalesce(arg_max(adjusted_close, date) FILTER (WHERE date < {s}), arg_min(adjusted_close, date)) AS {k}" for k, s in STARTS.items())
        + f", arg_min(adjusted_close, date) FILTER (WHERE date >= {STARTS['y5']}) AS p5, min(date) FILTER (WHERE date >= {STARTS['y5']}) AS d5 FROM b GROUP BY symbol)",
        "SELECT symbol, " + ", ".join(f"round((last / {k} - 1) * 100, 6) AS {k}_percent" for k in STARTS) + ", round((pow(last / p5, 1 / ((date - d5) / 365.25)) - 1) * 100, 6) AS cagr_percent FROM g",
    ),
    "max_drawdown": _with(BARS_SQL, f"a AS (SELECT symbol, adjusted_close / max(adjusted_close) OVER w - 1 AS fall FROM bars {W})", "SELECT symbol, round(min(fall) * 100, 6) AS max_drawdown_percent FROM a GROUP BY symbol"),
    "risk_metrics": steps(
        f"a AS (SELECT *, adjusted_close / {lag('adjusted_close')} - 1 AS r FROM numbered {W})", "l AS (SELECT symbol, date, r FROM a WHERE n - i < 252 AND r IS NOT NULL)",
        "own AS (SELECT symbol, stddev_samp(r) * sqrt(252) * 100 AS vol, avg(r) * 252 * 100 AS mean FROM l GROUP BY symbol)",
        "bb AS (SELECT l.symbol, CASE WHEN count(*) > 20 THEN covar_samp(l.r, m.r) / var_samp(m.r) END AS beta FROM l JOIN l m ON m.symbol = 'NO' AND m.date = l.date GROUP BY l.symbol)",
        f"SELECT symbol, round(vol, 6) AS volatility_percent, round(beta, 6) AS beta, round((mean - 4.5) / vol, 6) AS sharpe, CAST({_SCORE} AS BIGINT) AS risk_score FROM own LEFT JOIN bb USING (symbol)",
    ),
    "correlation_matrix": _with(
        BARS_SQL, RETURNS, "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN corr(x.r, y.r) ELSE 0 END, 6) AS correlation FROM rets x JOIN rets y ON x.date = y.date AND x.symbol < y.symbol GROUP BY ALL"
    ),
    "allocation_mix": _with(
        BARS_SQL, common(list(MIX)), f"cr AS (SELECT * FROM (SELECT symbol, date, adjusted_close / {lag('adjusted_close')} - 1 AS r FROM common {W}) WHERE r IS NOT NULL)",
        f"d AS (SELECT date, {_sum_r} AS r FROM cr GROUP BY date)", "e AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS growth FROM d)",
        "f AS (SELECT *, growth / greatest(max(growth) OVER (ORDER BY date), 1) - 1 AS fall FROM e)",
        "g AS (SELECT count(*) AS n, arg_max(growth, date) AS growth, stddev_samp(r) * sqrt(252) * 100 AS vol, avg(r) AS mean, min(fall) AS fall FROM f)",
        "SELECT n, round(ln(growth), 6) AS log_growth, round((pow(growth, 252 / n) - 1) * 100, 6) AS cagr_percent, round(vol, 6) AS volatility_percent, round((mean * 252 * 100 - 4.5) / vol, 6) AS sharpe, round(fall * 100, 6) AS max_drawdown_percent FROM g WHERE n >= 29",
    ),
    "vt_comparison": _with(
        BARS_SQL, common(TRIO), "p AS (SELECT date, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN adjusted_close END) AS {s}" for s in TRIO) + " FROM common GROUP BY date)",
        f'SELECT date, round(10000 * "AF" / first_value("AF") OVER (ORDER BY date), 6) AS single_value, round({_held}, 6) AS split_value FROM p',
    ),
    "dashboard_movers": steps(
        f"a AS (SELECT symbol, is_last, i, round((adjusted_close - {lag('adjusted_close')}) / {lag('adjusted_close')} * 100, 6) AS ch FROM numbered {W})",
        "SELECT arg_max(symbol, row(ch, symbol)) AS top, max(ch) AS top_percent, arg_min(symbol, row(ch, symbol)) AS worst, min(ch) AS worst_percent, count(*) AS n FROM a WHERE is_last AND i >= 2",
    ),
}

_DETAILS = f"""SELECT symbol, date, price, change, change_percent, p.* EXCLUDE (symbol), r.* EXCLUDE (symbol), max_drawdown_percent
    FROM ({ORACLES['snapshot']}) JOIN ({ORACLES['performance_stats']}) p USING (symbol) JOIN ({ORACLES['risk_metrics']}) r USING (symbol) JOIN ({ORACLES['max_drawdown']}) USING (symbol)"""
_TRIO = "(" + ", ".join(repr(x) for x in TRIO) + ")"
ORACLES["details"] = _DETAILS
ORACLES["compare"] = f"""
    WITH rho AS (SELECT a, b, correlation FROM ({ORACLES['correlation_matrix']}) WHERE a IN {_TRIO} AND b IN {_TRIO}),
    both_ways AS (SELECT * FROM rho UNION ALL SELECT b, a, correlation FROM rho),
    lists AS (SELECT a AS symbol, string_agg(b || ' ' || CAST(CAST(correlation AS DECIMAL(8, 4)) AS VARCHAR), ', ' ORDER BY b) AS correlations FROM both_ways GROUP BY a)
    SELECT d.*, correlations FROM ({_DETAILS}) d LEFT JOIN lists USING (symbol) WHERE symbol IN {_TRIO}"""
ORACLES["listed_by_tag"] = f"""SELECT symbol, price, change_percent, 'all, fixed, letter ' || substr(symbol, 1, 1) AS tags FROM ({ORACLES['snapshot']}) WHERE symbol LIKE '%F'"""
