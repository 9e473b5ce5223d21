"""DuckDB SQL for the calendar, portfolio, screener and dividend queries."""

from __future__ import annotations

from barloom.plans.oracles_analytics import MIX, _with
from barloom.plans.oracles_technical import W, _w, lag, roll, sma, steps
from barloom.sources.bars import BARS_SQL

AS_OF = "2001-10-20"
MONTHS = f"""ends_m AS (SELECT symbol, year(date) * 12 + month(date) - 1 AS m, arg_max(adjusted_close, date) AS p, max(date) AS last FROM bars GROUP BY ALL),
    e1 AS (SELECT *, lag(p) OVER v AS before, lag(m) OVER v AS before_m, lead(m) OVER v IS NULL AS is_last, last_day(last) AS fin FROM ends_m WINDOW v AS (PARTITION BY symbol ORDER BY m)),
    spine AS (SELECT symbol, unnest(range(min(m), max(m) + 1)) AS m FROM ends_m GROUP BY symbol),
    e2 AS (SELECT s.symbol, s.m, p, before, before_m, is_last, DATE '{AS_OF}' > fin AND last >= fin - CASE isodow(fin) WHEN 7 THEN 2 WHEN 6 THEN 1 ELSE 0 END::INTEGER - 4 AS whole
        FROM spine s LEFT JOIN e1 USING (symbol, m)),
    e3 AS (SELECT *, CASE WHEN p IS NULL THEN 'missing' WHEN before IS NULL THEN 'no_base' WHEN before_m <> m - 1 THEN 'prior_month_missing' WHEN is_last AND NOT whole THEN 'partial_month' ELSE 'ok' END AS status FROM e2),
    months AS (SELECT symbol, m, status, CASE WHEN status IN ('ok', 'partial_month') THEN p / before - 1 END AS r FROM e3)"""
YEARS = f"""ends_y AS (SELECT symbol, year(date) AS year, arg_max(adjusted_close, date) AS p, max(date) AS last FROM bars GROUP BY ALL),
    y1 AS (SELECT *, lag(p) OVER v AS before, lag(year) OVER v AS before_year FROM ends_y WINDOW v AS (PARTITION BY symbol ORDER BY year)),
    grid AS (SELECT * FROM (SELECT DISTINCT symbol FROM ends_y) CROSS JOIN (SELECT DISTINCT year FROM ends_y)),
    y2 AS (SELECT g.symbol, g.year, p, last, make_date(g.year::INTEGER, 12, 31) AS fin, before, before_year, min(CASE WHEN p IS NOT NULL THEN g.year END) OVER (PARTITION BY g.symbol) AS f FROM grid g LEFT JOIN y1 USING (symbol, year)),
    y3 AS (SELECT *, CASE WHEN p IS NULL THEN CASE WHEN year < f THEN 'not_listed' ELSE 'missing' END WHEN before IS NULL THEN 'no_base' WHEN before_year <> year - 1 THEN 'prior_year_missing'
        WHEN fin >= DATE '{AS_OF}' OR last < fin - CASE isodow(fin) WHEN 7 THEN 2 WHEN 6 THEN 1 ELSE 0 END::INTEGER - 4 THEN 'partial' ELSE 'complete' END AS status FROM y2),
    cells AS (SELECT symbol, year, status, CASE WHEN status IN ('complete', 'partial') THEN p / before - 1 END AS r FROM y3)"""
WEEKS = "weeks AS (SELECT symbol, CAST(date + (12 - isodow(date))::INTEGER % 7 AS DATE) AS date, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ALL)"
_NAMES = ["rsi", "macd_hist", "ppo", "cmf", "percent_b", "volatility", "downside", "scaled_return", "adx"]
FEATURES = f"""wn AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS before, greatest(high - {lag('high')}, 0) AS u0, greatest({lag('low')} - low, 0) AS d0 FROM weeks {W}),
    wt AS (SELECT *, CASE WHEN u0 > d0 THEN u0 ELSE 0 END AS pdm, CASE WHEN d0 > u0 THEN d0 ELSE 0 END AS mdm FROM wn),
    wwalk AS (
        SELECT symbol, i, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down, CAST(NULL AS DOUBLE) AS sig, 0::DOUBLE AS p, 0::DOUBLE AS m, CAST(NULL AS DOUBLE) AS adx FROM wt WHERE i = 1
        UNION ALL
        SELECT symbol, i, e12, e26, up, down, CASE WHEN i < 26 THEN NULL WHEN sig IS NULL THEN e12 - e26 ELSE sig + 0.2::DOUBLE * (e12 - e26 - sig) END, p, m,
            CASE WHEN i < 14 THEN NULL WHEN adx IS NULL THEN dx ELSE adx + (dx - adx) / 14 END
        FROM (SELECT *, 100 * abs(p - m) / (p + m) AS dx FROM (
            SELECT t.symbol, t.i, s.e12 + 2 / 13.0::DOUBLE * (t.close - s.e12) AS e12, s.e26 + 2 / 27.0::DOUBLE * (t.close - s.e26) AS e26,
                CASE WHEN s.up IS NULL THEN greatest(t.close - t.before, 0) ELSE s.up + (greatest(t.close - t.before, 0) - s.up) / 14 END AS up,
                CASE WHEN s.down IS NULL THEN greatest(t.before - t.close, 0) ELSE s.down + (greatest(t.before - t.close, 0) - s.down) / 14 END AS down,
                s.sig, s.p + (t.pdm - s.p) / 14 AS p, s.m + (t.mdm - s.m) / 14 AS m, s.adx FROM wwalk s JOIN wt t ON t.symbol = s.symbol AND t.i = s.i + 1))),
    k1 AS (SELECT t.*, t.close / t.before - 1 AS r, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume AS flow,
        CASE WHEN i < 15 THEN NULL WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi, CASE WHEN i >= 34 THEN e12 - e26 - sig END AS macd_hist,
        CASE WHEN i >= 26 THEN (e12 - e26) / e26 * 100 END AS ppo, CASE WHEN i >= 27 THEN adx END AS adx FROM wt t JOIN wwalk USING (symbol, i)),
    k2 AS (SELECT *, CASE WHEN count(flow) OVER {_w(20)} = 20 AND sum(volume) OVER {_w(20)} > 0 THEN sum(flow) OVER {_w(20)} / sum(volume) OVER {_w(20)} END AS cmf,
        {sma('close', 20)} AS mean, {roll('stddev_samp', 'close', 20)} AS sd, {roll('stddev_samp', 'r', 12)} * sqrt(52.0) AS volatility, least(r, 0) * least(r, 0) AS dd FROM k1),
    k3 AS (SELECT *, date AS week, CASE WHEN sd > 0 THEN (close - (mean - 2 * sd)) / (4 * sd) END AS percent_b,
        CASE WHEN count(r) OVER {_w(12)} = 12 THEN sqrt(avg(dd) OVER {_w(12)}) * sqrt(52.0) END AS downside, CASE WHEN volatility > 0 THEN r / volatility END AS own FROM k2),
    feats AS (SELECT a.*, CASE WHEN a.symbol = 'NO' THEN 0 ELSE a.own - b.own END AS scaled_return FROM k3 a LEFT JOIN k3 b ON b.symbol = 'NO' AND b.week = a.week)"""


def _z(name: str) -> str:
    return f"CASE WHEN stddev_samp({name}) OVER p > 0 THEN ({name} - avg({name}) OVER p) / stddev_samp({name}) OVER p WHEN {name} IS NOT NULL THEN 0 END AS z_{name}"


_TERMS = ["z_rsi", "z_macd_hist", "z_ppo", "z_cmf", "z_percent_b", "-z_volatility", "-z_downside", "z_scaled_return", "z_adx * CASE WHEN z_macd_hist >= 0 THEN 1 WHEN z_macd_hist < 0 THEN -1 END"]
STANDARD = [
    f"z AS (SELECT *, count(*) OVER p AS n_weeks, {', '.join(_z(x) for x in _NAMES)} FROM feats WINDOW p AS (PARTITION BY symbol))",
    f"scores AS (SELECT *, list_avg(list_filter([{', '.join(_TERMS)}], lambda x: x IS NOT NULL)) AS composite, lead(week) OVER (PARTITION BY symbol ORDER BY week) IS NULL AS is_last FROM z WHERE n_weeks >= 90)",
]
TAGS = "tags AS (SELECT symbol, unnest([CASE WHEN symbol LIKE '%F' THEN 'fixed' ELSE 'open' END, 'letter ' || substr(symbol, 1, 1), 'all']) AS tag FROM (SELECT DISTINCT symbol FROM bars))"
_OWN = f"own AS (SELECT symbol, m AS month FROM (SELECT *, (close / {lag('close', 21)} - 1) * 100 AS m FROM numbered {W}) WHERE is_last AND i >= 26)"
_share = "CASE symbol " + " ".join(f"WHEN '{s}' THEN {v / 100}::DOUBLE" for s, v in MIX.items()) + " END"


def _walk(*parts: str) -> str:
    return _with(BARS_SQL, WEEKS, FEATURES, *parts).replace("WITH ", "WITH RECURSIVE ", 1)


_PERIOD = "SELECT symbol, k * {n} // 12 AS year, k % {parts} + 1 AS part, round((exp(sum(ln(1 + r))) - 1) * 100, 6) AS return_percent FROM (SELECT *, m // {n} AS k FROM months WHERE status = 'ok') GROUP BY symbol, k HAVING count(*) = {n}"

ORACLES = {
    "seasonal_months": _with(BARS_SQL, MONTHS, "SELECT symbol, m // 12 AS year, m % 12 + 1 AS month, status, round(r * 100, 6) AS return_percent FROM months"),
    "seasonal_quarters": _with(BARS_SQL, MONTHS, _PERIOD.format(n=3, parts=4)),
    "seasonal_years": _with(BARS_SQL, MONTHS, _PERIOD.format(n=12, parts=1)),
    "seasonal_summary": _with(
        BARS_SQL, MONTHS,
        """SELECT symbol, m % 12 + 1 AS month, count(*) AS n, round(avg(r) * 100, 6) AS mean_percent, round(median(r) * 100, 6) AS median_percent,
        round(count_if(r > 0)::DOUBLE / count(*) * 100, 6) AS positive_percent, round(max(r) * 100, 6) AS best_percent, round(min(r) * 100, 6) AS worst_percent FROM months WHERE status = 'ok' GROUP BY ALL""",
    ),
    "diversification_annual": _with(BARS_SQL, YEARS, "SELECT symbol, year, status, round(r * 100, 6) AS return_percent FROM cells"),
    "diversification_ranking": _with(
        BARS_SQL, YEARS, "d AS (SELECT symbol, year, r FROM cells WHERE status = 'complete')",
        f"x AS (SELECT * FROM d UNION ALL SELECT 'PORTFOLIO', year, sum(r * {_share}) FROM d WHERE symbol IN ({', '.join(repr(s) for s in MIX)}) GROUP BY year HAVING count(*) = {len(MIX)})",
        "SELECT symbol, year, round(r * 100, 6) AS return_percent, rank() OVER (PARTITION BY year ORDER BY round(r, 10) DESC) AS rank FROM x",
    ),
    "corporate_action_warnings": steps(
        f"a AS (SELECT *, adjusted_close / close AS ratio, abs(adjusted_close / close / ({lag('adjusted_close')} / {lag('close')}) - 1) AS jump FROM numbered {W})",
        "SELECT symbol, count_if(jump > 0.2::DOUBLE)::BIGINT AS jumps, round(max(jump) * 100, 6) AS largest_percent, max(ratio) - min(ratio) < 1e-9 AND max(date) - min(date) > 730 AS constant_ratio FROM a GROUP BY symbol HAVING count(*) >= 3",
    ),
    "tlt_cycle": steps(
        "l AS (SELECT symbol, date, list_filter(list_transform(range(0, day(last_day(date))), lambda k: CAST(date_trunc('month', date) AS DATE) + k::INTEGER), lambda d: isodow(d) < 6) AS days, list_min(list_filter(list_transform(range(1, 8), lambda k: last_day(date) + k::INTEGER), lambda d: isodow(d) < 6)) AS nxt FROM numbered WHERE is_last AND i >= 5)",
        "a AS (SELECT *, len(list_filter(days, lambda d: d < date)) + 1 AS k, len(days) AS n, least(greatest(len(days) - 4, 4), len(days)) AS e FROM l)",
        """SELECT symbol, date, k AS business_day, n AS business_days, CASE WHEN k <= 3 THEN 'Short Window (Start of Month)' WHEN k < e THEN 'Mid-Month (No Position)' WHEN k <= n THEN 'Long Window (End of Month)' ELSE 'Post Long-Exit (No Position)' END AS phase,
        CASE WHEN k <= 3 THEN 'Short' WHEN k >= e AND k <= n THEN 'Long' ELSE 'Flat' END AS position, CASE WHEN k < 3 THEN 'Exit Short' WHEN k < e THEN 'Enter Long' WHEN k < n THEN 'Exit Long' ELSE 'Enter Short' END AS next_action,
        CASE WHEN k < 3 THEN days[3] WHEN k < e THEN days[e] WHEN k < n THEN days[n] ELSE nxt END AS next_date FROM a""",
    ),
    "factor_momentum": steps(
        TAGS, _OWN, "t AS (SELECT tag, avg(month) AS mean, count(*) AS n FROM own JOIN tags USING (symbol) GROUP BY tag)",
        "SELECT tag, n, round(mean, 6) AS mean_percent, row_number() OVER (ORDER BY mean DESC, tag) AS rank, round(cume_dist() OVER (ORDER BY mean), 6) AS share_below FROM t",
    ),
    "factor_scores": steps(
        TAGS, _OWN, "t AS (SELECT tag, avg(month) AS mean FROM own JOIN tags USING (symbol) GROUP BY tag)",
        "SELECT symbol, round(max(month), 6) AS month_percent, round(avg(mean), 6) AS score, count(*) AS n_tags FROM own JOIN tags USING (symbol) JOIN t USING (tag) GROUP BY symbol",
    ),
    "regime_features": _walk(f"SELECT symbol, week, {', '.join(f'round({x}, 6) AS {x}' for x in _NAMES)} FROM feats"),
    "regime_composite": _walk(
        *STANDARD,
        "SELECT symbol, week, round(composite, 6) AS composite, round(100 / (1 + exp(-3 * composite)), 6) AS score, CASE WHEN 100 / (1 + exp(-3 * composite)) >= 50 THEN 'Risk-On' ELSE 'Risk-Off' END AS regime FROM scores WHERE is_last",
    ),
    "regime_composite_chart": _walk(
        *STANDARD,
        "SELECT week, round(avg(composite), 6) AS composite, round(avg(volatility), 6) AS volatility, count(composite) AS n FROM scores GROUP BY week HAVING count(composite) > 0 ORDER BY week DESC LIMIT 104",
    ),
}
