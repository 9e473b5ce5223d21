"""DuckDB SQL for portfolio, screener and dividend queries."""

from __future__ import annotations

from barloom.plans.oracles_analytics import MIX, _with, common
from barloom.plans.oracles_calendar import AS_OF
from barloom.plans.oracles_technical import NUMBERED, W, lag, sma, steps
from barloom.sources.bars import BARS_SQL, STOCKS_SQL
from barloom.sources.fundamentals import EPS_SQL, FUNDAMENTALS_SQL

_N = list(MIX)
_WT = {s: f"{v / 100}::DOUBLE" for s, v in MIX.items()}


def _sum(x: str) -> str:
    return "(" + " + ".join(x.format(s=s, w=_WT[s]) for s in _N) + ")"


def harvest(frequency: str, cost: float) -> list[str]:
    months = {"month": 1, "quarter": 3, "half": 6, "year": 12}[frequency]
    return [
        BARS_SQL, common(_N),
        "p AS (SELECT date, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN adjusted_close END) AS {s}" for s in _N) + f", (year(date) * 12 + month(date) - 1) // {months} AS key FROM common GROUP BY date)",
        "h1 AS (SELECT *, lag(date) OVER o IS NULL AS fst, coalesce(lag(date) OVER o IS NOT NULL AND lead(date) OVER o IS NOT NULL AND key <> lag(key) OVER o, false) AS turn FROM p WINDOW o AS (ORDER BY date))",
        "h2 AS (SELECT *, " + ", ".join(f"last_value(CASE WHEN fst OR turn THEN {s} END IGNORE NULLS) OVER (ORDER BY date) AS now_{s}, last_value(CASE WHEN fst OR turn THEN {s} END IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_{s}, first_value({s}) OVER (ORDER BY date) AS st_{s}" for s in _N) + " FROM h1)",
        f"h3 AS (SELECT *, {_sum('{w} * {s} / old_{s}')} AS grown FROM h2)",
        f"h4 AS (SELECT *, CASE WHEN turn THEN {_sum('abs({w} - {w} * {s} / old_{s} / grown)')} END AS traded FROM h3)",
        f"h5 AS (SELECT *, exp(sum(CASE WHEN turn THEN ln(grown * (1 - {cost}::DOUBLE * traded)) ELSE 0 END) OVER (ORDER BY date)) AS level FROM h4)",
        f"h AS (SELECT date, level * {_sum('{w} * {s} / now_{s}')} AS rebalanced, {_sum('{w} * {s} / st_{s}')} AS held, turn AS is_rebalance, traded / 2 AS turnover FROM h5)",
    ]


def metrics(frequency: str, cost: float, extra: str) -> str:
    sides = ("rebalanced", "held")
    m = "m AS (SELECT *, " + ", ".join(f"{x} / lag({x}) OVER (ORDER BY date) - 1 AS r_{x}, {x} / max({x}) OVER (ORDER BY date) - 1 AS f_{x}" for x in sides) + " FROM h)"
    out = ", ".join(f"round(ln(arg_max({x}, date)), 6) AS {x}_log_growth, round(stddev_samp(r_{x}) * sqrt(252.0) * 100, 6) AS {x}_volatility, round(min(f_{x}) * 100, 6) AS {x}_drawdown" for x in sides)
    return _with(*harvest(frequency, cost), m, f"SELECT count_if(is_rebalance)::BIGINT AS rebalances, round(sum(turnover), 6) AS turnover, {out}{extra} FROM m")


STOCK = STOCKS_SQL.replace("stocks AS", "bars AS", 1)
STOCK_NUMBERED = NUMBERED.replace(BARS_SQL, STOCK)
PRICES = f"""pn AS (SELECT *, {sma('close', 200)} AS sma200 FROM numbered),
    price AS (SELECT symbol, max(date) AS date, arg_max(close, date) AS close, max(close) AS high, min(close) AS low, arg_max(close, date) / arg_min(close, date) - 1 AS ret, arg_max(sma200, date) AS sma200
        FROM pn WHERE n - i < 252 AND n >= 252 GROUP BY symbol)"""
RS = "rs AS (SELECT symbol, ret, row_number() OVER (ORDER BY ret DESC, symbol) AS rank, count(*) OVER () AS n FROM price), rsp AS (SELECT *, round(CASE WHEN n > 1 THEN (n - rank)::DOUBLE / (n - 1) * 100 ELSE 100 END, 1) AS percentile FROM rs)"
EPS = f"eps AS (SELECT symbol, y AS year, {EPS_SQL} AS eps FROM (SELECT p_brand AS symbol, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand) CROSS JOIN range(1997, 2002) t(y))"
GROWTH = """gk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS k FROM eps WHERE eps IS NOT NULL),
    gg AS (SELECT symbol, count(*) AS years, arg_min(eps, year) AS f, arg_max(eps, year) AS l, max(year) - min(year) AS span FROM gk WHERE k <= 5 GROUP BY symbol),
    eps_growth AS (SELECT symbol, years, f, CASE WHEN years >= 3 AND f > 0 THEN l / f - 1 END AS growth, CASE WHEN years >= 3 AND f > 0 AND l > 0 THEN pow(l / f, 1.0::DOUBLE / span) - 1 END AS cagr FROM gg)"""
_CRIT = {
    "c": ("eps_now IS NOT NULL AND eps_ago IS NOT NULL", "eps_ago > 0", "eps_now / eps_ago - 1 >= 0.25"),
    "a": ("eps_years >= 3 AND roe IS NOT NULL", "eps_first > 0", "growth_ >= 0.25 AND roe >= 0.17"),
    "n": ("close IS NOT NULL", "true", "close / high >= 0.85"),
    "s": ("shares_float IS NOT NULL", "true", "shares_float < 25000000"),
    "l": ("percentile IS NOT NULL", "true", "percentile >= 80"),
    "i": ("holders IS NOT NULL", "true", "holders >= 3"),
    "m": ("up IS NOT NULL", "true", "up"),
}
_MEMBERS = "members AS (SELECT DISTINCT p_brand AS symbol FROM part UNION ALL SELECT 'Nobody')"
_CANSLIM = [
    STOCK_NUMBERED, PRICES, RS, FUNDAMENTALS_SQL, EPS, GROWTH, _MEMBERS,
    "idx AS (SELECT close > sma200 AS up FROM pn WHERE symbol = 'Brand#1' AND is_last)",
    "j AS (SELECT m.symbol, f.* EXCLUDE (symbol), p.close, p.high, r.percentile, g.growth AS growth_, g.years AS eps_years, g.f AS eps_first, (SELECT up FROM idx) AS up FROM members m LEFT JOIN facts f USING (symbol) LEFT JOIN price p USING (symbol) LEFT JOIN rsp r USING (symbol) LEFT JOIN eps_growth g USING (symbol))",
    "k AS (SELECT symbol, sector, " + ", ".join(f"CASE WHEN NOT coalesce({known}, false) THEN 'UNAVAILABLE' WHEN NOT ({fits}) THEN 'NOT_APPLICABLE' WHEN {rule} THEN 'PASS' ELSE 'FAIL' END AS {x}" for x, (known, fits, rule) in _CRIT.items()) + " FROM j)",
    "scan AS (SELECT *, " + ", ".join(f"CAST({' + '.join(f'({x} IN {v})::INTEGER' for x in _CRIT)} AS BIGINT) AS {name}" for v, name in (("('PASS')", "passed"), ("('UNAVAILABLE', 'NOT_APPLICABLE')", "unavailable"))) + " FROM k)",
]
PAYS = """mon AS (SELECT symbol, max(date) AS ex_date, arg_max(close, date) AS close FROM bars GROUP BY symbol, date_trunc('month', date)),
    pays AS (SELECT symbol, ex_date, CAST(floor(close) / 100.0 AS DOUBLE) AS amount, month(ex_date) = 6 AND year(ex_date) % 3 = 0 AS is_special FROM mon WHERE month(ex_date) % 3 = 0)"""
ANNUAL = f"""an AS (SELECT symbol, year(ex_date) AS year, sum(amount) FILTER (WHERE NOT is_special) AS total, count_if(NOT is_special) AS n, count_if(is_special) AS n_special FROM pays GROUP BY ALL),
    annual AS (SELECT s.symbol, s.year, round(coalesce(total, 0), 6) AS total, coalesce(n, 0)::BIGINT AS n, coalesce(n_special, 0)::BIGINT AS n_special
        FROM (SELECT symbol, unnest(range(min(year), year(DATE '{AS_OF}'))) AS year FROM an GROUP BY symbol) s LEFT JOIN an USING (symbol, year)),
    modal AS (SELECT symbol, arg_max(n, row(times, last)) AS modal FROM (SELECT symbol, n, count(*) AS times, max(year) AS last FROM
        (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS k FROM annual WHERE n > 0) WHERE k <= 5 GROUP BY symbol, n) GROUP BY symbol)"""
GROWTHS = """g1 AS (SELECT *, CASE WHEN lag(total) OVER v > 0 THEN (total / lag(total) OVER v - 1) * 100 END AS change, lag(total, 3) OVER v AS o3, lag(total, 5) OVER v AS o5, lag(total, 10) OVER v AS o10 FROM annual WINDOW v AS (PARTITION BY symbol ORDER BY year)),
    g2 AS (SELECT *, sum(CASE WHEN change > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY year) AS isle, sum(CASE WHEN n > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY year) AS gap FROM g1),
    grows AS (SELECT symbol, year, round(change, 6) AS change_percent, CASE WHEN change > 0.5 THEN 'Positive' WHEN change < -0.5 THEN 'Negative' WHEN change IS NOT NULL THEN 'Flat' END AS kind,
        round(CASE WHEN o3 > 0 AND total > 0 THEN (pow(total / o3, 1.0::DOUBLE / 3) - 1) * 100 END, 6) AS cagr3, round(CASE WHEN o5 > 0 AND total > 0 THEN (pow(total / o5, 1.0::DOUBLE / 5) - 1) * 100 END, 6) AS cagr5, round(CASE WHEN o10 > 0 AND total > 0 THEN (pow(total / o10, 1.0::DOUBLE / 10) - 1) * 100 END, 6) AS cagr10,
        CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, gap ORDER BY year) AS BIGINT) AS paying_years,
        CAST(sum(CASE WHEN change > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, isle ORDER BY year) AS BIGINT) AS increases FROM g2)"""
TREND = """t1 AS (SELECT *, coalesce(n = modal, false) AS usual FROM annual LEFT JOIN modal USING (symbol)),
    t2 AS (SELECT *, lag(total) OVER v AS before, lag(usual) OVER v AS usual1, lag(n) OVER v AS n1 FROM t1 WINDOW v AS (PARTITION BY symbol ORDER BY year)),
    t3 AS (SELECT *, (total / before - 1) * 100 AS change, before > 0 AND (usual AND usual1 OR n = 0 AND n1 > 0) AS usable FROM t2),
    t4 AS (SELECT *, row_number() OVER v AS nth, CASE WHEN usable THEN count_if(usable) OVER v END AS kth FROM t3 WINDOW v AS (PARTITION BY symbol ORDER BY year DESC)),
    t5 AS (SELECT symbol, count_if(n > 0) AS paying, count_if(kth <= 5)::BIGINT AS changes, count_if(kth <= 5 AND change > 0.5)::BIGINT AS up, count_if(kth <= 5 AND change < -0.5)::BIGINT AS down,
        avg(CASE WHEN usual THEN 0 ELSE 1 END) FILTER (WHERE nth <= 6) AS unusual FROM t4 GROUP BY symbol),
    trends AS (SELECT symbol, changes, up, down, CASE WHEN paying < 3 THEN 'Insufficient History' WHEN unusual >= 0.5 THEN 'Irregular' WHEN changes < 2 THEN 'Insufficient History'
        WHEN down = 0 THEN CASE WHEN up >= 0.6 * changes THEN 'Increasing' ELSE 'Stable' END WHEN up = 0 THEN 'Decreasing' ELSE 'Irregular' END AS trend FROM t5)"""
CUTS = """c1 AS (SELECT *, lag(amount) OVER v AS before, ex_date - lag(ex_date) OVER v AS gap, least(lead(amount, 1) OVER v, lead(amount, 2) OVER v) AS nxt FROM pays WHERE NOT is_special WINDOW v AS (PARTITION BY symbol ORDER BY ex_date)),
    cuts AS (SELECT symbol, ex_date, before, amount, round((amount / before - 1) * 100, 6) AS change_percent, coalesce(nxt <= 0.95::DOUBLE * before, false) AS confirmed FROM c1 WHERE gap <= 400 AND amount <= 0.9::DOUBLE * before)"""
STATUS = f"""s1 AS (SELECT symbol, max(ex_date) FILTER (WHERE ex_date <= DATE '{AS_OF}') AS last, count_if(ex_date > DATE '{AS_OF}') AS upcoming FROM pays WHERE NOT is_special GROUP BY symbol),
    s2 AS (SELECT *, CAST(DATE '{AS_OF}' - last AS BIGINT) AS days, CASE modal WHEN 12 THEN 30.4::DOUBLE WHEN 4 THEN 91.3::DOUBLE WHEN 2 THEN 182.6::DOUBLE WHEN 1 THEN 365.2::DOUBLE ELSE 365.2::DOUBLE / modal END AS expected FROM s1 LEFT JOIN modal USING (symbol)),
    statuses AS (SELECT symbol, last, days, round(expected, 6) AS expected_days, CASE WHEN upcoming > 0 THEN 'declared' WHEN days > greatest(2 * expected, expected + 90) THEN 'suspended' WHEN days > 1.35::DOUBLE * expected + 15 THEN 'delayed' ELSE 'on time' END AS status FROM s2)"""
PAYOUT = """feps AS (SELECT symbol, year(date) AS year, CAST(floor(max(close)) / 50.0 AS DOUBLE) AS eps FROM bars GROUP BY ALL),
    po AS (SELECT e.symbol, e.year, CASE WHEN e.eps > 0 THEN coalesce(p.paid, 0) / e.eps * 100 END AS ratio FROM feps e LEFT JOIN (SELECT symbol, year(ex_date) AS year, sum(amount) AS paid FROM pays GROUP BY ALL) p USING (symbol, year)),
    payouts AS (SELECT symbol, year, round(ratio, 6) AS payout_percent, CASE WHEN ratio <= 60 THEN 'low' WHEN ratio <= 80 THEN 'moderate' WHEN ratio <= 100 THEN 'high' WHEN ratio IS NOT NULL THEN 'above earnings' ELSE 'unavailable' END AS band FROM po)"""

#: Made-up statements of each fund and year; the same text in Spark SQL.
STATEMENTS = {
    "eps": "CASE WHEN m % 11 = 0 THEN NULL ELSE (m % 23 - 3) / 2 END",
    "revenue": "m * 10 + k",
    "fcf": "CASE WHEN k % 13 = 0 THEN NULL ELSE (k % 37) * 5 - 20 END",
    "paid": "k % 29",
    "ebitda": "CASE WHEN m % 9 = 0 THEN NULL ELSE (m % 31) * 3 - 6 END",
    "net_debt": "(m + k) % 90 - 10",
}
HEALTH = [
    "st AS (SELECT symbol, year, " + ", ".join(f"{x} AS {n}" for n, x in STATEMENTS.items()) + " FROM (SELECT symbol, y AS year, m0 + y % 17 AS m, k0 + y % 7 AS k FROM (SELECT symbol, year(date) AS y, CAST(floor(max(close)) AS BIGINT) AS m0, CAST(floor(avg(close)) AS BIGINT) AS k0 FROM bars GROUP BY ALL)))",
    "h1 AS (SELECT *, lag(eps) OVER v AS eps1, lag(revenue) OVER v AS revenue1, lead(year) OVER v IS NULL AS lst FROM st WINDOW v AS (PARTITION BY symbol ORDER BY year))",
    "h2 AS (SELECT *, sum(CASE WHEN eps < eps1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS falls FROM h1)",
    "h3 AS (SELECT h2.*, p.payout_percent AS payout, CASE WHEN eps1 > 0 THEN (eps / eps1 - 1) * 100 END AS ec, CASE WHEN revenue1 > 0 THEN (revenue / revenue1 - 1) * 100 END AS rc, CASE WHEN paid > 0 AND fcf > 0 THEN fcf / paid END AS cv, CASE WHEN net_debt > 0 AND ebitda > 0 THEN net_debt / ebitda END AS lv FROM h2 LEFT JOIN payouts p USING (symbol, year) WHERE lst)",
    """h4 AS (SELECT symbol, year, eps, round(payout, 6) AS payout, round(ec, 6) AS eps_change, round(cv, 6) AS cover, round(lv, 6) AS leverage,
        CASE WHEN payout <= 60 THEN 'supportive' WHEN payout <= 80 THEN 'neutral' WHEN payout > 80 THEN 'concern' END AS payout_factor,
        CASE WHEN eps1 IS NULL THEN NULL WHEN eps <= 0 OR ec <= -20 THEN 'concern' WHEN ec >= 0 AND falls = 0 THEN 'supportive' ELSE 'neutral' END AS earnings_factor,
        CASE WHEN rc <= -10 THEN 'concern' WHEN rc >= 0 THEN 'supportive' WHEN rc IS NOT NULL THEN 'neutral' END AS revenue_factor,
        CASE WHEN NOT paid > 0 THEN NULL WHEN fcf <= 0 THEN 'concern' WHEN cv >= 1.5 THEN 'supportive' WHEN cv >= 1 THEN 'neutral' ELSE 'concern' END AS cash_factor,
        CASE WHEN net_debt IS NULL OR ebitda IS NULL THEN NULL WHEN net_debt <= 0 THEN 'supportive' WHEN ebitda <= 0 THEN 'concern' WHEN lv <= 2 THEN 'supportive' WHEN lv <= 4 THEN 'neutral' ELSE 'concern' END AS debt_factor FROM h3)""",
    """h5 AS (SELECT *, [payout_factor, earnings_factor, revenue_factor, cash_factor, debt_factor] AS fs FROM h4)""",
    """health AS (SELECT * EXCLUDE (fs), CAST(len(list_filter(fs, lambda x: x = 'concern')) AS BIGINT) AS concerns, CAST(len(list_filter(fs, lambda x: x = 'supportive')) AS BIGINT) AS supports,
        CASE WHEN len(list_filter(fs, lambda x: x IS NOT NULL)) < 2 THEN 'Insufficient Data' WHEN len(list_filter(fs, lambda x: x = 'concern')) >= 2 THEN 'Weak'
        WHEN len(list_filter(fs, lambda x: x = 'concern')) = 0 AND len(list_filter(fs, lambda x: x = 'supportive')) >= 2 THEN 'Supportive' ELSE 'Mixed' END AS assessment FROM h5)""",
]

_QUARTERS = "q AS (SELECT symbol, eps_now, CASE WHEN eps_now IS NOT NULL THEN DATE '2001-09-30' END AS eps_day, CASE WHEN eps_now IS NOT NULL THEN eps_ago END AS eps_ago, CASE WHEN eps_now IS NOT NULL AND eps_ago IS NOT NULL THEN DATE '2000-09-30' END AS ago_day FROM facts)"
_FUND_YEARS = "fy AS (SELECT symbol, year(date) AS year, CAST(floor(max(close)) AS BIGINT) AS m FROM bars GROUP BY ALL)"
_PAYOUT_BASES = [
    _FUND_YEARS,
    "fq AS (SELECT symbol, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS day, CAST(floor(max(close)) AS BIGINT) / 200 AS eps FROM bars WHERE symbol IN ('AF', 'NO', 'RO') GROUP BY ALL)",
    f"fis AS (SELECT symbol, make_date(max(year)::INTEGER, 12, 31) AS stop, arg_max((m - 1500) / 20, year) AS eps FROM fy WHERE symbol IN ('AF', 'NF') AND year < year(DATE '{AS_OF}') GROUP BY symbol)",
    f"four AS (SELECT symbol, max(day) AS stop, sum(eps) AS eps FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM fq WHERE day <= DATE '{AS_OF}') WHERE k <= 4 GROUP BY symbol HAVING count(*) = 4 AND max(day) - min(day) BETWEEN 200 AND 330)",
    f"fp AS (SELECT symbol, eps, CASE WHEN eps > 0 THEN coalesce((SELECT sum(amount) FROM pays p WHERE p.symbol = e.symbol AND ex_date > stop - INTERVAL 1 YEAR AND ex_date <= stop AND ex_date <= DATE '{AS_OF}'), 0) / eps * 100 END AS r FROM fis e)",
    f"tp AS (SELECT symbol, eps, CASE WHEN eps > 0 THEN coalesce((SELECT sum(amount) FROM pays p WHERE p.symbol = e.symbol AND ex_date > stop - INTERVAL 1 YEAR AND ex_date <= stop AND ex_date <= DATE '{AS_OF}'), 0) / eps * 100 END AS r FROM four e)",
    "cp AS (SELECT symbol, CASE WHEN arg_max(m, year) % 97 > 0 THEN (arg_max(m, year) % 29 + 1) / (arg_max(m, year) % 97) * 100 END AS r FROM fy GROUP BY symbol)",
    "pb AS (SELECT symbol, fp.r AS f, tp.r AS t, cp.r AS c, coalesce(fp.eps <= 0, false) OR coalesce(tp.eps <= 0, false) AS lost FROM cp LEFT JOIN fp USING (symbol) LEFT JOIN tp USING (symbol))",
    "pc AS (SELECT *, CASE WHEN f IS NOT NULL THEN 'fiscal_year' WHEN t IS NOT NULL THEN 'trailing_twelve_months' WHEN NOT lost AND c IS NOT NULL THEN 'aggregate_cash_basis' END AS basis FROM pb)",
    "pd AS (SELECT *, CASE basis WHEN 'fiscal_year' THEN f WHEN 'trailing_twelve_months' THEN t WHEN 'aggregate_cash_basis' THEN c END AS v FROM pc)",
    """SELECT symbol, round(f, 6) AS fiscal_payout, round(t, 6) AS ttm_payout, round(c, 6) AS cash_payout, basis, round(v, 6) AS payout_percent, CASE WHEN basis IS NOT NULL THEN 'available' WHEN lost THEN 'not_meaningful' ELSE 'unavailable' END AS status,
    CASE WHEN round(v, 2) <= 60 THEN 'Moderate' WHEN round(v, 2) <= 80 THEN 'Elevated' WHEN round(v, 2) <= 100 THEN 'High' WHEN v IS NOT NULL THEN 'Exceeds earnings' END AS band FROM pd""",
]

ORACLES = {
    "facts_quarters": _with(FUNDAMENTALS_SQL, _QUARTERS, "SELECT * FROM q WHERE eps_now IS NOT NULL"),
    "facts_ebit": _with(FUNDAMENTALS_SQL, "SELECT symbol, DATE '2001-12-31' AS ebit_day, ebit::DOUBLE AS ebit, CASE WHEN s % 2 = 0 THEN 'ebit' ELSE 'operatingIncome' END AS ebit_item FROM facts JOIN (SELECT p_brand AS symbol, sum(p_size)::BIGINT AS s FROM part GROUP BY p_brand) USING (symbol) WHERE ebit IS NOT NULL"),
    "facts_balance": _with(FUNDAMENTALS_SQL, "SELECT symbol, DATE '2000-12-31' AS balance_day, " + ", ".join(f"{x}::DOUBLE AS {x}" for x in ("current_assets", "cash", "current_liabilities", "current_debt", "net_ppe")) + " FROM facts"),
    "facts_valuation": _with(FUNDAMENTALS_SQL, "SELECT * REPLACE (CASE WHEN eps_now IS NOT NULL THEN eps_ago END AS eps_ago) FROM facts"),
    "payout_bases": _with(BARS_SQL, PAYS, *_PAYOUT_BASES),
    "canslim_filtered": steps(*_CANSLIM[1:], "SELECT symbol, passed, count(*) OVER () AS total FROM scan WHERE passed >= 1 AND sector IN ('Technology', 'Energy') ORDER BY passed DESC, symbol LIMIT 50", base=STOCK_NUMBERED),
    "canslim_quality_counts": steps(*_CANSLIM[1:], "g AS (SELECT CASE WHEN unavailable = 0 THEN 'COMPLETE' WHEN unavailable < 7 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS value, count(*) AS n FROM scan GROUP BY 1)", "SELECT value, n, round(n / sum(n) OVER () * 100, 6) AS percent FROM g", base=STOCK_NUMBERED),
    "volatility_harvesting": _with(*harvest("quarter", 0.001), "SELECT date, round(ln(rebalanced), 6) AS log_rebalanced, round(ln(held), 6) AS log_held, is_rebalance, round(turnover, 6) AS turnover FROM h"),
    "vol_harvest_frequency_grid": " UNION ALL ".join(f"({metrics(f, 0.001, f', {f!r} AS frequency')})" for f in ("month", "quarter", "half", "year")),
    "vol_harvest_cost_grid": " UNION ALL ".join(f"({metrics('quarter', x, f', {x}::DOUBLE AS cost')})" for x in (0.0, 0.001, 0.005)),
    "covariances": _with(
        BARS_SQL, common(_N), f"lr AS (SELECT * FROM (SELECT symbol, date, ln(close) - ln({lag('close')}) AS r FROM common {W}) WHERE r IS NOT NULL)",
        "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(covar_samp(x.r, y.r) * 252, 6) AS covariance, round(avg(x.r) * 252, 6) AS mean_a FROM lr x JOIN lr y USING (date) GROUP BY ALL",
    ),
    "canslim_etf": steps(PRICES, "k AS (SELECT symbol, date, close, close >= 0.85::DOUBLE * high AS n, close >= 1.3::DOUBLE * low AS l, close > sma200 AS m FROM price)", "SELECT *, CAST(coalesce(n::INTEGER, 0) + coalesce(l::INTEGER, 0) + coalesce(m::INTEGER, 0) AS BIGINT) AS score FROM k"),
    "relative_strength_rank": steps(PRICES, RS, "SELECT symbol, round(ret, 6) AS ret, rank, percentile FROM rsp", base=STOCK_NUMBERED),
    "market_direction": steps(f"a AS (SELECT *, {sma('close', 200)} AS s FROM numbered WHERE symbol = 'Brand#1')", "SELECT symbol, date, close, round(s, 6) AS sma200, close > s AS confirmed_up FROM a WHERE is_last", base=STOCK_NUMBERED),
    "annual_eps_growth": _with(EPS, GROWTH, "SELECT symbol, years, round(growth, 6) AS growth, round(cagr, 6) AS cagr FROM eps_growth"),
    "canslim_stock": steps(*_CANSLIM[1:], "SELECT *, CASE WHEN unavailable = 0 THEN 'COMPLETE' WHEN unavailable < 7 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS quality, passed >= 5 AS qualifies FROM scan", base=STOCK_NUMBERED),
    "canslim_page": steps(*_CANSLIM[1:], "SELECT symbol, passed, count(*) OVER () AS total FROM scan WHERE passed >= 2 ORDER BY passed DESC, symbol LIMIT 10 OFFSET 5", base=STOCK_NUMBERED),
    "magic_formula": _with(
        FUNDAMENTALS_SQL, "a AS (SELECT *, coalesce(enterprise_value, market_cap + total_debt - total_cash) AS ev, CASE WHEN net_ppe >= 0 THEN current_assets - cash - (current_liabilities - current_debt) + net_ppe END AS cap FROM facts)",
        "b AS (SELECT *, CASE WHEN ev > 0 THEN round(ebit / ev, 6) END AS ey, CASE WHEN cap > 0 THEN round(ebit / cap, 6) END AS roc FROM a)",
        "d AS (SELECT *, CASE WHEN ebit IS NULL THEN 'no data' WHEN sector IN ('Financials', 'Financial Services', 'Utilities') THEN 'sector' WHEN price_currency <> financial_currency THEN 'currency' WHEN ey IS NULL OR roc IS NULL THEN 'invalid' END AS excluded FROM b)",
        "e AS (SELECT *, rank() OVER (ORDER BY round(ey, 10) DESC) AS ey_rank, rank() OVER (ORDER BY round(roc, 10) DESC) AS roc_rank FROM d WHERE excluded IS NULL)",
        "SELECT symbol, ey, roc, ey_rank, roc_rank, ey_rank + roc_rank AS combined, row_number() OVER (ORDER BY ey_rank + roc_rank, ey_rank, roc_rank, symbol) AS place, excluded FROM e UNION ALL SELECT symbol, ey, roc, NULL, NULL, NULL, NULL, excluded FROM d WHERE excluded IS NOT NULL",
    ),
    "graham_valuation": steps(
        FUNDAMENTALS_SQL, "px AS (SELECT symbol, close FROM numbered WHERE is_last)",
        "a AS (SELECT *, least(growth, 15)::DOUBLE AS g FROM facts LEFT JOIN px USING (symbol))",
        "b AS (SELECT *, CASE WHEN eps_now > 0 AND g IS NOT NULL THEN eps_now * (8.5::DOUBLE + 2 * g) * (4.4::DOUBLE / 4.8::DOUBLE) END AS v, CASE WHEN eps_now > 0 AND g IS NOT NULL THEN eps_now * (8.5::DOUBLE + g) * (4.4::DOUBLE / 4.8::DOUBLE) END AS h, CASE WHEN eps_now > 0 THEN eps_now * 8.5::DOUBLE * (4.4::DOUBLE / 4.8::DOUBLE) END AS z FROM a)",
        """SELECT symbol, round(v, 6) AS value, round(h, 6) AS half_growth, round(z, 6) AS no_growth, round(v * 0.7::DOUBLE, 6) AS with_margin, round((v - close) / close * 100, 6) AS upside_percent,
        CASE WHEN eps_now IS NULL THEN 'no earnings' WHEN eps_now <= 0 THEN 'earnings not positive' WHEN growth IS NULL THEN 'no growth' WHEN close IS NULL THEN 'no price' END AS unavailable FROM b""",
        base=STOCK_NUMBERED,
    ),
    "fed_model": steps(
        FUNDAMENTALS_SQL, "t AS (SELECT date, close / 40 AS y FROM bars WHERE symbol = 'AF')",
        "n AS (SELECT arg_max(y, date) AS now, avg(y) AS mean FROM t WHERE y > 0 AND y <= 20)", "sh AS (SELECT count_if(y <= (SELECT now FROM n))::DOUBLE / count(*) AS share FROM t WHERE y > 0 AND y <= 20)",
        "a AS (SELECT *, CASE WHEN pe > 0 THEN 100 / pe END AS ey FROM facts CROSS JOIN n CROSS JOIN sh)",
        """SELECT symbol, round(ey, 6) AS earnings_yield, round(now, 6) AS treasury, round(ey - now, 6) AS spread, CASE WHEN ey - now > 0.25 THEN 'above' WHEN ey - now < -0.25 THEN 'below' WHEN ey IS NOT NULL THEN 'near' END AS kind,
        round(mean, 6) AS treasury_mean, round(share, 6) AS treasury_share FROM a""",
    ),
    "composite_score": steps(
        FUNDAMENTALS_SQL, f"p AS (SELECT * FROM (SELECT *, {sma('close', 200)} AS s FROM numbered) WHERE is_last)",
        f"ch AS (SELECT symbol, i, close - {lag('close')} AS d FROM numbered {W})",
        "sd AS (SELECT symbol, avg(greatest(d, 0)) AS up, avg(greatest(-d, 0)) AS down FROM ch WHERE i BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14)",
        "rest AS (SELECT symbol, list(d ORDER BY i) AS ds FROM ch WHERE i > 15 GROUP BY symbol)",
        "wl AS (SELECT symbol, CASE WHEN ds IS NULL THEN up ELSE list_reduce(ds, lambda a, x: (a * 13 + greatest(x, 0)) / 14, up) END AS up, CASE WHEN ds IS NULL THEN down ELSE list_reduce(ds, lambda a, x: (a * 13 + greatest(-x, 0)) / 14, down) END AS down FROM sd LEFT JOIN rest USING (symbol))",
        "a AS (SELECT f.symbol, forward_pe, debt_to_equity, close, s, CASE WHEN up = 0 AND down = 0 THEN NULL WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM facts f LEFT JOIN p USING (symbol) LEFT JOIN wl USING (symbol))",
        """k AS (SELECT symbol, round(rsi, 6) AS rsi, CASE WHEN s IS NULL THEN 'unavailable' WHEN close > s THEN 'pass' ELSE 'fail' END AS above_ma, CASE WHEN rsi IS NULL THEN 'unavailable' WHEN rsi < 70 THEN 'pass' ELSE 'fail' END AS rsi_below,
            CASE WHEN forward_pe IS NULL THEN 'unavailable' WHEN forward_pe <= 0 THEN 'not_meaningful' WHEN forward_pe < 25 THEN 'pass' ELSE 'fail' END AS pe_below,
            CASE WHEN debt_to_equity IS NULL THEN 'unavailable' WHEN debt_to_equity < 0 THEN 'not_meaningful' WHEN debt_to_equity < 1.5 THEN 'pass' ELSE 'fail' END AS de_below, rsi < 30 AS oversold FROM a)""",
        "m AS (SELECT *, CAST(" + " + ".join(f"({x} = 'pass')::INTEGER" for x in ("above_ma", "rsi_below", "pe_below", "de_below")) + " AS BIGINT) AS score, CAST(" + " + ".join(f"({x} = 'unavailable')::INTEGER" for x in ("above_ma", "rsi_below", "pe_below", "de_below")) + " AS BIGINT) AS unknown FROM k)",
        "SELECT *, CASE WHEN unknown = 0 THEN 'complete' WHEN unknown < 4 THEN 'partial' ELSE 'unavailable' END AS status FROM m",
        base=STOCK_NUMBERED,
    ),
    "dividend_annual_table": _with(BARS_SQL, PAYS, ANNUAL, "SELECT * FROM annual"),
    "dividend_modal_count": _with(BARS_SQL, PAYS, ANNUAL, "SELECT * FROM modal"),
    "dividend_yield": _with(
        BARS_SQL, PAYS, ANNUAL, f"px AS (SELECT symbol, arg_max(close, date) AS close FROM bars WHERE date <= DATE '{AS_OF}' GROUP BY symbol)",
        f"g AS (SELECT symbol, sum(amount) FILTER (WHERE ex_date > DATE '{AS_OF}' - 365) AS ttm, arg_max(amount, ex_date) FILTER (WHERE NOT is_special) AS latest FROM pays WHERE ex_date <= DATE '{AS_OF}' GROUP BY symbol)",
        "SELECT symbol, close, round(ttm, 6) AS ttm, round(ttm / close * 100, 6) AS yield_percent, round(latest * modal / close * 100, 6) AS forward_percent FROM px LEFT JOIN g USING (symbol) LEFT JOIN modal USING (symbol)",
    ),
    "dividend_growth": _with(BARS_SQL, PAYS, ANNUAL, GROWTHS, "SELECT * FROM grows"),
    "dividend_trend": _with(BARS_SQL, PAYS, ANNUAL, GROWTHS, TREND, "SELECT * FROM trends"),
    "dividend_cut_events": _with(BARS_SQL, PAYS, CUTS, "SELECT * FROM cuts"),
    "dividend_status": _with(BARS_SQL, PAYS, ANNUAL, STATUS, "SELECT * FROM statuses"),
    "payout_ratio": _with(BARS_SQL, PAYS, PAYOUT, "SELECT * FROM payouts"),
    "sustainability": _with(BARS_SQL, PAYS, PAYOUT, *HEALTH, "SELECT * FROM health"),
    "cut_risk": _with(
        BARS_SQL, PAYS, ANNUAL, GROWTHS, TREND, CUTS, STATUS, PAYOUT, *HEALTH,
        f"rc AS (SELECT symbol, count(*) AS cuts, bool_or(confirmed) AS sure FROM cuts WHERE ex_date > DATE '{AS_OF}' - 729 AND ex_date <= DATE '{AS_OF}' GROUP BY symbol)",
        """a AS (SELECT s.symbol, payout > 80 AS payout_high, eps <= 0 AS no_earnings, CASE WHEN earnings_factor IS NOT NULL THEN earnings_factor = 'concern' AND coalesce(eps_change <= -20, false) END AS earnings_down,
            cash_factor = 'concern' AS cash_short, debt_factor = 'concern' AS debt_high, revenue_factor = 'concern' AS revenue_down, coalesce(cuts, 0) > 0 AS recent_cut, trend = 'Irregular' AS irregular, status IN ('suspended', 'delayed') AS overdue,
            payout > 100 AS v1, cover IS NULL OR cover < 0.75 AS v4, coalesce(sure, false) AS v7, status = 'suspended' AS v9 FROM statuses s LEFT JOIN trends USING (symbol) LEFT JOIN rc USING (symbol) LEFT JOIN health USING (symbol))""",
        """b AS (SELECT *, CAST(len(list_filter([payout_high, no_earnings, earnings_down, cash_short, debt_high, revenue_down, recent_cut, irregular, overdue], lambda x: x IS NOT NULL)) AS BIGINT) AS known,
            len(list_filter([payout_high, no_earnings, earnings_down, cash_short, debt_high, revenue_down], lambda x: x IS NOT NULL)) AS ff,
            CAST(len(list_filter([payout_high AND v1, no_earnings, cash_short AND v4, recent_cut AND v7, overdue AND v9], lambda x: x)) AS BIGINT) AS high,
            CAST(len(list_filter([payout_high AND NOT coalesce(v1, false), earnings_down, cash_short AND NOT v4, debt_high, recent_cut AND NOT v7, irregular, overdue AND NOT v9], lambda x: x)) AS BIGINT) AS medium FROM a)""",
        """SELECT symbol, payout_high, no_earnings, earnings_down, cash_short, debt_high, revenue_down, recent_cut, irregular, overdue, known, high, medium,
        CASE WHEN known < 3 OR ff = 0 THEN 'Insufficient Data' WHEN high >= 2 OR (high >= 1 AND medium >= 2) THEN 'Elevated risk indicators' WHEN high = 1 OR medium >= 2 THEN 'Moderate risk indicators' ELSE 'Few risk indicators' END AS level FROM b""",
    ),
}

ORACLES["magic_formula_top"] = f"SELECT * FROM ({ORACLES['magic_formula']}) WHERE place <= 5 OR symbol = 'Brand#1'"
ORACLES["dividend_analysis"] = f"""
    SELECT y.*, g.* EXCLUDE (symbol), trend, last, days, status, assessment, level FROM ({ORACLES['dividend_yield']}) y
    LEFT JOIN (SELECT * FROM ({ORACLES['dividend_growth']}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year DESC) = 1) g USING (symbol)
    LEFT JOIN (SELECT symbol, trend FROM ({ORACLES['dividend_trend']})) USING (symbol) LEFT JOIN (SELECT symbol, last, days, status FROM ({ORACLES['dividend_status']})) USING (symbol)
    LEFT JOIN (SELECT symbol, assessment FROM ({ORACLES['sustainability']})) USING (symbol) LEFT JOIN (SELECT symbol, level FROM ({ORACLES['cut_risk']})) USING (symbol)"""
