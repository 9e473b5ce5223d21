"""DuckDB SQL for cleaned series, ranges, stored states and results, and outcomes."""

from __future__ import annotations

from barloom.plans.oracles_calendar import ORACLES as CALENDAR
from barloom.plans.oracles_portfolio import ORACLES as PORTFOLIO
from barloom.plans.oracles_calendar import AS_OF
from barloom.plans.oracles_portfolio import EPS, FUNDAMENTALS_SQL, PAYS, PRICES, STOCK_NUMBERED, harvest
from barloom.plans.oracles_quant import ORACLES as QUANT
from barloom.plans.oracles_technical import INDICATORS, NUMBERED, W, lag, r6, sma, steps
from barloom.plans.oracles_technical import ORACLES as TECHNICAL
from barloom.sources.bars import BARS_SQL

_DIRTY = """dirty AS (
        SELECT symbol, CASE WHEN i % 97 <> 0 THEN date END AS date, open, high, low, CASE WHEN i % 31 = 0 THEN -1 ELSE close END AS close,
            CASE WHEN i % 17 = 0 THEN NULL WHEN i % 19 = 0 THEN 0 ELSE adjusted_close END AS adjusted_close, volume, 0 AS arrival FROM numbered
        UNION ALL SELECT symbol, date, open, high, low, close * 2, NULL, volume, 1 FROM numbered WHERE i % 29 = 0),
    day_last AS (SELECT * FROM dirty WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY arrival DESC) = 1)"""
_ROOM = "1e-9 * greatest(high, 1)"
_MARKED = f"""marked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos,
        open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close, low) - {_ROOM} AND low <= least(open, close, high) + {_ROOM} AS ok FROM day_last)"""
_DRIFT = """steps_of AS (SELECT symbol, date, volume, round(100 * exp(sum((close / 150.0::DOUBLE - 1) * 0.02::DOUBLE + 0.0015::DOUBLE) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)), 4) AS close FROM bars)"""

_PAYS = """mon AS (SELECT symbol, max(date) AS ex_date, arg_max(close, date) AS close FROM bars GROUP BY symbol, date_trunc('month', date)),
    pays AS (SELECT symbol, ex_date, CAST(floor(close) / 100.0 AS DOUBLE) / CASE WHEN symbol IN ('AF', 'NF') AND ex_date >= DATE '1997-01-01' THEN 2 ELSE 1 END AS amount, month(ex_date) = 6 AND year(ex_date) % 3 = 0 AS is_special,
        CASE WHEN symbol = 'NF' AND ex_date >= DATE '1997-01-01' THEN 'semi-annual' WHEN symbol <> 'AO' THEN 'quarterly' END AS label, CASE WHEN symbol = 'NO' THEN 'EUR' WHEN symbol <> 'RF' THEN 'USD' END AS currency
        FROM mon WHERE month(ex_date) % 3 = 0 AND (symbol <> 'RO' OR ex_date < DATE '1996-01-01'))"""
_DAYS = "asks(as_of) AS (VALUES (DATE '1998-03-31'), (DATE '2001-06-30'))"
_CUT = [
    "past AS (SELECT * FROM asks JOIN pays ON ex_date <= as_of)",
    "e1 AS (SELECT *, lag(amount) OVER v AS b, lag(label) OVER v AS l, ex_date - lag(ex_date) OVER v AS gap, least(lead(amount, 1) OVER v, lead(amount, 2) OVER v) AS nxt FROM past WHERE NOT is_special WINDOW v AS (PARTITION BY as_of, symbol ORDER BY ex_date))",
    "e2 AS (SELECT *, ex_date >= as_of - 729 AS recent, coalesce(nxt <= 0.95::DOUBLE * b, false) AS sure FROM e1 WHERE gap <= 400 AND amount <= 0.9::DOUBLE * b AND NOT coalesce(label <> l, false))",
    "e3 AS (SELECT as_of, symbol, count(*) AS cut_events, count_if(recent)::BIGINT AS recent_events, count_if(recent AND sure)::BIGINT AS confirmed_events FROM e2 GROUP BY ALL)",
    "y0 AS (SELECT as_of, symbol, unnest(range(min(year(ex_date)), year(as_of))) AS year FROM past GROUP BY as_of, symbol)",
    "y1 AS (SELECT as_of, symbol, year, round(coalesce(sum(amount) FILTER (WHERE NOT is_special), 0), 6) AS total, count(*) FILTER (WHERE NOT is_special) AS n FROM y0 LEFT JOIN (SELECT *, year(ex_date) AS year FROM past) USING (as_of, symbol, year) GROUP BY ALL)",
    "y2 AS (SELECT *, row_number() OVER (PARTITION BY as_of, symbol ORDER BY year DESC) AS nth, row_number() OVER (PARTITION BY as_of, symbol, n > 0 ORDER BY year DESC) AS kth FROM y1)",
    "md AS (SELECT as_of, symbol, arg_max(n, row(times, last)) AS modal FROM (SELECT as_of, symbol, n, count(*) AS times, max(year) AS last FROM y2 WHERE n > 0 AND kth <= 5 GROUP BY ALL) GROUP BY ALL)",
    "y3 AS (SELECT y2.*, modal, coalesce(n = modal, false) AS usual FROM y2 LEFT JOIN md USING (as_of, symbol))",
    "y4 AS (SELECT *, lag(total) OVER v AS t1, lag(n) OVER v AS n1, lag(usual) OVER v AS u1 FROM y3 WINDOW v AS (PARTITION BY as_of, symbol ORDER BY year))",
    """y5 AS (SELECT as_of, symbol, max(modal) AS modal, bool_or(coalesce(nth = 1 AND t1 > 0 AND total < 0.995::DOUBLE * t1, false)) AS fell, bool_or(coalesce(nth = 1 AND t1 > 0 AND total < 0.995::DOUBLE * t1 AND (usual AND u1 OR n = 0), false)) AS alike,
        count_if(nth <= 3 AND usual) = 3 AS reg, count_if(t1 > 0 AND NOT (usual AND u1) AND NOT (n = 0 AND n1 > 0))::BIGINT AS excluded FROM y4 GROUP BY as_of, symbol)""",
    "l1 AS (SELECT as_of, symbol, arg_max(ex_date, row(NOT is_special, ex_date)) AS last, arg_max(coalesce(label, ''), row(NOT is_special, ex_date)) AS label FROM past GROUP BY as_of, symbol)",
    "up AS (SELECT as_of, symbol, count(*) AS upcoming FROM asks JOIN pays ON ex_date > as_of GROUP BY ALL)",
    """f AS (SELECT *, CAST(as_of - last AS BIGINT) AS days, coalesce(CASE modal WHEN 12 THEN 30.4::DOUBLE WHEN 4 THEN 91.3::DOUBLE WHEN 2 THEN 182.6::DOUBLE WHEN 1 THEN 365.2::DOUBLE END, 365.2::DOUBLE / modal, CASE label WHEN 'quarterly' THEN 91.3 WHEN 'semi-annual' THEN 182.6 END) AS expected
        FROM l1 LEFT JOIN y5 USING (as_of, symbol) LEFT JOIN e3 USING (as_of, symbol) LEFT JOIN up USING (as_of, symbol))""",
]

_HARVEST = harvest("quarter", 0.001)
_SIDE = """SELECT '{x}' AS path, round(10000 * arg_max({x}, date), 2) AS final_value, round((arg_max({x}, date) / arg_min({x}, date) - 1) * 100, 4) AS return_percent,
    round((pow(arg_max({x}, date) / arg_min({x}, date), 365.25::DOUBLE / (max(date) - min(date))) - 1) * 100, 4) AS cagr_percent, round(stddev_samp(r_{x}) * sqrt(252.0::DOUBLE) * 100, 4) AS volatility_percent,
    round((avg(r_{x}) * 252 - 0.045::DOUBLE) / (stddev_samp(r_{x}) * sqrt(252.0::DOUBLE)), 4) AS sharpe, round(min(f_{x}) * 100, 4) AS drawdown_percent,
    arg_min(p_{x}, row(f_{x}, date)) AS peak, arg_min(date, row(f_{x}, date)) AS trough FROM sides"""

_CODES = """codes(symbol, code) AS (SELECT symbol, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(symbol) + 1), lambda i: ascii(symbol[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) FROM facts)"""

_SOURCE = NUMBERED.replace("bars AS", "bars0 AS", 1).replace("FROM bars ", "FROM bars0 ").replace("numbered AS", "numbered0 AS", 1)
_CLEAN = f"""{_SOURCE}, {_DIRTY.replace("FROM numbered", "FROM numbered0").replace("WHERE date IS NOT NULL", "WHERE date <= DATE '1998-11-27'")}, {_MARKED},
    bars AS (SELECT symbol, date, pos, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, volume FROM marked WHERE ok AND date <> DATE '1998-11-27')"""
_THREE, _TWO = "('Morning Star', 'Evening Star', 'Three Black Crows')", "('Bullish Engulfing', 'Bearish Engulfing', 'Bullish Harami', 'Bearish Harami')"
_PATTERNS_CLEAN = (
    TECHNICAL["candlestick_patterns"].replace(BARS_SQL, _CLEAN, 1).replace(",\nd AS (SELECT *, ", f",\nd AS (SELECT *, {lag('pos', 1)} AS pos1, {lag('pos', 2)} AS pos2, ", 1)
    + f" AND (pattern NOT IN {_TWO} OR pos - pos1 = 1) AND (pattern NOT IN {_THREE} OR pos - pos2 = 2)"
)
_NAMES = "['Doji', 'Hammer', 'Hanging Man', 'Shooting Star', 'Bullish Engulfing', 'Bearish Engulfing', 'Bullish Harami', 'Bearish Harami', 'Morning Star', 'Evening Star', 'Three Black Crows']"

_CENTRED = "xx AS (SELECT symbol, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(x, z) AS xz, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM pairs GROUP BY symbol)"

ORACLES = {
    "payout_report": f"""WITH {BARS_SQL}, {_PAYS}, base AS ({PORTFOLIO["payout_bases"].replace(PAYS, _PAYS).replace(AS_OF, "2001-06-30")}),
        past AS (SELECT symbol, arg_max(currency, row(ex_date, amount)) FILTER (WHERE currency IS NOT NULL) AS paid_in, count(*) AS payments FROM pays WHERE ex_date <= DATE '2001-06-30' GROUP BY symbol),
        told AS (SELECT symbol, CASE WHEN symbol IN ('AF', 'NO', 'RF') THEN 'USD' END AS reported_in, CASE WHEN symbol IN ('AF', 'NO', 'RF') THEN 45.67::DOUBLE END AS provider_percent FROM base),
        fiscal AS (SELECT symbol, max(make_date(year(date), 12, 31)) FILTER (WHERE make_date(year(date), 12, 31) <= DATE '2001-06-30') AS stop FROM bars WHERE symbol IN ('AF', 'NF') GROUP BY symbol),
        k AS (SELECT *, coalesce(payments, 0) = 0 AS unpaid, coalesce(paid_in <> reported_in, false) AS mixed FROM base JOIN told USING (symbol) LEFT JOIN past USING (symbol) LEFT JOIN fiscal USING (symbol))
        SELECT symbol, CASE WHEN unpaid THEN 'no_history' WHEN mixed THEN 'not_meaningful' ELSE status END AS status, CASE WHEN unpaid THEN 'no dividend history' WHEN mixed THEN 'paid in ' || paid_in || ', reported in ' || reported_in END AS reason,
            CASE WHEN NOT unpaid AND NOT mixed THEN basis END AS basis, CASE WHEN NOT unpaid AND NOT mixed THEN payout_percent END AS payout_percent, CASE WHEN NOT unpaid AND NOT mixed THEN band END AS band,
            coalesce(DATE '2001-06-30' - stop > 548, false) AS stale, provider_percent FROM k""",
    "allocation_of_few_days": f"""WITH {BARS_SQL} SELECT greatest(count(*) - 1, 0) AS n, 0.0::DOUBLE AS log_growth, 0.0::DOUBLE AS cagr_percent, 0.0::DOUBLE AS volatility_percent, 0.0::DOUBLE AS sharpe, 0.0::DOUBLE AS max_drawdown_percent
        FROM (SELECT date FROM bars WHERE symbol IN ('AF', 'NO', 'RO') AND date BETWEEN DATE '1998-12-01' AND DATE '1998-12-20' GROUP BY date HAVING count(DISTINCT symbol) = 3) HAVING count(*) < 30""",
    "volatility_report": steps(
        f"lr AS (SELECT symbol, date, n, 100 * (ln(close) - ln({lag('close')})) AS r FROM numbered {W})",
        f"lq AS (SELECT symbol, n, r, {lag('r')} AS q FROM lr {W})",
        "pairs AS (SELECT symbol, r * r AS y, q * q AS x, CASE WHEN q < 0 THEN q * q ELSE 0 END AS z FROM lq WHERE q IS NOT NULL AND n >= 61)",
        _CENTRED,
        "co AS (SELECT *, xx * zz - xz * xz AS d, xy / xx AS ar1 FROM xx)",
        "cf AS (SELECT *, (zz * xy - xz * zy) / d AS b, (xx * zy - xz * xy) / d AS c FROM co)",
        "v AS (SELECT symbol, sum(pow((xx * (z - mz) - xz * (x - mx)) / d / n * (y - my - b * (x - mx) - c * (z - mz)), 2)) AS v FROM pairs JOIN cf USING (symbol) GROUP BY symbol)",
        f"""SELECT symbol, ljung_box, round(exp(-ljung_box / 2) * (1 + ljung_box / 2 + pow(ljung_box / 2, 2) / 2 + pow(ljung_box / 2, 3) / 6 + pow(ljung_box / 2, 4) / 24), 6) AS p_value, round(ar1, 6) AS ar1,
            round(CASE WHEN ar1 > 0 AND ar1 < 1 THEN ln(0.5) / ln(ar1) END, 4) AS half_life, round(c, 6) AS asymmetry, round(c / sqrt(v * n / (n - 3)), 4) AS asymmetry_t
        FROM cf JOIN v USING (symbol) JOIN (SELECT symbol, ljung_box FROM ({QUANT["acf_squared_returns"]}) WHERE lag = 10) USING (symbol)""",
    ),
    "patterns_of_clean_candles": _PATTERNS_CLEAN,
    "pattern_counts": f"""SELECT symbol, pattern, coalesce(n, 0) AS n, last FROM (SELECT symbol, unnest({_NAMES}) AS pattern FROM (SELECT DISTINCT l_returnflag || l_linestatus AS symbol FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-11-27'))
        LEFT JOIN (SELECT symbol, pattern, count(*) AS n, max(date) AS last FROM ({_PATTERNS_CLEAN}) GROUP BY symbol, pattern) USING (symbol, pattern)""",
    "fed_report": steps(
        _DIRTY,
        FUNDAMENTALS_SQL,
        _CODES,
        "y AS (SELECT date, close / 40 AS y FROM day_last WHERE symbol = 'AF' AND date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30')",
        "t AS (SELECT arg_max(y, date) FILTER (WHERE y > 0 AND y <= 20) AS now, max(date) FILTER (WHERE y > 0 AND y <= 20) AS newest, count_if(y > 0 AND y <= 20)::BIGINT AS n, min(y) FILTER (WHERE y > 0) AS low, max(y) AS high, avg(y) FILTER (WHERE y > 0 AND y <= 20) AS mean, count_if(NOT (y > 0 AND y <= 20))::BIGINT AS dropped FROM y)",
        "u AS (SELECT count_if(y > 0 AND y <= now) / count_if(y > 0) * 100 AS share FROM y CROSS JOIN t)",
        "p AS (SELECT symbol, pe, CASE WHEN code % 4 = 0 THEN 'bond' WHEN code % 4 = 1 THEN 'growth' ELSE 'equity' END AS tag, CASE WHEN code % 3 = 0 THEN 'us equity' WHEN code % 5 = 0 THEN 'gold trust' ELSE 'broad' END AS kind FROM facts JOIN codes USING (symbol))",
        "k AS (SELECT *, tag = 'bond' OR kind = 'gold trust' AS other, tag = 'equity' OR kind = 'us equity' AS eq FROM p)",
        "s AS (SELECT *, CASE WHEN other OR NOT eq THEN 'NOT_APPLICABLE' WHEN coalesce(pe > 0, false) THEN 'OK' ELSE 'UNAVAILABLE' END AS status FROM k CROSS JOIN t CROSS JOIN u)",
        """SELECT symbol, status, CASE WHEN other THEN 'not an equity fund' WHEN NOT eq THEN 'not known to be an equity fund' WHEN status <> 'OK' THEN 'no positive P/E' END AS reason, CASE WHEN status = 'OK' THEN round(100 / pe, 4) END AS earnings_yield,
            CASE WHEN status = 'OK' THEN round(now, 4) END AS treasury, CASE WHEN status = 'OK' THEN round(100 / pe - now, 4) END AS spread, CASE WHEN status = 'OK' THEN CASE WHEN 100 / pe - now > 0.25 THEN 'equities' WHEN 100 / pe - now < -0.25 THEN 'bonds' ELSE 'equal' END END AS more_attractive,
            CASE WHEN status = 'OK' THEN n END AS observations, CASE WHEN status = 'OK' THEN round(low, 4) END AS low, CASE WHEN status = 'OK' THEN round(high, 4) END AS high, CASE WHEN status = 'OK' THEN round(mean, 4) END AS mean, CASE WHEN status = 'OK' THEN round(share, 2) END AS share,
            CASE WHEN status = 'OK' THEN dropped END AS dropped, CASE WHEN status = 'OK' THEN CAST(DATE '2001-06-30' - newest AS INTEGER) END AS days_apart FROM s""",
    ),
    "graham_with_proxy": steps(
        FUNDAMENTALS_SQL.replace("facts AS", "facts0 AS", 1),
        EPS,
        "l AS (SELECT symbol, arg_max(eps, year) AS last_eps, max(year) AS last_year, arg_min(eps, year) AS f, count(*) AS k, max(year) - min(year) AS span FROM eps WHERE eps IS NOT NULL GROUP BY symbol)",
        "facts AS (SELECT f0.* REPLACE (coalesce(eps_now, last_eps) AS eps_now, coalesce(growth::DOUBLE, CASE WHEN k >= 3 AND f > 0 AND last_eps > 0 THEN (pow(last_eps / f, 1.0::DOUBLE / span) - 1) * 100 END) AS growth), CASE WHEN eps_now IS NOT NULL THEN 'trailing' WHEN last_eps IS NOT NULL THEN 'FY' || last_year END AS eps_basis, CASE WHEN growth IS NOT NULL THEN 'forward estimate' WHEN k >= 3 AND f > 0 AND last_eps > 0 THEN 'historical proxy' END AS growth_basis FROM facts0 f0 LEFT JOIN l USING (symbol))",
        "px AS (SELECT symbol, close FROM numbered WHERE is_last)",
        "a AS (SELECT *, least(growth, 15)::DOUBLE AS g FROM facts LEFT JOIN px USING (symbol))",
        "b AS (SELECT *, CASE WHEN eps_now > 0 AND g IS NOT NULL THEN eps_now * (8.5::DOUBLE + 2 * g) * (4.4::DOUBLE / 4.8::DOUBLE) END AS v, CASE WHEN eps_now > 0 AND g IS NOT NULL THEN eps_now * (8.5::DOUBLE + g) * (4.4::DOUBLE / 4.8::DOUBLE) END AS h, CASE WHEN eps_now > 0 THEN eps_now * 8.5::DOUBLE * (4.4::DOUBLE / 4.8::DOUBLE) END AS z FROM a)",
        """SELECT symbol, round(v, 6) AS value, round(h, 6) AS half_growth, round(z, 6) AS no_growth, round(v * 0.7::DOUBLE, 6) AS with_margin, round((v - close) / close * 100, 6) AS upside_percent, eps_basis, growth_basis,
        CASE WHEN eps_now IS NULL THEN 'no earnings' WHEN eps_now <= 0 THEN 'earnings not positive' WHEN growth IS NULL THEN 'no growth' WHEN close IS NULL THEN 'no price' END AS unavailable FROM b""",
        base=STOCK_NUMBERED,
    ),
    "index_components": """WITH m AS (SELECT r_name AS symbol, n_nationkey, upper(substr(n_name, 1, 3)) || '-' || (n_nationkey % 2) AS code, n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN 'Trade' END AS sector FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 8 <> 0)
        SELECT symbol, code, arg_min(name, n_nationkey) AS name, nullif(arg_min(coalesce(sector, ''), n_nationkey), '') AS sector, NULL::VARCHAR AS industry, 'US' AS exchange FROM m GROUP BY symbol, code""",
    "stream_first_write": f"WITH {BARS_SQL} SELECT symbol, date, open, high, low, close, CASE WHEN date >= DATE '2000-01-01' THEN round(close / 2, 6) ELSE adjusted_close END AS adjusted_close, volume FROM bars WHERE date < DATE '2000-01-01' OR day(date) <> 13",
    "factor_exposure": CALENDAR["factor_scores"].replace("SELECT symbol, round(max(month), 6)", """, s AS (SELECT symbol, round(max(month), 6)""", 1).replace("\n, s AS", ", s AS") + """),
        e AS (SELECT arg_max(tag, row(mean, -tagrank)) AS first_tag, arg_min(tag, row(mean, -tagrank)) AS last_tag FROM (SELECT *, row_number() OVER (ORDER BY tag) AS tagrank FROM t)),
        h AS (SELECT s.*, cume_dist() OVER (ORDER BY score) * 100 AS share, list_contains((SELECT list(tag) FROM tags g WHERE g.symbol = s.symbol), first_tag) AS up, list_contains((SELECT list(tag) FROM tags g WHERE g.symbol = s.symbol), last_tag) AS down FROM s CROSS JOIN e)
        SELECT symbol, month_percent, score, round(share, 2) AS share_at_or_below, round(30 + 70 * share / 100, 2) AS exposure_percent, CASE WHEN up THEN 'Maintain / Increase Exposure' WHEN down THEN 'Reduce Exposure' ELSE 'Neutral' END AS guidance FROM h""",
    "vt_comparison_from": f"""WITH {BARS_SQL}, p AS (SELECT date, max(CASE WHEN symbol = 'AF' THEN adjusted_close END) AS x, max(CASE WHEN symbol = 'NO' THEN adjusted_close END) AS y, max(CASE WHEN symbol = 'RF' THEN adjusted_close END) AS z FROM bars WHERE date >= DATE '1996-06-01' GROUP BY date),
        q AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)
        SELECT date, round(10000 * x / first_value(x) OVER (ORDER BY date), 6) AS single_value, round(10000 * 0.6::DOUBLE * y / first_value(y) OVER (ORDER BY date) + 10000 * 0.4::DOUBLE * z / first_value(z) OVER (ORDER BY date), 6) AS split_value FROM q""",
    "composite_counts": f"SELECT status AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM ({PORTFOLIO['composite_score']}) GROUP BY 1",
    "magic_formula_counts": f"SELECT coalesce(excluded, 'ranked') AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM ({PORTFOLIO['magic_formula']}) GROUP BY 1",
    "universes": f"""WITH {BARS_SQL}, m AS (SELECT DISTINCT r_name AS universe, ['AF', 'NO', 'RF', 'RO', 'ZZ'][n_nationkey % 5 + 1] AS symbol, n_nationkey % 7 <> 0 AS is_current FROM nation JOIN region ON r_regionkey = n_regionkey),
        l AS (SELECT symbol, max(date) AS last FROM bars GROUP BY symbol)
        SELECT universe, count(*) AS members, count_if(is_current)::BIGINT AS current, count_if(is_current AND last IS NOT NULL)::BIGINT AS with_bars, max(last) FILTER (WHERE is_current) AS last FROM m LEFT JOIN l USING (symbol) GROUP BY universe""",
    "bars_from_json": steps(
        _DIRTY,
        """SELECT symbol, count(*) AS received, count_if(date IS NULL OR close <= 0)::BIGINT AS refused, count_if(date IS NOT NULL AND close > 0)::BIGINT AS kept, count_if(date IS NOT NULL AND close > 0 AND coalesce(adjusted_close, close) = close)::BIGINT AS stand_in,
            CAST(sum(volume) FILTER (WHERE date IS NOT NULL AND close > 0) AS BIGINT) AS volume, max(close) FILTER (WHERE date IS NOT NULL AND close > 0) AS highest FROM dirty GROUP BY symbol""",
    ),
    "dividends_from_json": f"""WITH {BARS_SQL}, {_PAYS} SELECT symbol, ex_date, round(amount, 6) AS amount, CASE WHEN is_special THEN 'Special cash' WHEN label = 'semi-annual' THEN 'Semi-Annual' WHEN label = 'quarterly' THEN 'Quarterly' END AS period, currency, is_special
        FROM pays WHERE day(ex_date) <> 28""",
    "sma_ordering": steps(
        "s AS (SELECT symbol, date, i, is_last, close AS \"Close\", " + ", ".join(f'{sma("close", n)} AS "SMA{n}"' for n in (10, 25, 50)) + " FROM numbered)",
        "o AS (SELECT symbol, date, list_sort([{'v': -\"Close\", 'k': 0, 'name': 'Close'}, {'v': -\"SMA10\", 'k': 1, 'name': 'SMA10'}, {'v': -\"SMA25\", 'k': 2, 'name': 'SMA25'}, {'v': -\"SMA50\", 'k': 3, 'name': 'SMA50'}]) AS x FROM s WHERE is_last AND i >= 50)",
        "SELECT symbol, date, x[1].name || " + " || ".join(f"CASE WHEN abs(x[{k}].v - x[{k - 1}].v) <= 1e-12 THEN ' = ' ELSE ' > ' END || x[{k}].name" for k in (2, 3, 4)) + " AS ordering, " + " OR ".join(f"abs(x[{k}].v - x[{k - 1}].v) <= 1e-12" for k in (2, 3, 4)) + " AS has_ties FROM o",
    ),
    "crash_evaluation": QUANT["crash_validation"].split("d AS (SELECT *, sum")[0] + """b2 AS (SELECT symbol, segment, i, label, breach, 'warning' AS rule, warn FROM b WHERE segment IS NOT NULL UNION ALL SELECT symbol, segment, i, label, breach, 'baseline', below_sma200 FROM b WHERE segment IS NOT NULL),
        d AS (SELECT *, sum(CASE WHEN label THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, segment, rule ORDER BY i) AS run FROM b2),
        e AS (SELECT symbol, segment, rule, run, bool_or(warn) AS hit, arg_min(breach, i) FILTER (WHERE warn) AS ld FROM d WHERE label GROUP BY ALL),
        f AS (SELECT symbol, segment, rule, count(*) AS episodes, count_if(hit)::BIGINT AS detected, median(ld) FILTER (WHERE hit) AS median_lead FROM e GROUP BY ALL),
        g AS (SELECT symbol, segment, rule, count(*) AS bars, count_if(warn AND label)::BIGINT AS tp, count_if(warn AND NOT label)::BIGINT AS fp, count_if(NOT warn AND label)::BIGINT AS fn, count_if(NOT warn AND NOT label)::BIGINT AS tn FROM d GROUP BY ALL),
        h AS (SELECT g.*, coalesce(episodes, 0) AS episodes, coalesce(detected, 0) AS detected, median_lead, round((tp + fn)::DOUBLE / bars * 100, 1) AS base_rate_percent, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp) * 100, 1) END AS precision_percent,
            CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn) * 100, 1) END AS recall_percent, CASE WHEN fp + tn > 0 THEN round(fp::DOUBLE / (fp + tn) * 100, 1) END AS false_rate_percent FROM g LEFT JOIN f USING (symbol, segment, rule))
        SELECT *, episodes - detected AS missed, CASE WHEN base_rate_percent > 0 THEN round(precision_percent / base_rate_percent, 2) END AS lift, segment = 'test' AND episodes < 5 AS too_few_episodes FROM h""",
    "harvest_comparison": "WITH " + ",\n".join(_HARVEST) + ",\nsides AS (SELECT *, " + ", ".join(f"{x} / lag({x}) OVER (ORDER BY date) - 1 AS r_{x}, {x} / max({x}) OVER (ORDER BY date) - 1 AS f_{x}, arg_max(date, {x}) OVER (ORDER BY date) AS p_{x}" for x in ("rebalanced", "held")) + " FROM h),"
    + f"a AS ({_SIDE.format(x='rebalanced')}), b AS ({_SIDE.format(x='held')}), " + """
        d AS (SELECT 'difference' AS path, round(a.final_value - b.final_value, 2) AS final_value, round(a.return_percent - b.return_percent, 4) AS return_percent, round(a.cagr_percent - b.cagr_percent, 4) AS cagr_percent,
            round(a.volatility_percent - b.volatility_percent, 4) AS volatility_percent, round(a.sharpe - b.sharpe, 4) AS sharpe, round(a.drawdown_percent - b.drawdown_percent, 4) AS drawdown_percent, NULL::DATE AS peak, NULL::DATE AS trough FROM a CROSS JOIN b)
        SELECT *, CASE WHEN path = 'difference' THEN CASE WHEN abs(return_percent) < 0.005 THEN 'No material difference' WHEN return_percent > 0 THEN 'Rebalanced ahead' ELSE 'Buy-and-hold ahead' END END AS direction FROM (FROM a UNION ALL FROM b UNION ALL FROM d)""",
    "dividend_cut_status": f"WITH {BARS_SQL},\n{_PAYS},\n{_DAYS},\n" + ",\n".join(_CUT) + """
        SELECT CAST(as_of AS VARCHAR) AS as_of, symbol, CASE WHEN coalesce(confirmed_events, 0) > 0 OR coalesce(alike, false) THEN 'observed' WHEN coalesce(recent_events, 0) > 0 OR coalesce(fell, false) THEN 'possible' ELSE 'none' END AS cut_status,
            coalesce(cut_events, 0) AS cut_events, coalesce(recent_events, 0) AS recent_events, coalesce(confirmed_events, 0) AS confirmed_events, coalesce(fell, false) AS annual_decline, CASE WHEN coalesce(reg, false) THEN 'Regular' ELSE 'Irregular' END AS regularity,
            coalesce(excluded, 0) AS excluded_changes, CASE WHEN upcoming > 0 THEN 'none' WHEN days > greatest(2 * expected, expected + 90) THEN 'possible_suspension' WHEN days > 1.35::DOUBLE * expected + 15 THEN 'possible_delay'
            WHEN expected IS NULL AND days > 730 THEN 'possible_suspension' ELSE 'none' END AS suspension, days AS days_since, round(expected, 6) AS expected_days FROM f""",
    "fund_ranking": f"""WITH {STOCK_NUMBERED}, {PRICES}, s AS (SELECT p_brand AS symbol, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand),
        inputs AS (SELECT symbol, close, high, low, sma200, CASE WHEN s % 5 <> 0 THEN s % 60 / 100.0::DOUBLE END AS eg, CASE WHEN s % 7 <> 0 THEN s % 45 / 100.0::DOUBLE END AS rg, CASE WHEN s % 4 <> 0 THEN s % 33 / 100.0::DOUBLE END AS roe,
            CASE WHEN s % 6 <> 0 THEN s % 100 * 10000000 END AS fl, CASE WHEN s % 9 <> 0 THEN s % 100 / 100.0::DOUBLE END AS inst FROM price JOIN s USING (symbol)),
        flags AS (SELECT *, eg >= 0.25::DOUBLE AS c_pass, CASE WHEN rg IS NOT NULL AND roe IS NOT NULL THEN rg >= 0.2::DOUBLE AND roe >= 0.17::DOUBLE END AS a_pass, close / high >= 0.85::DOUBLE AS n_pass, fl < 500000000 AS s_pass, (close - low) / low * 100 >= 30 AS l_pass,
            inst BETWEEN 0.3::DOUBLE AND 0.85::DOUBLE AS i_pass, close > sma200 AS m_pass FROM inputs),
        sums AS (SELECT *, CAST(len(list_filter([c_pass, a_pass, n_pass, s_pass, l_pass, i_pass, m_pass], lambda x: x)) AS BIGINT) AS score, CAST(len(list_filter([c_pass, a_pass, n_pass, s_pass, l_pass, i_pass, m_pass], lambda x: x IS NOT NULL)) AS BIGINT) AS evaluated FROM flags)
        SELECT m.symbol, c_pass, a_pass, n_pass, s_pass, l_pass, i_pass, m_pass, score, evaluated,
            CASE WHEN score IS NOT NULL THEN concat_ws(',', CASE WHEN c_pass IS NULL THEN 'c' END, CASE WHEN a_pass IS NULL THEN 'a' END, CASE WHEN n_pass IS NULL THEN 'n' END, CASE WHEN s_pass IS NULL THEN 's' END, CASE WHEN l_pass IS NULL THEN 'l' END, CASE WHEN i_pass IS NULL THEN 'i' END, CASE WHEN m_pass IS NULL THEN 'm' END) END AS unavailable,
            score >= 5 AS meets_minimum, round(close / high, 6) AS to_high, round((close - low) / low * 100, 6) AS from_low_percent, CASE WHEN score IS NOT NULL THEN row_number() OVER (ORDER BY score DESC NULLS LAST, m.symbol) END AS rank, CASE WHEN score IS NULL THEN 'UNAVAILABLE' ELSE 'OK' END AS status
        FROM (SELECT DISTINCT p_brand AS symbol FROM part UNION ALL SELECT 'Nobody') m LEFT JOIN sums USING (symbol)""",
    "simulation_windows": f"""WITH {BARS_SQL}, asks(ask, symbol, other, a, z) AS (VALUES (0, 'NO', 'AF', DATE '1994-01-01', DATE '1996-12-31'), (1, 'NO', 'AF', DATE '1990-01-01', DATE '2010-01-01'), (2, 'NO', 'NO', DATE '1995-01-01', DATE '1995-01-15'), (3, 'RF', 'ZZ', NULL, DATE '1995-12-31')),
        w AS (SELECT ask, k.symbol, other, a, z, date, adjusted_close AS p, (SELECT arg_max(o.adjusted_close, o.date) FROM bars o WHERE o.symbol = other AND o.date <= b.date) AS q FROM asks k JOIN bars b ON b.symbol = k.symbol AND (a IS NULL OR date >= a) AND date <= z),
        g AS (SELECT ask, symbol, other, a, z, count(*) AS days, min(date) AS first, max(date) AS last, arg_min(p, date) AS p0, arg_max(p, date) AS p1, arg_min(coalesce(q, 0), date) AS b0, arg_max(coalesce(q, 0), date) AS b1 FROM w GROUP BY ALL),
        h AS (SELECT *, floor(9999.0::DOUBLE / (p0 * 1.001::DOUBLE)) AS ps, CASE WHEN b0 > 0 THEN floor(9999.0::DOUBLE / (b0 * 1.001::DOUBLE)) END AS bs, days >= 20 AS ok FROM g)
        SELECT ask, symbol, CASE WHEN ok THEN 'OK' ELSE 'UNAVAILABLE' END AS status, CASE WHEN NOT ok THEN days || ' days in the window, 20 are needed' END AS reason, days, first, last,
            CASE WHEN ok THEN round(10000 - (ps * p0 * 1.001::DOUBLE + 1) + ps * p1, 4) END AS hold_final, CASE WHEN ok AND b0 > 0 THEN round(10000 - (bs * b0 * 1.001::DOUBLE + 1) + bs * b1, 4) END AS benchmark_final,
            CASE WHEN ok THEN concat_ws('; ', CASE WHEN a < first THEN 'starts at the first price' END, CASE WHEN z > last THEN 'ends at the last price' END, CASE WHEN last - first < 365.25 THEN 'shorter than a year' END,
                CASE WHEN NOT EXISTS (FROM bars o WHERE o.symbol = other) THEN 'benchmark has no prices' WHEN b0 = 0 THEN 'benchmark starts later' END) END AS notes FROM h""",
    "clean_prices": steps(
        _DIRTY,
        "p AS (SELECT symbol, date, CASE WHEN adjusted_close IS NULL OR adjusted_close = 0 THEN close ELSE adjusted_close END AS price, close, volume FROM day_last)",
        "SELECT * FROM p WHERE price > 0",
    ),
    "clean_basis": steps(
        _DIRTY,
        "SELECT symbol, date, arg_max(adjusted_close, arrival) AS price FROM dirty WHERE adjusted_close > 0 AND date IS NOT NULL GROUP BY symbol, date",
    ),
    "clean_candles": steps(_DIRTY, _MARKED, "SELECT symbol, date, pos, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, volume FROM marked WHERE ok"),
    "candle_report": steps(
        _DIRTY,
        _MARKED,
        "s AS (SELECT symbol, count(*) AS source_rows, count(*) FILTER (WHERE date IS NULL) AS without_date, count(date) - count(DISTINCT date) AS repeated_dates FROM dirty GROUP BY symbol)",
        "b AS (SELECT symbol, count(*) AS invalid, array_to_string(list_slice(list(date::VARCHAR ORDER BY date), 1, 5), ',') AS invalid_dates FROM marked WHERE NOT ok GROUP BY symbol)",
        "SELECT symbol, source_rows, without_date, repeated_dates, coalesce(invalid, 0) AS invalid, coalesce(invalid_dates, '') AS invalid_dates FROM s LEFT JOIN b USING (symbol)",
    ),
    "clean_yields": steps(
        _DIRTY,
        "y AS (SELECT symbol || '.' || n AS symbol, date, close / x AS y FROM day_last CROSS JOIN (VALUES ('low', 40.0::DOUBLE), ('edge', 10.0::DOUBLE), ('high', 8.0::DOUBLE)) t(n, x) WHERE symbol IN ('AF', 'NO'))",
        "g AS (SELECT symbol, count(*) AS observations, count(*) FILTER (WHERE NOT (y > 0 AND y <= 20)) AS dropped, max(date) FILTER (WHERE y > 0 AND y <= 20) AS last FROM y GROUP BY symbol)",
        """SELECT symbol, observations, dropped, CASE WHEN bad THEN 'UNAVAILABLE' ELSE 'OK' END AS status,
            CASE WHEN observations = dropped THEN 'no valid observations' WHEN bad THEN dropped || ' of ' || observations || ' observations out of range' END AS reason,
            CASE WHEN NOT bad THEN observations - dropped END AS kept, CASE WHEN NOT bad THEN last END AS last
        FROM (SELECT *, observations = dropped OR dropped / observations > 0.2 AS bad FROM g)""",
    ),
    "date_window": f"WITH {BARS_SQL} SELECT * FROM bars WHERE date BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'",
    "bars_ranges": f"""WITH {BARS_SQL},
        w AS (SELECT n_name, ['AF', 'NO', 'RF'][n_nationkey % 3 + 1] AS symbol, make_date(1993 + n_nationkey % 3, 9, 1 + n_nationkey) AS start FROM nation WHERE n_nationkey < 6)
        SELECT n_name, symbol, date, close, volume FROM w JOIN bars USING (symbol) WHERE date BETWEEN start AND start + 200""",
    "chart_tails": steps(f"SELECT symbol, date, close, {r6('ema8', 'ema21', 'ema50', 'rsi', 'atr', 'macd', 'signal', 'hist')} FROM ind WHERE n - i < 180", base=f"{NUMBERED}, {INDICATORS}", recursive=True),
    "keyed_trend": TECHNICAL["sma_trend"],
    "model_outcomes": steps(
        "b AS (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE symbol = 'NO' AND i % 100 = 0) AS bad FROM numbered WHERE symbol <> 'RF' OR i <= 90 GROUP BY symbol UNION ALL SELECT 'ZZ', 0, 0)",
        "g(model, gate) AS (VALUES ('hmm', 120), ('garch', 251))",
        """SELECT model, symbol, CASE WHEN n < gate OR bad > 0 THEN 'UNAVAILABLE' ELSE 'OK' END AS status,
            CASE WHEN n = 0 THEN 'no bars' WHEN n < gate THEN gate || ' bars are needed, there are ' || n WHEN bad > 0 THEN bad || ' closes are no positive numbers' END AS reason FROM b CROSS JOIN g""",
    ),
    "soc_avalanche": QUANT["soc_avalanche"].replace(NUMBERED, f"{BARS_SQL}, {_DRIFT}, numbered AS (SELECT * FROM steps_of)"),
}
