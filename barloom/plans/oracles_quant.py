"""DuckDB SQL for the statistical queries."""

from __future__ import annotations

from barloom.operators.quant import ricker
from barloom.plans.oracles_technical import INDICATORS, W, _w, lag, roll, sma, steps

_LOG = f"lr AS (SELECT *, ln(close) - ln({lag('close')}) AS r FROM numbered {W})"
_LR = "l AS (SELECT *, r * r AS r2 FROM lr WHERE r IS NOT NULL)"
_USABLE = "sma200 IS NOT NULL AND signal IS NOT NULL AND rsi IS NOT NULL"
_FLAGS = {
    "below_sma200": "close < sma200",
    "death_cross": "sma50 < sma200",
    "macd_down": "hist < 0 AND crossed",
    "fading": "hist < h1 AND h1 < h2 AND h2 < h3",
    "divergence": "new.close > old.close AND new.rsi < old.rsi",
}
_AROUND = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
CRASH = [
    INDICATORS,
    f"c1 AS (SELECT *, {sma('close', 50)} AS sma50, {sma('close', 200)} AS sma200, {lag('hist')} AS h1, {lag('hist', 2)} AS h2, {lag('hist', 3)} AS h3 FROM ind {W})",
    "c2 AS (SELECT *, CASE WHEN hist < 0 AND h1 >= 0 THEN 1 ELSE 0 END AS cr FROM c1)",
    f"c3 AS (SELECT *, max(cr) OVER {_w(10)} = 1 AS crossed, CASE WHEN close = max(close) OVER {_AROUND} AND count(close) OVER {_AROUND} = 11 AND rsi IS NOT NULL THEN {{'i': i, 'close': close, 'rsi': rsi}} END AS swing, CASE WHEN count(close) OVER {_w(252)} >= 60 THEN max(close) OVER {_w(252)} END AS high252 FROM c2)",
    "c3b AS (SELECT *, list_filter(list(swing) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND 5 PRECEDING), lambda x: x IS NOT NULL) AS swings FROM c3)",
    "c3d AS (SELECT *, swings[-1] AS new, list_filter(swings, lambda x: swings[-1].i - x.i >= 5)[-1] AS old FROM c3b)",
    "c4 AS (SELECT *, " + ", ".join(f"coalesce({_USABLE} AND {rule}, false) AS {name}" for name, rule in _FLAGS.items()) + f", {_USABLE} AS usable FROM c3d)",
    "crash AS (SELECT *, CAST(" + " + ".join(f"{x}::BIGINT" for x in _FLAGS) + " AS BIGINT) AS flags, (close / high252 - 1) * 100 AS drawdown FROM c4)",
]


def _wave(s: int) -> str:
    kernel = ricker(s)
    terms = " + ".join(f"({x!r})::DOUBLE * lag(r, {k}) OVER w" if k else f"({x!r})::DOUBLE * r" for k, x in enumerate(kernel))
    return f"CASE WHEN count(r) OVER {_w(len(kernel))} = {len(kernel)} THEN {terms} END / {roll('stddev_samp', 'r', len(kernel))} AS f{s}"


_AHEAD = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"

ORACLES = {
    "evar_risk": steps(
        _LOG,
        f"a AS (SELECT *, count(r) OVER {_w(252)} AS k, kurtosis(r) OVER {_w(252)} AS kt, stddev_samp(r) OVER {_w(252)} AS sd, avg(r) OVER {_w(252)} AS mu FROM lr)",
        "b AS (SELECT *, CASE WHEN k >= 60 THEN least(1 + greatest(kt, 0) / (greatest(kt, 0) + 3), 1.8::DOUBLE) END AS q FROM a)",
        "d AS (SELECT *, CASE WHEN k >= 60 THEN greatest(0, (1.645::DOUBLE * (1 + 1.5::DOUBLE * (q - 1)) * sd - mu) * 100) END AS evar FROM b)",
        f"e AS (SELECT *, list(evar) OVER {_w(120)} AS raw FROM d)",
        "f AS (SELECT *, list_filter(raw, lambda x: x IS NOT NULL) AS seen FROM e WHERE is_last AND i >= 180)",
        "g AS (SELECT *, (len(list_filter(seen, lambda x: x < evar)) + (len(list_filter(seen, lambda x: x = evar)) + 1) / 2.0::DOUBLE) / 120 * 100 AS rank FROM f WHERE len(seen) = 120)",
        """SELECT symbol, date, round(evar, 6) AS evar_percent, round(q, 6) AS tsallis_q, round(rank, 6) AS percentile,
        CASE WHEN rank < 33 THEN 'Low' WHEN rank < 66 THEN 'Moderate' WHEN rank < 85 THEN 'Elevated' ELSE 'High' END AS level,
        CASE WHEN rank < 33 THEN 'Calm' WHEN rank < 66 THEN 'Normal' WHEN rank < 85 THEN 'Elevated' ELSE 'Stressed' END AS regime,
        round(greatest(20.0::DOUBLE, least(100.0::DOUBLE, 100 - 0.8::DOUBLE * rank)), 6) AS exposure FROM g""",
    ),
    "momentum_reversal": steps(
        f"a AS (SELECT *, close / {lag('close')} - 1 AS r FROM numbered {W})",
        "b AS (SELECT *, CASE WHEN r < -0.001 THEN 'Long' WHEN r > 0.001 THEN 'Short' END AS s FROM a)",
        f"d AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER w, 'Flat') AS position FROM b {W})",
        f"e AS (SELECT *, {lag('position')} AS p FROM d {W})",
        "SELECT symbol, date, round(r * 100, 6) AS return_percent, CASE s WHEN 'Long' THEN 'Bullish Reversal' WHEN 'Short' THEN 'Bearish Reversal' ELSE 'No Signal' END AS signal, position, position <> p AS changed_today FROM e WHERE is_last AND i >= 15",
    ),
    "avalanches": steps(
        f"a AS (SELECT *, (1 - close / max(close) OVER w) * 100 AS fall FROM numbered {W})",
        f"b AS (SELECT *, sum(CASE WHEN fall = 0 THEN 1 ELSE 0 END) OVER w AS run FROM a {W})",
        "SELECT symbol, min(date) AS start, round(max(fall), 6) AS size FROM b WHERE fall > 0 GROUP BY symbol, run",
    ),
    "soc_avalanche": steps(
        f"a AS (SELECT *, (1 - close / max(close) OVER w) * 100 AS fall FROM numbered {W})",
        f"b AS (SELECT *, sum(CASE WHEN fall = 0 THEN 1 ELSE 0 END) OVER w AS run FROM a {W})",
        "s AS (SELECT symbol, log10(max(fall)) AS x FROM b WHERE fall > 0 GROUP BY symbol, run)",
        "e AS (SELECT symbol, min(x) AS lo, max(x) AS hi, count(*) AS n FROM s GROUP BY symbol HAVING count(*) >= 15 AND max(x) > min(x))",
        "k AS (SELECT symbol, least(CAST(floor((x - lo) / ((hi - lo) / 12)) AS BIGINT), 11) AS bin, lo, hi, n, count(*) AS k FROM s JOIN e USING (symbol) GROUP BY ALL)",
        "p AS (SELECT *, pow(10.0::DOUBLE, lo + bin * ((hi - lo) / 12)) AS l, pow(10.0::DOUBLE, lo + (bin + 1) * ((hi - lo) / 12)) AS h FROM k)",
        "g AS (SELECT symbol, n, count(*) AS bins, regr_slope(log10(k / (h - l)), (log10(l) + log10(h)) / 2) AS slope, regr_r2(log10(k / (h - l)), (log10(l) + log10(h)) / 2) AS r2 FROM p GROUP BY symbol, n HAVING count(*) >= 3)",
        "SELECT symbol, n AS avalanches, bins, round(-slope, 6) AS alpha, round(r2, 6) AS r_squared, CASE WHEN -slope >= 2.8 THEN 'Gaussian' WHEN -slope >= 1.8 THEN 'Transitional' WHEN -slope >= 1.0 THEN 'Critical' ELSE 'Super-critical' END AS regime, round(dd, 6) AS drawdown_percent FROM g JOIN (SELECT symbol, (arg_max(close, date) / max(close) - 1) * 100 AS dd FROM numbered GROUP BY symbol HAVING count(close) >= 300) USING (symbol)",
    ),
    "wavelet_trend": steps(
        _LOG,
        f"b AS (SELECT *, {', '.join(_wave(s) for s in (5, 10, 20))} FROM lr {W})",
        """SELECT symbol, date, round(f5, 6) AS filter5, round(f10, 6) AS filter10, round(f20, 6) AS filter20,
        CASE WHEN f5 > 0 AND f10 > 0 AND f20 > 0 THEN 'Strong Uptrend' WHEN f5 <= 0 AND f10 <= 0 AND f20 <= 0 THEN 'Strong Downtrend' WHEN f10 > 0 THEN 'Uptrend (Mixed Confirmation)' WHEN f10 < 0 THEN 'Downtrend (Mixed Confirmation)' ELSE 'Transitional / Mixed' END AS state FROM b WHERE is_last AND i >= 90""",
    ),
    "crash_warning": steps(
        *CRASH,
        f"""SELECT symbol, date, {', '.join(_FLAGS)}, flags, CASE WHEN flags <= 1 THEN 'Low' WHEN flags <= 3 THEN 'Elevated' ELSE 'High' END AS level,
        flags >= 3 AS warning, round(drawdown, 6) AS drawdown_percent FROM crash WHERE is_last AND i >= 260""",
        recursive=True,
    ),
    "crash_validation": steps(
        *CRASH,
        f"a0 AS (SELECT *, coalesce({', '.join(f'CASE WHEN lead(close, {k}) OVER w <= close * 0.9::DOUBLE THEN {k} END' for k in range(1, 21))}) AS breach FROM crash {W})",
        "a1 AS (SELECT *, breach IS NOT NULL AS label, flags >= 3 AS warn, CASE WHEN usable AND i + 20 <= n THEN i END AS fit FROM a0)",
        "a2 AS (SELECT *, min(fit) OVER (PARTITION BY symbol) AS a, max(fit) OVER (PARTITION BY symbol) AS z, count(fit) OVER (PARTITION BY symbol) AS fits FROM a1)",
        "a3 AS (SELECT *, a + floor((z - a + 1) * 0.6) AS cut FROM a2 WHERE fits >= 100 AND i BETWEEN a AND z)",
        "b AS (SELECT *, CASE WHEN i < greatest(a + 1, cut - 20) THEN 'train' WHEN i >= cut THEN 'test' END AS segment FROM a3)",
        "d AS (SELECT *, sum(CASE WHEN label THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, segment ORDER BY i) AS run FROM b WHERE segment IS NOT NULL)",
        "e AS (SELECT symbol, segment, run, bool_or(warn) AS hit, arg_min(breach, i) FILTER (WHERE warn) AS ld FROM d WHERE label GROUP BY ALL)",
        "f AS (SELECT symbol, segment, count(*) AS episodes, count_if(hit)::BIGINT AS detected, median(ld) FILTER (WHERE hit) AS median_lead FROM e GROUP BY ALL)",
        """g AS (SELECT symbol, segment, count_if(warn AND label)::BIGINT AS tp, count_if(warn AND NOT label)::BIGINT AS fp, count_if(NOT warn AND label)::BIGINT AS fn, count_if(NOT warn AND NOT label)::BIGINT AS tn,
            count_if(below_sma200 AND label)::BIGINT AS base_tp, count_if(below_sma200 AND NOT label)::BIGINT AS base_fp FROM d GROUP BY ALL)""",
        """SELECT g.*, coalesce(episodes, 0) AS episodes, coalesce(detected, 0) AS detected, median_lead, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) END AS recall,
        CASE WHEN fp + tn > 0 THEN round(fp::DOUBLE / (fp + tn), 6) END AS false_rate, CASE WHEN base_tp + base_fp > 0 THEN round(base_tp::DOUBLE / (base_tp + base_fp), 6) END AS base_precision FROM g LEFT JOIN f USING (symbol, segment)""",
        recursive=True,
    ),
    "acf_squared_returns": steps(
        _LOG, _LR,
        "m AS (SELECT *, r2 - avg(r2) OVER (PARTITION BY symbol) AS m FROM l)",
        f"p AS (SELECT symbol, k AS lag, m, lag(m, k::INTEGER) OVER (PARTITION BY symbol, k ORDER BY date) AS mk FROM m CROSS JOIN range(1, 11) t(k))",
        "g AS (SELECT symbol, lag, count(*) AS n, sum(m * mk) / sum(m * m) AS acf FROM p GROUP BY symbol, lag)",
        "SELECT symbol, lag, round(acf, 6) AS acf, round(n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY symbol ORDER BY lag), 4) AS ljung_box FROM g",
    ),
    "shock_asymmetry": steps(
        _LOG, _LR,
        f"""a AS (SELECT *, stddev_samp(r) OVER (PARTITION BY symbol) AS lim, lead(r2) OVER w AS nxt,
            CASE WHEN count(r2) OVER {_AHEAD.format(n=5)} = 5 THEN avg(r2) OVER {_AHEAD.format(n=5)} END AS ahead FROM l {W})""",
        "b AS (SELECT *, CASE WHEN r < -lim THEN 'negative' WHEN r > lim THEN 'positive' ELSE 'quiet' END AS kind FROM a)",
        """SELECT symbol, kind, count(*) AS n, round(avg(r) * 100, 6) AS mean_percent, round(sqrt(avg(nxt) * 252) * 100, 6) AS next_vol,
        round(sqrt(avg(ahead) * 252) * 100, 6) AS forward_vol, count(*) >= 10 AS sufficient FROM b GROUP BY symbol, kind""",
    ),
    "leverage_correlations": steps(
        _LOG, _LR, "a AS (SELECT *, " + ", ".join(f"lead(r2, {k}) OVER w AS a{k}" for k in range(1, 6)) + f" FROM l {W})",
        "SELECT symbol, " + ", ".join(f"round(corr(r, a{k}), 6) AS corr{k}" for k in range(1, 6)) + " FROM a GROUP BY symbol",
    ),
    "volatility_rank": steps(
        _LOG, f"a AS (SELECT symbol, date, {roll('stddev_samp', 'r', 21)} * sqrt(252.0) * 100 AS vol FROM lr)",
        "b AS (SELECT *, arg_max(vol, date) OVER (PARTITION BY symbol) AS now FROM a WHERE vol IS NOT NULL)",
        "SELECT symbol, round(max(now), 6) AS volatility_percent, round(count_if(vol <= now)::DOUBLE / count(*), 6) AS share_below FROM b GROUP BY symbol",
    ),
    "linear_channel": steps(
        f"SELECT symbol, date, round(CASE WHEN count(close) OVER {_w(20)} = 20 THEN regr_intercept(close, i) OVER {_w(20)} + regr_slope(close, i) OVER {_w(20)} * i END, 6) AS fitted FROM numbered"
    ),
}
