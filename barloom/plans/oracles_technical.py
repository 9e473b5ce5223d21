"""DuckDB SQL for the technical queries."""

from __future__ import annotations

from barloom.sources.bars import BARS_SQL

_LAST = "lead(date) OVER w IS NULL"


def _w(n: int, shift: int = 0, by: str = "") -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift or 'CURRENT'} {'PRECEDING' if shift else 'ROW'})"


def roll(agg: str, x: str, n: int, shift: int = 0) -> str:
    over = _w(n, shift)
    return f"CASE WHEN count({x}) OVER {over} = {n} THEN {agg}({x}) OVER {over} END"


def sma(x: str, n: int, shift: int = 0) -> str:
    return roll("avg", x, n, shift)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER w"


W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"
#: numbered: bars with i and is_last
NUMBERED = f"{BARS_SQL}, numbered AS (SELECT *, row_number() OVER w AS i, {_LAST} AS is_last, count(*) OVER (PARTITION BY symbol) AS n FROM bars {W})"


def steps(*parts: str, base: str = NUMBERED, recursive: bool = False) -> str:
    """``WITH`` the base and the named parts before the last, which selects."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([base, *parts[:-1]]) + "\n" + parts[-1]


def r6(*names: str) -> str:
    return ", ".join(f"round({x}, 6) AS {x}" for x in names)


#: One walk over each symbol's bars that carries all exponential means.
INDICATORS = f"""tr AS (SELECT *, {lag("close")} AS before,
        greatest(abs(high - low), abs(high - {lag("close")}), abs(low - {lag("close")})) AS range FROM numbered {W}),
    walk AS (
        SELECT symbol, i, close AS e8, close AS e12, close AS e21, close AS e26, close AS e50, range AS a14,
            CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down, CAST(NULL AS DOUBLE) AS sig FROM tr WHERE i = 1
        UNION ALL
        SELECT t.symbol, t.i, s.e8 + 2 / 9.0::DOUBLE * (t.close - s.e8), s.e12 + 2 / 13.0::DOUBLE * (t.close - s.e12), s.e21 + 2 / 22.0::DOUBLE * (t.close - s.e21),
            s.e26 + 2 / 27.0::DOUBLE * (t.close - s.e26), s.e50 + 2 / 51.0::DOUBLE * (t.close - s.e50), s.a14 + (t.range - s.a14) / 14,
            CASE WHEN s.up IS NULL THEN greatest(t.close - t.before, 0) ELSE s.up + (greatest(t.close - t.before, 0) - s.up) / 14 END,
            CASE WHEN s.down IS NULL THEN greatest(t.before - t.close, 0) ELSE s.down + (greatest(t.before - t.close, 0) - s.down) / 14 END,
            CASE WHEN t.i < 26 THEN NULL
                WHEN t.i = 26 THEN s.e12 + 2 / 13.0::DOUBLE * (t.close - s.e12) - (s.e26 + 2 / 27.0::DOUBLE * (t.close - s.e26))
                ELSE s.sig + 0.2::DOUBLE * (s.e12 + 2 / 13.0::DOUBLE * (t.close - s.e12) - (s.e26 + 2 / 27.0::DOUBLE * (t.close - s.e26)) - s.sig) END
        FROM walk s JOIN tr t ON t.symbol = s.symbol AND t.i = s.i + 1),
    ind AS (SELECT t.* EXCLUDE (range), CASE WHEN i >= 8 THEN e8 END AS ema8, CASE WHEN i >= 21 THEN e21 END AS ema21,
        CASE WHEN i >= 50 THEN e50 END AS ema50, CASE WHEN i >= 14 THEN a14 END AS atr, CASE WHEN i >= 26 THEN e12 - e26 END AS macd,
        CASE WHEN i >= 34 THEN sig END AS signal, CASE WHEN i >= 34 THEN e12 - e26 - sig END AS hist,
        CASE WHEN i < 15 THEN NULL WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi
        FROM tr t JOIN walk USING (symbol, i))"""


def _supertrend(n: int, k: float) -> str:
    return f"""tr AS (SELECT *, {lag("close")} AS before,
        greatest(abs(high - low), abs(high - {lag("close")}), abs(low - {lag("close")})) AS range FROM numbered {W}),
    walk AS (
        SELECT symbol, i, range AS a, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down, 0 AS side,
            (open + close) / 2 AS ha_open, (open + high + low + close) / 4 AS ha_close FROM tr WHERE i = 1
        UNION ALL
        SELECT symbol, i, a, up2, down2, CASE WHEN i < {n} THEN 0 WHEN i = {n} THEN CASE WHEN close >= mid THEN 1 ELSE -1 END
                WHEN side < 0 AND close > up2 THEN 1 WHEN side > 0 AND close < down2 THEN -1 ELSE side END,
            ha, (open + high + low + close) / 4
        FROM (SELECT *, CASE WHEN i < {n} THEN NULL WHEN i = {n} OR mid + {k} * a < up OR before > up THEN mid + {k} * a ELSE up END AS up2,
                CASE WHEN i < {n} THEN NULL WHEN i = {n} OR mid - {k} * a > down OR before < down THEN mid - {k} * a ELSE down END AS down2
            FROM (SELECT t.symbol, t.i, t.open, t.high, t.low, t.close, t.before, s.a + (t.range - s.a) / {n} AS a, s.up, s.down, s.side,
                    (t.high + t.low) / 2 AS mid, (s.ha_open + s.ha_close) / 2 AS ha
                FROM walk s JOIN tr t ON t.symbol = s.symbol AND t.i = s.i + 1))),
    st AS (SELECT t.*, CASE WHEN side > 0 THEN down WHEN side < 0 THEN up END AS line, side, ha_open, ha_close FROM tr t JOIN walk USING (symbol, i))"""


_COLOUR = "CASE WHEN close > open THEN 'Green' WHEN close < open THEN 'Red' ELSE 'Neutral' END"
_HA = "CASE WHEN ha_close > ha_open THEN 'Green' WHEN ha_close < ha_open THEN 'Red' ELSE 'Neutral' END"
_SMA3 = ", ".join(f"{sma('close', n)} AS sma{n}" for n in (10, 25, 50))
_PIVOTS = "pp, r1, r2, r3, s1, s2, s3"


def _direction(n: int) -> str:
    return f"CASE WHEN slope{n} > 0.05 THEN 'Rising' WHEN slope{n} < -0.05 THEN 'Falling' WHEN slope{n} IS NOT NULL THEN 'Flat' END AS direction{n}"


def _place(n: int) -> str:
    return f"CASE WHEN abs(close - sma{n}) <= 1e-12 THEN 'Equal' WHEN close > sma{n} THEN 'Above' ELSE 'Below' END AS position{n}"


def _run(flag: str, out: str, src: str, dst: str) -> str:
    return f"""{dst}_i AS (SELECT *, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER w AS isle FROM {src} {W}),
    {dst} AS (SELECT * EXCLUDE (isle), CAST(sum(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, isle ORDER BY date) AS BIGINT) AS {out} FROM {dst}_i)"""


_PATTERNS = """('Doji', doji), ('Hammer', hammer AND down), ('Hanging Man', hammer AND up), ('Shooting Star', star AND up),
    ('Bullish Engulfing', close > open AND close1 < open1 AND open <= close1 AND close >= open1 AND body > body1 AND down1),
    ('Bearish Engulfing', close < open AND close1 > open1 AND open >= close1 AND close <= open1 AND body > body1 AND up1),
    ('Bullish Harami', close1 < open1 AND body1 > 0 AND body1 >= usual1 AND close > open AND inside AND down1),
    ('Bearish Harami', close1 > open1 AND body1 > 0 AND body1 >= usual1 AND close < open AND inside AND up1),
    ('Morning Star', close2 < open2 AND body2 > 0 AND body2 >= usual2 AND body1 <= 0.5 * usual1 AND greatest(open1, close1) <= close2 AND close > open AND close > (open2 + close2) / 2 AND down2),
    ('Evening Star', close2 > open2 AND body2 > 0 AND body2 >= usual2 AND body1 <= 0.5 * usual1 AND least(open1, close1) >= close2 AND close < open AND close < (open2 + close2) / 2 AND up2),
    ('Three Black Crows', crow0 AND crow1 AND crow2 AND close < close1 AND close1 < close2 AND open1 BETWEEN close2 AND open2 AND open BETWEEN close1 AND open1 AND up2)"""


def _crow(k: str) -> str:
    return f"(close{k} < open{k} AND body{k} >= 0.5 * span{k} AND close{k} - low{k} <= 0.25 * span{k}) AS crow{k or 0}"


ORACLES = {
    "bollinger_latest": steps(
        f"a AS (SELECT *, {sma('close', 20)} AS middle, {roll('stddev_samp', 'close', 20)} AS sd FROM numbered)",
        "b AS (SELECT *, middle + 2 * sd AS upper, middle - 2 * sd AS lower FROM a WHERE is_last AND i >= 30)",
        f"""SELECT symbol, date, close, {r6('middle', 'upper', 'lower')}, round((upper - lower) / middle * 100, 6) AS width_percent,
        CASE WHEN close > upper THEN 'Above Upper Band' WHEN close < lower THEN 'Below Lower Band' ELSE 'Within Bands' END AS status,
        abs(close / upper - 1) * 100 <= 1 AS near_upper, abs(close / lower - 1) * 100 <= 1 AS near_lower FROM b""",
    ),
    "better_breakout": steps(
        "a AS (SELECT *, greatest(high - close, close - low) AS wick FROM numbered)",
        f"b AS (SELECT *, {lag('close')} + {sma('wick', 3, 1)} AS level, {sma('close', 40)} AS s40 FROM a {W})",
        "SELECT symbol, date, close, round(level, 6) AS breakout_level, close > level AS is_breakout, round(close - s40, 6) AS momentum FROM b WHERE is_last AND i >= 53",
    ),
    "sma_trend": steps(
        "a AS (SELECT *, " + ", ".join(f"{sma('close', n)} AS sma{n}" for n in (20, 50, 100, 200)) + " FROM numbered)",
        f"b AS (SELECT *, sma50 - sma200 AS gap, {lag('(sma50 - sma200)')} AS last_gap FROM a {W})",
        f"""SELECT symbol, date, close, {r6('sma20', 'sma50', 'sma100', 'sma200')},
        CASE WHEN close > sma200 AND sma50 > sma200 THEN 'Bullish' WHEN close < sma200 AND sma50 < sma200 THEN 'Bearish' ELSE 'Neutral' END AS trend,
        gap > 0 AND last_gap <= 0 AS golden_cross, gap < 0 AND last_gap >= 0 AS death_cross FROM b WHERE is_last AND i >= 210""",
    ),
    "sma_traffic_light": steps(
        f"a AS (SELECT *, {_SMA3} FROM numbered)",
        "b AS (SELECT *, " + ", ".join(f"(sma{n} / {lag(f'sma{n}', 5)} - 1) * 100 AS slope{n}, (close / {lag('close', n)} - 1) * 100 AS c{n}" for n in (10, 25, 50)) + f" FROM a {W})",
        f"""SELECT symbol, date, CASE WHEN close > sma10 AND sma10 > sma25 AND sma25 > sma50 THEN 'Bullish'
        WHEN close < sma10 AND sma10 < sma25 AND sma25 < sma50 THEN 'Bearish' ELSE 'Mixed' END AS state,
        {', '.join(_place(n) for n in (10, 25, 50))}, {', '.join(_direction(n) for n in (10, 25, 50))},
        {', '.join(f'round(c{n}, 6) AS change{n}' for n in (10, 25, 50))} FROM b WHERE is_last AND i >= 50""",
    ),
    "sma_crossovers": steps(
        f"a AS (SELECT *, {_SMA3} FROM numbered)",
        "g AS (" + " UNION ALL ".join(f"SELECT symbol, date, n - i AS bars_ago, '{a}/{b}' AS pair, sma{a} - sma{b} AS gap, {lag(f'(sma{a} - sma{b})')} AS before FROM a {W}" for a, b in ((10, 25), (10, 50), (25, 50))) + ")",
        "SELECT symbol, pair, date, bars_ago, CASE WHEN gap > 0 THEN 'up' ELSE 'down' END AS direction FROM g WHERE bars_ago < 10 AND ((gap > 0 AND before <= 0) OR (gap < 0 AND before >= 0))",
    ),
    "td_setup": steps(
        f"a AS (SELECT *, coalesce(close > {lag('close', 4)}, false) AS above, coalesce(close < {lag('close', 4)}, false) AS below FROM numbered {W})",
        _run("below", "bullish", "a", "b1"),
        _run("above", "bearish", "b1", "b2"),
        "g AS (SELECT symbol, max(date) AS on_, arg_max(CASE WHEN bearish = 9 THEN 'Bearish' ELSE 'Bullish' END, date) AS kind FROM b2 WHERE bearish = 9 OR bullish = 9 GROUP BY symbol)",
        """SELECT b2.symbol, date, CASE WHEN bearish > 0 THEN 'Bearish' WHEN bullish > 0 THEN 'Bullish' ELSE 'None' END AS setup, greatest(bearish, bullish) AS run, least(greatest(bearish, bullish), 9) AS count,
        greatest(bearish, bullish) >= 9 AS completed, CASE WHEN bearish >= 9 THEN 'Potential Upside Exhaustion' WHEN bullish >= 9 THEN 'Potential Downside Exhaustion' WHEN bearish + bullish > 0 THEN 'Setup In Progress' ELSE 'No Active Setup' END AS state,
        g.kind AS last_completed, g.on_ AS last_completed_date FROM b2 LEFT JOIN g USING (symbol) WHERE is_last AND i >= 13""",
    ),
    "pivot_levels": steps(
        f"a AS (SELECT *, {lag('high')} AS h, {lag('low')} AS l, {lag('close')} AS k FROM numbered {W})",
        "b AS (SELECT *, (h + l + k) / 3 AS pp FROM a WHERE is_last AND i >= 5)",
        "d AS (SELECT *, 2 * pp - l AS r1, 2 * pp - h AS s1, pp + (h - l) AS r2, pp - (h - l) AS s2, h + 2 * (pp - l) AS r3, l - 2 * (h - pp) AS s3 FROM b)",
        f"""SELECT symbol, date, close, {r6(*_PIVOTS.split(', '))},
        round(up, 6) AS resistance, round(abs(up - close) / close * 100, 6) AS to_resistance_percent, round(down, 6) AS support, round(abs(down - close) / close * 100, 6) AS to_support_percent,
        CASE WHEN close > r1 THEN 'Upper Zone' WHEN close < s1 THEN 'Lower Zone' ELSE 'Middle Zone' END AS zone, close > pp AS above_pivot
        FROM (SELECT *, list_min(list_filter([{_PIVOTS}], lambda x: x > close)) AS up, list_max(list_filter([{_PIVOTS}], lambda x: x <= close)) AS down FROM d)""",
    ),
    "cpr": steps(
        f"a AS (SELECT *, ({lag('high')} + {lag('low')} + {lag('close')}) / 3 AS pivot_point, ({lag('high')} + {lag('low')}) / 2 AS m FROM numbered {W})",
        "b AS (SELECT *, least(m, 2 * pivot_point - m) AS bottom, greatest(m, 2 * pivot_point - m) AS top FROM a)",
        "d AS (SELECT *, (top - bottom) / pivot_point * 100 AS width FROM b)",
        f"e AS (SELECT *, list(width) OVER {_w(60)} AS raw FROM d)",
        "f AS (SELECT *, list_filter(raw, lambda x: x IS NOT NULL) AS ws FROM e WHERE is_last AND i >= 61)",
        "g AS (SELECT *, (len(list_filter(ws, lambda x: x < width - 1e-9)) + 0.5 * len(list_filter(ws, lambda x: abs(x - width) <= 1e-9)))::DOUBLE / len(ws) AS rank FROM f)",
        f"""SELECT symbol, date, {r6('pivot_point', 'bottom', 'top', 'width', 'rank')}, CASE WHEN rank <= 0.25 THEN 'Narrow' WHEN rank >= 0.75 THEN 'Wide' ELSE 'Normal' END AS kind,
        CASE WHEN close > top THEN 'Bullish Day Bias' WHEN close < bottom THEN 'Bearish Day Bias' ELSE 'Neutral' END AS bias FROM g""",
    ),
    "candle_confirmation": steps(f"SELECT symbol, date, {_COLOUR} AS candle, false AS setup, false AS confirmed FROM numbered WHERE is_last AND i >= 20"),
    "squeeze_momentum": steps(
        f"t AS (SELECT *, greatest(abs(high - low), abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM numbered {W})",
        f"a AS (SELECT *, {sma('close', 20)} AS mean, {roll('stddev_pop', 'close', 20)} AS sd, {sma('tr', 20)} AS range, ({roll('max', 'high', 20)} + {roll('min', 'low', 20)}) / 2 AS mid FROM t)",
        "b AS (SELECT *, 2 * sd < 1.5 * range AS sq, 2 * sd > 1.5 * range AS off, close - (mid + mean) / 2 AS y FROM a)",
        f"d AS (SELECT *, CASE WHEN count(y) OVER {_w(20)} = 20 THEN regr_intercept(y, i) OVER {_w(20)} + regr_slope(y, i) OVER {_w(20)} * i END AS m FROM b)",
        f"e AS (SELECT *, {lag('sq')} AS was, {lag('m')} AS p FROM d {W})",
        """SELECT symbol, date, CASE WHEN sq THEN 'Squeeze On' WHEN off THEN 'Squeeze Released' ELSE 'No Squeeze' END AS squeeze_state, was AND off AS released_today, round(m, 6) AS momentum,
        CASE WHEN m > p THEN 'Rising' WHEN m < p THEN 'Falling' ELSE 'Flat' END AS direction,
        CASE WHEN m > 0 THEN 'Bullish' ELSE 'Bearish' END || ' Momentum (' || CASE WHEN (m > 0) = coalesce(m > p, false) THEN 'Strengthening' ELSE 'Weakening' END || ')' AS momentum_state,
        round(mean + 2 * sd, 6) AS upper_bb, round(mean - 2 * sd, 6) AS lower_bb, round(mean + 1.5 * range, 6) AS upper_kc, round(mean - 1.5 * range, 6) AS lower_kc FROM e WHERE is_last AND i >= 40""",
    ),
    "ema50_rsi_pullback": steps(
        INDICATORS,
        f"a AS (SELECT *, {lag('rsi')} AS last_rsi, (close / ema50 - 1) * 100 AS d FROM ind {W})",
        """SELECT symbol, date, close, round(ema50, 6) AS ema50, round(rsi, 6) AS rsi, round(d, 6) AS distance_percent, CASE WHEN close > ema50 THEN 'Bullish' ELSE 'Bearish' END AS trend,
        rsi > last_rsi AS rsi_turning_up, close > ema50 AND abs(d) <= 2 AS is_pullback FROM a WHERE is_last AND i >= 74""",
        recursive=True,
    ),
    "ema8_21_pullback": steps(
        INDICATORS,
        f"a AS (SELECT *, ema8 - ema21 AS gap, {lag('(ema8 - ema21)')} AS last_gap FROM ind {W})",
        f"""SELECT symbol, date, {r6('ema8', 'ema21')}, gap > 0 AND last_gap <= 0 AS cross_up, gap < 0 AND last_gap >= 0 AS cross_down,
        CASE WHEN gap > 0 THEN 'Bullish' ELSE 'Bearish' END AS trend, close > ema8 AND close > ema21 AS above_both, close > ema8 AND close > ema21 AND abs((close / ema8 - 1) * 100) <= 1 AS is_pullback FROM a WHERE is_last AND i >= 31""",
        recursive=True,
    ),
    "macd": steps(
        INDICATORS,
        f"a AS (SELECT *, {lag('hist')} AS last_hist FROM ind {W})",
        f"""SELECT symbol, date, {r6('macd', 'signal', 'hist')}, hist > 0 AND last_hist <= 0 AS cross_up, hist < 0 AND last_hist >= 0 AS cross_down,
        CASE WHEN macd > signal THEN 'Bullish' ELSE 'Bearish' END AS trend FROM a WHERE is_last AND i >= 45""",
        recursive=True,
    ),
    "triple_ma_pullback": steps(
        INDICATORS,
        f"a AS (SELECT *, {sma('close', 20)} AS ma1, {sma('close', 5)} AS mean5 FROM ind)",
        f"b AS (SELECT *, {sma('ma1', 20)} AS ma2 FROM a)",
        f"d AS (SELECT *, {sma('ma2', 20)} AS ma3, mean5 - atr AS entry, mean5 + 0.5 * atr AS exit FROM b)",
        f"""SELECT symbol, date, {r6('ma1', 'ma2', 'ma3', 'mean5', 'atr', 'entry', 'exit')},
        ma1 > ma2 AND ma2 > ma3 AND close > ma3 AS uptrend, close > exit AS exit_zone,
        CASE WHEN NOT (ma1 > ma2 AND ma2 > ma3 AND close > ma3) THEN 'No Confirmed Uptrend' WHEN close < entry THEN 'Pullback Entry Zone' WHEN close > exit THEN 'Uptrend - Exit Zone' ELSE 'Uptrend - No Pullback' END AS label
        FROM d WHERE is_last AND i >= 84""",
        recursive=True,
    ),
    "supertrend_confirmation": steps(
        _supertrend(10, 3.0),
        f"a AS (SELECT *, {_COLOUR} AS colour FROM st)",
        f"b AS (SELECT *, {lag('colour')} AS c1, {lag('colour', 2)} AS c2, {lag('side')} AS last_side FROM a {W})",
        """SELECT symbol, date, round(line, 6) AS line, CAST(side AS BIGINT) AS side, side <> last_side AS flipped,
        side = 1 AND c1 = 'Green' AND c2 = 'Green' AND close > line AS confirmed_up, side = -1 AND c1 = 'Red' AND c2 = 'Red' AND close < line AS confirmed_down
        FROM b WHERE is_last AND i >= 30""",
        recursive=True,
    ),
    "heikin_ashi_setup": steps(
        _supertrend(6, 2.0),
        f"a AS (SELECT *, {_HA} AS ha, {_COLOUR} AS colour, {lag('side')} AS last_side FROM st {W})",
        """b AS (SELECT *, CASE WHEN side <> last_side AND last_side <> 0 AND side = 1 AND ha = 'Green' AND colour = 'Green' THEN 'long'
            WHEN side <> last_side AND last_side <> 0 AND side = -1 AND ha = 'Red' AND colour = 'Red' THEN 'short' END AS kind FROM a)""",
        "s AS (SELECT symbol, arg_max(kind, date) AS kind, max(date) AS on_, arg_max(close, date) AS entry, arg_max(line, date) AS stop FROM b WHERE kind IS NOT NULL GROUP BY symbol)",
        """SELECT b.symbol, b.date, b.ha, s.kind AS setup, s.on_ AS setup_date, CASE WHEN ok THEN round(s.entry, 6) END AS entry, CASE WHEN ok THEN round(s.stop, 6) END AS stop,
        CASE WHEN ok THEN round(s.entry + 1.5 * (s.entry - s.stop), 6) END AS target FROM b LEFT JOIN (SELECT *, CASE WHEN kind = 'long' THEN entry - stop ELSE stop - entry END > 0 AS ok FROM s) s USING (symbol) WHERE b.is_last AND b.i >= 50""",
        recursive=True,
    ),
    "ta_candles": steps(
        INDICATORS,
        f"a AS (SELECT *, (close / {lag('close', 10)} - 1) * 100 AS roc, atr / close * 100 AS ap, {_COLOUR} AS candle FROM ind {W})",
        f"b AS (SELECT *, CASE WHEN count(ap) OVER {_w(50)} >= 14 THEN median(ap) OVER {_w(50)} END AS usual, sum((candle = 'Green')::INTEGER) OVER {_w(10)}::DOUBLE / 10 AS g, sum((candle = 'Red')::INTEGER) OVER {_w(10)}::DOUBLE / 10 AS r FROM a)",
        _run("candle = 'Green'", "gr", "b", "d1"),
        _run("candle = 'Red'", "rr", "d1", "d2"),
        """e AS (SELECT *, CASE WHEN (ema21 / ema50 - 1) * 100 >= 0.25 AND close > ema21 THEN 'Bullish' WHEN (ema21 / ema50 - 1) * 100 <= -0.25 AND close < ema21 THEN 'Bearish' ELSE 'Mixed' END AS trend,
            CASE WHEN roc > 0 THEN 'Positive' WHEN roc < 0 THEN 'Negative' ELSE 'Flat' END AS momentum FROM d2 WHERE is_last AND i >= 74)""",
        """SELECT symbol, date, trend, momentum, round(roc, 6) AS roc10, round(ap, 6) AS atr_percent, CASE WHEN ap / usual >= 1.25 THEN 'Expanding' WHEN ap / usual <= 0.75 THEN 'Contracting' ELSE 'Normal' END AS volatility,
        g AS green_ratio, r AS red_ratio, greatest(gr, rr) AS streak, candle AS streak_colour,
        CASE WHEN trend = 'Bullish' AND momentum = 'Positive' AND g >= 0.6 THEN 'Healthy Trend (Bullish)' WHEN trend = 'Bullish' AND (momentum <> 'Positive' OR g < 0.5) THEN 'Weakening Bullish Trend'
            WHEN trend = 'Bearish' AND momentum = 'Negative' AND r >= 0.6 THEN 'Healthy Trend (Bearish)' WHEN trend = 'Bearish' AND (momentum <> 'Negative' OR r < 0.5) THEN 'Weakening Bearish Trend' ELSE 'Choppy - Caution' END AS health FROM e""",
        recursive=True,
    ),
    "mswing": steps(
        f"a AS (SELECT *, (close / {lag('close', 20)} - 1) * 100 + (close / {lag('close', 50)} - 1) * 100 AS swing, {sma('close', 50)} AS sma50 FROM numbered {W})",
        "walk AS (SELECT symbol, i, swing AS e FROM a WHERE i = 51 UNION ALL SELECT a.symbol, a.i, e + 0.2::DOUBLE * (a.swing - e) FROM walk JOIN a ON a.symbol = walk.symbol AND a.i = walk.i + 1)",
        "b AS (SELECT a.*, CASE WHEN i >= 59 THEN e END AS average FROM a LEFT JOIN walk USING (symbol, i))",
        f"d AS (SELECT *, {lag('swing')} AS s1, {lag('(swing - average)')} AS g1 FROM b {W})",
        "x AS (SELECT swing AS ix FROM d WHERE symbol = 'NO' AND is_last AND i >= 69)",
        """SELECT symbol, date, round(swing, 6) AS swing, round(average, 6) AS average, round(sma50, 6) AS sma50,
        CASE WHEN swing > 0 AND swing > average THEN 'Strong bullish momentum' WHEN swing > 0 THEN 'Weakening bullish momentum' WHEN swing > average THEN 'Recovering bearish momentum' ELSE 'Bearish momentum' END AS state,
        coalesce(s1 <= 0 AND swing > 0, false) AS zero_up, coalesce(s1 >= 0 AND swing < 0, false) AS zero_down, coalesce(g1 <= 0 AND swing > average, false) AS ema_up, coalesce(g1 >= 0 AND swing < average, false) AS ema_down,
        swing > 0 AND swing > average AND close > sma50 AS bullish, swing <= 0 OR close <= sma50 OR swing >= 4 AS exit, round(swing - (SELECT ix FROM x), 6) AS relative_strength
        FROM d WHERE is_last AND i >= 69""",
        recursive=True,
    ),
    "candlestick_patterns": steps(
        INDICATORS,
        f"""a AS (SELECT *, abs(close - open) AS body, high - low AS span, high - greatest(open, close) AS upper, least(open, close) - low AS lower,
            {lag('close')} - {lag('close', 6)} AS move, {lag('atr')} AS one_atr FROM ind {W})""",
        f"b AS (SELECT *, {sma('body', 10, 1)} AS usual, move >= one_atr AS up, move <= -one_atr AS down FROM a)",
        "d AS (SELECT *, " + ", ".join(f"{lag(x, k)} AS {x}{k}" for k in (1, 2) for x in ("open", "close", "body", "usual", "low", "span", "up", "down")) + f" FROM b {W})",
        f"""e AS (SELECT *, span > 0 AND body <= 0.1 * span AS doji,
            body > 0.1 * span AND lower >= 2 * body AND upper <= 0.1 * span AS hammer,
            body > 0.1 * span AND upper >= 2 * body AND lower <= 0.1 * span AS star,
            body < body1 AND greatest(open, close) < greatest(open1, close1) AND least(open, close) > least(open1, close1) AS inside,
            {_crow('')}, {_crow('1')}, {_crow('2')} FROM d WHERE n - i < 120)""",
        f"SELECT symbol, date, pattern FROM e, LATERAL (VALUES {_PATTERNS}) AS v(pattern, hit) WHERE hit",
        recursive=True,
    ),
}
