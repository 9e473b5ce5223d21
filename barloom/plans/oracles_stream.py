"""DuckDB SQL for the streaming queries, and the last odds and ends."""

from __future__ import annotations

from barloom.plans.oracles_analytics import _with
from barloom.sources.bars import BARS_SQL, HOURS_SQL

_STAMP = "strftime({x}, '%Y-%m-%d %H:%M:%S') AS {y}"

ORACLES = {
    "stream_hourly_ohlcv": _with(
        HOURS_SQL, f"SELECT symbol, {_STAMP.format(x='ts', y='ts')}, open, high, low, close, volume FROM hours WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"
    ),
    "stream_dedup_ingest": "SELECT event_id, any_value(user_id) AS user_id, any_value(event_type) AS event_type, any_value(value) AS value FROM events GROUP BY event_id",
    "stream_session_users": f"""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a),
        g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY user_id, k)
        SELECT user_id, {_STAMP.format(x='start', y='start')}, {_STAMP.format(x='stop', y='stop')}, n, total FROM g WHERE stop <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
    "stream_ema_state": """SELECT event_type AS symbol, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a + 2 / 21.0::DOUBLE * (x - a)), 6) AS average, count(*) AS n
        FROM events GROUP BY event_type""",
    "buy_and_hold_shares": _with(
        BARS_SQL,
        "g AS (SELECT symbol, arg_min(adjusted_close, date) AS f, arg_max(adjusted_close, date) AS l, max(date) - min(date) AS days FROM bars GROUP BY symbol)",
        "s AS (SELECT *, CAST(floor(9999.0::DOUBLE / (f * 1.001::DOUBLE)) AS BIGINT) AS shares FROM g)",
        "t AS (SELECT *, 10000 - CASE WHEN shares > 0 THEN shares * f * 1.001::DOUBLE + 1 ELSE 0 END AS cash FROM s)",
        "SELECT symbol, shares, round(cash, 6) AS cash, round(cash + shares * l, 6) AS final, round((pow((cash + shares * l) / 10000, 1 / (days / 365.25::DOUBLE)) - 1) * 100, 6) AS annual_percent FROM t",
    ),
    "dividend_parse": """WITH r AS (SELECT c_mktsegment AS symbol, CASE WHEN c_custkey % 11 = 0 THEN 'bad' ELSE '2001-0' || (c_custkey % 9 + 1) || '-15T00:00' END AS d,
            CASE WHEN c_custkey % 5 = 0 THEN 'NA' WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 40 AS VARCHAR) END AS v, CAST(c_custkey % 30 AS VARCHAR) AS u, c_custkey % 13 = 0 AS special FROM customer),
        p AS (SELECT DISTINCT symbol, try_cast(substr(d, 1, 10) AS DATE) AS ex_date, round(coalesce(try_cast(v AS DOUBLE), try_cast(u AS DOUBLE)), 6) AS amount, coalesce(special, false) AS is_special FROM r)
        SELECT *, ex_date > DATE '2001-06-30' AS upcoming FROM p WHERE ex_date IS NOT NULL AND amount > 0""",
}
