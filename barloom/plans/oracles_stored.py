"""DuckDB SQL for stored versions, streams in several batches and sessions.

Clock changes are written out as UTC moments, so no time zone data is needed.
"""

from __future__ import annotations

from barloom.plans.oracles_analytics import _with
from barloom.plans.oracles_stream import ORACLES as STREAMS
from barloom.plans.oracles_technical import INDICATORS, NUMBERED, r6, steps
from barloom.sources.bars import BARS_SQL, STOCKS_SQL

_BATCH = "CASE WHEN date < DATE '1999-07-01' THEN 0 WHEN date < DATE '2000-01-01' THEN 1 WHEN date < DATE '2001-01-01' THEN 2 ELSE 3 END"
_TRADES = "trades AS (SELECT event_type AS symbol, ts, event_id AS id, CAST((10000 + floor(value * 100)) / 100.0 AS DOUBLE) AS price FROM events)"
_SUMMER = {
    "NEWYORK": ("2024-03-10 07:00:00", "2024-11-03 06:00:00", -4, -5),
    "LONDON": ("2024-03-31 01:00:00", "2024-10-27 01:00:00", 1, 0),
    "TOKYO": ("2024-01-01", "2024-01-01", 9, 9),
}
_OFFSET = "CASE exchange " + " ".join(f"WHEN '{x}' THEN CASE WHEN ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{z}' THEN {s} ELSE {w} END" for x, (a, z, s, w) in _SUMMER.items()) + " END"
_HOURS = "hours(exchange, opens, closes) AS (VALUES ('NEWYORK', 570, 960), ('LONDON', 480, 990), ('TOKYO', 540, 900))"
_OFF = "off(exchange, date) AS (VALUES ('NEWYORK', DATE '2024-03-29'), ('LONDON', DATE '2024-03-29'), ('TOKYO', DATE '2024-03-20'), ('TOKYO', DATE '2024-11-04'))"

_SNAPSHOTS = """q AS (SELECT symbol, date_trunc('quarter', date) AS q, floor(max(close)) / 50.0::DOUBLE AS eps, count(*) AS n_bars FROM stocks GROUP BY ALL),
    dated AS (SELECT *, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS valid_from FROM q),
    codes(symbol, code) AS (SELECT symbol, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(symbol) + 1), lambda i: ascii(symbol[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) FROM (SELECT DISTINCT symbol FROM stocks)),
    late AS (SELECT d.*, CAST(20 + xor(code, 4294967295) % 40 AS INTEGER) AS lag FROM dated d JOIN codes USING (symbol)),
    snaps AS (
        SELECT symbol, valid_from, valid_from + lag AS recorded_at, (year(q) + month(q)) % 5 <> 0 AS ok, eps, n_bars FROM late
        UNION ALL SELECT symbol, valid_from, valid_from + lag + 120, true, eps * 2, n_bars FROM late WHERE n_bars % 3 = 0)"""
_SEEN = "s.valid_from, CAST(s.recorded_at AS VARCHAR) AS recorded_at, s.eps, s.n_bars"
#: No later good snapshot that was seen as well: a self-join.
_NONE_LATER = "NOT EXISTS (FROM snaps t WHERE t.symbol = s.symbol AND t.ok AND {seen} AND (t.valid_from > s.valid_from OR (t.valid_from = s.valid_from AND t.recorded_at > s.recorded_at)))"
_KNOWN = "t.valid_from <= {v} AND t.recorded_at <= {r}"

_UNTIL = BARS_SQL.replace("bars AS", "all_bars AS", 1) + ", bars AS (SELECT * FROM all_bars WHERE date <= DATE '1998-08-12')"

ORACLES = {
    "stream_months": _with(
        _UNTIL,
        "m AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(close, date) AS close, max(date) AS last, count(*) AS n FROM bars GROUP BY ALL)",
        "e AS (SELECT *, last_day(month) - CASE isodow(last_day(month)) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS weekday FROM m)",
        "f AS (SELECT *, lead(month) OVER w IS NOT NULL OR last >= weekday - 4 AS is_complete, CASE WHEN lag(month) OVER w = month - INTERVAL 1 MONTH THEN close / lag(close) OVER w - 1 END AS r FROM e WINDOW w AS (PARTITION BY symbol ORDER BY month))",
        """SELECT symbol, month, close, n, is_complete, round(r * 100, 6) AS return_percent, CASE WHEN is_complete AND r IS NOT NULL THEN rank() OVER (PARTITION BY symbol, is_complete AND r IS NOT NULL ORDER BY r DESC) END AS rank FROM f""",
    ),
    "stream_indicators": steps(f"SELECT symbol, date, i, close, {r6('ema8', 'ema21', 'ema50', 'rsi', 'atr', 'macd', 'signal', 'hist')} FROM ind WHERE is_last", base=f"{NUMBERED.replace(BARS_SQL, _UNTIL)}, {INDICATORS}", recursive=True),
    "members_from_pages": """SELECT CAST(page_id AS VARCHAR) AS page_id, upper(substr(n_name, 1, 4)) || '-' || n_nationkey AS symbol, n_name || ' & Co' AS name, 'Sector ' || (n_nationkey % 2) AS sector, n_name || ' works' AS industry
        FROM pages JOIN nation ON n_regionkey = page_id % 5 WHERE page_id % 3 = 0""",
    "page_table_counts": """SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(count(n_name) AS INTEGER) AS n_rows, CAST(page_id % 3 = 0 AS INTEGER) AS n_tables, CAST(page_id % 33 = 0 AS INTEGER) AS n_unclosed, 0 AS n_stray, 0 AS n_bad_spans
        FROM pages LEFT JOIN nation ON n_regionkey = page_id % 5 AND page_id % 3 = 0 GROUP BY page_id""",
    "snapshots_as_of": _with(
        STOCKS_SQL,
        _SNAPSHOTS,
        "moments(moment, v, r) AS (VALUES (0, DATE '1995-06-30', TIMESTAMP '1995-06-30 12:00:00'), (1, DATE '1996-12-31', TIMESTAMP '1998-01-01'), (2, DATE '1998-09-30', TIMESTAMP '1996-03-31 09:00:00'))",
        f"SELECT s.symbol, moment, {_SEEN} FROM moments JOIN snaps s ON s.ok AND s.valid_from <= v AND s.recorded_at <= r WHERE {_NONE_LATER.format(seen=_KNOWN.format(v='v', r='r'))}",
    ),
    "snapshots_for_bars": _with(
        STOCKS_SQL,
        _SNAPSHOTS,
        f"found AS (SELECT b.symbol, b.date, s.valid_from, s.recorded_at, s.eps, s.n_bars FROM stocks b JOIN snaps s ON s.symbol = b.symbol AND s.ok AND s.valid_from <= b.date AND s.recorded_at <= b.date QUALIFY row_number() OVER (PARTITION BY b.symbol, b.date ORDER BY s.valid_from DESC, s.recorded_at DESC) = 1)",
        f"SELECT b.symbol, b.date AS valid, {_SEEN} FROM stocks b LEFT JOIN found s USING (symbol, date)",
    ),
    "snapshots_latest": _with(STOCKS_SQL, _SNAPSHOTS, f"SELECT s.symbol, {_SEEN} FROM snaps s WHERE s.ok AND {_NONE_LATER.format(seen='true')}"),
    "snapshot_refreshes": _with(
        STOCKS_SQL,
        _SNAPSHOTS,
        "SELECT strftime(recorded_at, '%Y-%m') AS run, count(DISTINCT symbol) FILTER (WHERE ok) AS succeeded, count(DISTINCT symbol) FILTER (WHERE NOT ok) AS failed FROM snaps GROUP BY 1",
    ),
    "stream_restatement": _with(
        BARS_SQL,
        """SELECT symbol, date, open, high, low, close, CASE WHEN date >= DATE '1999-01-01' AND day(date) <> 13 THEN round(close / 2, 6) ELSE adjusted_close END AS adjusted_close, volume
        FROM bars WHERE date < DATE '2000-01-01' OR day(date) <> 13""",
    ),
    "ingest_runs": _with(
        BARS_SQL,
        f"late AS (SELECT *, {_BATCH} AS batch, CASE WHEN month(date) = 12 THEN 2 ELSE 1 END AS times, day(date) = 13 AS bad FROM bars WHERE date >= DATE '1999-01-01')",
        """each AS (SELECT batch, sum(times) AS received, sum(CASE WHEN bad THEN times ELSE 0 END) AS refused, sum(CASE WHEN bad THEN 0 ELSE times - 1 END) AS repeated,
            count(*) FILTER (WHERE NOT bad AND date >= DATE '2000-01-01') AS inserted, count(*) FILTER (WHERE NOT bad AND date < DATE '2000-01-01' AND adjusted_close <> round(close / 2, 6)) AS restated,
            count(*) FILTER (WHERE NOT bad AND date < DATE '2000-01-01' AND adjusted_close = round(close / 2, 6)) AS unchanged FROM late GROUP BY batch
            UNION ALL SELECT -1, count(*), 0, 0, count(*), 0, 0 FROM bars WHERE date < DATE '2000-01-01')""",
        """SELECT batch + 2 AS version, CASE WHEN batch < 0 THEN 'backfill' ELSE 'corrections' END AS stream, batch, 'success' AS status, CAST(received AS BIGINT) AS received, CAST(refused AS BIGINT) AS refused,
            CAST(repeated AS BIGINT) AS repeated, inserted, restated, unchanged, CAST(coalesce(sum(inserted) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
            CAST(sum(inserted) OVER (ORDER BY batch) AS BIGINT) AS after FROM each""",
    ),
    "stream_ema_batches": STREAMS["stream_ema_state"],
    "stream_closed_sessions": _with(
        _TRADES,
        "local AS (SELECT *, ts - INTERVAL 5 HOUR AS here, row(ts, id) AS k FROM trades)",
        """SELECT symbol, CAST(here AS DATE) AS date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, count(*) AS volume FROM local
        WHERE hour(here) * 60 + minute(here) BETWEEN 570 AND 959 GROUP BY symbol, CAST(here AS DATE)
        HAVING CAST(here AS DATE) + INTERVAL 21 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 4 HOUR""",
    ),
    "session_hours": _with(
        _TRADES,
        _HOURS,
        _OFF,
        "moved AS (SELECT symbol, id, price, ['NEWYORK', 'LONDON', 'TOKYO'][id % 3 + 1] AS exchange, ts + to_days(CASE WHEN (id // 3) % 2 = 0 THEN 65 ELSE 290 END) AS ts FROM trades)",
        f"local AS (SELECT *, ts + to_hours({_OFFSET}) AS here FROM moved)",
        "clock AS (SELECT *, CAST(here AS DATE) AS date, hour(here) * 60 + minute(here) - opens AS m, row(ts, id) AS k FROM local JOIN hours USING (exchange))",
        "inside AS (SELECT *, m // 60 AS slot FROM clock WHERE m >= 0 AND m < closes - opens AND isodow(date) < 6 AND NOT EXISTS (FROM off WHERE off.exchange = clock.exchange AND off.date = clock.date))",
        """SELECT exchange, symbol, date, CAST(slot AS BIGINT) AS slot, strftime(arg_min(date_trunc('minute', ts) - to_minutes(m % 60), k), '%Y-%m-%d %H:%M:%S') AS ts,
            arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, count(*) AS volume FROM inside GROUP BY exchange, symbol, date, slot""",
    ),
}
