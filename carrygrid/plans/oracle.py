"""DuckDB SQL that states the expected result of every registered query.

Written independently of the Spark code: latest values by ``row_number``, best
pairs by comparing all pairs, time buckets by ``time_bucket``.
"""

from __future__ import annotations

T0 = "TIMESTAMP '2024-01-01 00:00:00'"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
READ_AT_MS = 1706486400000

SYMBOL = (
    "concat('TKN', CAST(CAST(floor(user_id/5.0) AS BIGINT) AS VARCHAR), '-USD-', "
    "CAST(user_id AS VARCHAR), '-PERP')"
)
TOKEN = "concat('TKN', CAST(CAST(floor(user_id/5.0) AS BIGINT) AS VARCHAR))"
RATE = "CAST((value-50)*CAST('0.00003' AS DOUBLE) AS DECIMAL(18,10))"
VALUE = "CAST(value AS DECIMAL(18,2))"
EXCHANGE = "CASE WHEN user_id % 50 = 49 THEN 3 ELSE user_id % 5 END"

BASE = f"""WITH fx_exchanges AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id,
         concat(upper(substr(split_part(r_name,' ',1),1,1)), lower(substr(split_part(r_name,' ',1),2)),
                CASE WHEN split_part(r_name,' ',2)='' THEN ''
                     ELSE concat(' ', upper(substr(split_part(r_name,' ',2),1,1)),
                                      lower(substr(split_part(r_name,' ',2),2))) END) AS name
  FROM region),
fx_exchange_table AS (
  SELECT id, name,
         CAST(CASE WHEN id % 3 = 1 THEN 60 WHEN id % 3 = 2 THEN 480 END AS INTEGER) AS carry_interval_minutes,
         id % 4 <> 3 AS is_active, {T0} AS created_at, {T0} AS updated_at
  FROM fx_exchanges),
fx_markets AS (
  SELECT DISTINCT user_id AS id, CAST({EXCHANGE} AS BIGINT) AS exchange_id,
         CAST(floor(user_id/5.0) AS BIGINT) AS token_id,
         {SYMBOL} AS market_symbol, user_id % 20 <> 7 AS is_active
  FROM events),
fx_listed AS (
  SELECT * FROM fx_markets
  UNION ALL
  SELECT DISTINCT user_id + 1000000000, CAST((user_id + 2) % 5 AS BIGINT), CAST(floor(user_id/5.0) AS BIGINT), {TOKEN} || '-NEW', TRUE
  FROM events WHERE user_id % 30 = 11),
fx_tokens AS (
  SELECT DISTINCT CAST(floor(user_id/5.0) AS BIGINT) AS id, {TOKEN} AS symbol FROM events),
fx_ticks AS (
  SELECT e.event_id, e.user_id, m.exchange_id, m.id AS market_id, m.market_symbol, {RATE} AS rate, e.ts
  FROM events e JOIN fx_markets m ON m.id = e.user_id
  WHERE e.event_type <> 'purchase'),
fx_carry AS (
  SELECT exchange_id, market_id, rate, date_trunc('second', ts) AS ts FROM fx_ticks),
fx_purchases AS (
  SELECT * FROM events WHERE event_type = 'purchase'),
fx_stats AS (
  SELECT user_id AS market_id,
         CAST({VALUE}*100000  AS DECIMAL(30,10)) AS open_interest,
         CAST({VALUE}*1000000 AS DECIMAL(30,10)) AS volume_24h,
         date_trunc('second', ts) AS ts
  FROM fx_purchases),
f8 AS (
  SELECT exchange_id, market_id, time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01') AS bucket_start,
         CAST(SUM(rate) AS DOUBLE)/COUNT(*) AS rate_8h, COUNT(*) AS samples
  FROM fx_carry GROUP BY ALL),
latest_f8 AS (
  SELECT exchange_id, market_id, rate_8h, bucket_start FROM (
    SELECT *, row_number() OVER (PARTITION BY exchange_id, market_id ORDER BY bucket_start DESC) AS rn FROM f8)
  WHERE rn = 1),
latest_stats AS (
  SELECT m.exchange_id, s.market_id, s.open_interest, s.volume_24h, s.ts FROM (
    SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY ts DESC) AS rn FROM fx_stats) s
  JOIN fx_markets m ON m.id = s.market_id WHERE rn = 1),
snapshot AS (
  SELECT t.symbol AS token, e.name AS exchange, m.id AS market_id, m.market_symbol, f.rate_8h,
         f.bucket_start AS carry_bucket, s.open_interest, s.volume_24h, s.ts AS stats_ts,
         greatest(coalesce(f.bucket_start, TIMESTAMP '1970-01-01'), coalesce(s.ts, TIMESTAMP '1970-01-01')) AS last_update
  FROM fx_listed m
  JOIN fx_tokens t ON t.id = m.token_id
  JOIN fx_exchanges e ON e.id = m.exchange_id
  LEFT JOIN latest_f8 f ON f.exchange_id = e.id AND f.market_id = m.id
  LEFT JOIN latest_stats s ON s.exchange_id = e.id AND s.market_id = m.id
  WHERE m.is_active),
token_update AS (SELECT token, max(last_update) AS last_update FROM snapshot GROUP BY token),
cells AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY token, exchange ORDER BY market_id DESC) AS rn FROM snapshot)
  WHERE rn = 1),
served AS (
  SELECT token, exchange, market_symbol, coalesce(rate_8h, 0.0) AS carry_rate,
         coalesce(open_interest, CAST(0 AS DECIMAL(30,10))) AS oi,
         coalesce(volume_24h, CAST(0 AS DECIMAL(30,10))) AS volume, carry_bucket, stats_ts, rate_8h
  FROM cells)"""


def _pairs(source: str) -> str:
    return f""", pairs AS (
  SELECT a.token,
         CASE WHEN a.carry_rate > b.carry_rate THEN b.exchange ELSE a.exchange END AS long_exchange,
         CASE WHEN a.carry_rate > b.carry_rate THEN a.exchange ELSE b.exchange END AS short_exchange,
         least(a.carry_rate, b.carry_rate) AS long_rate,
         greatest(a.carry_rate, b.carry_rate) AS short_rate,
         abs(a.carry_rate - b.carry_rate)*10000.0 AS spread,
         CAST(a.oi AS DOUBLE) + CAST(b.oi AS DOUBLE) AS combined_oi,
         a.exchange AS first, b.exchange AS second
  FROM {source} a JOIN {source} b ON a.token = b.token AND a.exchange < b.exchange
  WHERE abs(a.carry_rate - b.carry_rate)*10000.0 >= 2),
best AS (
  SELECT token, long_exchange, short_exchange, long_rate, short_rate, spread, combined_oi FROM (
    SELECT *, row_number() OVER (PARTITION BY token ORDER BY spread DESC, first, second) AS rn FROM pairs)
  WHERE rn = 1)"""


SPREADS = """, spreads AS (
  SELECT token, CAST(sum(oi) AS DOUBLE) AS total_oi, count(*) AS n, min(carry_rate) AS low, max(carry_rate) AS high,
         CASE WHEN count(*) >= 2 THEN (max(carry_rate)-min(carry_rate))*10000.0 END AS spread
  FROM served GROUP BY token),
classed AS (
  SELECT s.token, s.exchange, s.carry_rate, CAST(s.oi AS DOUBLE) AS open_interest,
    CASE WHEN n < 2 THEN 'rate-neutral'
         WHEN (low > 0 OR high < 0) AND spread >= 25 AND carry_rate = high THEN 'rate-extreme-short'
         WHEN (low > 0 OR high < 0) AND spread >= 25 AND carry_rate = low THEN 'rate-extreme-long'
         WHEN spread < 2 THEN 'rate-neutral'
         WHEN spread >= 5 AND carry_rate = high THEN 'rate-short-candidate'
         WHEN spread >= 5 AND carry_rate = low THEN 'rate-long-candidate'
         WHEN carry_rate = high THEN 'rate-short-opportunity'
         WHEN carry_rate = low THEN 'rate-long-opportunity'
         WHEN carry_rate > 0 THEN 'rate-positive'
         WHEN carry_rate < 0 THEN 'rate-negative'
         ELSE 'rate-neutral' END AS rate_class
  FROM served s JOIN spreads p ON p.token = s.token)"""


def fixed(x: str, places: int) -> str:
    """printf rounds exact halves to even; the display text rounds them away from zero."""
    y, d = f"({x})", 10**places
    half = f"{y}*{2 ** (places + 1)} = floor({y}*{2 ** (places + 1)}) AND abs({y})*{d} - floor(abs({y})*{d}) = 0.5"
    return f"printf('%.{places}f', CASE WHEN {half} THEN {y} + sign({y})*{10.0 ** -(places + 1):.6f} ELSE {y} END)"


def number_text(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    return (
        f"CASE WHEN {x} >= 1e9 THEN {fixed(f'{x}/1e9', 2)} || 'B' WHEN {x} >= 1e6 THEN {fixed(f'{x}/1e6', 2)} || 'M' "
        f"WHEN {x} >= 1e3 THEN {fixed(f'{x}/1e3', 2)} || 'K' ELSE {fixed(x, 0)} END"
    )


def rate_text(x: str) -> str:
    return fixed(f"{x}*CAST(100 AS DOUBLE)", 3) + " || '%'"


def apr(x: str) -> str:
    return f"{x}*CAST(3 AS DOUBLE)*CAST(365 AS DOUBLE)*CAST(100 AS DOUBLE)"


def spread_text(x: str) -> str:
    return f"coalesce({fixed(f'{x}/CAST(100 AS DOUBLE)', 3)} || '%', '–')"


def bps_text(x: str) -> str:
    return f"coalesce({fixed(x, 0)} || ' bps', '–')"


SAME = "((long_rate > 0 AND short_rate > 0) OR (long_rate < 0 AND short_rate < 0))"


def label(spread: str) -> str:
    pair = "'L:' || upper(substr(long_exchange,1,3)) || ' S:' || upper(substr(short_exchange,1,3))"
    return (
        f"CASE WHEN {spread} IS NULL THEN '–' WHEN {SAME} AND {spread} >= 50 THEN '🔥 ' || {pair} "
        f"WHEN {SAME} AND {spread} >= 25 THEN '🎯 ' || {pair} WHEN {spread} >= 25 THEN '⚡ ' || {pair} ELSE {pair} END"
    )


def capture(spread: str) -> str:
    return (
        f"CASE WHEN {spread} >= 25 AND long_rate > 0 AND short_rate > 0 THEN 'Both positive, ' || {fixed(spread, 0)} || 'bps spread' "
        f"WHEN {spread} >= 25 AND long_rate < 0 AND short_rate < 0 THEN 'Both negative, ' || {fixed(spread, 0)} || 'bps spread' END"
    )


def spread_class(s: str) -> str:
    return (
        f"CASE WHEN {s} IS NULL THEN '' WHEN {s} >= 50 THEN 'arb-extreme' WHEN {s} >= 25 THEN 'arb-very-high' "
        f"WHEN {s} >= 10 THEN 'arb-high' WHEN {s} >= 5 THEN 'arb-medium' ELSE 'arb-low' END"
    )


def pair_class(s: str) -> str:
    return (
        f"CASE WHEN {s} IS NULL THEN '' WHEN {SAME} AND {s} >= 25 THEN 'arb-combo-extreme-capture' "
        f"WHEN {s} >= 15 THEN 'arb-combo-excellent' WHEN {s} >= 8 THEN 'arb-combo-good' "
        f"WHEN {s} >= 4 THEN 'arb-combo-decent' ELSE 'arb-combo-minimal' END"
    )


def row_class(s: str) -> str:
    return (
        f"CASE WHEN {SAME} AND {s} >= 50 THEN 'row-extreme-capture' WHEN {SAME} AND {s} >= 25 THEN 'row-high-capture' "
        f"WHEN {s} >= 25 THEN 'row-high-spread' ELSE '' END"
    )


NAMES = "['Africa','America','Asia','Europe','Middle East']"
ARBS = f"""WITH lows AS (
  SELECT event_id, user_id, CAST(({VALUE} - 60)*CAST(0.0001 AS DECIMAL(6,4)) AS DECIMAL(18,10)) AS lo FROM events),
arbs AS (
  SELECT event_id,
    CASE WHEN event_id % 17 <> 0 THEN {NAMES}[user_id % 5 + 1] END AS long_exchange,
    CASE WHEN event_id % 17 <> 0 THEN {NAMES}[(user_id + 1) % 5 + 1] END AS short_exchange,
    CASE WHEN event_id % 17 <> 0 THEN CAST(lo AS DOUBLE) END AS long_rate,
    CASE WHEN event_id % 17 <> 0 THEN
      CAST(CAST(lo + (event_id % 13)*CAST(0.0005 AS DECIMAL(6,4)) AS DECIMAL(18,10)) AS DOUBLE) END AS short_rate
  FROM lows),
pairs AS (SELECT *, (short_rate - long_rate)*10000.0 AS spread FROM arbs) """

PRICES = (
    f"coalesce(CASE WHEN event_id % 2 <> 0 THEN {VALUE} END, CASE WHEN event_id % 4 <> 0 THEN {VALUE} + 1 END, "
    f"CASE WHEN event_id % 8 <> 0 THEN {VALUE} + 2 END)"
)


def _unique(table: str, *keys: str) -> str:
    k = ", ".join(keys)
    return (
        f"SELECT '{table}: unique {k}' AS \"constraint\", count(*) AS violations FROM "
        f"(SELECT {k} FROM c_{table} GROUP BY {k} HAVING count(*) > 1)"
    )


def _not_null(table: str, *columns: str) -> str:
    return (
        f"SELECT '{table}: not null {', '.join(columns)}', count(*) FROM c_{table} WHERE "
        + " OR ".join(f"{c} IS NULL" for c in columns)
    )


def _refers(table: str, column: str, parent: str) -> str:
    return (
        f"SELECT '{table}: {column} in {parent}', count(*) FROM c_{table} x WHERE x.{column} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM c_{parent} p WHERE p.id = x.{column})"
    )


def _appended(rows: str, columns: str) -> str:
    """First row per (market, second): earlier batch first, then event id."""
    return f"""{BASE}, raw AS ({rows}),
batches AS (SELECT *, 1 AS batch FROM raw WHERE ts < TIMESTAMP '2024-01-20'
  UNION ALL SELECT *, 2 FROM raw WHERE ts >= TIMESTAMP '2024-01-15'
  UNION ALL SELECT *, 3 FROM raw WHERE ts >= TIMESTAMP '2024-01-15'),
ranked AS (SELECT * EXCLUDE (ts), date_trunc('second', ts) AS ts,
  row_number() OVER (PARTITION BY market_id, date_trunc('second', ts) ORDER BY batch, event_id) AS rn FROM batches)
SELECT {columns} FROM ranked WHERE rn = 1"""


MARKS = """, marks AS (
  SELECT m.id AS market_id, m.exchange_id, m.market_symbol, max(f.ts) AS last_ts FROM fx_markets m
  LEFT JOIN fx_carry f ON f.market_id = m.id AND f.ts < TIMESTAMP '2024-01-20'
  WHERE m.is_active GROUP BY ALL)"""

OPEN_MS = f"{READ_AT_MS} - 24*3600000"

SUFFIXES = "['-PERP','-perps','-Perp','PERP','-PERPX','-PERP-C']"
SPELLED = "['AFRICA','america','aSIA','Europe','middle EAST','nowhere']"

WORDS = "regexp_extract_all(lower({x}), '[a-z0-9]+|[^a-z0-9]+')"

ONCE = """, once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market_id, date_trunc('second', ts) ORDER BY ts, event_id) AS rn FROM fx_ticks)
  WHERE rn = 1),
f8_once AS (
  SELECT exchange_id, market_id, time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01') AS bucket_start,
         CAST(SUM(rate) AS DOUBLE)/COUNT(*) AS rate_8h, COUNT(*) AS samples FROM once GROUP BY ALL)"""

JOB_BOARD = f"""WITH jm AS (
  SELECT DISTINCT user_id, 'TKN' || CAST(floor(user_id/2.0) AS BIGINT) AS token,
    CASE WHEN user_id % 2 = 0 THEN 'Paradex' ELSE 'Extended' END AS exchange FROM events
  WHERE user_id % 2 = 0 OR user_id % 20 <> 7),
ticks AS (SELECT user_id, {RATE} AS rate, ts,
    row_number() OVER (PARTITION BY user_id, date_trunc('second', ts) ORDER BY ts) AS rn
  FROM events WHERE event_type <> 'purchase'),
jb AS (SELECT user_id, time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01') AS b,
    CAST(sum(rate) AS DOUBLE)/count(*) AS r FROM ticks WHERE rn = 1 GROUP BY ALL),
jf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b DESC) AS rn FROM jb) WHERE rn = 1),
js AS (SELECT * FROM (SELECT user_id, {VALUE} * CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS oi,
    row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) DESC, ts) AS rn
  FROM events WHERE event_type = 'purchase') WHERE rn = 1),
served AS (SELECT jm.token, jm.exchange, coalesce(jf.r, 0.0) AS carry_rate, CAST(coalesce(js.oi, 0) AS DECIMAL(30,10)) AS oi
  FROM jm LEFT JOIN jf ON jf.user_id = jm.user_id LEFT JOIN js ON js.user_id = jm.user_id)""" + SPREADS + _pairs("served") + """
SELECT s.token, s.total_oi, s.spread, b.long_exchange, b.short_exchange, b.long_rate, b.short_rate, b.combined_oi
FROM spreads s LEFT JOIN best b ON b.token = s.token"""

JOB_FACTS = """WITH e AS (SELECT *, user_id % 2 = 0 AS even, user_id % 2 = 0 OR user_id % 20 <> 7 AS active,
    event_type = 'purchase' AS bought, date_trunc('second', ts) AS s FROM events)
SELECT CASE WHEN even THEN 'Paradex' ELSE 'Extended' END AS exchange,
  concat('TKN', CAST(CAST(floor(user_id/2.0) AS BIGINT) AS VARCHAR), '-USD-PERP') AS market_symbol,
  count(DISTINCT s) FILTER (NOT bought AND {tick}) AS ticks,
  min(s) FILTER (NOT bought AND {tick}) AS first_tick, max(s) FILTER (NOT bought AND {tick}) AS last_tick,
  count(DISTINCT s) FILTER (bought AND {stat}) AS stats, max(s) FILTER (bought AND {stat}) AS last_stats,
  count(*) FILTER (NOT bought AND NOT active AND {waits}) AS waiting_ticks,
  count(*) FILTER (bought AND NOT active AND {waits_stat}) AS waiting_stats
FROM e WHERE {of} GROUP BY even, user_id"""

ORACLE: dict[str, str] = {
    "norm_markets_a": BASE + """
SELECT 'paradex' AS exchange, split_part(market_symbol,'-',1) AS symbol,
  CASE WHEN id % 2 = 0 THEN market_symbol ELSE lower(market_symbol) || 's' END AS market_symbol,
  split_part(market_symbol,'-',1) AS base_currency, 'USD' AS quote_currency, TRUE AS is_active FROM fx_markets""",
    "norm_stats_a": BASE + f""", priced AS (
  SELECT *, CASE WHEN event_id % 2 <> 0 THEN event_id % 1000 + 1 WHEN event_id % 4 <> 0 THEN event_id % 1000 + 2
                 WHEN event_id % 8 <> 0 THEN event_id % 1000 + 3 END AS quarter FROM fx_purchases)
SELECT {SYMBOL} AS market_symbol,
  CASE WHEN event_id % 7 <> 0 THEN CAST({VALUE} * CAST(quarter * 25 AS DECIMAL(18,0)) * CAST('0.01' AS DECIMAL(2,2)) AS DECIMAL(30,10)) END AS open_interest,
  CASE WHEN event_id % 5 <> 0 THEN CAST({VALUE} AS DECIMAL(30,10)) END AS volume_24h, ts FROM priced""",
    "norm_carry_a": BASE + "\nSELECT market_symbol, rate, date_trunc('milliseconds', ts) AS ts FROM fx_ticks",
    "norm_markets_b": BASE + """
SELECT 'extended' AS exchange, 'TKN' || token_id AS symbol,
  CASE WHEN id % 7 = 0 THEN CAST(id AS VARCHAR) ELSE id || '-USD' END AS market_symbol,
  'TKN' || token_id AS base_currency, CASE WHEN id % 7 = 0 THEN '' ELSE 'USD' END AS quote_currency, is_active
FROM fx_markets""",
    "norm_carry_b": BASE + "\nSELECT market_symbol, rate, date_trunc('milliseconds', ts) AS ts FROM fx_ticks",
    "norm_stats_b": BASE + f"""
SELECT {SYMBOL} AS market_symbol, CAST({VALUE} AS DECIMAL(30,10)) AS open_interest,
  CAST({VALUE}*10 AS DECIMAL(30,10)) AS volume_24h, ts FROM fx_purchases""",
    "norm_all": BASE + """
SELECT CASE WHEN user_id % 3 = 0 THEN 'paradex' ELSE 'extended' END AS exchange, market_symbol, rate,
  date_trunc('milliseconds', ts) AS ts FROM fx_ticks WHERE user_id % 3 <> 2""",
    "norm_skipped": BASE + """
SELECT 'Elsewhere' AS exchange, count(*) AS responses FROM fx_ticks WHERE user_id % 3 = 2 HAVING count(*) > 0""",
    "unnest_batch": BASE + "\nSELECT market_id, rate, ts FROM fx_ticks",
    "active_exchanges": BASE + "\nSELECT id, name FROM fx_exchange_table WHERE is_active ORDER BY name",
    "active_markets": BASE + """
SELECT id, market_symbol FROM fx_markets WHERE exchange_id = 3 AND is_active ORDER BY market_symbol""",
    "matrix_document": BASE + """
SELECT token, exchange, market_symbol, carry_rate, CAST(oi AS DOUBLE) AS open_interest, CAST(volume AS DOUBLE) AS volume_24h,
  strftime(carry_bucket, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS carry_ts,
  strftime(stats_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stats_ts FROM served""",
    "matrix_health": BASE + "\nSELECT count(*) AS tokens, max(last_update) AS last_updated FROM token_update",
    "health_document": BASE + """
SELECT concat('{"ok":true,"tokens":', count(*), ',"last_updated":"', strftime(max(last_update), '%Y-%m-%dT%H:%M:%S'), 'Z"}') AS document
FROM token_update""",
    "perp_filter": f"""SELECT event_id, symbol FROM (
  SELECT event_id, {TOKEN} || '-' || event_id || {SUFFIXES}[event_id % 6 + 1] AS symbol FROM events)
WHERE upper(symbol) LIKE '%-PERP' OR upper(symbol) LIKE '%-PERPS'""",
    "price_fallback": f"SELECT event_id, CAST({PRICES} AS DECIMAL(20,2)) AS price FROM events",
    "oi_usd": f"""WITH p AS (SELECT *, (CAST((user_id*3+1) * 10000000000000 + event_id AS HUGEINT)
    * (CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) * 7919 + event_id % 1000) + 50000000) // 100000000 AS units FROM events)
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN
  CAST(CAST(user_id*3+1 AS DECIMAL(18,0)) * CAST({PRICES} AS DECIMAL(18,2)) AS DECIMAL(30,10)) END AS open_interest,
  CAST(concat(units // 10000000000, '.', lpad(CAST(units % 10000000000 AS VARCHAR), 10, '0')) AS DECIMAL(30,10)) AS tiny_price FROM p""",
    "epoch_ms_to_second": "SELECT event_id, date_trunc('second', ts) AS ts FROM events",
    "exchange_lookup_ci": BASE + f"""
SELECT e.event_id, x.id AS exchange_id, x.name AS exchange
FROM (SELECT event_id, {SPELLED}[event_id % 6 + 1] AS name FROM events) e
JOIN fx_exchange_table x ON lower(x.name) = lower(e.name) WHERE x.is_active""",
    "normalize_names": "SELECT s_suppkey, array_to_string(list_transform("
    + WORDS.format(x="concat(s_name, '-dEX x1.', CAST(s_suppkey AS VARCHAR), 'ab')")
    + ", lambda w: upper(w[1]) || w[2:]), '') AS name FROM supplier",
    "bucket_8h": """SELECT event_id, date_trunc('hour', ts) - to_hours(CAST(extract(hour FROM ts) % 8 AS INTEGER)) AS bucket_start
FROM events""",
    "cell_defaults": f"""SELECT event_id,
  CASE WHEN event_id % 4 <> 1 THEN 'M' || user_id ELSE '' END AS market_symbol,
  CASE WHEN event_id % 4 <> 3 THEN CAST({VALUE} AS DOUBLE) ELSE 0.0 END AS carry_rate,
  CASE WHEN event_id % 4 <> 3 THEN CAST({VALUE} AS DOUBLE) ELSE 0.0 END AS open_interest,
  CAST(0 AS DOUBLE) AS volume_24h,
  CASE event_id % 4 WHEN 0 THEN '2024-01-01T00:00:00+00:00' WHEN 1 THEN '2023-12-31T16:00:00+00:00' END AS carry_ts,
  CASE WHEN event_id % 4 = 2 THEN '2024-01-02T00:00:00+00:00' END AS stats_ts FROM events""",
    "fmt_number": f"""SELECT event_id, {number_text('v')} AS text FROM (
  SELECT event_id, value * CAST([1,10,1000,100000,1000000,100000000,1000000000][event_id % 7 + 1] AS DOUBLE)
    * CASE WHEN event_id % 11 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS v FROM events)""",
    "fmt_rate": f"""SELECT event_id, {rate_text('r')} AS rate_text, {fixed(apr('r'), 2)} || '%' AS apr_text, {apr('r')} AS rate_apr
FROM (SELECT event_id, CAST({RATE} AS DOUBLE) AS r FROM events)""",
    "fmt_spread": f"""SELECT event_id, {spread_text('s')} AS percent_text, {bps_text('s')} AS bps_text
FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS s FROM events)""",
    "arb_label": ARBS + f"SELECT event_id, {label('spread')} AS label FROM pairs",
    "capture_info": ARBS + f"SELECT event_id, {capture('spread')} AS capture FROM pairs",
    "spread_class": ARBS + f"SELECT event_id, {spread_class('spread')} AS class FROM pairs",
    "opportunity_class": ARBS + f"SELECT event_id, {pair_class('spread')} AS class FROM pairs",
    "row_class": ARBS + f"SELECT event_id, {row_class('spread')} AS class FROM pairs",
    "market_dim": BASE + """
SELECT m.id AS market_id, m.exchange_id, e.name AS exchange, m.token_id, t.symbol AS token, m.market_symbol
FROM fx_markets m JOIN fx_tokens t ON t.id = m.token_id JOIN fx_exchanges e ON e.id = m.exchange_id WHERE m.is_active""",
    "stats_by_symbol": BASE + """
SELECT s.user_id AS market_id, CAST(CAST(s.value AS DECIMAL(18,2))*100000 AS DECIMAL(30,10)) AS open_interest,
  CAST(CAST(s.value AS DECIMAL(18,2))*1000000 AS DECIMAL(30,10)) AS volume_24h, date_trunc('second', s.ts) AS ts
FROM fx_purchases s WHERE s.event_id % 9 <> 0""",
    "carry_8h": BASE + "\nSELECT * FROM f8",
    "latest_carry_8h": BASE + "\nSELECT * FROM latest_f8",
    "latest_market_stats": BASE + "\nSELECT * FROM latest_stats",
    "carry_matrix": BASE + """
SELECT c.token AS symbol, c.exchange, c.market_symbol, c.rate_8h AS carry_rate_8h, c.carry_bucket,
  CAST(c.open_interest AS DOUBLE) AS open_interest, CAST(c.volume_24h AS DOUBLE) AS volume_24h, c.stats_ts, u.last_update
FROM cells c JOIN token_update u ON u.token = c.token""",
    "token_last_update": BASE + "\nSELECT * FROM token_update",
    "total_open_interest": BASE + "\nSELECT token, CAST(sum(oi) AS DOUBLE) AS total_oi FROM served GROUP BY token",
    "arb_spread": BASE + SPREADS + "\nSELECT token, spread FROM spreads",
    "best_arb": BASE + _pairs("served") + "\nSELECT * FROM best",
    "best_arb_known_rates": BASE
    + ", known AS (SELECT * FROM served WHERE rate_8h IS NOT NULL)"
    + _pairs("known")
    + "\nSELECT * FROM best",
    "carry_hwm": BASE + """
SELECT m.id AS market_id, m.exchange_id, m.market_symbol, max(f.ts) AS last_ts
FROM fx_markets m LEFT JOIN fx_carry f ON f.market_id = m.id WHERE m.is_active GROUP BY ALL""",
    "exchange_header": BASE + "\nSELECT DISTINCT exchange FROM cells ORDER BY exchange",
    "matrix_wide": BASE + "\nSELECT token, " + ", ".join(
        f"max(CASE WHEN exchange = '{n}' THEN carry_rate END) AS \"{n}_rate\", "
        f"max(CASE WHEN exchange = '{n}' THEN CAST(oi AS DOUBLE) END) AS \"{n}_oi\""
        for n in ("Africa", "America", "Asia", "Europe", "Middle East")
    ) + " FROM served GROUP BY token",
    "rate_class": BASE + SPREADS + "\nSELECT token, exchange, carry_rate, rate_class FROM classed",
    "carry_board": BASE + SPREADS + _pairs("served") + f""", listed AS (
  SELECT token, count(*) AS cells, string_agg(rate_class, ',' ORDER BY exchange) AS rate_classes,
    string_agg({rate_text('carry_rate')}, ',' ORDER BY exchange) AS rate_texts,
    string_agg('$' || {number_text('open_interest')}, ',' ORDER BY exchange) AS oi_texts
  FROM classed GROUP BY token),
joined AS (
  SELECT s.token, s.total_oi, s.spread AS token_spread, b.* EXCLUDE (token, spread), b.spread AS pair_spread,
    l.* EXCLUDE (token), u.last_update
  FROM spreads s LEFT JOIN best b ON b.token = s.token JOIN listed l ON l.token = s.token JOIN token_update u ON u.token = s.token)
SELECT token, total_oi, '$' || {number_text('total_oi')} AS total_oi_text, token_spread AS spread,
  {spread_text('token_spread')} AS spread_text, {spread_class('token_spread')} AS spread_class,
  {label('pair_spread')} AS pair_label, {capture('pair_spread')} AS capture_text,
  coalesce('$' || {number_text('combined_oi')}, '–') AS pair_oi_text,
  {pair_class('pair_spread')} AS pair_class, {row_class('pair_spread')} AS row_class,
  long_exchange, short_exchange, long_rate, short_rate, pair_spread, combined_oi,
  cells, rate_classes, rate_texts, oi_texts, last_update FROM joined""",
    "carry_board_annualized": BASE + SPREADS + f"""
SELECT s.token, {bps_text('any_value(s.spread)')} AS spread_text,
  string_agg({fixed(apr('c.carry_rate'), 2)} || '%', ',' ORDER BY c.exchange) AS rate_texts
FROM spreads s JOIN classed c ON c.token = s.token GROUP BY s.token""",
    "board_sorted": BASE + SPREADS + _pairs("served") + """
SELECT s.token, s.total_oi, s.spread, b.spread AS pair_spread FROM spreads s LEFT JOIN best b ON b.token = s.token
ORDER BY coalesce(b.spread, -1) DESC, s.token""",
    "upsert_exchanges": BASE + f""", asked AS (
  SELECT DISTINCT x.name FROM fx_exchanges x WHERE x.id % 2 = 1
  UNION SELECT array_to_string(list_transform({WORDS.format(x="n_name || '-dex'")}, lambda w: upper(w[1]) || w[2:]), '') FROM nation)
SELECT x.name, x.id AS known_id, x.carry_interval_minutes,
  x.is_active OR a.name IS NOT NULL AS is_active, x.created_at,
  CASE WHEN a.name IS NOT NULL AND NOT x.is_active THEN {NOW} ELSE x.updated_at END AS updated_at
FROM fx_exchange_table x LEFT JOIN asked a ON a.name = x.name
UNION ALL SELECT a.name, NULL, NULL, TRUE, {NOW}, {NOW} FROM asked a
WHERE a.name NOT IN (SELECT name FROM fx_exchange_table)""",
    "upsert_tokens": BASE + f"""
SELECT symbol, CASE WHEN id % 3 <> 0 THEN id END AS known_id, CASE WHEN id % 3 <> 0 THEN {T0} ELSE {NOW} END AS created_at
FROM fx_tokens""",
    "upsert_tokens_ids": BASE + """
SELECT count(*) AS tokens, count(*) AS ids,
  coalesce(max(CASE WHEN id % 3 <> 0 THEN id END), 0) + count(*) FILTER (WHERE id % 3 = 0) AS last_id FROM fx_tokens""",
    "upsert_markets": BASE + f""", incoming AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN NOT is_active ELSE is_active END AS active FROM fx_markets WHERE id % 5 <> 0 OR id % 4 = 0)
SELECT m.exchange_id, CASE WHEN m.id % 4 = 0 AND m.id % 7 = 0 THEN 0 ELSE m.token_id END AS token_id, m.market_symbol,
  coalesce(i.active, m.is_active) AS is_active, CASE WHEN m.id % 4 <> 0 THEN {T0} ELSE {NOW} END AS created_at,
  CASE WHEN i.id IS NOT NULL THEN {NOW} ELSE {T0} END AS updated_at
FROM fx_markets m LEFT JOIN incoming i ON i.id = m.id WHERE m.id % 4 <> 0 OR i.id IS NOT NULL""",
    "append_carry": _appended(
        "SELECT event_id, exchange_id, market_id, rate, ts FROM fx_ticks", "exchange_id, market_id, rate, ts"
    ),
    "append_stats": _appended(
        f"""SELECT event_id, user_id AS market_id, CAST({VALUE}*100000 AS DECIMAL(30,10)) AS open_interest,
        CAST({VALUE}*1000000 AS DECIMAL(30,10)) AS volume_24h, ts FROM fx_purchases""",
        "market_id, open_interest, volume_24h, ts",
    ),
    "set_interval": BASE + f"""
SELECT id, name, CAST(480 AS INTEGER) AS carry_interval_minutes, is_active, created_at,
  CASE WHEN carry_interval_minutes IS DISTINCT FROM 480 THEN {NOW} ELSE updated_at END AS updated_at FROM fx_exchange_table""",
    "cascade_delete": BASE + """, gone AS (SELECT id FROM fx_markets WHERE exchange_id = 3)
SELECT 'exchanges' AS table_name, count(*) AS row_count, CAST(sum(id) AS BIGINT) AS key_sum FROM fx_exchanges WHERE name <> 'Europe'
UNION ALL SELECT 'tokens', count(*), CAST(sum(id) AS BIGINT) FROM fx_tokens
UNION ALL SELECT 'markets', count(*), CAST(sum(id) AS BIGINT) FROM fx_markets WHERE exchange_id <> 3
UNION ALL SELECT 'carry_rates', count(*), CAST(sum(market_id) AS BIGINT) FROM fx_carry WHERE exchange_id <> 3
UNION ALL SELECT 'market_stats', count(*), CAST(sum(market_id) AS BIGINT) FROM fx_stats WHERE market_id NOT IN (SELECT id FROM gone)""",
    "constraint_report": BASE + """, c_exchanges AS (SELECT * FROM fx_exchange_table), c_tokens AS (SELECT * FROM fx_tokens),
c_markets AS (SELECT * EXCLUDE (market_symbol), CASE WHEN id % 13 <> 4 THEN market_symbol END AS market_symbol FROM fx_markets),
c_carry_rates AS (SELECT * FROM fx_carry UNION ALL
  SELECT exchange_id, market_id + 1000000000, rate, ts FROM fx_carry WHERE market_id % 97 = 5),
c_market_stats AS (SELECT * FROM fx_stats UNION ALL SELECT * FROM fx_stats WHERE market_id % 10 = 1)
""" + "\nUNION ALL ".join([
        _unique("exchanges", "id"), _unique("exchanges", "name"), _unique("tokens", "id"), _unique("tokens", "symbol"),
        _unique("markets", "id"), _unique("markets", "exchange_id", "market_symbol"),
        _unique("carry_rates", "market_id", "ts"), _unique("market_stats", "market_id", "ts"),
        _not_null("exchanges", "id", "name", "is_active"), _not_null("tokens", "id", "symbol"),
        _not_null("markets", "id", "exchange_id", "token_id", "market_symbol", "is_active"),
        _not_null("carry_rates", "exchange_id", "market_id", "rate", "ts"), _not_null("market_stats", "market_id", "ts"),
        _refers("markets", "exchange_id", "exchanges"), _refers("markets", "token_id", "tokens"),
        _refers("carry_rates", "exchange_id", "exchanges"), _refers("carry_rates", "market_id", "markets"),
        _refers("market_stats", "market_id", "markets"),
    ]),
    "resolve_windows": BASE + MARKS + f"""
SELECT 'between' AS spec, market_id, 1705000000000 AS start_ms, 1706000000000 AS end_ms FROM marks
UNION ALL SELECT 'lookback', market_id, {READ_AT_MS} - 48*3600000, {READ_AT_MS} FROM marks
UNION ALL SELECT 'since_last', market_id, coalesce(epoch_ms(last_ts) + 1, {OPEN_MS}), {READ_AT_MS} FROM marks
UNION ALL SELECT 'saturating', market_id, 0, {READ_AT_MS} FROM marks""",
    "incremental_extract": BASE + MARKS + f"""
SELECT t.exchange_id, t.market_id, t.rate, t.ts FROM fx_ticks t JOIN marks m ON m.market_id = t.market_id
WHERE epoch_us(t.ts) // 1000 BETWEEN coalesce(epoch_ms(m.last_ts) + 1, {OPEN_MS}) AND {READ_AT_MS}""",
    "stream_carry_8h": BASE + ONCE + "\nSELECT * FROM f8_once",
    "stream_latest_stats": BASE + "\nSELECT market_id, open_interest, volume_24h, ts FROM latest_stats",
    "stream_latest_carry": BASE + ONCE + """
SELECT exchange_id, market_id, rate_8h, bucket_start FROM (
  SELECT *, row_number() OVER (PARTITION BY exchange_id, market_id ORDER BY bucket_start DESC) AS rn FROM f8_once) WHERE rn = 1""",
    "job_init": JOB_BOARD,
    "stream_ingest": JOB_BOARD,
    "stream_carry_8h_table": BASE + ONCE + "\nSELECT * FROM f8_once",
    "job_late_markets": JOB_FACTS.format(
        of="TRUE", tick="active", stat="active AND NOT (even AND user_id % 7 = 2)", waits="TRUE", waits_stat="TRUE"
    ),
    "job_add_exchange": JOB_FACTS.format(of="NOT even", tick="active", stat="TRUE", waits="TRUE", waits_stat="FALSE"),
    "job_backfill": JOB_FACTS.format(
        of="even", tick="epoch_ms(ts) BETWEEN 1705000000000 AND 1706000000000", stat="NOT (user_id % 7 = 2)", waits="TRUE", waits_stat="TRUE"
    ),
}
