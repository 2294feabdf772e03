"""DuckDB SQL for the queries of ``catalog``, assembled from common table expressions.

Written for one machine: plain windows per key, whole-series folds. The point is an
independent statement of each result, not a fast one.
"""

CTES: dict[str, tuple[list[str], str]] = {}
ORACLE: dict[str, str] = {}


def cte(name, sql, *deps):
    CTES[name] = (list(deps), sql)


def sql(body, *deps):
    order = []

    def visit(n):
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for d in deps:
        visit(d)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


def oracle(name, body, *deps):
    ORACLE[name] = sql(body, *deps)


def r(expr, alias, digits=6):
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)::DOUBLE AS {alias}"


def money(expr, alias):
    return r(expr, alias, 2)


def rs(*names):
    return ", ".join(r(n, n) for n in names)


def ms(*names):
    return ", ".join(money(n, n) for n in names)


def pf(x):
    return (f"CASE WHEN sum({x}) FILTER ({x} < 0) < 0 THEN "
            f"abs(coalesce(sum({x}) FILTER ({x} > 0), 0) / (sum({x}) FILTER ({x} < 0))) END")


def bucketed(us, key="symbol"):
    return f"make_timestamp(epoch_us(ts) // {us} * {us})"


def bars_from(ticks, us):
    return (f"SELECT symbol, {bucketed(us)} AS ts, arg_min(price, seq) AS open, max(price) AS high, "
            f"min(price) AS low, arg_max(price, seq) AS close, count(*)::DOUBLE AS volume FROM {ticks} GROUP BY 1, 2")


M = 60_000_000
cte("ticks", "SELECT event_type AS symbol, ts, value + 1000.0::DOUBLE AS price, event_id AS seq FROM events")
cte("ticks_all", "SELECT 'ALL' AS symbol, ts, price, seq FROM ticks", "ticks")
cte("b1m", bars_from("ticks", M), "ticks")
cte("b15", bars_from("ticks", 15 * M), "ticks")
cte("b1h", bars_from("ticks", 60 * M), "ticks")
cte("b4h", bars_from("ticks", 240 * M), "ticks")
cte("ball", bars_from("ticks_all", 15 * M), "ticks_all")
cte("bars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ord FROM b15", "b15")

BAR = rs("open", "high", "low", "close", "volume")
oracle("bars_1h", f"SELECT symbol, ts, {BAR} FROM b1h", "b1h")
oracle("bars_15m", f"SELECT symbol, ts, {BAR}, ord::BIGINT AS ord FROM bars", "bars")


def windows(src, us):
    return (f"SELECT symbol, {bucketed(us)} AS window_start, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, "
            f"min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n FROM {src} GROUP BY 1, 2")


cte("w1h", windows("b15", 60 * M), "b15")
cte("w4h", windows("b15", 240 * M), "b15")
cte("wall", windows("ball", 240 * M), "ball")
oracle("resample_1h", f"SELECT symbol, ts, {BAR} FROM w1h WHERE n = 4", "w1h")
oracle("resample_4h", f"SELECT symbol, ts, {BAR} FROM wall WHERE n = 16", "wall")
oracle("resample_incomplete", "SELECT symbol, window_start, n::BIGINT AS count, 4::BIGINT AS expected FROM w1h "
       "WHERE n <> 4", "w1h")
oracle("resample_audit", " UNION ALL ".join(
    f"SELECT symbol, '{t}' AS target, sum(n)::BIGINT AS source_rows, count(*) FILTER (n = {per}) AS bars, "
    f"count(*) FILTER (n <> {per}) AS incomplete FROM {w} GROUP BY 1"
    for t, w, per in (("1h", "w1h", 4), ("4h", "w4h", 16))), "w1h", "w4h")

# Data quality
cte("dirty0", """SELECT symbol, ts, epoch_ms(ts) // 900000 AS n,
 CASE WHEN epoch_ms(ts) // 900000 % 17 = 0 THEN NULL ELSE open END AS open,
 CASE WHEN epoch_ms(ts) // 900000 % 29 = 0 THEN low - 1 ELSE high END AS high, low,
 CASE WHEN epoch_ms(ts) // 900000 % 23 = 0 THEN -close ELSE close END AS close,
 CASE WHEN epoch_ms(ts) // 900000 % 31 = 0 THEN -volume ELSE volume END AS volume FROM b15""", "b15")
cte("dirty", """SELECT symbol, ts, open, high, low, close, volume, n * 10 AS ingest_id FROM dirty0
 UNION ALL SELECT symbol, ts, open, high, low, close, volume, n * 10 + 35 FROM dirty0 WHERE n % 11 = 0""", "dirty0")
cte("dirty_prev", """SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ingest_id) AS prev,
 row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_id) AS nth FROM dirty""", "dirty")
_issue = []
for _f in ("open", "high", "low", "close", "volume"):
    _issue.append(f"SELECT symbol, ingest_id, 'error' AS severity, 'nan' AS type, '{_f}' AS field, "
                  f"'{_f} is not a finite number' AS message FROM dirty_prev WHERE {_f} IS NULL")
for _sev, _type, _msg, _cond in [
    ("error", "non-positive-close", "close must be > 0", "close IS NULL OR close <= 0"),
    ("error", "ohlc", "high < low", "high < low"),
    ("error", "ohlc", "high must be >= open/close",
     "NOT coalesce(high < low, false) AND (coalesce(high < open, false) OR coalesce(high < close, false))"),
    ("error", "ohlc", "low must be <= open/close",
     "NOT coalesce(high < low, false) AND NOT (coalesce(high < open, false) OR coalesce(high < close, false)) "
     "AND (coalesce(low > open, false) OR coalesce(low > close, false))"),
    ("error", "negative-volume", "volume must be >= 0", "volume < 0"),
    ("error", "out-of-order", "timestamp is not strictly greater than previous", "ts <= prev"),
    ("warning", "duplicate-timestamp", "duplicate timestamp", "nth > 1"),
]:
    _issue.append(f"SELECT symbol, ingest_id, '{_sev}', '{_type}', '', '{_msg}' FROM dirty_prev WHERE {_cond}")
cte("issues", " UNION ALL ".join(_issue), "dirty_prev")
oracle("quality_issues", "SELECT * FROM issues", "issues")
cte("dirty_delta", "SELECT *, epoch_ms(ts) - epoch_ms(prev) AS d FROM dirty_prev", "dirty_prev")
cte("dirty_med", "SELECT symbol, list_sort(list(d) FILTER (d IS NOT NULL))[count(d) // 2 + 1] AS med FROM dirty_delta "
    "GROUP BY 1", "dirty_delta")
cte("dirty_gaps", "SELECT symbol, ingest_id, d, med FROM dirty_delta JOIN dirty_med USING (symbol) WHERE d > 5 * med",
    "dirty_med")
oracle("gap_warnings", "SELECT symbol, ingest_id, d AS delta_ms, med AS median_interval_ms FROM dirty_gaps", "dirty_gaps")
oracle("quality_summary", """SELECT t.symbol, total, total - errors AS valid, errors, nan_count, invalid_ohlc_count,
 non_positive_close_count, duplicate_count, coalesce(gap_count, 0) AS gap_count, med AS median_interval_ms, largest_gap_ms
 FROM (SELECT symbol, count(*) AS total FROM dirty GROUP BY 1) t
 JOIN (SELECT symbol, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (type = 'nan') AS nan_count,
  count(*) FILTER (type = 'ohlc') AS invalid_ohlc_count,
  count(*) FILTER (type = 'non-positive-close') AS non_positive_close_count,
  count(*) FILTER (type = 'duplicate-timestamp') AS duplicate_count FROM issues GROUP BY 1) i USING (symbol)
 LEFT JOIN (SELECT symbol, count(*) AS gap_count, max(d) AS largest_gap_ms FROM dirty_gaps GROUP BY 1) g USING (symbol)
 JOIN dirty_med USING (symbol)""", "issues", "dirty_gaps")
oracle("dedupe_first", f"SELECT symbol, ts, {BAR}, ingest_id FROM dirty_prev WHERE nth = 1", "dirty_prev")
cte("sorted_steps", """SELECT symbol, epoch_ms(ts) AS at_ms, epoch_ms(ts) - lag(epoch_ms(ts)) OVER
 (PARTITION BY symbol ORDER BY ts, ingest_id) AS delta_ms FROM dirty""", "dirty")
cte("gaps", """SELECT *, greatest(floor(delta_ms / 900000.0 + 0.5) - 1, 0)::BIGINT AS missing FROM sorted_steps
 WHERE delta_ms <> 900000""", "sorted_steps")
oracle("gap_list", "SELECT symbol, at_ms, delta_ms, missing FROM gaps", "gaps")
oracle("continuity", """SELECT s.symbol, (last_ms - first_ms) // 900000 + 1 AS expected_bars, actual_bars, duplicate_bars,
 greatest(coalesce(missing, 0), (last_ms - first_ms) // 900000 + 1 - uniq)::BIGINT AS missing_bars,
 coalesce(gap_count, 0) AS gap_count, coalesce(largest, 0) AS largest_gap_ms, first_ms, last_ms
 FROM (SELECT symbol, count(*) AS actual_bars, count(*) - count(DISTINCT at_ms) AS duplicate_bars,
  count(DISTINCT at_ms) AS uniq, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM sorted_steps GROUP BY 1) s
 LEFT JOIN (SELECT symbol, sum(missing) AS missing, count(*) AS gap_count, max(delta_ms) AS largest FROM gaps GROUP BY 1) g
 USING (symbol)""", "gaps")
oracle("interval_estimate", """SELECT symbol, m AS interval_ms, CASE WHEN m % 60000 = 0 THEN (m // 60000) || 'm'
 ELSE floor(m / 1000.0 + 0.5)::BIGINT || 's' END AS label
 FROM (SELECT symbol, list_sort(list(d))[count(*) // 2 + 1] AS m FROM dirty_delta WHERE d > 0 GROUP BY 1)""", "dirty_delta")

# Carry events and marks
cte("cev", "SELECT symbol, ts AS event_time, (open - 1000.0::DOUBLE - 50) / 100000 AS rate FROM b1h", "b1h")
cte("marks", "SELECT symbol, ts AS open_time, open, close FROM b1m", "b1m")
cte("marked", """SELECT e.*, CASE WHEN m.open_time = e.event_time THEN m.open
  WHEN epoch_ms(e.event_time) - epoch_ms(m.open_time) <= 300000 THEN m.close END AS mark_price,
 CASE WHEN m.open_time IS NULL THEN 'NO_DATA' WHEN m.open_time = e.event_time THEN 'EXACT_OPEN'
  WHEN epoch_ms(e.event_time) - epoch_ms(m.open_time) <= 300000 THEN 'PREVIOUS_FALLBACK' ELSE 'TOO_STALE' END AS mark_status,
 epoch_ms(e.event_time) - epoch_ms(m.open_time) AS staleness_ms
 FROM cev e ASOF LEFT JOIN marks m ON e.symbol = m.symbol AND e.event_time >= m.open_time""", "cev", "marks")
oracle("asof_mark", f"SELECT symbol, event_time, {r('rate', 'rate')}, {r('mark_price', 'mark_price')}, mark_status, "
       "staleness_ms FROM marked", "marked")
_used = "FILTER (mark_status IN ('EXACT_OPEN', 'PREVIOUS_FALLBACK'))"
oracle("mark_coverage", f"""SELECT symbol, count(*) AS events, count(*) FILTER (mark_status = 'EXACT_OPEN') AS exact_open,
 count(*) FILTER (mark_status = 'PREVIOUS_FALLBACK') AS previous_fallback,
 count(*) FILTER (mark_status = 'TOO_STALE') AS too_stale, count(*) FILTER (mark_status = 'NO_DATA') AS no_data,
 {r(f'avg(staleness_ms) {_used}', 'avg_staleness_ms')}, max(staleness_ms) {_used} AS max_staleness_ms
 FROM marked GROUP BY 1""", "marked")
oracle("asof_backward", f"""SELECT t.symbol, t.seq, b.ts AS open_time, {r('b.open', 'open')}
 FROM ticks t ASOF LEFT JOIN b1h b ON t.symbol = b.symbol AND t.ts >= b.ts""", "b1h")
oracle("carry_integrity", """SELECT symbol, min(epoch_ms(event_time)) AS first_time, max(epoch_ms(event_time)) AS last_time,
 count(*) AS event_count, 0::BIGINT AS duplicate_count, 0::BIGINT AS invalid_rate_count, 0::BIGINT AS invalid_time_count,
 count(*) FILTER (rate > 0) AS positive_events, count(*) FILTER (rate < 0) AS negative_events,
 count(*) FILTER (rate = 0) AS zero_events, false AS out_of_order, max(event_time) >= TIMESTAMP '2026-01-01' AS holdout_violation,
 '' AS issues, 'OK' AS status FROM cev GROUP BY 1""", "cev")
oracle("holdout_integrity", """SELECT symbol, bars, 0::BIGINT AS duplicate_bars, gaps, events, 0::BIGINT AS duplicate_events,
 synthetic_events, events - synthetic_events AS official_events,
 CASE WHEN gaps = 0 AND synthetic_events = 0 AND bars > 0 THEN 'PASS' ELSE 'FAIL' END AS status
 FROM (SELECT symbol, count(*) AS bars, count(*) FILTER (d > 1350000) AS gaps FROM
  (SELECT symbol, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM b15) GROUP BY 1)
 JOIN (SELECT symbol, count(*) AS events, count(*) FILTER (rate < -0.00049) AS synthetic_events FROM cev GROUP BY 1)
 USING (symbol)""", "b15", "cev")
oracle("common_end", """SELECT min(m) AS common_end, min(m) >= TIMESTAMP '2024-01-15' AS valid_period FROM
 (SELECT symbol, max(ts) AS m FROM (SELECT symbol, ts FROM b15 UNION ALL SELECT symbol, event_time FROM cev) GROUP BY 1)""",
       "b15", "cev")
oracle("provenance", """SELECT symbol, min(epoch_ms(event_time)) AS first_time, max(epoch_ms(event_time)) AS last_time,
 count(*) AS events, count(mark_price) AS direct_marks, count(*) - count(mark_price) AS missing_marks,
 0::BIGINT AS duplicates, 0::BIGINT AS invalid, count(*) FILTER (rate > 0) AS positive,
 count(*) FILTER (rate < 0) AS negative, count(*) FILTER (rate = 0) AS zero, 0::BIGINT AS synthetic FROM marked GROUP BY 1""",
       "marked")
oracle("split_segments", """SELECT symbol, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'test' END AS segment,
 count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM b15 WHERE ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2""", "b15")
oracle("period_slices", f"""SELECT symbol, period, count(*) AS bars, {r('max(high)', 'high')}, {r('min(low)', 'low')}
 FROM b15 JOIN (VALUES ('DISCOVERY', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16'),
 ('VALIDATION', TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-24'), ('HOLDOUT', TIMESTAMP '2024-01-24', TIMESTAMP '2024-02-01'),
 ('FULL', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01')) p(period, a, b) ON ts >= a AND ts < b GROUP BY 1, 2""", "b15")


# Indicators
def fold_ema(values, p, first="0.0::DOUBLE"):
    k = 2.0 / (p + 1)
    seed = f"list_reduce({values}[1:{p}], lambda a, x: a + x, 0.0::DOUBLE) / {p}.0::DOUBLE"
    return f"list_reduce({values}[{p + 1}:], lambda e, x: x * {k!r}::DOUBLE + e * {1 - k!r}::DOUBLE, {seed})"


W = "PARTITION BY symbol ORDER BY ts"
cte("buf", f"SELECT *, list(close) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS buf, "
    f"close - lag(close) OVER ({W}) AS diff, lag(close) OVER ({W}) AS pc FROM bars", "bars")
cte("emas", "SELECT *, " + ", ".join(
    f"CASE WHEN ord >= {p - 1} THEN {fold_ema('buf', p)} END AS ema{p}" for p in (9, 21, 50)) + " FROM buf", "buf")
oracle("ema_buffered", f"SELECT symbol, ts, {rs('ema9', 'ema21', 'ema50')} FROM emas", "emas")
cte("gl", f"""SELECT *, sum(greatest(diff, 0)) OVER w / 14 AS gain, sum(greatest(-diff, 0)) OVER w / 14 AS loss FROM emas
 WINDOW w AS ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""", "emas")
cte("rsis", "SELECT *, CASE WHEN ord >= 14 THEN CASE WHEN loss = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + gain / loss) END END "
    "AS rsi FROM gl", "gl")
oracle("rsi14", f"SELECT symbol, ts, {rs('rsi')} FROM rsis", "rsis")
cte("hist", f"""SELECT *, CASE WHEN ord >= 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
 list(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS all_close FROM buf""", "buf")
oracle("true_range", f"SELECT symbol, ts, {r('tr', 'true_range')} FROM hist", "hist")
cte("trs", f"SELECT *, list(tr) FILTER (tr IS NOT NULL) OVER ({W} ROWS UNBOUNDED PRECEDING) AS all_tr FROM hist", "hist")
cte("longs0", "SELECT * EXCLUDE (buf, all_close, all_tr), " + ", ".join(
    f"CASE WHEN ord >= {p - 1} THEN {fold_ema('all_close', p)} END AS l{p}" for p in (9, 21, 50)) + """,
 CASE WHEN ord >= 14 THEN list_reduce(all_tr[15:], lambda a, x: (a * 13 + x) / 14,
 list_reduce(all_tr[1:14], lambda a, x: a + x, 0.0::DOUBLE) / 14) END AS atr14 FROM trs""", "trs")
cte("longs", f"""SELECT *, lag(l50) OVER ({W}) AS l50p, CASE WHEN ord >= 20 THEN l9 > l21 END AS above FROM longs0""", "longs0")
cte("flips", f"SELECT *, coalesce(above <> lag(above) OVER ({W}), false)::INT AS flip FROM longs", "longs")
cte("feats", f"""SELECT symbol, ts, ord, close AS entry_signal_close, l9 AS ema9, l21 AS ema21, l50 AS ema50,
 (l9 - l21) / close * 100 AS ema_spread_pct, (l50 - l50p) / l50p * 100 AS ema50_slope_pct,
 CASE WHEN l50p IS NULL THEN NULL WHEN l50 > l50p THEN 1 ELSE -1 END::BIGINT AS ema50_slope_sign,
 atr14 / close * 100 AS atr_pct, atr14,
 CASE WHEN count(ret) OVER w24 >= 2 THEN stddev_pop(ret) OVER w24 * 100 END AS entry_volatility_pct,
 (close / lag(close, 96) OVER ({W}) - 1) * 100 AS prev24h_return_pct,
 (close / lag(close, 288) OVER ({W}) - 1) * 100 AS prev72h_return_pct, volume AS entry_volume,
 volume / avg(volume) OVER ({W} ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING) AS volume_ratio,
 (sum(flip) OVER ({W} ROWS BETWEEN 95 PRECEDING AND CURRENT ROW))::BIGINT AS crosses_24h,
 (sum(flip) OVER ({W} ROWS BETWEEN 287 PRECEDING AND CURRENT ROW))::BIGINT AS crosses_72h
 FROM (SELECT *, close / pc - 1 AS ret FROM flips) WINDOW w24 AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""", "flips")
oracle("long_averages", f"""SELECT symbol, ts, {rs('ema9', 'ema21', 'ema50', 'atr_pct', 'ema50_slope_pct', 'ema_spread_pct')},
 ema50_slope_sign FROM feats""", "feats")
oracle("cross_counts", "SELECT symbol, ts, crosses_24h, crosses_72h FROM feats", "feats")
oracle("rolling_features", f"""SELECT symbol, ts, {r('entry_volatility_pct', 'volatility_pct')}, {r('prev24h_return_pct', 'ret_96')},
 {r('prev72h_return_pct', 'ret_288')}, {rs('volume_ratio')} FROM feats""", "feats")
oracle("prior_high", "SELECT symbol, ts, " + ", ".join(
    r(f"max(high) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)", f"high_{n}") for n in (6, 24, 96)) + " FROM bars", "bars")


def fwd(h):
    f = f"OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"(max(high) {f} / open - 1) * 100 AS fwd_mfe_{h}, (min(low) {f} / open - 1) * 100 AS fwd_mae_{h}"


cte("fwds", f"SELECT *, {fwd(4)}, {fwd(12)}, {fwd(24)} FROM bars", "bars")
oracle("forward_excursion", f"SELECT symbol, ts, {rs('fwd_mfe_12', 'fwd_mae_12')} FROM fwds", "fwds")
oracle("ticker_change", f"SELECT symbol, ts, {r('(close - open) / open * 100', 'change_pct')} FROM b1h", "b1h")

# Rules
cte("crs", f"""SELECT s.*, f.atr14, CASE WHEN s.ord >= 20 THEN s.ema9 > s.ema21 END AS st,
 CASE WHEN s.ord >= 49 THEN s.ema9 > s.ema21 END AS tt
 FROM rsis s JOIN feats f USING (symbol, ts)""", "rsis", "feats")
cte("cross2", f"""SELECT *, coalesce(st AND NOT lag(st) OVER w, false) AS sg, coalesce(NOT st AND lag(st) OVER w, false) AS sd,
 coalesce(tt AND NOT lag(tt) OVER w, false) AS tg, coalesce(NOT tt AND lag(tt) OVER w, false) AS td,
 lag(ema50) OVER w AS e50p, lag(ema9) OVER w AS e9p, lag(high) OVER w AS hp, lag(rsi) OVER w AS rp,
 lead(ts) OVER w AS nts, lead(open) OVER w AS nopen, lead(high) OVER w AS nhigh, lead(low) OVER w AS nlow, """ + ", ".join(
    f"max(high) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS h{n}" for n in (96,)) +
    f" FROM crs WINDOW w AS ({W})", "crs")
cte("cross3", f"""SELECT *, (sum((tg OR td)::INT) OVER (PARTITION BY symbol ORDER BY ts
 RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW)) AS day_crosses,
 coalesce(lag(sg) OVER ({W}), false) AS confirm FROM cross2""", "cross2")
_UP = "close > ema50 AND ema50 > e50p"
RULE_SQL = {
    "emaCrossover": ("sg", "sd"),
    "rsiEma": ("ord >= 51 AND close > ema50 AND ema9 > ema21 AND rsi > 40 AND rp <= 40 AND rsi < 55",
               "ord >= 51 AND (sd OR (rsi < 60 AND rp >= 60))"),
    "emaTrendFilter": (f"tg AND {_UP}", "td"),
    "emaTrendDensityFilter": (f"tg AND {_UP} AND day_crosses < 4", "td"),
    "emaTrendVolFilter": (f"tg AND {_UP} AND atr14 / close * 100 < 0.629", "td"),
    "emaConfirmation": ("confirm AND ema9 > ema21 AND close > hp", "sd"),
    "trendPullbackReclaim": (f"ord >= 50 AND {_UP} AND ema9 > ema21 AND pc <= e9p AND close > ema9", "td"),
    "breakout24hTrend": (f"ord >= 49 AND ord + 1 >= 96 AND {_UP} AND close > h96", "td"),
}
cte("sig", " UNION ALL ".join(
    f"SELECT symbol, '{name}' AS strategy, ord, ts, high, low, close, nts, nopen, nhigh, nlow, "
    f"coalesce({a}, false) AS set_long, coalesce({b}, false) AS reset FROM cross3" for name, (a, b) in RULE_SQL.items()), "cross3")
for _n in RULE_SQL:
    oracle(f"sig_{_n}", f"SELECT symbol, strategy, ts, set_long, reset FROM sig WHERE strategy = '{_n}' "
           "AND (set_long OR reset)", "sig")
# The breakouts over one day of longer bars.
for _n, _src, _day in (("breakout24h1h", "b1h", 24), ("breakout24h4h", "b4h", 6)):
    cte(f"o_{_src}", f"""SELECT *, row_number() OVER ({W}) - 1 AS ord, list(close) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS buf,
 max(high) OVER ({W} ROWS BETWEEN {_day} PRECEDING AND 1 PRECEDING) AS top FROM {_src}""", _src)
    cte(f"e_{_src}", "SELECT *, " + ", ".join(
        f"CASE WHEN ord >= {p - 1} THEN {fold_ema('buf', p)} END AS ema{p}" for p in (9, 21, 50)) + f" FROM o_{_src}", f"o_{_src}")
    oracle(f"sig_{_n}", f"""SELECT symbol, '{_n}' AS strategy, ts, set_long, reset FROM (SELECT symbol, ts,
 coalesce(ord >= 49 AND ord + 1 >= {_day} AND close > ema50 AND ema50 > lag(ema50) OVER w AND close > top, false) AS set_long,
 coalesce(NOT over AND lag(over) OVER w, false) AS reset FROM (SELECT *, CASE WHEN ord >= 49 THEN ema9 > ema21 END AS over FROM e_{_src})
 WINDOW w AS ({W})) WHERE set_long OR reset""", f"e_{_src}")

# Positions. K: run keys without costs.


def position_ctes(prefix, source, keys, dep):
    part = ", ".join(keys)
    w = f"PARTITION BY {part} ORDER BY ord"
    cte(f"{prefix}tc", f"SELECT *, sum((set_long AND reset)::INT) OVER ({w}) AS tc, CASE WHEN set_long AND NOT reset THEN 1 "
        f"WHEN reset AND NOT set_long THEN 0 END AS const FROM {source}", dep)
    cte(f"{prefix}st", f"SELECT *, (coalesce(last_value((const + tc) % 2 IGNORE NULLS) OVER ({w}), 0) + tc) % 2 AS st "
        f"FROM {prefix}tc", f"{prefix}tc")
    cte(f"{prefix}pv", f"SELECT *, coalesce(lag(st) OVER ({w}), 0) AS pv FROM {prefix}st", f"{prefix}st")
    cte(f"{prefix}held", f"""SELECT *, pv = 1 AS held, st = 1 AND pv = 0 AS up, st = 0 AND pv = 1 AS down,
 sum((st = 1 AND pv = 0)::INT) OVER ({w}) - (st = 1 AND pv = 0)::INT AS trade FROM {prefix}pv""", f"{prefix}pv")
    # A trade's bars: the bar whose signal opened it (nts / nopen are its fill), then all held bars.
    cte(f"{prefix}raw", f"""SELECT {part}, t AS trade_no, max(nts) FILTER (opens) AS entry_time,
 max(nopen) FILTER (opens) AS entry_raw, max(ord + 1) FILTER (opens) AS entry_ord,
 max(CASE WHEN closes THEN ord + 1 WHEN forced THEN ord END) AS exit_ord,
 max(CASE WHEN closes THEN nts WHEN forced THEN ts END) AS exit_time,
 max(CASE WHEN closes THEN nopen WHEN forced THEN close END) AS exit_raw, bool_or(forced) AS forced_exit,
 max(CASE WHEN held THEN greatest(high, CASE WHEN closes THEN nhigh ELSE high END) END) AS path_high,
 min(CASE WHEN held THEN least(low, CASE WHEN closes THEN nlow ELSE low END) END) AS path_low,
 sum(close) FILTER (held) AS held_close_sum
 FROM (SELECT *, up AND nts IS NOT NULL AS opens, down AND nts IS NOT NULL AS closes, held AND nts IS NULL AS forced,
  CASE WHEN up THEN trade + 1 ELSE trade END AS t FROM {prefix}held) WHERE held OR opens GROUP BY {part}, t""", f"{prefix}held")


SCEN = ("(VALUES ('GROSS', 0.0::DOUBLE, 0.0::DOUBLE), ('BASE', 0.0004::DOUBLE, 0.0002::DOUBLE), "
        "('STRESS', 0.0006::DOUBLE, 0.0005::DOUBLE)) s(scenario, commission, slippage)")


def ledger_ctes(prefix, keys, scen, sizes="(VALUES (100.0::DOUBLE)) z(size_pct)", carry="0.0::DOUBLE"):
    run = ", ".join([*keys, "scenario", "size_pct"])
    cte(f"{prefix}f", f"""SELECT *, 1 + size_pct / 100 * ((exit_price / entry_price) * (1 - commission) / (1 + commission) - 1
 - {carry} * held_close_sum / (entry_price * (1 + commission))) AS f FROM (SELECT *, entry_raw * (1 + slippage) AS entry_price,
 exit_raw * (1 - slippage) AS exit_price FROM {prefix}raw, {scen}, {sizes})""", f"{prefix}raw")
    cte(f"{prefix}cash", f"""SELECT *, 10000.0::DOUBLE * coalesce(product(f) OVER (PARTITION BY {run} ORDER BY entry_ord
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS cash_before FROM {prefix}f""", f"{prefix}f")
    cte(f"{prefix}qty", f"""SELECT *, cash_before * size_pct / 100 / (1 + commission) AS notional,
 cash_before * size_pct / 100 / (1 + commission) / entry_price AS quantity, cash_before * f AS cash_after FROM {prefix}cash""",
        f"{prefix}cash")
    cte(f"{prefix}led", f"""SELECT *, gross_pnl - fees AS net_pnl, (gross_pnl - fees) / notional * 100 AS return_pct,
 exit_ord - entry_ord AS holding_bars, (exit_price / entry_price - 1) * 100 AS gross_return_pct,
 (gross_pnl - fees) / notional * 100 AS net_return_pct,
 (exit_price / entry_price - 1) * 100 - (gross_pnl - fees) / notional * 100 AS cost_pct,
 greatest((path_high / entry_price - 1) * 100, 0) AS mfe, least((path_low / entry_price - 1) * 100, 0) AS mae
 FROM (SELECT *, (exit_price - entry_price) * quantity AS gross_pnl,
  notional * commission + exit_price * quantity * commission AS fees FROM {prefix}qty)""", f"{prefix}qty")


def equity_cte(prefix, bars, bar_keys, run_keys, runs, carry="0.0::DOUBLE"):
    keys = [*bar_keys, *run_keys]
    same = " AND ".join(f"b.{k} = t.{k}" for k in keys)
    part = ", ".join(f"b.{k}" for k in keys)
    cte(f"{prefix}eq0", f"""SELECT {part}, b.ord, b.ts, b.close, t.entry_ord, t.exit_ord, t.forced_exit, t.cash_before,
 t.cash_after, t.quantity, t.size_pct AS tsize FROM (SELECT * FROM {bars}, {runs}) b
 ASOF LEFT JOIN {prefix}led t ON {same} AND b.ord >= t.entry_ord""", f"{prefix}led")
    p = ", ".join(keys)
    cte(f"{prefix}eq", f"""SELECT *, entry_ord IS NOT NULL AND (ord < exit_ord OR (forced_exit AND ord = exit_ord)) AS in_position,
 CASE WHEN entry_ord IS NULL THEN 10000.0::DOUBLE WHEN ord >= exit_ord THEN cash_after
 ELSE cash_before * (1 - tsize / 100) + quantity * close - quantity * {carry} * sum(close) OVER (PARTITION BY {p}, entry_ord
 ORDER BY ord) END AS equity FROM {prefix}eq0""", f"{prefix}eq0")


K2 = ["symbol", "strategy"]
RUNC = "symbol, strategy, scenario, size_pct"
cte("sig3", "SELECT * FROM sig WHERE strategy IN ('emaCrossover', 'rsiEma', 'breakout24hTrend')", "sig")
position_ctes("m_", "sig3", K2, "sig3")
oracle("latch_held", "SELECT symbol, strategy, ts, held, up, down FROM m_held WHERE strategy <> 'rsiEma'", "m_held")
ledger_ctes("m_", K2, SCEN)
LEDGER = (f"entry_time, exit_time, forced_exit, holding_bars::BIGINT AS holding_bars, {rs('return_pct')}, "
          f"{ms('entry_price', 'exit_price', 'quantity', 'gross_pnl', 'fees', 'net_pnl')}")
oracle("ledger", f"SELECT {RUNC}, {LEDGER} FROM m_led", "m_led")
RUNS = ("(SELECT strategy, scenario, 100.0::DOUBLE AS size_pct FROM (VALUES ('emaCrossover'), ('rsiEma'), "
        f"('breakout24hTrend')) n(strategy), {SCEN}) q")
equity_cte("m_", "bars", ["symbol"], ["strategy", "scenario", "size_pct"], RUNS)
oracle("equity_curve", f"SELECT {RUNC}, ts, {ms('equity')}, in_position FROM m_eq WHERE strategy = 'emaCrossover'", "m_eq")


def metric_ctes(prefix, source, run, dep, millis=900000, capital="10000.0::DOUBLE"):
    w = f"PARTITION BY {run} ORDER BY ord"
    cte(f"{prefix}p", f"SELECT *, equity / lag(equity) OVER ({w}) - 1 AS br, max(equity) OVER ({w}) AS peak FROM {source}", dep)
    cte(f"{prefix}d", f"SELECT *, (peak - equity) / peak * 100 AS dd, peak - equity AS dda FROM {prefix}p", f"{prefix}p")
    years = f"((epoch_ms(t1) - epoch_ms(t0)) / 31536000000.0::DOUBLE)"
    scale = f"sqrt({365 * 86400000 / millis!r}::DOUBLE)"
    cte(f"{prefix}e", f"""SELECT {run}, start AS initial_capital, final_equity, (final_equity / start - 1) * 100 AS total_return_pct,
 CASE WHEN t1 > t0 AND final_equity > 0 THEN (pow(final_equity / start, 1 / {years}) - 1) * 100 END AS annualized_return_pct,
 max_drawdown_pct, CASE WHEN max_drawdown_pct > 0 THEN dda ELSE 0 END AS max_drawdown_abs,
 CASE WHEN max_drawdown_pct > 0 THEN peak_index ELSE 0 END AS peak_index,
 CASE WHEN max_drawdown_pct > 0 THEN trough_index ELSE 0 END AS trough_index,
 CASE WHEN n >= 2 AND sd > 0 THEN mu / sd * {scale} END AS sharpe,
 CASE WHEN n >= 2 AND dv > 0 THEN mu / sqrt(dv) * {scale} END AS sortino, bars_total, bars_in_position,
 bars_in_position / bars_total * 100 AS exposure_pct
 FROM (SELECT {run}, {capital} AS start, arg_max(equity, ord) AS final_equity, min(ts) AS t0, max(ts) AS t1, count(*) AS bars_total,
  count(br) AS n, avg(br) AS mu, stddev_pop(br) AS sd, avg(CASE WHEN br < 0 THEN br * br WHEN br >= 0 THEN 0 END) AS dv,
  count(*) FILTER (in_position) AS bars_in_position, max(dd) AS max_drawdown_pct
  FROM {prefix}d GROUP BY {run})
 JOIN (SELECT {run}, ord AS trough_index, dda, (SELECT min(x.ord) FROM (SELECT 1) z, {prefix}d x WHERE {{same}} AND x.equity = q.peak)
  AS peak_index FROM {prefix}d q QUALIFY row_number() OVER (PARTITION BY {run} ORDER BY dd DESC, ord) = 1) USING ({run})""".replace(
        "{same}", " AND ".join(f"x.{k.strip()} = q.{k.strip()}" for k in run.split(","))), f"{prefix}d")


TRADE_COLS = ["total_fees", "win_rate_pct", "avg_win", "avg_loss", "gross_profit", "gross_loss", "net_profit_factor",
              "gross_profit_factor", "expectancy", "expectancy_pct"]


def trade_sql(source, run):
    return f"""SELECT {run}, count(*) AS trade_count, sum(fees) AS total_fees, count(*) FILTER (net_pnl > 0) / count(*) * 100 AS
 win_rate_pct, avg(net_pnl) FILTER (net_pnl > 0) AS avg_win, avg(net_pnl) FILTER (net_pnl < 0) AS avg_loss,
 coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) AS gross_profit, coalesce(sum(net_pnl) FILTER (net_pnl < 0), 0) AS gross_loss,
 {pf('net_pnl')} AS net_profit_factor, {pf('gross_pnl')} AS gross_profit_factor, avg(net_pnl) AS expectancy,
 avg(return_pct) AS expectancy_pct FROM {source} GROUP BY {run}"""


def streak_sql(source, run, order):
    return f"""SELECT {run}, max(n) AS max_losing_streak FROM (SELECT {run}, isle, count(*) FILTER (net_pnl < 0) AS n FROM
 (SELECT {run}, net_pnl, sum((NOT net_pnl < 0)::INT) OVER (PARTITION BY {run} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS isle
 FROM {source}) GROUP BY {run}, isle) GROUP BY {run}"""


TRADE_OUT = (f"{ms('total_fees', 'avg_win', 'avg_loss', 'gross_profit', 'gross_loss', 'expectancy')}, "
             f"{rs('win_rate_pct', 'net_profit_factor', 'gross_profit_factor', 'expectancy_pct')}")
metric_ctes("m_", "m_eq", RUNC, "m_eq")
cte("m_t", trade_sql("m_led", RUNC), "m_led")
cte("m_s", streak_sql("m_led", RUNC, "entry_ord"), "m_led")
cte("m_all", f"""SELECT * REPLACE (coalesce(trade_count, 0) AS trade_count, coalesce(total_fees, 0) AS total_fees,
 coalesce(gross_profit, 0) AS gross_profit, coalesce(gross_loss, 0) AS gross_loss)
 FROM m_e LEFT JOIN m_t USING ({RUNC}) LEFT JOIN m_s USING ({RUNC})""", "m_e", "m_t", "m_s")
oracle("run_metrics", f"""SELECT {RUNC}, {rs('initial_capital', 'total_return_pct', 'max_drawdown_pct',
 'sharpe', 'sortino', 'exposure_pct')}, {ms('final_equity', 'max_drawdown_abs', 'annualized_return_pct')}, bars_total, bars_in_position, trade_count,
 max_losing_streak, {TRADE_OUT} FROM m_all""", "m_all")
oracle("flagship", f"""SELECT symbol, trade_count, {rs('win_rate_pct', 'net_profit_factor', 'total_return_pct', 'max_drawdown_pct',
 'sharpe', 'exposure_pct')}, max_losing_streak FROM m_all WHERE strategy = 'emaCrossover' AND scenario = 'BASE'""", "m_all")
oracle("max_drawdown", f"""SELECT {RUNC}, {rs('max_drawdown_pct')}, {ms('max_drawdown_abs')}, peak_index::BIGINT AS peak_index,
 trough_index::BIGINT AS trough_index FROM m_e WHERE strategy = 'emaCrossover'""", "m_e")
oracle("capital_efficiency", f"""SELECT {RUNC}, {r('total_return_pct / nullif(exposure_pct / 100, 0)', 'return_per_exposure')}
 FROM m_e WHERE strategy = 'emaCrossover'""", "m_e")
oracle("winner_per_dimension", """SELECT symbol, arg_max(strategy, total_return_pct) AS highest_return,
 arg_max(strategy, sharpe) AS best_sharpe, arg_min(strategy, max_drawdown_pct) AS lowest_drawdown
 FROM m_all WHERE scenario = 'BASE' GROUP BY 1""", "m_all")
_cmp = ["trade_count", "expectancy_pct", "win_rate_pct"]
oracle("before_after", "SELECT symbol, strategy, " + ", ".join(
    (f"max({c}) FILTER (scenario = 'GROSS') AS {c}_before, max({c}) FILTER (scenario = 'BASE') AS {c}_after, "
     f"max({c}) FILTER (scenario = 'BASE') - max({c}) FILTER (scenario = 'GROSS') AS {c}_delta") if c == "trade_count" else
    (r(f"max({c}) FILTER (scenario = 'GROSS')", f"{c}_before") + ", " + r(f"max({c}) FILTER (scenario = 'BASE')", f"{c}_after")
     + ", " + r(f"max({c}) FILTER (scenario = 'BASE') - max({c}) FILTER (scenario = 'GROSS')", f"{c}_delta"))
    for c in _cmp) + " FROM m_t GROUP BY 1, 2", "m_t")

# Sizes, constant carry, event carry: the crossover rule alone.
cte("sigx", "SELECT * FROM sig WHERE strategy = 'emaCrossover'", "sig")
position_ctes("z_", "sigx", K2, "sigx")
ledger_ctes("z_", K2, SCEN, "(VALUES (25.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE)) z(size_pct)")
cte("z_t", trade_sql("z_led", RUNC), "z_led")
oracle("size_sensitivity", f"""SELECT {RUNC}, trade_count, {ms('expectancy')}, {rs('net_profit_factor')},
 bool_and(expectancy < 0) OVER (PARTITION BY symbol, strategy, scenario) OR
 bool_and(expectancy > 0) OVER (PARTITION BY symbol, strategy, scenario) AS consistent FROM z_t""", "z_t")
position_ctes("k_", "sigx", K2, "sigx")
ledger_ctes("k_", K2, "(VALUES ('CARRY', 0.0004::DOUBLE, 0.0002::DOUBLE)) s(scenario, commission, slippage)",
            "(VALUES (50.0::DOUBLE)) z(size_pct)", "0.00001::DOUBLE")
equity_cte("k_", "bars", ["symbol"], ["strategy", "scenario", "size_pct"],
           "(SELECT 'emaCrossover' AS strategy, 'CARRY' AS scenario, 50.0::DOUBLE AS size_pct) q", "0.00001::DOUBLE")
oracle("bar_carry_ledger", f"SELECT symbol, ts, {ms('equity')} FROM k_eq", "k_eq")
BASE25 = "(SELECT 'emaCrossover' AS strategy, 'BASE' AS scenario, 25.0::DOUBLE AS size_pct) q"
position_ctes("c_", "sigx", K2, "sigx")
ledger_ctes("c_", K2, "(VALUES ('BASE', 0.0004::DOUBLE, 0.0002::DOUBLE)) s(scenario, commission, slippage)",
            "(VALUES (25.0::DOUBLE)) z(size_pct)")
equity_cte("c_", "bars", ["symbol"], ["strategy", "scenario", "size_pct"], BASE25)
cte("flows", """SELECT t.symbol, t.entry_ord, t.entry_time, e.event_time, e.rate, e.mark_price,
 -(t.quantity * e.mark_price * e.rate) AS cashflow FROM c_led t JOIN marked e ON t.symbol = e.symbol
 AND e.event_time > t.entry_time AND e.event_time < t.exit_time WHERE e.mark_price > 0 AND e.rate <> 0""", "c_led", "marked")
oracle("interval_carry", f"SELECT symbol, entry_time, event_time, {rs('rate', 'mark_price')}, {ms('cashflow')} FROM flows", "flows")
cte("rich", """SELECT t.*, coalesce(n, 0) AS carry_events, coalesce(paid, 0) AS carry_paid, coalesce(recv, 0) AS carry_received,
 coalesce(net, 0) AS net_carry, net_pnl + coalesce(net, 0) AS net_pnl_after FROM c_led t LEFT JOIN
 (SELECT symbol, entry_ord, count(*) AS n, sum(CASE WHEN cashflow < 0 THEN -cashflow ELSE 0 END) AS paid,
  sum(CASE WHEN cashflow >= 0 THEN cashflow ELSE 0 END) AS recv, sum(cashflow) AS net FROM flows GROUP BY 1, 2) USING (symbol, entry_ord)""",
    "flows", "c_led")
oracle("carry_trades", f"""SELECT symbol, entry_time, carry_events, {ms('carry_paid', 'carry_received', 'net_carry')},
 {money('net_pnl', 'net_pnl_before')}, {ms('net_pnl_after')} FROM rich""", "rich")
cte("ceq", """SELECT e.symbol, e.ord, e.ts, e.in_position, e.equity + coalesce((SELECT sum(cashflow) FROM flows f
 WHERE f.symbol = e.symbol AND f.event_time <= e.ts), 0) AS equity FROM c_eq e""", "c_eq", "flows")
oracle("carry_equity", f"SELECT symbol, ts, {ms('equity')} FROM ceq", "ceq")


def family(prefix, eq, trades, net, dep1, dep2):
    w = "PARTITION BY symbol ORDER BY ord"
    cte(f"{prefix}r", f"SELECT *, equity / lag(equity) OVER ({w}) - 1 AS x, max(equity) OVER ({w}) AS peak FROM {eq}", dep1)
    s = "sqrt(35040.0::DOUBLE)"
    cte(f"{prefix}m", f"""SELECT symbol, (final_equity - 10000) / 10000 * 100 AS total_return_pct,
 CASE WHEN sd > 0 THEN mu / sd * {s} ELSE 0 END AS sharpe, CASE WHEN nb > 1 AND dv > 0 THEN mu / sqrt(dv) * {s} ELSE 0 END AS sortino,
 max_drawdown_pct, trade_count, net_exp_pct, net_profit_factor, win_rate_pct, avg_holding_hours
 FROM (SELECT symbol, arg_max(equity, ord) AS final_equity, avg(x) AS mu, stddev_samp(x) AS sd, count(*) FILTER (x < 0) AS nb,
  avg(x * x) FILTER (x < 0) AS dv, max((peak - equity) / peak * 100) AS max_drawdown_pct FROM {prefix}r GROUP BY 1)
 JOIN (SELECT symbol, count(*) AS trade_count, avg({net}) / 2500 * 100 AS net_exp_pct, {pf(net)} AS net_profit_factor,
  count(*) FILTER ({net} > 0) / count(*) * 100 AS win_rate_pct, avg(holding_bars) * 0.25 AS avg_holding_hours FROM {trades}
  GROUP BY 1) USING (symbol)""", f"{prefix}r", dep2)


family("fb_", "c_eq", "c_led", "net_pnl", "c_eq", "c_led")
family("fa_", "ceq", "rich", "net_pnl_after", "ceq", "rich")
oracle("carry_metrics", f"""SELECT a.symbol, a.trade_count, {r('b.total_return_pct', 'return_before')},
 {r('a.total_return_pct', 'total_return_pct')}, {r('b.net_exp_pct', 'exp_before')}, {r('a.net_exp_pct', 'net_exp_pct')},
 {', '.join(r('a.' + c, c) for c in ('net_profit_factor', 'sharpe', 'sortino', 'max_drawdown_pct', 'win_rate_pct', 'avg_holding_hours'))},
 {money('paid', 'total_carry_paid')}, {money('recv', 'total_carry_received')}, {money('net', 'total_net_carry')},
 n::BIGINT AS total_carry_events, CASE WHEN abs(b.total_return_pct) <= 0.01 THEN 'UNSTABLE RATIO — NEAR ZERO BASE PNL'
 WHEN abs(net / 100 / b.total_return_pct) < 0.10 THEN 'NEGLIGIBLE' WHEN abs(net / 100 / b.total_return_pct) < 0.30 THEN 'MODERATE'
 WHEN abs(net / 100 / b.total_return_pct) < 0.50 THEN 'MATERIAL' ELSE 'SEVERE' END AS impact,
 b.net_exp_pct > 0 AND a.net_exp_pct <= 0 AS edge_destroyed
 FROM fa_m a JOIN fb_m b USING (symbol) JOIN (SELECT symbol, sum(carry_paid) AS paid, sum(carry_received) AS recv, sum(net_carry) AS net,
 sum(carry_events) AS n FROM rich GROUP BY 1) t USING (symbol)""", "fa_m", "fb_m", "rich")
oracle("carry_yearly", f"""SELECT symbol, year, count(*) AS trade_count, {r('avg(net_pnl_after) / 2500 * 100', 'net_exp_pct')},
 {r('sum(net_pnl_after)', 'net_pnl', 2)}, {money('sum(net_pnl)', 'net_before_carry')}, {money('sum(net_carry)', 'net_carry')},
 {money('sum(gross_pnl)', 'gross_pnl')}, {r(pf('net_pnl_after'), 'net_profit_factor')},
 {r('coalesce(CASE WHEN stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(35040.0::DOUBLE) END, 0)', 'sharpe')}
 FROM (SELECT *, eq / lag(eq) OVER (PARTITION BY symbol, year ORDER BY entry_ord) - 1 AS x FROM
 (SELECT *, year(entry_time) AS year, 10000 + sum(net_pnl_after) OVER (PARTITION BY symbol, year(entry_time) ORDER BY entry_ord) AS eq
 FROM rich)) GROUP BY 1, 2""", "rich")
oracle("carry_top5", f"""SELECT symbol, {money('sum(carry_paid)', 'total_paid')}, {money('sum(carry_paid) FILTER (k <= 5)', 'top_paid')},
 {r('CASE WHEN sum(carry_paid) > 0 THEN sum(carry_paid) FILTER (k <= 5) / sum(carry_paid) END', 'top_share')},
 coalesce(sum(carry_paid) FILTER (k <= 5) / nullif(sum(carry_paid), 0) > 0.5, false) AS concentrated
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY carry_paid DESC, entry_time) AS k FROM rich) GROUP BY 1""", "rich")

# Buy and hold
cte("bhq", """SELECT symbol, arg_min(open, ord) AS o, arg_max(close, ord) AS c FROM bars GROUP BY 1""", "bars")
cte("bhd", """SELECT symbol, (peak - close) / peak * 100 AS dd, peak - close AS dda, ord FROM (SELECT *, max(close) OVER
 (PARTITION BY symbol ORDER BY ord) AS peak FROM bars)""", "bars")
oracle("buy_hold", f"""SELECT symbol, 10000.0::DOUBLE AS initial_capital, {money('fe', 'final_equity')},
 {r('(fe / 10000 - 1) * 100', 'total_return_pct')}, {r('dd', 'max_drawdown_pct')}, {money('dda * q', 'max_drawdown_abs')}
 FROM (SELECT symbol, 10000 / 1.0004::DOUBLE / (o * 1.0002::DOUBLE) AS q,
 c * 0.9998::DOUBLE * (10000 / 1.0004::DOUBLE / (o * 1.0002::DOUBLE)) * 0.9996::DOUBLE AS fe FROM bhq) JOIN
 (SELECT symbol, dd, dda FROM bhd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dd DESC, ord) = 1) USING (symbol)""",
       "bhq", "bhd")

# Weeks
cte("wb", "SELECT *, weekofyear(ts) AS week, row_number() OVER (PARTITION BY symbol, weekofyear(ts) ORDER BY ts) - 1 AS word FROM b15",
    "b15")
cte("we", "SELECT *, " + ", ".join(
    f"CASE WHEN word >= {p - 1} THEN {fold_ema('buf', p)} END AS ema{p}" for p in (9, 21)) +
    " FROM (SELECT *, list(close) OVER (PARTITION BY symbol, week ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS buf FROM wb)",
    "wb")
cte("ws", """SELECT symbol, week, word AS ord, ts, high, low, close, coalesce(st AND NOT lag(st) OVER w, false) AS set_long,
 coalesce(NOT st AND lag(st) OVER w, false) AS reset, lead(ts) OVER w AS nts, lead(open) OVER w AS nopen, lead(high) OVER w AS nhigh,
 lead(low) OVER w AS nlow FROM (SELECT *, CASE WHEN word >= 20 THEN ema9 > ema21 END AS st FROM we)
 WINDOW w AS (PARTITION BY symbol, week ORDER BY ts)""", "we")
position_ctes("w_", "ws", ["symbol", "week"], "ws")
ledger_ctes("w_", ["symbol", "week"], "(VALUES ('BASE', 0.0004::DOUBLE, 0.0002::DOUBLE)) s(scenario, commission, slippage)")
cte("w_t", trade_sql("w_led", "symbol, week"), "w_led")
oracle("weekly_rerun", f"SELECT symbol, week, trade_count, {rs('expectancy_pct', 'net_profit_factor')} FROM w_t", "w_t")
cte("xeq", "SELECT *, weekofyear(ts) AS week FROM m_eq WHERE strategy = 'emaCrossover'", "m_eq")
metric_ctes("x_", "xeq", RUNC + ", week", "xeq", capital="arg_min(equity, ord)")
cte("xled", "SELECT *, weekofyear(entry_time) AS week FROM m_led WHERE strategy = 'emaCrossover'", "m_led")
cte("x_t", trade_sql("xled", RUNC + ", week"), "xled")
oracle("weekly_slices", f"""SELECT {RUNC}, week, {rs('total_return_pct', 'max_drawdown_pct', 'sharpe', 'exposure_pct')},
 coalesce(trade_count, 0) AS trade_count, {rs('net_profit_factor')} FROM x_e LEFT JOIN x_t USING ({RUNC}, week)""", "x_e", "x_t")

# Folds
FOLDS = ("(VALUES ('F1', TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-18'), ('F2', TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-25'), "
         "('F3', TIMESTAMP '2024-01-25', TIMESTAMP '2024-02-01')) p(period, pa, pb)")
cte("fsig", f"""SELECT symbol, strategy, period, pa, pb, ord, ts, high, low, close, set_long, reset,
 CASE WHEN nts < pb THEN nts END AS nts, CASE WHEN nts < pb THEN nopen END AS nopen, CASE WHEN nts < pb THEN nhigh END AS nhigh,
 CASE WHEN nts < pb THEN nlow END AS nlow FROM sig, {FOLDS} WHERE ts < pb AND strategy IN ('emaCrossover', 'breakout24hTrend')""", "sig")
K3 = ["symbol", "strategy", "period"]
position_ctes("g_", "fsig", K3, "fsig")
ledger_ctes("g_", K3, "(VALUES ('BASE', 0.0004::DOUBLE, 0.0002::DOUBLE)) s(scenario, commission, slippage)",
            "(VALUES (25.0::DOUBLE)) z(size_pct)")
cte("fbars", f"SELECT * FROM bars, {FOLDS} WHERE ts < pb", "bars")
equity_cte("g_", "fbars", ["symbol", "period"], ["strategy", "scenario", "size_pct"],
           "(SELECT strategy, 'BASE' AS scenario, 25.0::DOUBLE AS size_pct FROM (VALUES ('emaCrossover'), ('breakout24hTrend')) "
           "n(strategy)) q")
CTES["g_eq0"][0].append("fbars")
cte("geq", f"SELECT e.* FROM g_eq e JOIN {FOLDS} USING (period) WHERE ts >= pa AND ts < pb", "g_eq")
metric_ctes("y_", "geq", "symbol, strategy, period", "geq", capital="arg_min(equity, ord)")
cte("gled", f"SELECT t.* FROM g_led t JOIN {FOLDS} USING (period) WHERE entry_time >= pa AND entry_time < pb", "g_led")
oracle("fold_metrics", f"""SELECT symbol, strategy, period, {rs('initial_capital', 'total_return_pct', 'max_drawdown_pct', 'sharpe',
 'exposure_pct')}, coalesce(trade_count, 0) AS trade_count, {rs('net_exp_pct', 'net_profit_factor', 'avg_cost_pct', 'avg_mfe',
 'avg_mae', 'median_net_pct')}, {money('coalesce(bought, 0) / initial_capital', 'turnover')},
 {r('coalesce(trade_count, 0) * (365 / 7)', 'trades_per_year')}, {money('coalesce(paid, 0) * (365 / 7)', 'fees_per_year')},
 {r('coalesce(paid, 0) * (365 / 7) / initial_capital * 100', 'fees_per_year_pct')},
 {r('CASE WHEN avg_cost_pct > 1e-9 THEN abs(g) / avg_cost_pct END', 'edge_cost')} FROM y_e LEFT JOIN
 (SELECT symbol, strategy, period, count(*) AS trade_count, avg(net_return_pct) AS net_exp_pct, {pf('net_return_pct')} AS
 net_profit_factor, avg(cost_pct) AS avg_cost_pct, avg(mfe) AS avg_mfe, avg(mae) AS avg_mae, sum(fees) AS paid, sum(quantity * entry_price) AS bought,
 avg(gross_return_pct) AS g, quantile_cont(net_return_pct, 0.5) AS median_net_pct FROM gled GROUP BY ALL) USING (symbol, strategy, period)""",
       "y_e", "gled")

# Diagnostics of run trades
cte("ctx", """SELECT t.*, f.* EXCLUDE (symbol, ts, ord, atr14) FROM m_led t JOIN feats f ON t.symbol = f.symbol
 AND f.ord = greatest(t.entry_ord - 1, 0) WHERE strategy = 'emaCrossover' AND scenario = 'BASE'""", "m_led", "feats")
oracle("trade_features", f"""SELECT symbol, entry_time, {rs('gross_return_pct', 'net_return_pct', 'cost_pct', 'mfe', 'mae',
 'entry_signal_close', 'ema9', 'ema21', 'ema50', 'ema_spread_pct', 'ema50_slope_pct', 'atr_pct', 'entry_volatility_pct',
 'prev24h_return_pct', 'prev72h_return_pct', 'entry_volume', 'volume_ratio')}, ema50_slope_sign, crosses_24h, crosses_72h FROM ctx""",
       "ctx")
oracle("mfe_mae", f"SELECT {RUNC}, entry_time, {rs('mfe', 'mae')} FROM m_led", "m_led")
oracle("forward_entry", f"""SELECT t.symbol, t.entry_time, {rs('fwd_mfe_4', 'fwd_mae_4', 'fwd_mfe_12', 'fwd_mae_12', 'fwd_mfe_24',
 'fwd_mae_24')} FROM m_led t JOIN fwds f ON t.symbol = f.symbol AND t.entry_ord = f.ord
 WHERE strategy = 'emaCrossover' AND scenario = 'GROSS'""", "m_led", "fwds")
cte("reg", """SELECT *, CASE WHEN atr_pct IS NULL THEN 'N/A' WHEN atr_pct <= q1 THEN 'Low' WHEN atr_pct >= q3 THEN 'High' ELSE 'Medium'
 END AS vol FROM ctx, (SELECT quantile_cont(atr_pct, 0.25) AS q1, quantile_cont(atr_pct, 0.75) AS q3 FROM ctx)""", "ctx")


def dens(c):
    return f"CASE WHEN {c} <= 1 THEN '0-1' WHEN {c} <= 3 THEN '2-3' ELSE '>=4' END"


oracle("regime_buckets", f"""SELECT kind, bucket, count(*) AS count, {r('avg(gross_return_pct)', 'gross_exp_pct')},
 {r('avg(net_return_pct)', 'net_exp_pct')}, {r(pf('net_return_pct'), 'net_profit_factor')},
 {r('count(*) FILTER (net_return_pct > 0) / count(*) * 100', 'win_rate_pct')} FROM (
 SELECT 'trend' AS kind, CASE WHEN coalesce(entry_signal_close > ema50, false) THEN 'above' ELSE 'below' END || '/' ||
 CASE WHEN coalesce(ema50_slope_sign = 1, false) THEN 'up' ELSE 'down' END AS bucket, gross_return_pct, net_return_pct FROM reg
 UNION ALL SELECT 'volatility', vol, gross_return_pct, net_return_pct FROM reg
 UNION ALL SELECT 'density_24h', {dens('crosses_24h')}, gross_return_pct, net_return_pct FROM reg
 UNION ALL SELECT 'density_72h', {dens('crosses_72h')}, gross_return_pct, net_return_pct FROM reg) GROUP BY 1, 2""", "reg")
oracle("spread_quartiles", f"""SELECT band, count(*) AS count, {r('avg(net_return_pct)', 'net_exp_pct')},
 {r('count(*) FILTER (net_return_pct > 0) / count(*) * 100', 'win_rate_pct')}, {r('avg(mfe)', 'avg_mfe_pct')},
 {r('avg(mae)', 'avg_mae_pct')} FROM (SELECT *, CASE WHEN ema_spread_pct <= q1 THEN 'Q1' WHEN ema_spread_pct <= q2 THEN 'Q2'
 WHEN ema_spread_pct <= q3 THEN 'Q3' ELSE 'Q4' END AS band FROM ctx, (SELECT quantile_cont(ema_spread_pct, 0.25) AS q1,
 quantile_cont(ema_spread_pct, 0.5) AS q2, quantile_cont(ema_spread_pct, 0.75) AS q3 FROM ctx) WHERE ema_spread_pct IS NOT NULL)
 GROUP BY 1""", "ctx")

# External ledger
cte("ext", """SELECT *, gross_pnl - fees AS net_pnl, gross_return_pct - cost_pct AS net_return_pct,
 gross_return_pct - cost_pct AS return_pct FROM (SELECT l_returnflag AS symbol, o_orderpriority AS strategy, o_orderdate AS entry_time,
 l_shipdate AS exit_time, datediff('day', o_orderdate, l_shipdate) AS holding_bars,
 l_extendedprice * (0.05::DOUBLE - l_discount) AS gross_pnl, l_extendedprice * l_tax * 0.1::DOUBLE AS fees,
 (0.05::DOUBLE - l_discount) * 100 AS gross_return_pct, l_tax * 10 AS cost_pct, l_quantity / 10 AS mfe, -l_linenumber / 10.0::DOUBLE AS mae,
 l_quantity AS quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)""")
EXT_ORDER = "entry_time, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, quantity"
cte("ext_t", trade_sql("ext", "symbol, strategy"), "ext")
cte("ext_s", streak_sql("ext", "symbol, strategy", EXT_ORDER), "ext")
oracle("trade_stats", f"""SELECT symbol, strategy, trade_count, {TRADE_OUT}, max_losing_streak FROM ext_t JOIN ext_s
 USING (symbol, strategy)""", "ext_t", "ext_s")
_hb = """CASE WHEN holding_bars <= 4 THEN '1-4' WHEN holding_bars <= 12 THEN '5-12' WHEN holding_bars <= 24 THEN '13-24'
 WHEN holding_bars <= 48 THEN '25-48' WHEN holding_bars <= 96 THEN '49-96' ELSE '>96' END"""
cte("ext_b", f"SELECT *, {_hb} AS bucket FROM ext", "ext")
oracle("holding_buckets", f"""SELECT symbol, bucket, count(*) AS count, {r('avg(gross_return_pct)', 'gross_exp_pct')},
 {r('avg(net_return_pct)', 'net_exp_pct')}, {r(pf('gross_return_pct'), 'gross_profit_factor')},
 {r(pf('net_return_pct'), 'net_profit_factor')}, {r('count(*) FILTER (net_return_pct > 0) * 100 / count(*)', 'win_rate_pct')},
 {r('avg(net_return_pct) FILTER (net_return_pct > 0)', 'avg_win_pct')}, {r('avg(net_return_pct) FILTER (net_return_pct < 0)', 'avg_loss_pct')},
 {r('avg(holding_bars)', 'avg_holding_bars')}, {r('avg(mfe)', 'avg_mfe_pct')}, {r('avg(mae)', 'avg_mae_pct')},
 {money('sum(gross_return_pct) * 100', 'total_gross_pnl')}, {money('sum(net_return_pct) * 100', 'total_net_pnl')},
 {money('sum(cost_pct) * 100', 'total_fees')}, (list_position(['1-4', '5-12', '13-24', '25-48', '49-96', '>96'], bucket) - 1)::BIGINT
 AS bucket_order FROM ext_b GROUP BY 1, 2""", "ext_b")
oracle("holding_hours", f"""SELECT symbol, CASE WHEN holding_bars <= 6 THEN '<=6h' WHEN holding_bars <= 24 THEN '6-24h'
 WHEN holding_bars <= 48 THEN '24-48h' WHEN holding_bars <= 96 THEN '48-96h' WHEN holding_bars <= 168 THEN '96h-7d' ELSE '>7d' END AS bucket,
 count(*) AS count, {r('count(*) FILTER (net_return_pct <= 0) / count(*) * 100', 'lose_rate_pct')},
 {r('avg(gross_return_pct)', 'gross_exp_pct')}, {r('avg(net_return_pct)', 'net_exp_pct')},
 {r(pf('net_return_pct'), 'net_profit_factor')} FROM ext GROUP BY 1, 2""", "ext")
cte("ext_tot", "SELECT strategy, count(*) AS n FROM ext GROUP BY 1", "ext")
oracle("short_trades", f"""SELECT strategy, bucket, count(*) AS count, count(*) FILTER (net_return_pct <= 0) AS losers,
 {r('count(*) / any_value(n) * 100', 'share_pct')}, {r('count(*) FILTER (net_return_pct <= 0) / count(*) * 100', 'loser_rate_pct')},
 {r('avg(gross_return_pct)', 'gross_exp_pct')}, {r('avg(net_return_pct)', 'net_exp_pct')} FROM ext_b JOIN ext_tot USING (strategy)
 GROUP BY 1, 2 UNION ALL SELECT strategy, '<=24 total', count(*) FILTER (holding_bars <= 24), count(*) FILTER (holding_bars <= 24
 AND net_return_pct <= 0), {r('count(*) FILTER (holding_bars <= 24) / count(*) * 100', 'share_pct')},
 {r('coalesce(count(*) FILTER (holding_bars <= 24 AND net_return_pct <= 0) / nullif(count(*) FILTER (holding_bars <= 24), 0) * 100, 0)', 'l')},
 NULL, NULL FROM ext GROUP BY 1""", "ext_b", "ext_tot")
oracle("excursion_table", f"""SELECT symbol, outcome, count(*) AS count, {r('avg(mfe)', 'avg_mfe')}, {r('avg(mae)', 'avg_mae')},
 {r('quantile_cont(mfe, 0.5)', 'median_mfe')}, {r('quantile_cont(mae, 0.5)', 'median_mae')} FROM
 (SELECT *, CASE WHEN net_return_pct > 0 THEN 'winners' ELSE 'losers' END AS outcome FROM ext UNION ALL SELECT *, 'all' FROM ext)
 GROUP BY 1, 2""", "ext")
oracle("give_back", f"""SELECT symbol, count(*) AS reached, count(*) FILTER (net_return_pct <= 0) AS gave_back,
 {r('count(*) FILTER (net_return_pct <= 0) / count(*) * 100', 'share_pct')},
 {r('avg(mfe) FILTER (net_return_pct <= 0)', 'avg_mfe_given_back')},
 {r('avg(net_return_pct) FILTER (net_return_pct <= 0)', 'avg_net_given_back')} FROM ext WHERE mfe >= 1 GROUP BY 1""", "ext")
oracle("cost_decomposition", f"""SELECT symbol, {r('avg(gross_return_pct)', 'avg_gross')}, {r('avg(net_return_pct)', 'avg_net')},
 {r('avg(cost_pct)', 'avg_cost')}, {r('quantile_cont(gross_return_pct, 0.5)', 'median_gross')},
 {r('quantile_cont(net_return_pct, 0.5)', 'median_net')}, {r('abs(avg(gross_return_pct)) / avg(cost_pct)', 'edge_cost_ratio')},
 CASE WHEN abs(avg(gross_return_pct)) / avg(cost_pct) < 2 THEN 'EDGE TOO THIN RELATIVE TO COST' ELSE 'edge > cost' END AS status
 FROM ext GROUP BY 1""", "ext")
oracle("quartiles", "SELECT l_returnflag, " + ", ".join(
    r(f"quantile_cont(l_extendedprice, {x})", n) for n, x in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))) +
    " FROM lineitem GROUP BY 1")
oracle("year_matrix", f"""SELECT strategy, year(entry_time) AS year, symbol, count(*) AS count, {r('avg(net_return_pct)', 'net_exp_pct')}
 FROM ext GROUP BY 1, 2, 3 UNION ALL SELECT strategy, year(entry_time), 'ALL', count(*), {r('avg(net_return_pct)', 'e')} FROM ext
 GROUP BY 1, 2""", "ext")
oracle("year_pivot", "SELECT year(entry_time) AS year, " + ", ".join(
    r(f"avg(net_return_pct) FILTER (symbol = '{x.upper()}')", f"exp_{x}") for x in "anr") + ", " +
    r("avg(net_return_pct)", "exp_all") + " FROM ext GROUP BY 1", "ext")
oracle("pooled_stats", f"""SELECT strategy, count(*) AS count, {r('avg(net_return_pct)', 'net_exp_pct')}, {r(pf('net_return_pct'), 'net_pf')},
 {r(pf('gross_return_pct'), 'gross_pf')}, {r('count(*) / (max(year(entry_time)) - min(year(entry_time)) + 1)', 'per_year')}
 FROM ext GROUP BY 1""", "ext")
oracle("concentration", f"""SELECT strategy, {money('max(p)', 'best')}, {r('max(p) / sum(p)', 'concentration')},
 coalesce(max(p) / sum(p) > 0.6, false) AS concentrated FROM (SELECT strategy, CASE WHEN sum(gross_pnl) > 0 THEN sum(gross_pnl) END AS p
 FROM ext GROUP BY strategy, symbol, year(entry_time)) GROUP BY 1""", "ext")
cte("ext_sym", trade_sql("ext", "symbol"), "ext")
oracle("long_metrics", " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS metric, {r(c, 'value')} FROM ext_sym" for c in ("win_rate_pct", "net_profit_factor", "expectancy_pct")),
    "ext_sym")

# Gates
cte("gi", f"""SELECT strategy, symbol, max(n) FILTER (scenario = 'BASE') AS count, max(e) FILTER (scenario = 'GROSS') AS ge,
 max(e) FILTER (scenario = 'BASE') AS be, max(p) FILTER (scenario = 'BASE') AS bp, max(e) FILTER (scenario = 'STRESS') AS se,
 max(p) FILTER (scenario = 'STRESS') AS sp FROM (SELECT strategy, symbol, scenario, count(*) AS n, avg(net_return_pct) AS e,
 {pf('net_return_pct')} AS p FROM m_led GROUP BY 1, 2, 3) GROUP BY 1, 2""", "m_led")
oracle("cost_class", """SELECT strategy, symbol, count, CASE WHEN count < 30 THEN 'VERY LOW SAMPLE SIZE' WHEN count <= 100
 THEN 'LOW SAMPLE SIZE' ELSE 'OK' END AS sample, CASE WHEN NOT coalesce(ge > 0, false) THEN 'NO EDGE'
 WHEN NOT coalesce(be > 0 AND bp > 1, false) THEN 'EDGE FAILS REALISTIC COST' WHEN coalesce(se >= 0 AND sp >= 1, false) THEN 'COST ROBUST'
 ELSE 'COST SENSITIVE' END AS cost_class, CASE WHEN ge <= 0 THEN 'NO EDGE' WHEN NOT coalesce(be > 0 AND bp > 1, false) THEN
 'EDGE TOO THIN' WHEN NOT coalesce(se > 0 AND sp > 1, false) THEN 'COST SENSITIVE' ELSE 'COST ROBUST IN DEVELOPMENT' END
 AS development_class FROM gi""", "gi")
cte("gsh", "SELECT strategy, symbol, sharpe FROM m_e WHERE scenario = 'BASE'", "m_e")
cte("gwk", """SELECT strategy, symbol, weekofyear(entry_time) AS week, avg(net_return_pct) AS e FROM m_led WHERE scenario = 'BASE'
 GROUP BY 1, 2, 3""", "m_led")
oracle("external_gates", f"""SELECT strategy, asset_pass, stress_pass, sample_pass, {r('year_share', 'year_share')},
 year_share >= 0.6 AS year_pass, CASE WHEN asset_pass AND stress_pass AND sample_pass AND year_share >= 0.6 THEN 'PASS' ELSE 'FAIL'
 END AS verdict FROM (SELECT strategy, bool_and(coalesce(be > 0 AND bp > 1.05 AND sharpe > 0, false)) AS asset_pass,
 bool_and(coalesce(se >= 0 AND sp >= 1, false)) AS stress_pass, bool_and(count >= 100) AS sample_pass
 FROM gi JOIN gsh USING (strategy, symbol) GROUP BY 1) JOIN
 (SELECT strategy, count(*) FILTER (e > 0) / count(*) AS year_share FROM gwk GROUP BY 1) USING (strategy)""", "gi", "gsh", "gwk")
cte("sg", f"""SELECT strategy, scenario, count(*) AS n, avg(net_return_pct) AS e, {pf('net_return_pct')} AS p
 FROM m_led GROUP BY 1, 2""", "m_led")
cte("sgs", f"""SELECT strategy, max(e) AS hi, min(e) AS lo, bool_and(e > 0) AS allpos,
 count(*) FILTER (coalesce(e > 0 AND p > 1.05 AND sharpe > 0, false)) AS assets,
 CASE WHEN count(sharpe) = count(*) THEN avg(sharpe) END AS sharpe FROM gsh LEFT JOIN
 (SELECT strategy, symbol, avg(net_return_pct) AS e, {pf('net_return_pct')} AS p FROM m_led WHERE scenario = 'BASE' GROUP BY 1, 2)
 USING (strategy, symbol) GROUP BY 1""", "m_led", "gsh")
cte("sgw", """SELECT strategy, bool_and(w > 0) AS weekpos, sum(k)::BIGINT AS pos FROM (SELECT strategy, week, avg(e) AS w,
 count(*) FILTER (e > 0) AS k FROM gwk GROUP BY 1, 2) GROUP BY 1""", "gwk")
oracle("survival_gates", f"""SELECT strategy, n AS count, pos AS positive, assets, {rs('sharpe')}, conf AS conflict, CASE WHEN n < 30 THEN 'INSUFFICIENT SAMPLE'
 WHEN NOT ok1 THEN 'FAIL (edge/PF/Sharpe not positive under BASE)' WHEN allpos AND weekpos THEN 'PASS SCREENING' ELSE 'PASS BUT INCONSISTENT' END AS screening,
 ok1 AND pos >= 4 AND NOT conf AND n >= 100 AS survives,
 CASE WHEN ok2 AND st AND pos >= 4 AND allpos AND NOT conf AND n >= 100 THEN 'PASS' WHEN coalesce(e > 0 AND p > 1.05, false) THEN 'PARTIAL'
 ELSE 'FAIL' END AS verdict, CASE WHEN n < 50 THEN 'INCONCLUSIVE' WHEN ok2 AND assets >= 3 AND st THEN 'PASS' ELSE 'FAIL' END AS pooled
 FROM (SELECT b.*, pos, assets, sharpe, allpos, weekpos, coalesce(hi > 0.01 AND lo < -0.01, false) AS conf,
 coalesce(b.e > 0 AND b.p > 1 AND sharpe > 0, false) AS ok1,
 coalesce(b.e > 0 AND b.p > 1.05 AND sharpe > 0, false) AS ok2, coalesce(s.e >= 0 AND s.p >= 1, false) AS st
 FROM sg b JOIN sgs USING (strategy) JOIN sgw USING (strategy) JOIN sg s ON s.strategy = b.strategy AND s.scenario = 'STRESS'
 WHERE b.scenario = 'BASE')""", "sg", "sgs", "sgw")
# The carry run once more with STRESS costs.
position_ctes("s_", "sigx", K2, "sigx")
ledger_ctes("s_", K2, "(VALUES ('STRESS', 0.0006::DOUBLE, 0.0005::DOUBLE)) s(scenario, commission, slippage)",
            "(VALUES (25.0::DOUBLE)) z(size_pct)")
cte("s_rich", """SELECT t.symbol, t.net_pnl + coalesce((SELECT sum(-(t.quantity * e.mark_price * e.rate)) FROM marked e
 WHERE e.symbol = t.symbol AND e.event_time > t.entry_time AND e.event_time < t.exit_time AND e.mark_price > 0 AND e.rate <> 0), 0)
 AS net FROM s_led t""", "s_led", "marked")
oracle("carry_gates", f"""SELECT 'emaCrossover' AS strategy, base_pass, stress_pass, edge_destroyed, {r('year_share', 'year_share')},
 coalesce(year_share >= 0.6, false) AS year_pass, CASE WHEN base_pass AND stress_pass AND NOT edge_destroyed AND coalesce(year_share >= 0.6, false)
 THEN 'SURVIVED' ELSE 'FAILED' END AS verdict FROM (SELECT bool_and(coalesce(a.net_exp_pct > 0 AND a.net_profit_factor > 1.05 AND a.sharpe > 0, false))
 AS base_pass, bool_and(coalesce(s.e >= 0 AND s.p >= 1, false)) AS stress_pass,
 bool_or(coalesce(b.net_exp_pct > 0 AND a.net_exp_pct <= 0, false)) AS edge_destroyed
 FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN fa_m a USING (symbol) LEFT JOIN fb_m b USING (symbol)
 LEFT JOIN (SELECT symbol, avg(net) AS e, {pf('net')} AS p FROM s_rich GROUP BY 1) s USING (symbol)),
 (SELECT count(*) FILTER (e > 0) / nullif(count(*), 0) AS year_share FROM (SELECT symbol, weekofyear(entry_time) AS week, avg(net_pnl_after) AS e
 FROM rich GROUP BY 1, 2) JOIN (SELECT symbol, weekofyear(ts) AS week FROM bars GROUP BY 1, 2 HAVING count(*) >= 600) USING (symbol, week))""",
       "fa_m", "fb_m", "s_rich", "rich", "bars")
oracle("grade", """SELECT symbol, strategy, n AS trade_count, g AS grade, CASE g WHEN 'A' THEN 'INSUFFICIENT DATA'
 WHEN 'B' THEN 'NEGATIVE EXPECTANCY IN TEST DATA' WHEN 'C' THEN 'POSITIVE GROSS EXPECTANCY BUT FAILS COST TEST'
 ELSE 'POSITIVE EXPECTANCY UNDER TESTED ASSUMPTIONS' END AS label FROM (SELECT *, CASE WHEN n < 30 THEN 'A' WHEN ge IS NULL OR ge <= 0 THEN 'B'
 WHEN be <= 0 THEN 'C' ELSE 'D' END AS g FROM (SELECT symbol, strategy, count(*) FILTER (scenario = 'BASE') AS n,
 avg(net_pnl) FILTER (scenario = 'GROSS') AS ge, avg(net_pnl) FILTER (scenario = 'BASE') AS be FROM m_led GROUP BY 1, 2))""", "m_led")
oracle("regime_check", """SELECT strategy, year, CASE WHEN bool_and(e < 0) THEN 'SYSTEMATIC 2025 REGIME FAILURE'
 ELSE 'mixed (not systematic)' END AS regime FROM (SELECT strategy, symbol, year(entry_time) AS year, avg(net_return_pct) AS e FROM ext
 GROUP BY 1, 2, 3) GROUP BY 1, 2""", "ext")

# Live tables
cte("loc", "SELECT c_custkey AS symbol, 'LONG' AS side, c_acctbal AS entry_price, 1.0::DOUBLE AS quantity, 5.0::DOUBLE AS leverage, "
    "c_acctbal * 0.97::DOUBLE AS stop_price FROM customer WHERE c_acctbal > 0")
cte("rem", "SELECT o_custkey AS symbol, max(o_totalprice) AS p, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1")
cte("ord", """SELECT o_custkey AS symbol, o_orderkey::VARCHAR AS order_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'sl'
 WHEN '2-HIGH' THEN 'tp' WHEN '3-MEDIUM' THEN 'sl' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS side,
 o_totalprice * 0.9::DOUBLE AS sp, o_orderkey AS arrival FROM orders WHERE o_orderstatus IN ('O', 'P')""")


def protect(src):
    return f"""SELECT p.symbol, arg_min(order_id, arrival) FILTER (kind = 'sl') AS stop_order_id,
 arg_min(sp, arrival) FILTER (kind = 'sl') AS stop_price, arg_min(order_id, arrival) FILTER (kind = 'tp') AS profit_order_id,
 arg_min(sp, arrival) FILTER (kind = 'tp') AS profit_price FROM {src} p JOIN ord o ON p.symbol = o.symbol
 AND o.side = CASE WHEN p.side = 'SHORT' THEN 'BUY' ELSE 'SELL' END GROUP BY 1"""


oracle("protective_match", f"SELECT symbol, stop_order_id, {rs('stop_price')}, profit_order_id, {rs('profit_price')} FROM "
       f"({protect('loc')})", "loc", "ord")
cte("rem2", "SELECT symbol, CASE WHEN n % 2 = 0 THEN 'SHORT' ELSE 'LONG' END AS side, p AS entry_price, n::DOUBLE AS quantity, "
    "3.0::DOUBLE AS leverage FROM rem", "rem")
cte("prot", protect("rem2"), "rem2", "ord")
oracle("reconcile_positions", f"""SELECT symbol, side, {ms('entry_price', 'quantity')}, {rs('leverage')}, stop_order_id, {rs('stop_price')},
 profit_order_id, {rs('profit_price')}, action, {r('''CASE WHEN action <> 'remove' AND stop_order_id IS NULL THEN CASE WHEN stop_price > 0 AND
 CASE WHEN side = 'SHORT' THEN stop_price > entry_price ELSE stop_price < entry_price END THEN stop_price ELSE
 round(CASE WHEN side = 'SHORT' THEN entry_price * (1 + 2.0::DOUBLE / 100) ELSE entry_price * (1 - 2.0::DOUBLE / 100) END, 2) END END''', 'repair_stop')}
 FROM (SELECT coalesce(r.symbol, l.symbol) AS symbol, coalesce(r.side, l.side) AS side, coalesce(r.entry_price, l.entry_price) AS entry_price,
 coalesce(r.quantity, l.quantity) AS quantity, coalesce(r.leverage, l.leverage) AS leverage, q.stop_order_id,
 coalesce(q.stop_price, l.stop_price) AS stop_price, q.profit_order_id, q.profit_price,
 CASE WHEN r.symbol IS NULL THEN 'remove' WHEN l.symbol IS NULL THEN 'add' ELSE 'keep' END AS action
 FROM loc l FULL JOIN rem2 r ON l.symbol = r.symbol LEFT JOIN prot q ON q.symbol = r.symbol)""", "loc", "prot")
oracle("snapshot_actions", """SELECT CASE WHEN r.symbol IS NULL THEN 'remove' WHEN l.symbol IS NULL THEN 'add' ELSE 'keep' END AS action,
 count(*) AS n FROM loc l FULL JOIN rem r ON l.symbol = r.symbol GROUP BY 1""", "loc", "rem")
oracle("position_upsert", f"""SELECT coalesce(r.symbol, l.symbol) AS symbol, l.side AS side, {money('coalesce(r.p, l.entry_price)', 'entry_price')},
 {money('l.quantity', 'quantity')}, {r('l.leverage', 'leverage')}, {r('CASE WHEN r.symbol IS NULL THEN l.stop_price END', 'stop_price')},
 NULL::DOUBLE AS profit_price FROM loc l FULL JOIN rem r ON l.symbol = r.symbol""", "loc", "rem")
cte("fl", """SELECT l_returnflag AS account, l_orderkey AS oid, l_linestatus = 'F' AS cl, l_extendedprice * (0.05::DOUBLE - l_discount) AS gross,
 l_extendedprice * l_tax * 0.1::DOUBLE AS fee, l_shipdate AS ts, l_shipdate::DATE AS day, l_linenumber AS k1, l_partkey AS k2, l_suppkey AS k3,
 l_extendedprice AS k4, l_quantity AS k5 FROM lineitem""")


def settle_sql(keys):
    k = ", ".join(keys)
    seq = "k1, k2, k3, k4, k5, ts"
    rev = ", ".join(f"{c} DESC" for c in seq.split(", "))
    return f"""SELECT {k}, sum(coalesce(gross, 0)) AS gross_pnl, sum(fee) AS total_commission, sum(coalesce(gross, 0) - fee) AS realised_pnl,
 count(*) FILTER (cl) AS trade_count, count(*) FILTER (cl AND gross - fee > 0) AS winning_trades FROM
 (SELECT {k}, oid, cl, CASE WHEN cl THEN gross END AS gross, fee FROM (SELECT *, bool_or(cl) OVER (PARTITION BY {k}, oid) AS anycl,
 row_number() OVER (PARTITION BY {k}, oid, cl ORDER BY {seq}) AS a, row_number() OVER (PARTITION BY {k}, oid, cl ORDER BY {rev}) AS z FROM fl)
 WHERE CASE WHEN anycl THEN cl AND z = 1 ELSE a = 1 END) GROUP BY {k}"""


SETTLED = f"{r('total_commission', 'total_commission', 5)}, {r('realised_pnl', 'realised_pnl', 5)}, trade_count, winning_trades"
oracle("settlement", f"SELECT account, {money('gross_pnl', 'gross_profit')}, {SETTLED} FROM ({settle_sql(['account'])})", "fl")
oracle("daily_stats", f"""SELECT account, day::VARCHAR AS day, {SETTLED}, {r('n * 1000', 'start_balance', 5)},
 {r('n * 1000 + realised_pnl', 'current_balance', 5)}, realised_pnl / (n * 1000) * 100 <= -3 AS loss_cap_hit
 FROM ({settle_sql(['account', 'day'])}) JOIN (SELECT account, day, count(*)::DOUBLE AS n FROM fl GROUP BY 1, 2) USING (account, day)""", "fl")
oracle("fill_normalisation", f"""SELECT o_orderkey AS seq, o_orderpriority AS symbol, o_orderkey::VARCHAR AS order_id,
 CASE WHEN o_orderkey % 2 = 0 THEN 'MARKET' ELSE 'STOP_MARKET' END AS order_type, {r('o_totalprice', 'price')}, 2.0::DOUBLE AS executed_qty,
 CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS commission, o_orderkey % 2 = 1 AS protective,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 = 0 ELSE true END AS is_close FROM orders
 WHERE o_orderkey % 2 = 0 OR o_orderstatus <> 'O'""")
oracle("screening", f"""SELECT direction, outcome, count(*) AS n, {r('sum(CASE WHEN outcome = $$approved$$ AND direction <> $$CLOSE$$ THEN qty END)', 'quantity_sum')}
 FROM (SELECT *, CASE WHEN paused AND NOT cl THEN 'trading paused' WHEN breaker AND NOT cl THEN 'circuit breaker tripped'
 WHEN pending THEN 'order already in flight' WHEN cl AND NOT has THEN 'no position to close' WHEN cl THEN 'approved'
 WHEN cool THEN 'signal cooldown' WHEN cap THEN 'daily loss cap exceeded' WHEN slots >= 3 THEN 'max positions'
 WHEN has THEN 'already has position' WHEN balance <= 0 OR price <= 0 THEN 'invalid balance/price'
 WHEN q * price < 5.5 THEN 'notional too small' WHEN qty <= 0 THEN 'quantity zero after rounding'
 WHEN balance / (balance / 4 + qty * coalesce(nullif(mark, 0), price) / 5) * 100 < 200 THEN 'margin ratio too low'
 WHEN abs(tp - price) < abs(price - sl) THEN 'reward below risk' ELSE 'approved' END AS outcome FROM
 (SELECT *, floor(floor(q / 0.001::DOUBLE) * 0.001::DOUBLE * 1000 + 0.5) / 1000 AS qty,
 floor(price * CASE WHEN direction = 'SHORT' THEN 1 + 2.0::DOUBLE / 100 ELSE 1 - 2.0::DOUBLE / 100 END * 100 + 0.5) / 100 AS sl,
 floor(price * CASE WHEN direction = 'SHORT' THEN 1 - 4.0::DOUBLE / 100 ELSE 1 + 4.0::DOUBLE / 100 END * 100 + 0.5) / 100 AS tp FROM
 (SELECT *, least(balance * 10 / 100 * 5, 4000) / price AS q, direction = 'CLOSE' AS cl FROM
 (SELECT CASE o_orderstatus WHEN 'O' THEN 'LONG' WHEN 'F' THEN 'SHORT' ELSE 'CLOSE' END AS direction, o_totalprice / 100 AS price,
 CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 100 * (1 + (o_orderkey % 7 - 3) / 10) END AS mark, c_custkey % 13 = 0 AS paused, c_custkey % 11 = 0 AS breaker, c_custkey % 7 = 0 AS pending, c_custkey % 5 = 0 AS cool,
 c_custkey % 17 = 0 AS cap, c_custkey % 5 AS slots, c_custkey % 2 = 0 AS has, c_acctbal AS balance
 FROM orders JOIN customer ON o_custkey = c_custkey)))) GROUP BY 1, 2""")
oracle("margin_ratio", f"""SELECT c_nationkey::BIGINT AS account, n AS open_positions, {r('bal / used * 100', 'ratio_pct')} FROM
 (SELECT c_nationkey, count(*) AS n, sum(0.01::DOUBLE * CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice ELSE m END / 5) AS used
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT o_orderpriority, max(o_totalprice) AS m FROM orders GROUP BY 1) USING (o_orderpriority)
 GROUP BY 1) JOIN (SELECT c_nationkey, sum(c_acctbal) AS bal FROM customer GROUP BY 1) USING (c_nationkey)""")
oracle("unrealised_pnl", f"""SELECT seq, symbol, CASE WHEN seq % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
 {money('CASE WHEN seq % 2 = 0 THEN last - price ELSE price - last END * 2', 'unrealised_pnl')} FROM ticks JOIN
 (SELECT symbol, arg_max(price, ts) AS last FROM ticks GROUP BY 1) USING (symbol)""", "ticks")
oracle("loss_trips", f"""SELECT symbol, count(*) FILTER (nth % 5 = 0) AS trips, max(nth) FILTER (nth % 5 = 0) AS longest_streak FROM
 (SELECT symbol, row_number() OVER (PARTITION BY symbol, isle ORDER BY {EXT_ORDER}) AS nth FROM
 (SELECT *, sum((NOT net_pnl < 0)::INT) OVER (PARTITION BY symbol ORDER BY {EXT_ORDER} ROWS UNBOUNDED PRECEDING) AS isle FROM ext)
 WHERE net_pnl < 0) GROUP BY 1""", "ext")
oracle("top_n_recent", f"""SELECT symbol, ts, {rs('price')}, seq FROM ticks
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) <= 50""", "ticks")
oracle("signal_log", """SELECT strategy, symbol, ts, kind FROM (SELECT strategy, symbol, ts, CASE WHEN set_long THEN 'signal' ELSE 'rejected' END
 AS kind FROM sig3 WHERE set_long OR reset) QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY ts DESC, symbol, kind) <= 50""", "sig3")
oracle("replace_from", f"""SELECT symbol, ts, {rs('open', 'high', 'low')}, {r("close + CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 1 ELSE 0 END", 'close')},
 {rs('volume')} FROM b1h""", "b1h")
cte("cont", """SELECT symbol, count(*) FILTER (d <> 900000) AS gaps, greatest(sum(greatest(floor(d / 900000.0 + 0.5) - 1, 0)) FILTER (d <> 900000),
 (max(t) - min(t)) // 900000 + 1 - count(*))::BIGINT AS missing FROM (SELECT symbol, epoch_ms(ts) AS t, epoch_ms(ts) - lag(epoch_ms(ts))
 OVER (PARTITION BY symbol ORDER BY ts) AS d FROM b15) GROUP BY 1""", "b15")
oracle("run_warnings", f"""SELECT {RUNC}, concat_ws(' | ', CASE WHEN trade_count < 30 THEN 'sample size too small (' || trade_count || ' trades)' END,
 'funding rate not included', CASE WHEN bars_total < 200 THEN 'insufficient trading history (bars < 200)' END,
 CASE WHEN forced THEN 'position force-exited at end of backtest (forced research exit at last close)' END,
 CASE WHEN gaps > 0 THEN 'DATA CONTINUITY WARNING: ' || missing || ' missing bar(s) in ' || gaps || ' gap(s); results NOT marked VALIDATED' END,
 CASE WHEN sharpe IS NULL AND trade_count >= 2 THEN 'sharpe not computable (insufficient or degenerate equity returns)' END) AS warnings
 FROM m_all LEFT JOIN (SELECT {RUNC}, bool_or(forced_exit) AS forced FROM m_led GROUP BY ALL) USING ({RUNC}) JOIN cont USING (symbol)
 WHERE strategy = 'rsiEma'""", "m_all", "m_led", "cont")
