"""Queries of the live parts in batch form, with their DuckDB SQL."""
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind, scalars as sc
from tickloom.operators import anchored, ranges
from tickloom.operators.sequence import blocked, owned
from tickloom.plans import derive
from tickloom.plans.catalog import BAR_MS, cut, query
from tickloom.plans.oracle import W, cte, fold_ema, oracle, r
from tickloom.streaming import replay

#: Bars of a micro-batch, and how many bars behind the newest the watermark runs.
BATCH_BARS, DELAY_BARS = 8, 4


@query
def live_replay(spark, sf):
    """Crossover signals of a run whose bars came up to two bars out of order, each 37th of them twenty bars late."""
    n = (sc.epoch_millis("ts") / BAR_MS).cast("bigint")
    b = derive.plain_bars(spark, sf, "15m").withColumn("_n", n)
    came = F.col("_n") + F.col("_n") % 3 + F.when(F.col("_n") % 37 == 0, 20).otherwise(0)
    b = b.withColumn("batch", replay.arrival_batch(came, BATCH_BARS)).drop("_n")
    return replay.replay_signals(b, "emaCrossover", "batch", DELAY_BARS * BAR_MS / 1000)


cte("came", f"""SELECT *, (n + n % 3 + CASE WHEN n % 37 = 0 THEN 20 ELSE 0 END) // {BATCH_BARS} AS batch FROM
 (SELECT *, epoch_ms(ts) // {BAR_MS} AS n FROM b15)""", "b15")
cte("came_wm", f"""SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY_BARS * BAR_MS} AS wm
 FROM (SELECT batch, max(epoch_ms(ts)) AS newest FROM came GROUP BY 1)""", "came")
cte("came_late", "SELECT c.*, coalesce(epoch_ms(ts) < wm, false) AS late FROM came c JOIN came_wm USING (batch)", "came", "came_wm")
cte("live_ema", "SELECT *, " + ", ".join(f"CASE WHEN ord >= {p - 1} THEN {fold_ema('buf', p)} END AS e{p}" for p in (9, 21)) +
    f""" FROM (SELECT *, row_number() OVER ({W}) - 1 AS ord, list(close) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS buf
 FROM came_late WHERE NOT late)""", "came_late")
cte("live_st", f"SELECT *, lag(st) OVER ({W}) AS pst FROM (SELECT *, CASE WHEN ord >= 20 THEN e9 > e21 END AS st FROM live_ema)", "live_ema")
cte("live_act", f"""SELECT symbol, ts, close, st AS up FROM (SELECT *, count(*) FILTER (st AND NOT pst) OVER ({W}) AS longs FROM live_st)
 WHERE st <> pst AND longs > 0""", "live_st")
oracle("live_replay", f"""SELECT symbol, ts, {r('close', 'close')}, CASE WHEN up THEN 'LONG' ELSE 'CLOSE' END AS action FROM live_act
 UNION ALL SELECT symbol, ts, {r('close', 'close')}, 'LATE' FROM came_late WHERE late""", "live_act", "came_late")


@query
def cooldown_batch(spark, sf):
    """Entries of each kind of event, allowed unless one was allowed in the half hour before."""
    return anchored.allowed_entries(derive.ticks(spark, sf), ["symbol"], 1800, settle=lambda df: cut(spark, df))


@query
def error_trips(spark, sf):
    """Errors of each kind of event from the fourth on within an hour anchored at its first."""
    return anchored.trips(derive.ticks(spark, sf), ["symbol"], ["ts", "seq"], limit=4, window_seconds=3600, seconds=3600,
                          settle=lambda df: cut(spark, df))


def chain(name: str, span: str, strict: bool) -> None:
    """Openers by walking from opener to opener."""
    cte(f"{name}_t", "SELECT DISTINCT symbol, ts FROM ticks", "ticks")
    cte(f"{name}_n", f"""SELECT a.symbol, a.ts, min(b.ts) AS nxt FROM {name}_t a ASOF LEFT JOIN {name}_t b
 ON a.symbol = b.symbol AND a.ts + INTERVAL {span} {'<' if strict else '<='} b.ts GROUP BY 1, 2""", f"{name}_t")


for _name, _span, _strict in (("cool", "'1800 seconds'", False), ("errs", "'3600 seconds'", True)):
    chain(_name, _span, _strict)


def _walk(name):
    return (f"{name}_w(symbol, ts) AS (SELECT symbol, min(ts) FROM {name}_n GROUP BY 1 UNION ALL SELECT n.symbol, n.nxt FROM {name}_w w "
            f"JOIN {name}_n n ON n.symbol = w.symbol AND n.ts = w.ts WHERE n.nxt IS NOT NULL)")


def _recursive(name, body, walk, dep):
    """A statement whose list of tables ends with a recursive one."""
    from tickloom.plans.oracle import ORACLE, sql
    whole = sql("", dep).strip().replace("WITH ", "WITH RECURSIVE ", 1)
    ORACLE[name] = f"{whole},\n{_walk(walk)}\n{body}"


_recursive("cooldown_batch", """SELECT t.symbol, t.ts, w.ts IS NOT NULL AS allowed FROM cool_t t
 LEFT JOIN cool_w w ON w.symbol = t.symbol AND w.ts = t.ts""", "cool", "cool_n")
_recursive("error_trips", """SELECT symbol, ts AS tripped_at, ts + INTERVAL 1 HOUR AS expires_at, nth AS errors FROM
 (SELECT t.symbol, t.ts, row_number() OVER (PARTITION BY t.symbol, w.ts ORDER BY t.ts, t.seq) AS nth
  FROM ticks t ASOF JOIN errs_w w ON t.symbol = w.symbol AND t.ts >= w.ts) WHERE nth >= 4""", "errs", "errs_n")


# Averages and paths over whole histories

ANY_PERIODS = (1, 2, 50, 200, 1000)


@query
def averages_any(spark, sf):
    """Full-history averages of any period: exponential ones of 1 to 1,000 bars, Wilder's true range of 1 and 200."""
    k = ["symbol"]
    b = owned(blocked(derive.bars(spark, sf), back=1).withColumn("_tr", ind.true_range(k))).drop("_blk")
    specs = {f"ema{p}": ind.long_ema_spec(p) for p in ANY_PERIODS} | {f"atr{p}": ind.wilder_spec(period=p) for p in (1, 200)}
    return ind.with_running_averages(b, k, specs).select("symbol", "ts", *specs)


cte("any0", "SELECT *, " + ", ".join(
    f"CASE WHEN ord >= {p - 1} THEN {fold_ema('all_close', p)} END AS ema{p}" for p in ANY_PERIODS) + ", " + ", ".join(
    f"CASE WHEN ord >= {p} THEN list_reduce(all_tr[{p + 1}:], lambda a, x: (a * {p - 1} + x) / {p}, "
    f"list_reduce(all_tr[1:{p}], lambda a, x: a + x, 0.0::DOUBLE) / {p}) END AS atr{p}" for p in (1, 200)) + " FROM trs", "trs")
oracle("averages_any", "SELECT symbol, ts, " + ", ".join(r(c, c) for c in (*(f"ema{p}" for p in ANY_PERIODS), "atr1", "atr200")) + " FROM any0", "any0")


@query
def external_path(spark, sf):
    """Best and worst price on the way of an external ledger: each seventh bar, held up to 700 bars."""
    b = derive.bars(spark, sf)
    n = b.select("symbol", "ord", "ts", "open").withColumn("_to", F.col("ord") + (F.col("ord") * 37) % 700)
    ends = b.select("symbol", F.col("ord").alias("_to"), F.col("ts").alias("exit_time"))
    t = n.where("ord % 7 = 0").join(ends, ["symbol", "_to"]).select(
        "symbol", F.col("ts").alias("entry_time"), "exit_time", F.col("open").alias("entry_price"))
    path = ranges.external_path(t, b, ["symbol"], ["symbol", "entry_time"], settle=lambda df: cut(spark, df))
    return path.select("symbol", "entry_time", "exit_time", "entry_price", (F.col("exit_ord") - F.col("entry_ord")).alias("holding_bars"), "mfe", "mae")


oracle("external_path", f"""SELECT a.symbol, a.ts AS entry_time, any_value(z.ts) AS exit_time, {r('any_value(a.open)', 'entry_price')},
 (any_value(z.ord) - a.ord)::BIGINT AS holding_bars, {r('greatest((max(p.high) / any_value(a.open) - 1) * 100, 0)', 'mfe')},
 {r('least((min(p.low) / any_value(a.open) - 1) * 100, 0)', 'mae')}
 FROM bars a JOIN bars z ON z.symbol = a.symbol AND z.ord = a.ord + (a.ord * 37) % 700
 JOIN bars p ON p.symbol = a.symbol AND p.ord BETWEEN a.ord AND z.ord WHERE a.ord % 7 = 0 GROUP BY a.symbol, a.ts, a.ord""", "bars")
