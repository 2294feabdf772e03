"""One DataFrame plan per operator, over the star-schema tables (see ``derive``)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions import scalars as sc
from tickloom.functions.signals import get_rule, list_rules, signals
from tickloom.operators import carry, diagnostics as dg, gates, grid, joins, metrics as mt
from tickloom.operators import positions as pos, quality as q, quantiles as qt, reconcile as rc, resample as rs
from tickloom.operators.sequence import block_no, block_window, blocked, owned, scan, time_chunk
from tickloom.plans import derive
from tickloom.session import settled

CAPITAL = 10_000.0
BAR_MS = 900_000
RUN = ["symbol", "strategy", "scenario", "size_pct"]
RULES_15M = ["emaCrossover", "rsiEma", "breakout24hTrend"]
MONEY = {"entry_price", "exit_price", "quantity", "gross_pnl", "fees", "net_pnl", "equity", "final_equity",
         "expectancy", "avg_win", "avg_loss", "gross_profit", "gross_loss", "total_fees", "max_drawdown_abs",
         "cashflow", "carry_paid", "carry_received", "net_carry", "total_carry_paid", "total_carry_received",
         "total_net_carry", "net_pnl_after", "net_pnl_before", "net_before_carry", "total_gross_pnl", "total_net_pnl", "cash_before",
         "total_paid", "top_paid", "best", "unrealised_pnl", "turnover", "annualized_return_pct", "fees_per_year"}
# Sums of products of short decimals: exact to five places, so never on a rounding edge there.
DECIMAL_SUMS = {"realised_pnl", "total_commission", "start_balance", "current_balance"}


def finish(df: DataFrame) -> DataFrame:
    """Stable output types: bigint, UTC wall-clock times, doubles to 6 decimals (money: 2)."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            # Plus 0.0 turns a rounded -0.0 into 0.0.
            c = F.round(c, 2 if name in MONEY else 5 if name in DECIMAL_SUMS else 6) + F.lit(0.0)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        cols.append(c.alias(name))
    return df.select(*cols)


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """End the lineage of a small table that several later steps read."""
    return settled(df)


# --- shared steps -------------------------------------------------------------------

def costs(spark, sizes=(100.0,), only=tuple(pos.SCENARIOS)):
    return pos.scenario_table(spark, {name: pos.SCENARIOS[name] for name in only}, sizes=sizes)


def rule_signals(spark, sf, strategies=RULES_15M, interval="15m"):
    return signals(derive.bars(spark, sf, interval), strategies, interval=interval)


def ledgers(spark, sf, strategies=RULES_15M, sizes=(100.0,), only=tuple(pos.SCENARIOS)):
    return cut(spark, grid.run_ledger(rule_signals(spark, sf, strategies), ["symbol", "strategy"],
                                      costs(spark, sizes, only), CAPITAL))


def curves(spark, sf, trades, strategies=RULES_15M, sizes=(100.0,)):
    runs = grid.run_list(costs(spark, sizes), strategies)
    return pos.equity_curve(derive.bars(spark, sf), trades, runs, ["symbol"],
                            ["strategy", "scenario", "size_pct"], CAPITAL)


def ext_trades(spark, sf):
    """External ledger: order date to ship date of every line shipped after its order."""
    li = derive.table(spark, sf, "lineitem")
    o = derive.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    t = li.join(o, li.l_orderkey == o.o_orderkey).filter("l_shipdate > o_orderdate")
    price = F.col("l_extendedprice")
    t = t.select(
        F.col("l_returnflag").alias("symbol"), F.col("o_orderpriority").alias("strategy"),
        F.col("o_orderdate").alias("entry_time"), F.col("l_shipdate").alias("exit_time"),
        F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("holding_bars"),
        (price * (0.05 - F.col("l_discount"))).alias("gross_pnl"), (price * F.col("l_tax") * 0.1).alias("fees"),
        ((0.05 - F.col("l_discount")) * 100).alias("gross_return_pct"), (F.col("l_tax") * 10).alias("cost_pct"),
        (F.col("l_quantity") / 10).alias("mfe"), (-F.col("l_linenumber") / 10).alias("mae"),
        F.col("l_quantity").alias("quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice")
    return t.withColumns({"net_pnl": F.col("gross_pnl") - F.col("fees"),
                          "net_return_pct": F.col("gross_return_pct") - F.col("cost_pct"),
                          "return_pct": F.col("gross_return_pct") - F.col("cost_pct")})


EXT_ORDER = ["entry_time", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "quantity"]


def ext_chunk():
    """Block number along EXT_ORDER: the day, then ranges of a million order keys (any bigint key)."""
    keys = (F.col("l_orderkey") / 1_000_000).cast("bigint")
    return time_chunk("entry_time", DAY) * (1 << 44) + keys


def dirty_bars(spark, sf):
    """Bars with faults put in by bar number: missing and negative values, repeats, disorder.

    Every bar stays; each 11th is sent a second time with a later arrival number.
    """
    b = derive.plain_bars(spark, sf, "15m")
    n = (sc.epoch_millis("ts") / BAR_MS).cast("bigint")
    b = b.withColumn("_n", n).withColumns({
        "open": F.when(F.col("_n") % 17 == 0, F.lit(None)).otherwise(F.col("open")),
        "close": F.when(F.col("_n") % 23 == 0, -F.col("close")).otherwise(F.col("close")),
        "high": F.when(F.col("_n") % 29 == 0, F.col("low") - 1).otherwise(F.col("high")),
        "volume": F.when(F.col("_n") % 31 == 0, -F.col("volume")).otherwise(F.col("volume"))})
    copies = F.when(F.col("_n") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    b = b.withColumn("_copy", F.explode(copies))
    # A copy arrives three bars late.
    return b.withColumn("ingest_id", F.col("_n") * 10 + F.col("_copy") * 35).drop("_n", "_copy")


def carry_events(spark, sf):
    """Hourly carry per symbol, its rate from the first tick of the hour."""
    h = rs.ticks_to_bars(derive.ticks(spark, sf), "1h", seq="seq")
    return h.select("symbol", F.col("ts").alias("event_time"),
                    ((F.col("open") - derive.PRICE_BASE - 50) / 100_000).alias("rate"))


def marks(spark, sf):
    m = rs.ticks_to_bars(derive.ticks(spark, sf), "1m", seq="seq")
    return m.select("symbol", F.col("ts").alias("open_time"), "open", "close")


def marked_events(spark, sf):
    return joins.mark_price(carry_events(spark, sf), marks(spark, sf), ["symbol"], "event_time", "open_time",
                            joins.seconds_block(86_400 * 5))


DAY = 86_400


def day_bucket(c):
    return block_no(time_chunk(c, DAY))


def carry_run(spark, sf, scenario="BASE"):
    """Costs, crossover ledger at quarter size and its carry cashflows."""
    base = pos.scenario_table(spark, {scenario: pos.SCENARIOS[scenario]}, (25.0,))
    trades = cut(spark, grid.run_ledger(rule_signals(spark, sf, ["emaCrossover"]), ["symbol", "strategy"], base))
    ev = marked_events(spark, sf).filter("mark_price is not null")
    flows = carry.cashflows(trades, ev, ["symbol"], day_bucket)
    return base, trades, flows


# --- queries ------------------------------------------------------------------------

QUERIES = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(fn(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def flagship(spark, sf):
    """Per symbol: ledger and equity metrics of the crossover rule with BASE costs."""
    base = pos.scenario_table(spark, {"BASE": pos.SCENARIOS["BASE"]})
    trades = cut(spark, grid.run_ledger(rule_signals(spark, sf, ["emaCrossover"]), ["symbol", "strategy"], base))
    eq = pos.equity_curve(derive.bars(spark, sf), trades, grid.run_list(base, ["emaCrossover"]), ["symbol"],
                          ["strategy", "scenario", "size_pct"], CAPITAL)
    m = mt.run_metrics(eq, trades, RUN, BAR_MS, CAPITAL)
    return m.select("symbol", "trade_count", "win_rate_pct", "net_profit_factor", "total_return_pct",
                    "max_drawdown_pct", "sharpe", "max_losing_streak", "exposure_pct")


@query
def bars_1h(spark, sf):
    return derive.plain_bars(spark, sf, "1h")


@query
def bars_15m(spark, sf):
    return derive.bars(spark, sf, "15m")


@query
def resample_1h(spark, sf):
    return rs.resample(derive.plain_bars(spark, sf, "15m"), "1h")


@query
def resample_4h(spark, sf):
    return rs.resample(rs.ticks_to_bars(derive.ticks(spark, sf).withColumn("symbol", F.lit("ALL")), "15m",
                                        seq="seq"), "4h")


@query
def resample_incomplete(spark, sf):
    return rs.incomplete_windows(derive.plain_bars(spark, sf, "15m"), "1h")


@query
def resample_audit(spark, sf):
    return rs.resample_audit(derive.plain_bars(spark, sf, "15m"))


@query
def quality_issues(spark, sf):
    return q.row_issues(dirty_bars(spark, sf)).withColumn("field", F.coalesce("field", F.lit("")))


@query
def quality_summary(spark, sf):
    return q.quality_summary(dirty_bars(spark, sf))


@query
def gap_warnings(spark, sf):
    return q.gap_warnings(dirty_bars(spark, sf)).select("symbol", "ingest_id", "delta_ms", "median_interval_ms")


@query
def dedupe_first(spark, sf):
    return q.dedupe_first(dirty_bars(spark, sf))


@query
def continuity(spark, sf):
    return q.continuity(dirty_bars(spark, sf), BAR_MS)


@query
def gap_list(spark, sf):
    return q.gap_list(dirty_bars(spark, sf), BAR_MS)


@query
def interval_estimate(spark, sf):
    est = q.interval_estimate(dirty_bars(spark, sf))
    return est.withColumn("label", sc.interval_label(F.col("interval_ms")))


@query
def carry_integrity(spark, sf):
    ev = carry_events(spark, sf).select(
        "symbol", F.unix_millis("event_time").alias("funding_time"), F.col("rate").alias("funding_rate"),
        F.unix_millis("event_time").alias("ingest_id"))
    return q.carry_integrity(ev).withColumn("issues", F.concat_ws(";", "issues"))


@query
def holdout_integrity(spark, sf):
    ev = carry_events(spark, sf).select(
        "symbol", F.unix_millis("event_time").alias("funding_time"),
        F.when(F.col("rate") < -0.00049, "SYNTHETIC_FILL").otherwise("OFFICIAL_ARCHIVE").alias("source"))
    return q.holdout_integrity(derive.plain_bars(spark, sf, "15m"), ev)


@query
def common_end(spark, sf):
    b = derive.plain_bars(spark, sf, "15m").select("symbol", "ts")
    return q.common_end(b.unionByName(carry_events(spark, sf).select("symbol", F.col("event_time").alias("ts"))),
                        F.lit("2024-01-15").cast("timestamp"))


@query
def provenance(spark, sf):
    from tickloom.sources.carry import provenance as prov

    ev = marked_events(spark, sf).select(
        "symbol", F.unix_millis("event_time").alias("funding_time"), F.col("rate").alias("funding_rate"),
        "mark_price", F.lit("OFFICIAL_ARCHIVE").alias("source"))
    return prov(ev)


@query
def split_segments(spark, sf):
    s = grid.split_train_test(derive.plain_bars(spark, sf, "15m"), ("2024-01-01", "2024-01-21"),
                              ("2024-01-21", "2024-02-01"))
    return s.groupBy("symbol", "segment").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"),
                                              F.max("ts").alias("last_ts"))


PERIODS = {"DISCOVERY": ("2024-01-01", "2024-01-16"), "VALIDATION": ("2024-01-16", "2024-01-24"),
           "HOLDOUT": ("2024-01-24", "2024-02-01"), "FULL": ("2024-01-01", "2024-02-01")}


@query
def period_slices(spark, sf):
    s = grid.slice_periods(derive.plain_bars(spark, sf, "15m"), grid.periods_table(spark, PERIODS))
    return s.groupBy("symbol", "period").agg(F.count(F.lit(1)).alias("bars"), F.max("high").alias("high"),
                                             F.min("low").alias("low"))


# Indicators

def _on_blocks(spark, sf, back, build, fwd=0):
    b = blocked(derive.bars(spark, sf), back=back, fwd=fwd)
    return owned(build(b))


@query
def ema_buffered(spark, sf):
    return _on_blocks(spark, sf, 60, lambda b: ind.with_buffered_emas(b, ["symbol"])).select(
        "symbol", "ts", "ema9", "ema21", "ema50")


@query
def rsi14(spark, sf):
    return _on_blocks(spark, sf, 15, lambda b: ind.with_rsi(b, ["symbol"])).select("symbol", "ts", "rsi")


@query
def long_averages(spark, sf):
    f = dg.bar_features(derive.bars(spark, sf))
    return f.select("symbol", "ts", "ema9", "ema21", "ema50", "atr_pct", "ema50_slope_pct", "ema50_slope_sign",
                    "ema_spread_pct")


@query
def true_range(spark, sf):
    return _on_blocks(spark, sf, 1, lambda b: b.withColumn("true_range", ind.true_range(["symbol"]))).select(
        "symbol", "ts", "true_range")


@query
def cross_counts(spark, sf):
    return dg.bar_features(derive.bars(spark, sf)).select("symbol", "ts", "crosses_24h", "crosses_72h")


@query
def rolling_features(spark, sf):
    """Rolling volatility, lagged returns, volume ratio."""
    k = ["symbol"]

    def build(b):
        b = b.withColumn("_ret", ind.bar_return(k))
        return b.withColumns({"volatility_pct": ind.rolling_return_vol(k), "ret_96": ind.lagged_return(k, 96),
                              "ret_288": ind.lagged_return(k, 288), "volume_ratio": ind.volume_ratio(k)})

    return _on_blocks(spark, sf, 289, build).select(
        "symbol", "ts", "volatility_pct", "ret_96", "ret_288", "volume_ratio")


@query
def prior_high(spark, sf):
    k = ["symbol"]
    return _on_blocks(spark, sf, 96, lambda b: b.withColumns(
        {f"high_{n}": ind.prior_high(k, n) for n in (6, 24, 96)})).select(
        "symbol", "ts", "high_6", "high_24", "high_96")


@query
def forward_excursion(spark, sf):
    k = ["symbol"]

    def build(b):
        up, down = ind.forward_excursion(k, 12)
        return b.withColumns({"fwd_mfe_12": up, "fwd_mae_12": down})

    return _on_blocks(spark, sf, 0, build, fwd=12).select("symbol", "ts", "fwd_mfe_12", "fwd_mae_12")


def _signal_query(name):
    def run(spark, sf):
        s = rule_signals(spark, sf, [name], get_rule(name).interval)
        return s.filter("set_long or reset").select("symbol", "strategy", "ts", "set_long", "reset")

    run.__name__ = "sig_" + name
    run.__doc__ = f"Bars of its own length at which {name} sets or resets."
    query(run)


for _name in list_rules():
    _signal_query(_name)


@query
def ticker_change(spark, sf):
    b = derive.plain_bars(spark, sf, "1h")
    return b.select("symbol", "ts", ind.ticker_change_pct(F.col("open"), F.col("close")).alias("change_pct"))


# Positions and metrics

@query
def latch_held(spark, sf):
    h = pos.hold(rule_signals(spark, sf, ["emaCrossover", "breakout24hTrend"]), ["symbol", "strategy"])
    return h.select("symbol", "strategy", "ts", "held", "up", "down")


@query
def ledger(spark, sf):
    return ledgers(spark, sf).select(*RUN, *pos.LEDGER)


@query
def equity_curve(spark, sf):
    t = ledgers(spark, sf, ["emaCrossover"])
    return curves(spark, sf, t, ["emaCrossover"]).select(*RUN, "ts", "equity", "in_position")


@query
def bar_carry_ledger(spark, sf):
    """Constant carry per held bar inside the ledger and the curve."""
    c = pos.scenario_table(spark, {"CARRY": pos.CostModel(0.0004, 0.0002, 0.00001)}, (50.0,))
    t = cut(spark, grid.run_ledger(rule_signals(spark, sf, ["emaCrossover"]), ["symbol", "strategy"], c))
    e = pos.equity_curve(derive.bars(spark, sf), t, grid.run_list(c, ["emaCrossover"]), ["symbol"],
                         ["strategy", "scenario", "size_pct"], CAPITAL, bar_carry=True)
    return e.select("symbol", "ts", "equity")


@query
def run_metrics(spark, sf):
    t = ledgers(spark, sf)
    return mt.run_metrics(curves(spark, sf, t), t, RUN, BAR_MS, CAPITAL).drop("peak_index", "trough_index")


@query
def max_drawdown(spark, sf):
    t = ledgers(spark, sf, ["emaCrossover"])
    return mt.drawdown(mt.equity_profile(curves(spark, sf, t, ["emaCrossover"]), RUN), RUN)


@query
def size_sensitivity(spark, sf):
    t = ledgers(spark, sf, ["emaCrossover"], pos.SIZES)
    m = mt.trade_metrics(t, RUN).select(*RUN, "trade_count", "expectancy", "net_profit_factor")
    signs = m.groupBy("symbol", "strategy", "scenario").agg(gates.same_sign("expectancy").alias("consistent"))
    return m.join(signs, ["symbol", "strategy", "scenario"])


@query
def buy_hold(spark, sf):
    return pos.buy_and_hold(derive.bars(spark, sf), ["symbol"], pos.SCENARIOS["BASE"])


@query
def weekly_rerun(spark, sf):
    """Each week run on its own: state and capital start over (the calendar-slice re-run)."""
    b = derive.plain_bars(spark, sf, "15m").withColumn("week", F.weekofyear("ts").cast("bigint"))
    k = ["symbol", "week"]
    s = signals(derive.number_bars(b, "15m", k), ["emaCrossover"], keys=k)
    base = pos.scenario_table(spark, {"BASE": pos.SCENARIOS["BASE"]})
    t = grid.run_ledger(s, [*k, "strategy"], base)
    return t.groupBy(*k).agg(*mt.trade_aggs()).select(*k, "trade_count", "expectancy_pct", "net_profit_factor")


@query
def weekly_slices(spark, sf):
    """One continuous run, scored per week of the bars."""
    t = ledgers(spark, sf, ["emaCrossover"])
    e = curves(spark, sf, t, ["emaCrossover"]).withColumn("week", F.weekofyear("ts").cast("bigint"))
    run = [*RUN, "week"]
    m = mt.equity_metrics(mt.equity_profile(e, run), run, BAR_MS)
    tm = mt.trade_metrics(t.withColumn("week", F.weekofyear("entry_time").cast("bigint")), run)
    return m.join(tm, run, "left").select(
        *run, "total_return_pct", "max_drawdown_pct", "sharpe", "exposure_pct",
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"), "net_profit_factor")


FOLDS = {"F1": ("2024-01-11", "2024-01-18"), "F2": ("2024-01-18", "2024-01-25"), "F3": ("2024-01-25", "2024-02-01")}


@query
def fold_metrics(spark, sf):
    """Anchored walk-forward: run from the start to each fold's end, score the fold."""
    folds = grid.periods_table(spark, FOLDS)
    base = pos.scenario_table(spark, {"BASE": pos.SCENARIOS["BASE"]}, (25.0,))
    k = ["symbol", "strategy", "period"]
    s = grid.fold_signals(rule_signals(spark, sf, ["emaCrossover", "breakout24hTrend"]), folds)
    t = cut(spark, grid.run_ledger(s, k, base).join(F.broadcast(folds), "period"))
    names = grid.run_list(base, ["emaCrossover", "breakout24hTrend"])
    bars = grid.fold_bars(derive.bars(spark, sf), folds)
    e = pos.equity_curve(bars, t, names, ["symbol", "period"], ["strategy", "scenario", "size_pct"], CAPITAL)
    e = grid.scored(e.join(F.broadcast(folds), "period"), "ts")
    m = mt.equity_metrics(mt.equity_profile(e, k), k, BAR_MS)
    tr = dg.trade_returns(grid.scored(t, "entry_time"))
    n = F.col("net_return_pct")
    ts = tr.groupBy(*k).agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg(n).alias("net_exp_pct"),
        mt.profit_factor(n).alias("net_profit_factor"), F.avg("cost_pct").alias("avg_cost_pct"),
        F.sum("fees").alias("_fees"), F.avg("mfe").alias("avg_mfe"), F.avg("mae").alias("avg_mae"),
        F.sum(F.col("quantity") * F.col("entry_price")).alias("_bought"), F.avg("gross_return_pct").alias("_g"))
    med = qt.exact_quantiles(tr, k, "net_return_pct", {"median_net_pct": 0.5})
    out = m.join(ts, k, "left").join(med, k, "left")
    return out.select(
        *k, "initial_capital", "total_return_pct", "max_drawdown_pct", "sharpe", "exposure_pct",
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"), "net_exp_pct", "net_profit_factor",
        "avg_cost_pct", "avg_mfe", "avg_mae", "median_net_pct",
        (F.coalesce("_bought", F.lit(0.0)) / F.col("initial_capital")).alias("turnover"),
        (F.coalesce("trade_count", F.lit(0)) * (365 / 7)).alias("trades_per_year"),
        (F.coalesce("_fees", F.lit(0.0)) * (365 / 7)).alias("fees_per_year"),
        (F.coalesce("_fees", F.lit(0.0)) * (365 / 7) / F.col("initial_capital") * 100).alias("fees_per_year_pct"),
        dg.edge_cost(F.col("_g"), F.col("avg_cost_pct")).alias("edge_cost"))


@query
def before_after(spark, sf):
    """GROSS against BASE metrics per run."""
    m = mt.trade_metrics(ledgers(spark, sf), RUN)
    return joins.compare_scenarios(m, ["symbol", "strategy"], ["trade_count", "expectancy_pct", "win_rate_pct"],
                                   "GROSS", "BASE")


@query
def winner_per_dimension(spark, sf):
    t = ledgers(spark, sf)
    m = mt.run_metrics(curves(spark, sf, t), t, RUN, BAR_MS, CAPITAL).filter("scenario = 'BASE'")
    return m.groupBy("symbol").agg(
        gates.best_by(m, [], "strategy", "total_return_pct").alias("highest_return"),
        gates.best_by(m, [], "strategy", "sharpe").alias("best_sharpe"),
        gates.best_by(m, [], "strategy", "max_drawdown_pct", highest=False).alias("lowest_drawdown"))


# Joins and carry

@query
def asof_backward(spark, sf):
    """Last hourly bar opened at or before every tick; ticks are dense, so blocks are short."""
    t = derive.ticks(spark, sf)
    b = derive.plain_bars(spark, sf, "1h").select("symbol", F.col("ts").alias("open_time"), "open")
    j = joins.asof_join(t, b, ["symbol"], "ts", "open_time", ["open"], joins.seconds_block(60))
    return j.select("symbol", "seq", F.col("match.at").alias("open_time"), F.col("match.open").alias("open"))


@query
def asof_mark(spark, sf):
    return marked_events(spark, sf)


@query
def mark_coverage(spark, sf):
    return joins.mark_coverage(marked_events(spark, sf), ["symbol"])


@query
def interval_carry(spark, sf):
    _, _, flows = carry_run(spark, sf)
    return flows.select("symbol", "entry_time", "event_time", "rate", "mark_price", "cashflow")


@query
def carry_trades(spark, sf):
    _, trades, flows = carry_run(spark, sf)
    e = carry.enrich(trades, flows.select(*RUN, "entry_ord", "cashflow"), [*RUN, "entry_ord"])
    return e.select("symbol", "entry_time", "carry_events", "carry_paid", "carry_received", "net_carry",
                    "net_pnl_before", "net_pnl_after")


@query
def carry_equity(spark, sf):
    base, trades, flows = carry_run(spark, sf)
    e = pos.equity_curve(derive.bars(spark, sf), trades, grid.run_list(base, ["emaCrossover"]), ["symbol"],
                         ["strategy", "scenario", "size_pct"], CAPITAL)
    return carry.equity_with_carry(e, flows, RUN, BAR_MS).select("symbol", "ts", "equity")


@query
def carry_metrics(spark, sf):
    """Carry-adjusted metric family with totals, impact class and gate inputs."""
    base, trades, flows = carry_run(spark, sf)
    e = pos.equity_curve(derive.bars(spark, sf), trades, grid.run_list(base, ["emaCrossover"]), ["symbol"],
                         ["strategy", "scenario", "size_pct"], CAPITAL)
    rich = cut(spark, carry.enrich(trades, flows.select(*RUN, "entry_ord", "cashflow"), [*RUN, "entry_ord"]))
    before = mt.carry_run_metrics(mt.equity_profile(e, RUN), trades, RUN, CAPITAL, 25.0, 96)
    after = mt.carry_run_metrics(mt.equity_profile(carry.equity_with_carry(e, flows, RUN, BAR_MS), RUN), rich,
                                 RUN, CAPITAL, 25.0, 96)
    b = before.select(*RUN, F.col("total_return_pct").alias("return_before"),
                      F.col("net_exp_pct").alias("exp_before"))
    out = after.join(b, RUN).join(carry.totals(rich, RUN), RUN)
    return out.select(
        "symbol", "trade_count", "return_before", "total_return_pct", "exp_before", "net_exp_pct",
        "net_profit_factor", "sharpe", "sortino", "max_drawdown_pct", "win_rate_pct", "avg_holding_hours",
        "total_carry_paid", "total_carry_received", "total_net_carry", "total_carry_events",
        carry.impact_class(F.col("total_net_carry"), CAPITAL, F.col("return_before")).alias("impact"),
        gates.edge_destroyed(F.col("exp_before"), F.col("net_exp_pct")).alias("edge_destroyed"))


@query
def carry_yearly(spark, sf):
    _, trades, flows = carry_run(spark, sf)
    rich = carry.enrich(trades, flows.select(*RUN, "entry_ord", "cashflow"), [*RUN, "entry_ord"])
    return carry.yearly(rich, ["symbol"], CAPITAL, 25.0, ["entry_ord"], 96)


@query
def carry_top5(spark, sf):
    _, trades, flows = carry_run(spark, sf)
    rich = cut(spark, carry.enrich(trades, flows.select(*RUN, "entry_ord", "cashflow"), [*RUN, "entry_ord"]))
    return carry.top_share(rich, ["symbol"])


# Diagnostics

@query
def trade_features(spark, sf):
    t = ledgers(spark, sf, ["emaCrossover"], only=["BASE"])
    c = dg.entry_context(t, dg.bar_features(derive.bars(spark, sf)))
    return c.select("symbol", "entry_time", "gross_return_pct", "net_return_pct", "cost_pct", "mfe", "mae",
                    *dg.FEATURES)


@query
def mfe_mae(spark, sf):
    t = dg.trade_returns(ledgers(spark, sf))
    return t.select(*RUN, "entry_time", "mfe", "mae")


@query
def forward_entry(spark, sf):
    t = ledgers(spark, sf, ["emaCrossover"], only=["GROSS"])
    return dg.forward_excursions(derive.bars(spark, sf), t).select(
        "symbol", "entry_time", *[f"fwd_{m}_{h}" for h in (4, 12, 24) for m in ("mfe", "mae")])


def _contexts(spark, sf):
    t = ledgers(spark, sf, ["emaCrossover"], only=["BASE"])
    return cut(spark, dg.entry_context(t, dg.bar_features(derive.bars(spark, sf))))


@query
def regime_buckets(spark, sf):
    t = dg.with_regime(_contexts(spark, sf), [])
    parts = {
        "trend": dg.quadrant(F.col("trend_above"), F.col("trend_up")),
        "volatility": F.coalesce("vol_bucket", F.lit("N/A")),
        "density_24h": dg.bucket(F.col("crosses_24h"), dg.DENSITY_BUCKETS),
        "density_72h": dg.bucket(F.col("crosses_72h"), dg.DENSITY_BUCKETS),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("bucket")) for k, v in parts.items()]))
    t = t.withColumn("_p", pairs).select("*", "_p.*").drop("_p")
    return t.groupBy("kind", "bucket").agg(*dg.bucket_stats()).select(
        "kind", "bucket", "count", "gross_exp_pct", "net_exp_pct", "net_profit_factor", "win_rate_pct")


@query
def spread_quartiles(spark, sf):
    t = dg.spread_quartile(_contexts(spark, sf)).filter("band is not null")
    return t.groupBy("band").agg(*dg.bucket_stats()).select("band", "count", "net_exp_pct", "win_rate_pct",
                                                            "avg_mfe_pct", "avg_mae_pct")


@query
def trade_stats(spark, sf):
    """Trade metrics with losing streak over the external ledger."""
    t = ext_trades(spark, sf)
    m = mt.trade_metrics(t, ["symbol", "strategy"])
    s = mt.losing_streak(t, ["symbol", "strategy"], EXT_ORDER, ext_chunk())
    return m.join(s, ["symbol", "strategy"])


@query
def holding_buckets(spark, sf):
    order = [label for _, label in dg.BAR_BUCKETS]
    return dg.bucketise(ext_trades(spark, sf), ["symbol"], dg.bucket(F.col("holding_bars"), dg.BAR_BUCKETS), order)


@query
def holding_hours(spark, sf):
    return dg.holding_hours(ext_trades(spark, sf), ["symbol"], 3_600_000)


@query
def short_trades(spark, sf):
    return dg.short_trade_share(ext_trades(spark, sf), ["strategy"])


@query
def excursion_table(spark, sf):
    return dg.excursion_table(ext_trades(spark, sf), ["symbol"])


@query
def give_back(spark, sf):
    return dg.give_back(ext_trades(spark, sf), ["symbol"])


@query
def cost_decomposition(spark, sf):
    return dg.cost_decomposition(ext_trades(spark, sf), ["symbol"])


@query
def quartiles(spark, sf):
    return qt.exact_quantiles(derive.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice",
                              {"q1": 0.25, "q2": 0.5, "q3": 0.75})


@query
def year_matrix(spark, sf):
    return dg.year_matrix(ext_trades(spark, sf), ["strategy"])


@query
def year_pivot(spark, sf):
    m = dg.year_matrix(ext_trades(spark, sf), [])
    return dg.pivot_years(m, [], ["A", "N", "R", "ALL"]).select(
        "year", F.col("A").alias("exp_a"), F.col("N").alias("exp_n"), F.col("R").alias("exp_r"),
        F.col("ALL").alias("exp_all"))


@query
def pooled_stats(spark, sf):
    t = ext_trades(spark, sf)
    n, g = F.col("net_return_pct"), F.col("gross_return_pct")
    return t.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("count"), F.avg(n).alias("net_exp_pct"), mt.profit_factor(n).alias("net_pf"),
        mt.profit_factor(g).alias("gross_pf"), mt.calendar_rate(F.count(F.lit(1)), F.min("entry_time"),
                                                                F.max("entry_time")).alias("per_year"))


@query
def concentration(spark, sf):
    y = ext_trades(spark, sf).groupBy("strategy", "symbol", F.year("entry_time").alias("year")).agg(
        F.sum("gross_pnl").alias("net_pnl"))
    return mt.year_concentration(y, ["strategy"])


@query
def capital_efficiency(spark, sf):
    t = ledgers(spark, sf, ["emaCrossover"])
    m = mt.equity_metrics(mt.equity_profile(curves(spark, sf, t, ["emaCrossover"]), RUN), RUN, BAR_MS, CAPITAL)
    return m.select(*RUN, mt.capital_efficiency(F.col("total_return_pct"), F.col("exposure_pct"))
                    .alias("return_per_exposure"))


# Gates

def base_sharpe(spark, sf, trades, strategies=RULES_15M):
    """Sharpe ratio of each rule's and symbol's equity with BASE costs."""
    runs = grid.run_list(costs(spark, only=["BASE"]), strategies)
    e = pos.equity_curve(derive.bars(spark, sf), trades.filter("scenario = 'BASE'"), runs, ["symbol"],
                         ["strategy", "scenario", "size_pct"], CAPITAL)
    m = mt.equity_metrics(mt.equity_profile(e, RUN), RUN, BAR_MS, CAPITAL)
    return m.select("strategy", "symbol", F.col("sharpe").alias("base_sharpe"))


def weekly_exp(trades, keys, value="net_return_pct"):
    """Expectancy of each week of entries (the test tables hold a few weeks, so these stand for calendar years)."""
    return trades.groupBy(*keys, F.weekofyear("entry_time").alias("week")).agg(F.avg(value).alias("net_exp"))


def _gate_inputs(trades):
    """Per rule and symbol: expectancy and profit factor of the three cost scenarios."""
    n = F.col("net_return_pct")
    t = dg.trade_returns(trades)
    m = t.groupBy("strategy", "symbol", "scenario").agg(
        F.count(F.lit(1)).alias("count"), F.avg(n).alias("exp"), mt.profit_factor(n).alias("pf"))

    def of(s, c):
        return F.max(F.when(F.col("scenario") == s, F.col(c)))

    return m.groupBy("strategy", "symbol").agg(
        of("BASE", "count").alias("count"), of("GROSS", "exp").alias("gross_net_exp"),
        of("BASE", "exp").alias("base_net_exp"), of("BASE", "pf").alias("base_net_pf"),
        of("STRESS", "exp").alias("stress_net_exp"), of("STRESS", "pf").alias("stress_net_pf"))


@query
def cost_class(spark, sf):
    c = F.col
    args = (c("gross_net_exp"), c("base_net_exp"), c("base_net_pf"), c("stress_net_exp"), c("stress_net_pf"))
    return _gate_inputs(ledgers(spark, sf)).select(
        "strategy", "symbol", "count", sc.sample_label(c("count")).alias("sample"),
        gates.cost_class(*args).alias("cost_class"), gates.development_cost_class(*args).alias("development_class"))


@query
def external_gates(spark, sf):
    """External-validation gates of each rule: its symbols with BASE and STRESS costs, BASE by week."""
    t = ledgers(spark, sf)
    a = _gate_inputs(t).join(base_sharpe(spark, sf, t), ["strategy", "symbol"])
    y = weekly_exp(dg.trade_returns(t).filter("scenario = 'BASE'"), ["strategy", "symbol"])
    return gates.external_gates(a, y, ["strategy"])


@query
def survival_gates(spark, sf):
    """Screening, development, timeframe and pooled decisions per rule over all symbols.

    The Sharpe ratio is the mean of the symbols' BASE runs (none if one is undefined); the buckets are symbol and week.
    """
    c = F.col
    n = c("net_return_pct")
    led = ledgers(spark, sf)
    t = dg.trade_returns(led)
    whole = t.groupBy("strategy", "scenario").agg(
        F.count(F.lit(1)).alias("count"), F.avg(n).alias("exp"), mt.profit_factor(n).alias("pf"))
    b = whole.filter("scenario = 'BASE'")
    s = whole.filter("scenario = 'STRESS'").select("strategy", c("exp").alias("s_exp"), c("pf").alias("s_pf"))
    per_symbol = t.filter("scenario = 'BASE'").groupBy("strategy", "symbol").agg(
        F.avg(n).alias("e"), mt.profit_factor(n).alias("p"))
    per_symbol = base_sharpe(spark, sf, led).join(per_symbol, ["strategy", "symbol"], "left")
    symbols = per_symbol.groupBy("strategy").agg(
        F.max("e").alias("_hi"), F.min("e").alias("_lo"), F.bool_and(c("e") > 0).alias("all_positive"),
        F.when(F.count("base_sharpe") == F.count(F.lit(1)), F.avg("base_sharpe")).alias("sharpe"),
        F.count_if(gates.asset_gate(c("e"), c("p"), c("base_sharpe"))).alias("assets"))
    cells = weekly_exp(t.filter("scenario = 'BASE'"), ["strategy", "symbol"])
    weeks = cells.groupBy("strategy", "week").agg(
        F.avg("net_exp").alias("_w"), F.count_if(c("net_exp") > 0).alias("_p"))
    weeks = weeks.groupBy("strategy").agg(F.bool_and(c("_w") > 0).alias("weeks_positive"), F.sum("_p").alias("positive"))
    conflict = gates.sign_conflict(c("_hi"), c("_lo"))
    args = (c("exp"), c("pf"), c("sharpe"))
    return b.join(s, "strategy").join(symbols, "strategy").join(weeks, "strategy").select(
        "strategy", "count", "positive", "assets", "sharpe", conflict.alias("conflict"),
        gates.screening(c("count"), *args, c("all_positive") & c("weeks_positive")).alias("screening"),
        gates.development_survival(*args, c("positive"), conflict, c("count")).alias("survives"),
        gates.timeframe_verdict(*args, c("s_exp"), c("s_pf"), c("positive"), c("all_positive"), conflict, c("count"))
        .alias("verdict"),
        gates.pooled_final(c("count"), *args, c("assets"), c("s_exp"), c("s_pf")).alias("pooled"))


FULL_WEEK = 600  # of 672 bars


@query
def carry_gates(spark, sf):
    """Carry-adjusted decision per rule: BASE and STRESS runs with their carry, full weeks, edge before and after."""
    bars = derive.bars(spark, sf)
    week = F.weekofyear("ts").alias("week")
    full = bars.groupBy("symbol", week).agg(F.count(F.lit(1)).alias("_n")).filter(mt.full_year(F.col("_n"), FULL_WEEK))
    runs = {}
    for name in ("BASE", "STRESS"):
        price, trades, flows = carry_run(spark, sf, name)
        rich = cut(spark, carry.enrich(trades, flows.select(*RUN, "entry_ord", "cashflow"), [*RUN, "entry_ord"]))
        e = pos.equity_curve(bars, trades, grid.run_list(price, ["emaCrossover"]), ["symbol"],
                             ["strategy", "scenario", "size_pct"], CAPITAL)
        e = carry.equity_with_carry(e, flows, RUN, BAR_MS)
        runs[name] = rich, mt.carry_run_metrics(mt.equity_profile(e, RUN), rich, RUN, CAPITAL, 25.0, 96)
    k = ["strategy", "symbol"]
    rich, base = runs["BASE"]
    before = rich.groupBy(*k).agg(F.avg("net_pnl_before").alias("before_exp"))
    assets = bars.select("symbol").distinct().withColumn("strategy", F.lit("emaCrossover"))
    assets = assets.join(base.select(*k, "net_exp_pct", "net_profit_factor", "sharpe"), k, "left").join(before, k, "left")
    stress = runs["STRESS"][1].select(*k, F.col("net_exp_pct").alias("stress_exp"), F.col("net_profit_factor").alias("stress_pf"))
    cells = weekly_exp(rich, k, "net_pnl_after").join(full.select("symbol", "week"), ["symbol", "week"], "left_semi")
    return gates.carry_gates(assets.join(stress, k, "left"), cells, ["strategy"])


@query
def grade(spark, sf):
    t = ledgers(spark, sf)
    m = t.groupBy("symbol", "strategy", "scenario").agg(
        F.count(F.lit(1)).alias("n"), F.avg("net_pnl").alias("e"), F.sum("net_pnl").alias("r"))

    def of(s, c):
        return F.max(F.when(F.col("scenario") == s, F.col(c)))

    g = m.groupBy("symbol", "strategy").agg(
        of("BASE", "n").alias("trade_count"), gates.grade(of("BASE", "n"), of("GROSS", "e"), of("GROSS", "r"), of("BASE", "e"),
                                    of("BASE", "r")).alias("grade"))
    return g.withColumn("label", gates.grade_label(F.col("grade")))


@query
def regime_check(spark, sf):
    t = ext_trades(spark, sf).groupBy("strategy", "symbol", F.year("entry_time").alias("year")).agg(
        F.avg("net_return_pct").alias("net_exp"))
    return t.groupBy("strategy", "year").agg(gates.regime_check(year=2025).alias("regime"))


# Tables of the live half

def snapshots(spark, sf):
    c = derive.table(spark, sf, "customer").withColumn("symbol", F.col("c_custkey"))
    o = derive.table(spark, sf, "orders")
    local = c.filter("c_acctbal > 0").select(
        "symbol", F.lit("LONG").alias("side"), F.col("c_acctbal").alias("entry_price"),
        F.lit(1.0).alias("quantity"), F.lit(5.0).alias("leverage"),
        (F.col("c_acctbal") * 0.97).alias("stop_price"), F.lit(None).cast("double").alias("profit_price"))
    recent = o.filter("o_orderdate >= timestamp '2001-01-01'").groupBy(F.col("o_custkey").alias("symbol")).agg(
        F.max("o_totalprice").alias("p"), F.count(F.lit(1)).alias("n"))
    sign = F.when(F.col("n") % 2 == 0, -1.0).otherwise(1.0)
    remote = recent.select(
        "symbol", (F.col("n") * sign).cast("string").alias("positionAmt"),
        F.col("p").cast("string").alias("entryPrice"), F.lit("3").alias("leverage"))
    orders = o.select(
        F.col("o_custkey").alias("symbol"), F.col("o_orderkey").cast("string").alias("order_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "STOP_MARKET")
        .when(F.col("o_orderpriority") == "2-HIGH", "TAKE_PROFIT_MARKET")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "STOP").otherwise("LIMIT").alias("type"),
        F.when(F.col("o_orderkey") % 2 == 0, "SELL").otherwise("BUY").alias("side"),
        F.when(F.col("o_orderstatus") == "O", "NEW").when(F.col("o_orderstatus") == "P", "PARTIALLY_FILLED")
        .otherwise("FILLED").alias("status"),
        (F.col("o_totalprice") * 0.9).cast("string").alias("stop_price"), F.lit("0").alias("price"),
        F.col("o_orderkey").alias("arrival"))
    return local, remote, orders


@query
def reconcile_positions(spark, sf):
    local, remote, orders = snapshots(spark, sf)
    return rc.reconcile_positions(local, remote, orders)


@query
def protective_match(spark, sf):
    local, _, orders = snapshots(spark, sf)
    return rc.protective_orders(local.select("symbol", "side"), orders)


@query
def snapshot_actions(spark, sf):
    local, remote, _ = snapshots(spark, sf)
    return rc.compare_snapshots(local, remote, ["symbol"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query
def position_upsert(spark, sf):
    local, remote, _ = snapshots(spark, sf)
    new = remote.select("symbol", F.lit(None).cast("string").alias("side"),
                        F.col("entryPrice").cast("double").alias("entry_price"),
                        F.lit(None).cast("double").alias("stop_price"))
    return rc.upsert(local, new, ["symbol"], explicit_null=("stop_price",))


def fills(spark, sf):
    """Closing and entry messages per order; a message sequence orders the versions."""
    li = derive.table(spark, sf, "lineitem")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return li.select(
        F.col("l_returnflag").alias("account"), F.col("l_orderkey").cast("string").alias("order_id"), seq.alias("seq"),
        (F.col("l_linestatus") == "F").alias("is_close"),
        (F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("gross_pnl"),
        (F.col("l_extendedprice") * F.col("l_tax") * 0.1).alias("commission"), F.col("l_shipdate").alias("ts"))


@query
def settlement(spark, sf):
    return rc.settle(fills(spark, sf), ["account"]).withColumnRenamed("gross_pnl", "gross_profit")


@query
def daily_stats(spark, sf):
    f = fills(spark, sf)
    b = f.groupBy("account", F.to_date("ts").alias("day")).agg(
        (F.count(F.lit(1)) * 1000.0).alias("start_balance"))
    d = rc.daily_stats(f, b, ["account"])
    return d.select("account", F.col("day").cast("string").alias("day"), "realised_pnl", "total_commission",
                    "trade_count", "winning_trades", "start_balance", "current_balance",
                    rc.loss_cap_hit(F.col("realised_pnl"), F.col("start_balance"), 3.0).alias("loss_cap_hit"))


@query
def fill_normalisation(spark, sf):
    """Order messages in both spellings, built from orders, read back."""
    o = derive.table(spark, sf, "orders")
    num = F.col("o_totalprice").cast("string")
    k = F.col("o_orderkey")
    short = F.to_json(F.struct(
        k.alias("i"), F.col("o_orderpriority").alias("s"), F.lit("FILLED").alias("X"), num.alias("ap"),
        F.lit("2").alias("z"), F.lit("0.5").alias("n"), F.lit("USDT").alias("N"), (k % 3 == 0).alias("R")))
    long = F.to_json(F.struct(
        k.alias("orderId"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("_x"),
        F.when(F.col("o_orderstatus") == "O", "NEW").otherwise("FILLED").alias("orderStatus"),
        num.alias("avgPrice"), F.lit("2").alias("executedQty"), F.lit("0.5").alias("commission"),
        F.lit("BNB").alias("commissionAsset"), F.lit("STOP_MARKET").alias("type")))
    m = o.select(k.alias("seq"), F.when(k % 2 == 0, short).otherwise(long).alias("body"))
    return rc.normalise_fills(m).select("seq", "symbol", "order_id", "order_type", "price", "executed_qty",
                                        "commission", "protective", "is_close")


LIMITS = {"size_pct": 10, "leverage": 5, "max_notional": 4000, "max_positions": 3, "stop_pct": 2, "profit_pct": 4}


@query
def screening(spark, sf):
    """Every order as an entry signal against its customer's account state."""
    o = derive.table(spark, sf, "orders")
    c = derive.table(spark, sf, "customer")
    direction = (F.when(F.col("o_orderstatus") == "O", "LONG").when(F.col("o_orderstatus") == "F", "SHORT")
                 .otherwise("CLOSE"))
    price = F.col("o_totalprice") / 100
    moved = price * (1 + (F.col("o_orderkey") % 7 - 3) / 10)
    s = o.select("o_orderkey", F.col("o_custkey").alias("account"), direction.alias("direction"), price.alias("price"),
                 F.when(F.col("o_orderkey") % 3 > 0, moved).alias("mark"))
    k = F.col("c_custkey")
    st = c.select(
        k.alias("account"), (k % 13 == 0).alias("paused"), (k % 11 == 0).alias("breaker"), (k % 7 == 0).alias("pending"),
        (k % 5 == 0).alias("cooling_down"), (k % 17 == 0).alias("loss_cap"), (k % 5).alias("slots_used"),
        (k % 2 == 0).alias("has_position"), F.col("c_acctbal").alias("balance"),
        (F.col("c_acctbal") / 4).alias("margin_used"), F.lit(0.001).alias("lot_step"), F.lit(0.01).alias("tick"))
    return rc.screen_entries(s, st, LIMITS, ["account"]).groupBy(
        "direction", F.coalesce("reject_reason", F.lit("approved")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity_sum"))


@query
def margin_ratio(spark, sf):
    """Margin ratio per nation over its customers' orders as positions."""
    o, c = derive.table(spark, sf, "orders"), derive.table(spark, sf, "customer")
    p = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("account"), F.col("o_orderpriority").alias("symbol"),
        F.col("o_totalprice").alias("entry_price"), F.lit(0.01).alias("quantity"), F.lit(5.0).alias("leverage"))
    m = o.groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.max("o_totalprice").alias("price")).withColumn(
        "price", F.when(F.col("symbol") != "5-LOW", F.col("price")))
    used = rc.margin_used(p, m, ["account"])
    bal = c.groupBy(F.col("c_nationkey").alias("account")).agg(F.sum("c_acctbal").alias("balance"))
    return used.join(bal, "account").select(
        "account", "open_positions", rc.margin_ratio(F.col("balance"), F.col("margin_used")).alias("ratio_pct"))


@query
def unrealised_pnl(spark, sf):
    t = derive.ticks(spark, sf)
    p = t.select("symbol", "seq", F.when(F.col("seq") % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
                 F.col("price").alias("entry_price"), F.lit(2.0).alias("quantity"))
    last = rc.latest_values(t, ["symbol"], "price", "ts")
    return rc.unrealised(p, last).select("seq", "symbol", "side", "unrealised_pnl")


@query
def loss_trips(spark, sf):
    """Batch form of the loss breaker: every fifth loss of an unbroken row of losses."""
    t = ext_trades(spark, sf)
    lost = F.col("net_pnl") < 0
    t = t.withColumns({"_c": block_no(ext_chunk()), "_win": (~lost).cast("bigint"),
                       "_lost": lost.cast("bigint")})
    t = scan(t, ["symbol"], EXT_ORDER, "_c", {"_isle": ("_win", "sum"), "_losses": ("_lost", "sum")})
    # Losses before the row of losses began: the running count at its winning head.
    t = t.withColumn("_head", F.when(~lost, F.col("_losses")))
    t = scan(t, ["symbol"], EXT_ORDER, "_c", {"_base": ("_head", "last")})
    nth = F.col("_losses") - F.coalesce("_base", F.lit(0))
    return t.filter(lost & (nth % 5 == 0)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trips"), F.max(nth).alias("longest_streak"))


@query
def top_n_recent(spark, sf):
    t = derive.ticks(spark, sf)
    return joins.latest_per_key(t, ["symbol"], 50, [F.desc("ts"), F.desc("seq")])


@query
def signal_log(spark, sf):
    """Newest 50 signals and rejections per rule."""
    s = rule_signals(spark, sf).filter("set_long or reset")
    ok = s.filter("set_long").select("strategy", "symbol", "ts", F.lit("signal").alias("kind"))
    no = s.filter("not set_long").select("strategy", "symbol", "ts", F.lit("rejected").alias("kind"))
    both = ok.unionByName(no)
    return joins.latest_per_key(both, ["strategy"], 50, [F.desc("ts"), F.asc("symbol"), F.asc("kind")])


@query
def replace_from(spark, sf):
    b = derive.plain_bars(spark, sf, "1h")
    cutoff = F.lit("2024-01-20").cast("timestamp")
    new = b.filter(F.col("ts") >= cutoff).withColumn("close", F.col("close") + 1)
    return joins.replace_from(b, new, cutoff)


@query
def long_metrics(spark, sf):
    m = mt.trade_metrics(ext_trades(spark, sf), ["symbol"])
    return joins.long_form(m, ["symbol"], ["win_rate_pct", "net_profit_factor", "expectancy_pct"])


@query
def run_warnings(spark, sf):
    t = ledgers(spark, sf, ["rsiEma"])
    m = mt.run_metrics(curves(spark, sf, t, ["rsiEma"]), t, RUN, BAR_MS, CAPITAL)
    forced = t.groupBy(*RUN).agg(F.max("forced_exit").alias("forced"))
    cont = q.continuity(derive.plain_bars(spark, sf, "15m"), BAR_MS)
    j = m.join(forced, RUN, "left").join(cont, "symbol")
    w = q.run_warnings(F.col("trade_count"), F.col("bars_total"), F.lit(False),
                       F.coalesce("forced", F.lit(False)), F.col("gap_count"), F.col("missing_bars"),
                       F.col("sharpe"), F.lit(0), F.lit(0))
    return j.select(*RUN, F.concat_ws(" | ", w).alias("warnings"))
