"""Periodic carry (funding) on top of trades and equity curves."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import finite, ratio
from tickloom.operators.joins import interval_join
from tickloom.operators.metrics import profit_factor
from tickloom.operators.sequence import BLOCK, block_no, scan, time_chunk


def cashflows(trades: DataFrame, events: DataFrame, on: list[str], bucket: Callable[[Column], Column]
              ) -> DataFrame:
    """One row per trade and carry event strictly inside it.

    A positive rate costs a long position: cashflow = -(quantity * mark * rate). Events
    with rate 0 or an unusable rate or mark are left out. ``events``: on, event_time,
    rate, mark_price, at most one per time.
    """
    usable = finite(F.col("rate")) & (F.col("rate") != 0) & finite(F.col("mark_price")) & (F.col("mark_price") > 0)
    j = interval_join(trades, events.filter(usable), on, "entry_time", "exit_time", "event_time", bucket)
    return j.withColumn("cashflow", -(F.col("quantity") * F.col("mark_price") * F.col("rate")))


def carry_aggs() -> list[Column]:
    c = F.col("cashflow")
    return [F.count(F.lit(1)).alias("carry_events"),
            F.sum(F.when(c < 0, -c).otherwise(0.0)).alias("carry_paid"),
            F.sum(F.when(c >= 0, c).otherwise(0.0)).alias("carry_received"),
            F.sum(c).alias("net_carry")]


def enrich(trades: DataFrame, flows: DataFrame, trade_key: list[str]) -> DataFrame:
    """Trades with carry totals and PnL before and after; trades without events get 0."""
    totals = flows.groupBy(*trade_key).agg(*carry_aggs())
    out = trades.join(totals, trade_key, "left").withColumns({
        "carry_events": F.coalesce("carry_events", F.lit(0)),
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("carry_paid", "carry_received", "net_carry")}})
    return out.withColumns({"net_pnl_before": F.col("net_pnl"),
                            "net_pnl_after": F.col("net_pnl") + F.col("net_carry")})


def totals(enriched: DataFrame, run: list[str]) -> DataFrame:
    return enriched.groupBy(*run).agg(*[F.sum(c).alias(f"total_{c}") for c in (
        "carry_paid", "carry_received", "net_carry", "carry_events")])


def equity_with_carry(equity: DataFrame, flows: DataFrame, run: list[str], interval_ms: int) -> DataFrame:
    """Equity plus all cashflows up to and including the bar's time, over all trades of a run."""
    e = equity.drop("_blk").withColumns({"_flow": F.lit(0.0), "_side": F.lit(1)})
    f = flows.select(*run, F.col("event_time").alias("ts"), F.col("cashflow").alias("_flow"),
                     F.lit(0).alias("_side"))
    both = e.unionByName(f, allowMissingColumns=True)
    both = both.withColumn("_chunk", block_no(time_chunk("ts", BLOCK * interval_ms / 1000)))
    out = scan(both, run, ["ts", "_side"], "_chunk", {"_cum": ("_flow", "sum")}).filter("_side = 1")
    out = out.withColumn("equity", F.col("equity") + F.col("_cum"))
    return out.withColumn("_blk", block_no(F.col("ord"), BLOCK)).drop("_flow", "_side", "_cum", "_chunk")


def impact_class(net_carry: Column, capital: float, total_return_pct: Column) -> Column:
    """Carry against trading result: share of the absolute return it makes up."""
    share = F.abs(ratio(net_carry / capital * 100, total_return_pct))
    return (F.when(F.abs(total_return_pct) <= 0.01, "UNSTABLE RATIO — NEAR ZERO BASE PNL")
            .when(share < 0.10, "NEGLIGIBLE").when(share < 0.30, "MODERATE")
            .when(share < 0.50, "MATERIAL").otherwise("SEVERE"))


def yearly(enriched: DataFrame, keys: list[str], capital: float, size_pct: float,
           order: list[str], bars_per_day: int = 6) -> DataFrame:
    """Per key and entry year: expectancy on a fixed notional, profit factor, carry and the
    Sharpe of the per-trade equity of that year."""
    run = [*keys, "year"]
    t = enriched.withColumn("year", F.year("entry_time"))
    t = t.withColumn("_blk", block_no(time_chunk("entry_time", 86_400 * 7)))
    # The first trade of a year has no return.
    t = t.withColumn("_one", F.lit(1).cast("bigint"))
    t = scan(t, run, order, "_blk", {"_cum": ("net_pnl_after", "sum"), "_nth": ("_one", "sum")})
    after = F.lit(capital) + F.col("_cum")
    before = after - F.col("net_pnl_after")
    r = F.when(F.col("_nth") > 1, ratio(after - before, before))
    g = t.withColumn("_r", r).groupBy(*run).agg(
        F.count(F.lit(1)).alias("trade_count"),
        (F.avg("net_pnl_after") / (capital * size_pct / 100) * 100).alias("net_exp_pct"),
        F.sum("net_pnl_after").alias("net_pnl"), F.sum("net_pnl_before").alias("net_before_carry"),
        F.sum("net_carry").alias("net_carry"), F.sum("gross_pnl").alias("gross_pnl"),
        profit_factor(F.col("net_pnl_after")).alias("net_profit_factor"),
        F.avg("_r").alias("_mu"), F.stddev_samp("_r").alias("_sd"))
    sharpe = F.when(F.col("_sd") > 0, F.col("_mu") / F.col("_sd") * F.sqrt(F.lit(float(365 * bars_per_day))))
    return g.withColumn("sharpe", F.coalesce(sharpe, F.lit(0.0))).drop("_mu", "_sd")


def top_share(flows_per_trade: DataFrame, keys: list[str], n: int = 5, limit: float = 0.5) -> DataFrame:
    """Share of the ``n`` costliest trades in all carry paid."""
    from tickloom.operators.joins import latest_per_key

    top = latest_per_key(flows_per_trade, keys, n, [F.desc("carry_paid"), F.asc("entry_time")])
    top = top.groupBy(*keys).agg(F.sum("carry_paid").alias("top_paid"))
    paid = flows_per_trade.groupBy(*keys).agg(F.sum("carry_paid").alias("total_paid"))
    share = F.when(F.col("total_paid") > 0, F.col("top_paid") / F.col("total_paid"))
    return paid.join(top, keys).withColumn("top_share", share).withColumn(
        "concentrated", F.coalesce(share > limit, F.lit(False)))
