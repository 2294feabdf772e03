"""Performance metrics per run from equity curves and trade ledgers.

Metrics that cannot be computed are NULL, never 0. Everything ends in a plain
groupBy over the run keys, so rows are combined before any exchange.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import YEAR_MILLIS, epoch_millis, periods_per_year, ratio
from tickloom.operators.sequence import BLOCK, int_div, scan


def equity_profile(equity: DataFrame, run: list[str]) -> DataFrame:
    """Bar returns and draw-down per point; the first point of a run has no return.

    Needs ``ord``, ``_blk`` and ``equity``. Slicing a run by year or fold means adding
    that column to ``run``.
    """
    e = equity.withColumn("_p", F.struct(F.col("equity").alias("v"), (-F.col("ord")).alias("o")))
    e = scan(e, run, ["ord"], "_blk", {"_prev": ("equity", "last"), "_peak": ("_p", "max")}, inclusive=False)
    peak = F.greatest(F.col("_peak"), F.col("_p"))
    e = e.withColumns({
        "bar_return": F.when(F.col("_prev") > 0, F.col("equity") / F.col("_prev") - 1),
        "raw_return": F.when(F.col("_prev") != 0, F.col("equity") / F.col("_prev") - 1),
        "peak": peak["v"], "peak_ord": -peak["o"]})
    e = e.withColumn("dd_abs", F.col("peak") - F.col("equity"))
    e = e.withColumn("dd_pct", F.when(F.col("peak") > 0, F.col("dd_abs") / F.col("peak") * 100)
                     .otherwise(F.lit(0.0)))
    return e.drop("_p", "_prev", "_peak")


def _drawdown_aggs() -> list[Column]:
    deepest = F.max_by(F.struct("dd_abs", "peak_ord", "ord", "dd_pct"), F.struct("dd_pct", -F.col("ord")))
    return [deepest.alias("_dd")]


def _drawdown_columns() -> list[Column]:
    d = F.col("_dd")
    none = d["dd_pct"] <= 0
    zero = F.lit(0).cast("bigint")
    return [
        F.when(none, 0.0).otherwise(d["dd_pct"]).alias("max_drawdown_pct"),
        F.when(none, 0.0).otherwise(d["dd_abs"]).alias("max_drawdown_abs"),
        F.when(none, zero).otherwise(d["peak_ord"]).alias("peak_index"),
        F.when(none, zero).otherwise(d["ord"]).alias("trough_index"),
    ]


def drawdown(profile: DataFrame, run: list[str]) -> DataFrame:
    """Deepest relative fall from a running peak; the first such point decides ties."""
    return profile.groupBy(*run).agg(*_drawdown_aggs()).select(*run, *_drawdown_columns())


def equity_metrics(profile: DataFrame, run: list[str], interval_ms: int,
                   capital: float | None = None) -> DataFrame:
    """Return, annualised return, draw-down, Sharpe, Sortino and exposure per run.

    Deviations are population ones; the downside mean runs over all bars. Without
    ``capital`` the first equity of the run is the starting value.
    """
    r = F.col("bar_return")
    a = profile.groupBy(*run).agg(
        F.min_by("equity", "ord").alias("_first"), F.max_by("equity", "ord").alias("final_equity"),
        F.min("ts").alias("_t0"), F.max("ts").alias("_t1"), F.count(F.lit(1)).alias("bars_total"),
        F.count("bar_return").alias("_n"), F.avg(r).alias("_mu"), F.stddev_pop(r).alias("_sd"),
        F.avg(F.when(r < 0, r * r).when(r >= 0, 0.0)).alias("_dv"),
        F.count_if("in_position").alias("bars_in_position"), *_drawdown_aggs())
    start = F.lit(float(capital)) if capital is not None else F.col("_first")
    years = (epoch_millis("_t1") - epoch_millis("_t0")) / F.lit(float(YEAR_MILLIS))
    scale = F.sqrt(F.lit(float(periods_per_year(interval_ms))))
    enough = F.col("_n") >= 2
    down = F.sqrt("_dv")
    return a.select(
        *run, start.alias("initial_capital"), "final_equity",
        F.when(start > 0, (F.col("final_equity") / start - 1) * 100).alias("total_return_pct"),
        F.when((years > 0) & (F.col("final_equity") > 0) & (start > 0),
               (F.pow(F.col("final_equity") / start, 1 / years) - 1) * 100).alias("annualized_return_pct"),
        *_drawdown_columns(),
        F.when(enough & (F.col("_sd") > 0), F.col("_mu") / F.col("_sd") * scale).alias("sharpe"),
        F.when(enough & (down > 0), F.col("_mu") / down * scale).alias("sortino"),
        "bars_total", "bars_in_position",
        (F.col("bars_in_position") / F.col("bars_total") * 100).alias("exposure_pct"))


def profit_factor(value: Column) -> Column:
    """|sum of gains / sum of losses| as an aggregate; NULL without a loss."""
    gain = F.coalesce(F.sum(F.when(value > 0, value)), F.lit(0.0))
    return F.abs(ratio(gain, F.sum(F.when(value < 0, value))))


def trade_aggs() -> list[Column]:
    net, n = F.col("net_pnl"), F.count(F.lit(1))
    return [
        n.alias("trade_count"), F.sum("fees").alias("total_fees"),
        (F.count_if(net > 0) / n * 100).alias("win_rate_pct"),
        F.avg(F.when(net > 0, net)).alias("avg_win"), F.avg(F.when(net < 0, net)).alias("avg_loss"),
        F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.sum(F.when(net < 0, net)), F.lit(0.0)).alias("gross_loss"),
        profit_factor(net).alias("net_profit_factor"),
        profit_factor(F.col("gross_pnl")).alias("gross_profit_factor"),
        F.avg(net).alias("expectancy"), F.avg("return_pct").alias("expectancy_pct"),
    ]


def trade_metrics(trades: DataFrame, run: list[str]) -> DataFrame:
    return trades.groupBy(*run).agg(*trade_aggs())


def losing_streak(trades: DataFrame, run: list[str], order: list[str], chunk: Column | None = None
                  ) -> DataFrame:
    """Longest row of losses per run. ``chunk`` grows with the order and bounds the windows
    (default: blocks of ``entry_ord``)."""
    chunk = int_div(F.col("entry_ord"), BLOCK) if chunk is None else chunk
    lost = F.col("net_pnl") < 0
    t = trades.withColumns({"_blk": chunk, "_win": (~lost).cast("bigint")})
    t = scan(t, run, order, "_blk", {"_isle": ("_win", "sum")})
    isles = t.groupBy(*run, "_isle").agg(F.count_if(lost).alias("_len"))
    return isles.groupBy(*run).agg(F.max("_len").alias("max_losing_streak"))


def run_metrics(equity: DataFrame, trades: DataFrame, run: list[str], interval_ms: int,
                capital: float | None = 10_000.0, order=("entry_ord",)) -> DataFrame:
    """The full metric set, one row per run, runs without trades included."""
    e = equity_metrics(equity_profile(equity, run), run, interval_ms, capital)
    t = trade_metrics(trades, run).join(losing_streak(trades, run, list(order)), run)
    return e.join(t, run, "left").withColumns({
        "trade_count": F.coalesce("trade_count", F.lit(0)),
        "total_fees": F.coalesce("total_fees", F.lit(0.0)),
        "gross_profit": F.coalesce("gross_profit", F.lit(0.0)),
        "gross_loss": F.coalesce("gross_loss", F.lit(0.0))})


def carry_run_metrics(profile: DataFrame, trades: DataFrame, run: list[str], capital: float,
                      size_pct: float, bars_per_day: int = 6) -> DataFrame:
    """The other metric family, used for carry-adjusted runs.

    Expectancy is on a fixed notional (capital * size), deviations are sample ones, the
    downside mean runs over negative returns only, and what cannot be computed is 0.
    ``net_pnl_after`` is used where a trade has one.
    """
    r = F.col("raw_return")
    scale = F.sqrt(F.lit(float(365 * bars_per_day)))
    bad = F.when(r < 0, r)
    e = profile.groupBy(*run).agg(
        F.max_by("equity", "ord").alias("final_equity"), F.avg(r).alias("_mu"),
        F.stddev_samp(r).alias("_sd"), F.count(bad).alias("_nb"), F.avg(bad * bad).alias("_dv"),
        F.greatest(F.max("dd_pct"), F.lit(0.0)).alias("max_drawdown_pct"))
    zero = F.lit(0.0)
    e = e.select(
        *run, "final_equity", ((F.col("final_equity") - capital) / capital * 100).alias("total_return_pct"),
        F.when(F.col("_sd") > 0, F.col("_mu") / F.col("_sd") * scale).otherwise(zero).alias("sharpe"),
        F.when((F.col("_nb") > 1) & (F.col("_dv") > 0), F.col("_mu") / F.sqrt("_dv") * scale)
        .otherwise(zero).alias("sortino"), "max_drawdown_pct")
    net = F.col("net_pnl_after") if "net_pnl_after" in trades.columns else F.col("net_pnl")
    t = trades.groupBy(*run).agg(
        F.count(F.lit(1)).alias("trade_count"),
        (F.avg(net) / (capital * size_pct / 100) * 100).alias("net_exp_pct"),
        profit_factor(net).alias("net_profit_factor"),
        (F.count_if(net > 0) / F.count(F.lit(1)) * 100).alias("win_rate_pct"),
        (F.avg("holding_bars") * (24 / bars_per_day)).alias("avg_holding_hours"))
    return e.join(t, run)


def calendar_rate(count: Column, first_ts: Column, last_ts: Column) -> Column:
    """Rows per calendar year touched."""
    return count / (F.year(last_ts) - F.year(first_ts) + 1)


def capital_efficiency(total_return_pct: Column, exposure_pct: Column) -> Column:
    return ratio(total_return_pct, exposure_pct / 100)


def year_concentration(years: DataFrame, keys: list[str], pnl: str = "net_pnl", limit: float = 0.6
                       ) -> DataFrame:
    """Share of the best positive bucket in all positive ones; NULL when none is positive."""
    p = F.when(F.col(pnl) > 0, F.col(pnl))
    out = years.groupBy(*keys).agg(F.max(p).alias("_b"), F.sum(p).alias("_s")) if keys else \
        years.agg(F.max(p).alias("_b"), F.sum(p).alias("_s"))
    share = ratio(F.col("_b"), F.col("_s"))
    return out.select(*keys, F.col("_b").alias("best"), share.alias("concentration"),
                      F.coalesce(share > limit, F.lit(False)).alias("concentrated"))


def full_year(bars: Column, least: int = 2100) -> Column:
    """A calendar year counts as complete from this many (4-hour) bars on."""
    return bars >= least
