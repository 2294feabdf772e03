"""Entry context of trades and bucketed trade statistics."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions.scalars import ratio
from tickloom.operators.joins import lookup
from tickloom.operators.metrics import profit_factor
from tickloom.operators.quantiles import exact_quantiles, wide_medians
from tickloom.operators.sequence import BLOCK, block_window, blocked, owned

# Bucket edges and labels.
BAR_BUCKETS = [(4, "1-4"), (12, "5-12"), (24, "13-24"), (48, "25-48"), (96, "49-96"), (None, ">96")]
HOUR_BUCKETS = [(6, "<=6h"), (24, "6-24h"), (48, "24-48h"), (96, "48-96h"), (168, "96h-7d"), (None, ">7d")]
DENSITY_BUCKETS = [(1, "0-1"), (3, "2-3"), (None, ">=4")]
NOTIONAL = 10_000.0
DAY_BARS, THREE_DAY_BARS = 96, 288

FEATURES = ["entry_signal_close", "ema9", "ema21", "ema50", "ema_spread_pct", "ema50_slope_pct",
            "ema50_slope_sign", "atr_pct", "entry_volatility_pct", "prev24h_return_pct",
            "prev72h_return_pct", "entry_volume", "volume_ratio", "crosses_24h", "crosses_72h"]


def bar_features(bars: DataFrame, keys=("symbol",), block: int = BLOCK) -> DataFrame:
    """Features of every bar from full-history averages, for use by the entry after it."""
    keys = list(keys)
    if block % ind.SUB:
        raise ValueError(f"block must be a multiple of {ind.SUB}")
    b = blocked(bars, back=2 * ind.SUB, block=block)
    b = b.withColumns({"_tr": ind.true_range(keys), "_ret": ind.bar_return(keys)})
    b = ind.with_long_averages(b, keys, {
        "ema9": ind.long_ema_spec(9), "ema21": ind.long_ema_spec(21), "ema50": ind.long_ema_spec(50),
        "atr14": ind.wilder_spec()})
    w = block_window(keys)
    above = F.when(F.col("ord") >= 20, ind.apart(F.col("ema9"), F.col("ema21")))
    b = b.withColumns({"_above": above, "_e50p": F.lag("ema50").over(w)})
    flip = F.coalesce(F.col("_above") != F.lag("_above").over(w), F.lit(False))
    b = b.withColumn("_flip", flip)
    close, e50, e50p = F.col("close"), F.col("ema50"), F.col("_e50p")
    slope = F.when(e50p != 0, (e50 - e50p) / e50p * 100)
    b = b.withColumns({
        "entry_signal_close": close,
        "ema_spread_pct": (F.col("ema9") - F.col("ema21")) / close * 100,
        "ema50_slope_pct": slope,
        "ema50_slope_sign": F.when(slope.isNotNull(), F.when(ind.apart(e50, e50p), 1).otherwise(-1)),
        "atr_pct": F.when(F.col("atr14") != 0, F.col("atr14") / close * 100),
        "entry_volatility_pct": ind.rolling_return_vol(keys),
        "prev24h_return_pct": ind.lagged_return(keys, DAY_BARS),
        "prev72h_return_pct": ind.lagged_return(keys, THREE_DAY_BARS),
        "entry_volume": F.col("volume"),
        "volume_ratio": ind.volume_ratio(keys, DAY_BARS),
        "crosses_24h": ind.crosses_in_rows(F.col("_flip"), keys, DAY_BARS),
        "crosses_72h": ind.crosses_in_rows(F.col("_flip"), keys, THREE_DAY_BARS),
    })
    return owned(b, block).select(*keys, "ord", "ts", *FEATURES)


def trade_returns(trades: DataFrame) -> DataFrame:
    """Gross, net and cost percentages and the best / worst price on the way."""
    gross = F.when(F.col("entry_price") > 0, (F.col("exit_price") / F.col("entry_price") - 1) * 100)
    t = trades.withColumns({"gross_return_pct": gross, "net_return_pct": F.col("return_pct")})
    t = t.withColumn("cost_pct", F.col("gross_return_pct") - F.col("net_return_pct"))
    return t.withColumns({
        "mfe": F.greatest((F.col("path_high") / F.col("entry_price") - 1) * 100, F.lit(0.0)),
        "mae": F.least((F.col("path_low") / F.col("entry_price") - 1) * 100, F.lit(0.0))})


def entry_context(trades: DataFrame, features: DataFrame, bar_keys=("symbol",)) -> DataFrame:
    """Trades with the features of the bar before their entry bar (known at the fill)."""
    keys = list(bar_keys)
    f = features.drop("ts").withColumnRenamed("ord", "_ford")
    t = trade_returns(trades).withColumn("_ford", F.greatest(F.col("entry_ord") - 1, F.lit(0).cast("bigint")))
    return t.join(f, [*keys, "_ford"], "left").drop("_ford")


def locate_trades(trades: DataFrame, bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """Bar positions of entry and exit for a ledger that has only times."""
    at = bars.select(*keys, "ts", "ord")
    for side in ("entry", "exit"):
        at_side = at.select(*keys, F.col("ts").alias(f"{side}_time"), F.col("ord").alias(f"{side}_ord"))
        trades = trades.join(at_side, [*keys, f"{side}_time"], "left")
    return trades


def forward_excursions(bars: DataFrame, trades: DataFrame, horizons=(4, 12, 24), keys=("symbol",),
                       block: int = BLOCK) -> DataFrame:
    """Best and worst move of the bars after the entry bar, against its open."""
    keys = list(keys)
    b = blocked(bars, fwd=max(horizons), block=block)
    cols = {}
    for h in horizons:
        cols[f"fwd_mfe_{h}"], cols[f"fwd_mae_{h}"] = ind.forward_excursion(keys, h)
    f = owned(b.withColumns(cols), block).select(*keys, F.col("ord").alias("entry_ord"), *cols)
    return trades.join(f, [*keys, "entry_ord"])


def bucket(value: Column, edges: list[tuple]) -> Column:
    """Label of the first upper edge at or above the value."""
    out = None
    for edge, label in edges:
        if edge is None:
            return out.otherwise(F.when(value.isNotNull(), label))
        out = F.when(value <= edge, label) if out is None else out.when(value <= edge, label)
    return out


def bucket_order(label: Column, order: list[str]) -> Column:
    """Position in the given order; labels outside it come after."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), label)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(order))).cast("int")


def bucket_stats(notional: float = NOTIONAL) -> list[Column]:
    """The 14 per-bucket statistics over enriched trades; money at a fixed notional."""
    g, n, c = F.col("gross_return_pct"), F.col("net_return_pct"), F.col("cost_pct")
    zero, unit = F.lit(0.0), notional / 100
    return [
        F.count(F.lit(1)).alias("count"), F.avg(g).alias("gross_exp_pct"), F.avg(n).alias("net_exp_pct"),
        profit_factor(g).alias("gross_profit_factor"), profit_factor(n).alias("net_profit_factor"),
        ratio(F.count_if(n > 0) * 100, F.count(n)).alias("win_rate_pct"),
        F.avg(F.when(n > 0, n)).alias("avg_win_pct"), F.avg(F.when(n < 0, n)).alias("avg_loss_pct"),
        F.avg("holding_bars").alias("avg_holding_bars"), F.avg("mfe").alias("avg_mfe_pct"),
        F.avg("mae").alias("avg_mae_pct"),
        (F.coalesce(F.sum(g), zero) * unit).alias("total_gross_pnl"),
        (F.coalesce(F.sum(n), zero) * unit).alias("total_net_pnl"),
        (F.coalesce(F.sum(c), zero) * unit).alias("total_fees"),
    ]


def bucketise(trades: DataFrame, keys: list[str], label: Column, order: list[str] | None = None,
              name: str = "bucket") -> DataFrame:
    """Statistics per bucket label, with the bucket's place in ``order``."""
    out = trades.withColumn(name, label).groupBy(*keys, name).agg(*bucket_stats())
    return out.withColumn("bucket_order", bucket_order(F.col(name), order)) if order else out


def holding_hours(trades: DataFrame, keys: list[str], interval_ms: int) -> DataFrame:
    """Count, share, lose rate, expectancies and profit factor per holding time."""
    t = trades.withColumn("bucket", bucket(F.col("holding_bars") * (interval_ms / 3_600_000), HOUR_BUCKETS))
    n = F.col("net_return_pct")
    return t.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("count"), (F.count_if(n <= 0) / F.count(F.lit(1)) * 100).alias("lose_rate_pct"),
        F.avg("gross_return_pct").alias("gross_exp_pct"), F.avg(n).alias("net_exp_pct"),
        profit_factor(n).alias("net_profit_factor"))


def short_trade_share(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets of holding bars with share and losers (<= 0), plus a '<=24 total' row."""
    n = F.col("net_return_pct")
    t = trades.withColumn("bucket", bucket(F.col("holding_bars"), BAR_BUCKETS))
    per = t.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(n <= 0).alias("losers"),
        F.sum("gross_return_pct").alias("_g"), F.sum(n).alias("_n"))
    short = F.col("bucket").isin([label for edge, label in BAR_BUCKETS if edge and edge <= 24])
    # A handful of rows per key from here on.
    totals = per.groupBy(*keys).agg(
        F.sum("count").alias("_all"), F.sum(F.when(short, F.col("count")).otherwise(0)).alias("_sc"),
        F.sum(F.when(short, F.col("losers")).otherwise(0)).alias("_sl"))
    share = (F.col("count") / F.col("_all") * 100).alias("share_pct")
    lose = ratio(F.col("losers") * 100.0, F.col("count")).alias("loser_rate_pct")
    rows = per.join(totals, keys).select(
        *keys, "bucket", "count", "losers", share, lose, (F.col("_g") / F.col("count")).alias("gross_exp_pct"),
        (F.col("_n") / F.col("count")).alias("net_exp_pct"))
    none = F.lit(None).cast("double")
    total = totals.select(*keys, F.lit("<=24 total").alias("bucket"), F.col("_sc").alias("count"),
                          F.col("_sl").alias("losers"), "_all").select(
        *keys, "bucket", "count", "losers", share, F.coalesce(lose, F.lit(0.0)).alias("loser_rate_pct"),
        none.alias("gross_exp_pct"), none.alias("net_exp_pct"))
    return rows.unionByName(total)


def excursion_table(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median MFE / MAE of winners, losers (<= 0) and all trades."""
    label = F.when(F.col("net_return_pct") > 0, "winners").otherwise("losers")
    t = trades.withColumn("outcome", F.explode(F.array(label, F.lit("all"))))
    by = [*keys, "outcome"]
    mean = t.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.avg("mfe").alias("avg_mfe"),
                              F.avg("mae").alias("avg_mae"))
    return mean.join(wide_medians(t, by, ["mfe", "mae"]), by, "left")


def give_back(trades: DataFrame, keys: list[str], reached: float = 1.0) -> DataFrame:
    """Trades that were up ``reached`` percent on the way and how many still ended <= 0."""
    t = trades.filter(F.col("mfe") >= reached)
    lost = F.col("net_return_pct") <= 0
    n = F.count(F.lit(1))
    return t.groupBy(*keys).agg(
        n.alias("reached"), F.count_if(lost).alias("gave_back"), (F.count_if(lost) / n * 100).alias("share_pct"),
        F.avg(F.when(lost, F.col("mfe"))).alias("avg_mfe_given_back"),
        F.avg(F.when(lost, F.col("net_return_pct"))).alias("avg_net_given_back"))


def edge_cost(avg_gross: Column, avg_cost: Column) -> Column:
    return F.when(avg_cost > 1e-9, F.abs(avg_gross) / avg_cost)


def cost_decomposition(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median gross / net return, cost, and edge against cost."""
    a = trades.groupBy(*keys).agg(
        F.avg("gross_return_pct").alias("avg_gross"), F.avg("net_return_pct").alias("avg_net"),
        F.avg("cost_pct").alias("avg_cost"))
    both = wide_medians(trades.withColumns({c: F.col(f"{c}_return_pct") for c in ("gross", "net")}), keys, ["gross", "net"])
    a = a.join(both, keys)
    r = F.when(F.col("avg_cost") > 0, F.abs("avg_gross") / F.col("avg_cost"))
    return a.withColumns({
        "edge_cost_ratio": r,
        "status": F.when(r < 2, "EDGE TOO THIN RELATIVE TO COST").otherwise("edge > cost")})


def with_regime(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trend and volatility labels; volatility limits are the quartiles of ``atr_pct``.

    ``keys`` empty: one set of limits over all trades.
    """
    limits = exact_quantiles(trades, keys, "atr_pct", {"atr_q1": 0.25, "atr_q3": 0.75})
    t = lookup(trades, limits, keys) if keys else trades.crossJoin(F.broadcast(limits))
    atr = F.col("atr_pct")
    above = F.coalesce(F.col("entry_signal_close") > F.col("ema50"), F.lit(False))
    up = F.coalesce(F.col("ema50_slope_sign") == 1, F.lit(False))
    return t.withColumns({
        "trend_above": above, "trend_up": up, "bull": above & up,
        "vol_bucket": F.when(atr.isNotNull(), F.when(atr <= F.col("atr_q1"), "Low")
                             .when(atr >= F.col("atr_q3"), "High").otherwise("Medium"))})


def quadrant(above: Column, up: Column) -> Column:
    return F.concat(F.when(above, "above").otherwise("below"), F.lit("/"), F.when(up, "up").otherwise("down"))


def spread_quartile(trades: DataFrame, value: str = "ema_spread_pct") -> DataFrame:
    """Quartile band Q1..Q4 of a value over all trades, broadcast from one row."""
    q = exact_quantiles(trades, [], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    v = F.col(value)
    band = (F.when(v <= F.col("q1"), "Q1").when(v <= F.col("q2"), "Q2").when(v <= F.col("q3"), "Q3")
            .when(v.isNotNull(), "Q4"))
    return trades.crossJoin(F.broadcast(q)).withColumn("band", band).drop("q1", "q2", "q3")


def year_matrix(trades: DataFrame, keys: list[str], column: str = "symbol") -> DataFrame:
    """Count and net expectancy per year and per value of ``column``, with an 'ALL' row."""
    t = trades.withColumn("year", F.year("entry_time"))
    g = t.rollup(*keys, "year", column).agg(
        F.count(F.lit(1)).alias("count"), F.avg("net_return_pct").alias("net_exp_pct"),
        F.grouping(column).alias("_all"), F.grouping("year").alias("_top"))
    return g.filter("_top = 0").select(*keys, "year", F.when(F.col("_all") == 1, "ALL").otherwise(
        F.col(column)).alias(column), "count", "net_exp_pct")


def pivot_years(matrix: DataFrame, keys: list[str], columns: list[str], column: str = "symbol",
                value: str = "net_exp_pct") -> DataFrame:
    return matrix.groupBy(*keys, "year").pivot(column, columns).agg(F.first(value))
