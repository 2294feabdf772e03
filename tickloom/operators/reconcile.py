"""Snapshot reconciliation, fills, settlement and entry screening on tables."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.joins import keep_last, lookup

# Order types and states.
STOP_TYPES = ["STOP_MARKET", "STOP", "STOP_LOSS_LIMIT"]
PROFIT_TYPES = ["TAKE_PROFIT_MARKET", "TAKE_PROFIT", "TAKE_PROFIT_LIMIT"]
ACTIVE = ["NEW", "PARTIALLY_FILLED"]
QUOTE_ASSET = "USDT"
MIN_NOTIONAL = 5.5
MIN_MARGIN_RATIO = 200.0


def protective_orders(positions: DataFrame, orders: DataFrame, arrival: str = "arrival") -> DataFrame:
    """First active stop and first active take-profit order on each position's closing side.

    ``positions``: symbol, side. ``orders``: symbol, order_id, type, side, status,
    stop_price, price and a unique arrival number.
    """
    closing = F.when(F.col("side") == "SHORT", "BUY").otherwise("SELL")
    p = positions.select("symbol", closing.alias("_side"))
    stop = F.col("type").isin(STOP_TYPES)
    gain = F.col("type").isin(PROFIT_TYPES)
    order = F.struct(F.col(arrival).alias("a"), "order_id", F.coalesce(
        F.col("stop_price").cast("string").try_cast("double"),
        F.col("price").cast("string").try_cast("double"), F.lit(0.0)).alias("p"))
    # First per symbol and side before the join, so that a symbol with most of the orders
    # reaches it as a few rows.
    o = orders.filter(F.col("status").isNull() | F.col("status").isin(ACTIVE)).groupBy("symbol", "side").agg(
        F.min(F.when(stop, order)).alias("_s"), F.min(F.when(gain, order)).alias("_t"))
    o = o.join(p, "symbol").filter(F.col("side").isNull() | (F.col("side") == F.col("_side")))
    first = o.groupBy("symbol").agg(F.min("_s").alias("_s"), F.min("_t").alias("_t"))

    def price(c):
        return F.when(F.col(c)["p"] > 0, F.col(c)["p"])

    return first.select("symbol", F.col("_s.order_id").alias("stop_order_id"), price("_s").alias("stop_price"),
                        F.col("_t.order_id").alias("profit_order_id"), price("_t").alias("profit_price"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], explicit_null: tuple[str, ...] = ()) -> DataFrame:
    """New values over old ones per column; ``explicit_null`` columns take the new row's
    NULL too. Rows on one side only are kept."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    cols = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key]
    for c in [c for c in old.columns if c not in key]:
        if c not in new.columns:
            cols.append(F.col(f"o.{c}"))
        elif c in explicit_null:
            cols.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
    return joined.select(*cols)


def compare_snapshots(local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """Every key of either side with its action: keep, add or remove (a ghost)."""
    lo, re = local.select(*key, F.lit(1).alias("_l")), remote.select(*key, F.lit(1).alias("_r"))
    action = (F.when(F.col("_r").isNull(), "remove").when(F.col("_l").isNull(), "add").otherwise("keep"))
    return lo.join(re, key, "full_outer").select(*key, action.alias("action"))


def reconcile_positions(local: DataFrame, exchange: DataFrame, orders: DataFrame, stop_pct: float = 2.0,
                        tick: float = 0.01, pending: DataFrame | None = None) -> DataFrame:
    """Local positions brought in line with the authoritative ones.

    Columns: the position, its protective orders, ``action`` (keep / add / remove) and the
    ``repair_stop`` price of positions without an active stop. Symbols in ``pending`` are
    left as they are.
    """
    amount = F.col("positionAmt").cast("string").try_cast("double")
    e = exchange.select(
        "symbol", F.when(amount > 0, "LONG").otherwise("SHORT").alias("side"),
        F.col("entryPrice").cast("string").try_cast("double").alias("entry_price"), F.abs(amount).alias("quantity"),
        F.col("leverage").cast("string").try_cast("double").alias("leverage")).filter(F.col("quantity") > 0)
    e = e.join(protective_orders(e, orders), "symbol", "left")
    lo = local.alias("l")
    j = lo.join(e.withColumn("_r", F.lit(True)).alias("r"), F.col("l.symbol") == F.col("r.symbol"), "full_outer")
    there, here = F.col("r._r").isNotNull(), F.col("l.symbol").isNotNull()

    def fresh(c):
        return F.coalesce(f"r.{c}", f"l.{c}").alias(c)

    out = j.select(
        F.coalesce("r.symbol", "l.symbol").alias("symbol"), fresh("side"), fresh("entry_price"),
        fresh("quantity"), fresh("leverage"), F.col("r.stop_order_id").alias("stop_order_id"),
        fresh("stop_price"), F.col("r.profit_order_id").alias("profit_order_id"), fresh("profit_price"),
        F.when(~there, "remove").when(here, "keep").otherwise("add").alias("action"))
    missing = (F.col("action") != "remove") & F.col("stop_order_id").isNull()
    out = out.withColumn("repair_stop", F.when(missing, repair_stop(
        F.col("side"), F.col("entry_price"), F.col("stop_price"), stop_pct, tick)))
    if pending is not None:
        out = out.join(pending.select("symbol"), "symbol", "left_anti")
    return out


def repair_stop(side: Column, entry: Column, stop: Column, stop_pct: float, tick: float) -> Column:
    """An existing stop on the loss side stays; else entry moved by ``stop_pct``, on a tick."""
    short = F.coalesce(side == "SHORT", F.lit(False))
    good = (stop > 0) & F.when(short, stop > entry).otherwise(stop < entry)
    return F.when(good, stop).otherwise(to_tick(stop_price(entry, stop_pct, short), tick))


def _digits(step: float) -> int:
    import math

    return max(0, math.ceil(-math.log10(step)))


def to_tick(price: Column, tick: float) -> Column:
    return F.round(price, _digits(tick))


def to_lot(quantity: Column, step: float) -> Column:
    return F.round(F.floor(quantity / F.lit(step)) * F.lit(step), _digits(step))


def stop_price(entry: Column, pct, short: Column) -> Column:
    return F.when(short, entry * (1 + F.lit(pct) / 100)).otherwise(entry * (1 - F.lit(pct) / 100))


def profit_price(entry: Column, pct, short: Column) -> Column:
    return F.when(short, entry * (1 - F.lit(pct) / 100)).otherwise(entry * (1 + F.lit(pct) / 100))


def position_notional(balance: Column, size_pct: Column, leverage: Column, cap: Column) -> Column:
    whole = balance * size_pct / 100 * leverage
    return F.when(cap > 0, F.least(whole, cap)).otherwise(whole)


def margin_used(positions: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of quantity * mark / leverage per account; the entry price stands in for a mark."""
    q = F.try_divide(F.col("quantity"), F.col("leverage"))
    # One row per account and symbol before the join with the marks.
    p = positions.groupBy(*keys, "symbol").agg(
        F.sum(q).alias("_q"), F.sum(q * F.col("entry_price")).alias("_e"), F.count(F.lit(1)).alias("_n"))
    j = p.join(marks.select("symbol", F.col("price").alias("_mark")), "symbol", "left")
    mark = F.nullif(F.col("_mark"), F.lit(0.0))
    used = F.when(mark.isNotNull(), F.col("_q") * mark).otherwise(F.col("_e"))
    return j.groupBy(*keys).agg(F.sum(used).alias("margin_used"), F.sum("_n").alias("open_positions"))


def margin_ratio(balance: Column, used: Column) -> Column:
    return F.when(F.coalesce(used, F.lit(0.0)) == 0, F.lit(9999.0)).otherwise(balance / used * 100)


def unrealised(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Side-aware open PnL at the last price, at the entry price where there is none."""
    j = lookup(positions, prices.select("symbol", F.col("price").alias("last_price")), ["symbol"])
    move = F.coalesce("last_price", "entry_price") - F.col("entry_price")
    return j.withColumn("unrealised_pnl", F.when(F.col("side") == "SHORT", -move).otherwise(move) * F.col("quantity"))


def normalise_fills(messages: DataFrame, body: str = "body", seq: str = "seq") -> DataFrame:
    """Order messages in either spelling to one row per filled order update.

    Field names differing only in case (s / S, o / ot, n / N) need case-sensitive parsing,
    so single fields are read by JSON path, which always is.
    """
    def get(*names):
        return F.coalesce(*[F.get_json_object(body, f"$.{root}{n}") for root in ("", "o.", "order.") for n in names])

    def num(*names):
        return get(*names).try_cast("double")

    def nested(*names):
        return F.coalesce(*[F.get_json_object(body, f"$.{root}{n}") for root in ("o.", "order.") for n in names])

    whole = F.get_json_object(body, "$.o")
    flat_type = F.when(~F.coalesce(whole, F.lit("")).startswith("{"), whole)
    kind = F.coalesce(get("origType", "originalOrderType", "ot", "type"), nested("o"), flat_type, F.lit("MARKET"))
    reduce_only = F.coalesce(get("reduceOnly", "R", "closePosition", "cp").try_cast("boolean"), F.lit(False))
    realised = num("realizedProfit", "rp")
    fee = F.coalesce(num("commission", "n"), F.lit(0.0))
    asset = F.coalesce(get("commissionAsset", "N"), F.lit(QUOTE_ASSET))
    protective = kind.isin(STOP_TYPES + PROFIT_TYPES)
    d = messages.select(
        seq, get("symbol", "s").alias("symbol"), get("orderId", "i").alias("order_id"),
        get("side", "S").alias("side"), kind.alias("order_type"), get("orderStatus", "X").alias("status"),
        F.coalesce(num("avgPrice", "averagePrice", "ap", "price", "p"), F.lit(0.0)).alias("price"),
        F.coalesce(num("executedQty", "orderFilledAccumulatedQuantity", "z", "origQty", "q"), F.lit(0.0))
        .alias("executed_qty"),
        realised.alias("realised"), F.when(asset == QUOTE_ASSET, fee).otherwise(0.0).alias("commission"),
        F.coalesce(get("orderTradeTime", "time", "T")).try_cast("bigint").alias("time_ms"),
        protective.alias("protective"),
        (reduce_only | protective | F.coalesce(realised != 0, F.lit(False))).alias("is_close"))
    return d.filter((F.col("status") == "FILLED") & F.col("symbol").isNotNull())


def settle(fills: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Idempotent settlement totals per account key.

    Entries: the first message of an order fixes its fee. Closes: the last message of an
    order replaces earlier ones; an order counts as one trade. A fee booked for the order
    before it became a close is replaced by the close's fee. Messages without an order id
    each count. ``fills``: keys, order_id, seq, is_close, gross_pnl, commission.
    """
    fee = F.greatest(F.coalesce(F.col("commission"), F.lit(0.0)), F.lit(0.0))
    f = fills.withColumns({"_fee": fee, "_gross": F.coalesce(F.col("gross_pnl"), F.lit(0.0)),
                           "_id": F.coalesce(F.nullif(F.col("order_id").cast("string"), F.lit("")),
                                             F.concat(F.lit("#"), F.col(seq).cast("string")))})
    close = F.col("is_close")
    per = f.groupBy(*keys, "_id").agg(
        F.min_by("_fee", F.when(~close, F.col(seq))).alias("entry_fee"),
        F.max_by("_gross", F.when(close, F.col(seq))).alias("gross"),
        F.max_by("_fee", F.when(close, F.col(seq))).alias("close_fee"))
    closed = F.col("gross").isNotNull()
    fee_of = F.when(closed, F.col("close_fee")).otherwise(F.col("entry_fee"))
    net = F.coalesce("gross", F.lit(0.0)) - fee_of
    return per.groupBy(*keys).agg(
        F.sum(F.coalesce("gross", F.lit(0.0))).alias("gross_pnl"), F.sum(fee_of).alias("total_commission"),
        F.sum(net).alias("realised_pnl"), F.count_if(closed).alias("trade_count"),
        F.count_if(closed & (net > 0)).alias("winning_trades"))


def daily_stats(fills: DataFrame, balances: DataFrame, keys: list[str], ts: str = "ts", seq: str = "seq"
                ) -> DataFrame:
    """Settlement totals per UTC day with start and current balance (order ids restart daily)."""
    day = [*keys, "day"]
    s = settle(fills.withColumn("day", F.to_date(ts)), day, seq)
    return s.join(balances, day, "left").withColumn(
        "current_balance", F.coalesce("start_balance", F.lit(0.0)) + F.col("realised_pnl"))


def loss_cap_hit(realised: Column, start_balance: Column, cap_pct) -> Column:
    return F.coalesce((start_balance > 0) & (realised / start_balance * 100 <= -F.lit(cap_pct)), F.lit(False))


def screen_entries(signals: DataFrame, state: DataFrame, limits: dict[str, float], on: list[str]) -> DataFrame:
    """First failing check of each signal as ``reject_reason`` (NULL when approved).

    ``state`` holds one row per ``on``: paused, breaker, pending, cooling_down, loss_cap,
    slots_used, has_position, balance, margin_used, lot_step, tick. It is joined once; the
    checks are one CASE chain in the order in which they apply. Signals may carry ``mark``, the
    last price of their symbol: the new order's margin is valued at it (NULL or 0: at its price).
    """
    s = signals.join(state, on, "left")
    price, direction = F.coalesce(F.col("price"), F.lit(0.0)), F.col("direction")
    closing, short = direction == "CLOSE", direction == "SHORT"

    def yes(c):
        return F.coalesce(F.col(c), F.lit(False))

    lim = {k: F.lit(float(v)) for k, v in limits.items()}
    notional = position_notional(F.col("balance"), lim["size_pct"], lim["leverage"], lim["max_notional"])
    s = s.withColumn("_qty", F.try_divide(notional, price))
    step, tick = F.coalesce("lot_step", F.lit(0.001)), F.coalesce("tick", F.lit(0.01))

    def digits(c):
        return F.greatest(F.ceil(-F.log10(c)), F.lit(0)).cast("int")

    def rounded(c, d):
        scale = F.pow(F.lit(10.0), d)
        return F.floor(c * scale + 0.5) / scale

    lots = rounded(F.floor(F.col("_qty") / step) * step, digits(step))
    s = s.withColumns({
        "quantity": lots,
        "stop": rounded(stop_price(price, limits["stop_pct"], short), digits(tick)),
        "target": rounded(profit_price(price, limits["profit_pct"], short), digits(tick))})
    mark = F.coalesce(F.nullif(F.col("mark"), F.lit(0.0)), price) if "mark" in signals.columns else price
    used = F.coalesce("margin_used", F.lit(0.0)) + F.col("quantity") * mark / lim["leverage"]
    ratio = margin_ratio(F.col("balance"), used)
    stop, target = F.col("stop"), F.col("target")
    reason = (
        F.when(yes("paused") & ~closing, "trading paused")
        .when(yes("breaker") & ~closing, "circuit breaker tripped")
        .when(yes("pending"), "order already in flight")
        .when(closing & ~yes("has_position"), "no position to close")
        .when(closing, F.lit(None).cast("string"))
        .when(~direction.isin("LONG", "SHORT"), "unsupported direction")
        .when(yes("cooling_down"), "signal cooldown")
        .when(yes("loss_cap"), "daily loss cap exceeded")
        .when(F.coalesce("slots_used", F.lit(0)) >= lim["max_positions"], "max positions")
        .when(yes("has_position"), "already has position")
        .when((F.coalesce("balance", F.lit(0.0)) <= 0) | (price <= 0), "invalid balance/price")
        .when(F.col("_qty") * price < MIN_NOTIONAL, "notional too small")
        .when(F.col("quantity") <= 0, "quantity zero after rounding")
        .when(ratio < MIN_MARGIN_RATIO, "margin ratio too low")
        .when(~short & (stop >= price), "stop above entry")
        .when(~short & (target <= price), "target below entry")
        .when(short & (stop <= price), "stop below entry")
        .when(short & (target >= price), "target above entry")
        .when(F.abs(target - price) < F.abs(price - stop), "reward below risk"))
    entry = reason.isNull() & ~closing
    return s.withColumn("reject_reason", reason).withColumns({
        c: F.when(entry, F.col(c)) for c in ("quantity", "stop", "target")}).drop("_qty")


def signal_log(approved: DataFrame, rejected: DataFrame, n: int, keys: list[str], ts: str = "ts") -> DataFrame:
    """Newest ``n`` signals and rejections per key."""
    from tickloom.operators.joins import latest_per_key

    both = approved.unionByName(rejected, allowMissingColumns=True)
    return latest_per_key(both, keys, n, [F.desc(ts)])


def latest_values(df: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """The value at the last time of each key; of several at that time the largest."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias(ts))


def last_version(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return keep_last(df, keys, order)
