"""From set / reset flags to positions, trades, ledgers and equity, as window algebra.

A rule's two flags are a latch: set-only turns the position on, reset-only turns it
off, both together flip it. Latch maps compose, so a block only passes one small
summary on, and no series is ever walked in one task.
"""
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.sequence import (BLOCK, FAN, block_no, block_window, carry_in, int_div, scan,
                                         split, summed, upto)

LEDGER = ["entry_time", "entry_price", "exit_time", "exit_price", "quantity", "gross_pnl",
          "fees", "net_pnl", "return_pct", "holding_bars", "forced_exit"]
#: Run keys that change prices and cash but not the bars of a trade.
SETTINGS = ("scenario", "size_pct")


@dataclass(frozen=True)
class CostModel:
    """Rates in [0, 1): commission on notional, slippage on price, carry per held bar."""
    commission: float = 0.0
    slippage: float = 0.0
    carry_rate: float = 0.0

    def __post_init__(self):
        for name in ("commission", "slippage"):
            if not 0 <= getattr(self, name) < 1:
                raise ValueError(f"{name} must be in [0, 1)")

    def entry_fill(self, price: Column) -> Column:
        return price * (1 + F.lit(self.slippage))

    def exit_fill(self, price: Column) -> Column:
        return price * (1 - F.lit(self.slippage))


# The three cost scenarios.
SCENARIOS = {
    "GROSS": CostModel(0.0, 0.0),
    "BASE": CostModel(0.0004, 0.0002),
    "STRESS": CostModel(0.0006, 0.0005),
}
SIZES = (25.0, 50.0, 100.0)


def scenario_table(spark, scenarios: dict[str, CostModel] | None = None, sizes=(100.0,)) -> DataFrame:
    """One row per scenario and size, to cross with trades."""
    rows = [(name, float(size), c.commission, c.slippage, c.carry_rate)
            for name, c in (scenarios or SCENARIOS).items() for size in sizes]
    return spark.createDataFrame(
        rows, "scenario string, size_pct double, commission double, slippage double, carry_rate double")


def _latch_carry(blocks: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """Latch state at the start of each block.

    A block's map is either 'ends in v whatever came before' (``c`` = v xor parity of its
    flips) or 'flips n times' (``c`` NULL, ``t`` = n).
    """
    def flips(w):
        return F.coalesce(F.sum("t").over(w), F.lit(0))

    by = [*keys, "_sup"]
    b = split(blocks.withColumn("_sup", block_no(F.col("_blk"), fan)), by)
    w = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    seen = b.withColumn("_h", F.xxhash64(*b.columns)).withColumn("_tl", flips(w))
    seen = seen.withColumn("_k", (F.col("c") + F.col("_tl")) % 2)
    sup = summed(seen, by, [
        F.sum("t").alias("t"),
        F.max_by("_k", F.when(F.col("_k").isNotNull(), F.col("_blk"))).alias("c")], touch=["_h"])
    w2 = Window.partitionBy(*keys).orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    sup = sup.withColumn("_ts", flips(w2)).withColumn("_k2", (F.col("c") + F.col("_ts")) % 2)
    sup = sup.withColumn("_cs", F.last("_k2", ignorenulls=True).over(w2))
    sup = sup.select(*by, ((F.coalesce("_cs", F.lit(0)) + F.col("_ts")) % 2).alias("_s_sup"))
    b = b.withColumn("_tl", flips(w)).withColumn("_k", (F.col("c") + F.col("_tl")) % 2)
    b = b.withColumn("_cl", F.last("_k", ignorenulls=True).over(w))
    s_in = ((F.coalesce("_cl", "_s_sup") + F.col("_tl")) % 2).cast("int")
    return b.join(sup, by).withColumn("s_in", s_in).drop("_sup", "_tl", "_k", "_cl", "_s_sup")


def hold(sig: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``held`` (a position is on at this bar), ``up`` / ``down`` (it opens / closes at
    the next bar) and ``entry_ord`` (position of the latest entry up to this bar).

    ``keys`` are all run keys (symbol, strategy, ...). The signal of a bar acts at the
    next one; the last bar's signal acts never.
    """
    by = [*keys, "_blk"]
    w = block_window(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    const = (F.when(F.col("set_long") & ~F.col("reset"), 1)
             .when(F.col("reset") & ~F.col("set_long"), 0))
    both = (F.col("set_long") & F.col("reset")).cast("int")
    rows = split(sig.withColumn("_blk", block_no(F.col("_blk"))), by)

    def within(r: DataFrame) -> DataFrame:
        # State under both possible starts of the block; they meet at the first constant map.
        r = r.withColumn("_tc", F.sum(both).over(upto(w)))
        r = r.withColumn("_cx", F.last((const + F.col("_tc")) % 2, ignorenulls=True).over(upto(w)))
        r = r.withColumns({f"_st{h}": (F.coalesce("_cx", F.lit(h)) + F.col("_tc")) % 2 for h in (0, 1)})
        r = r.withColumns({f"_pv{h}": F.coalesce(F.lag(f"_st{h}").over(w), F.lit(h)) for h in (0, 1)})
        return r.withColumns({
            f"_up{h}": F.when((F.col(f"_st{h}") == 1) & (F.col(f"_pv{h}") == 0), F.col("ord") + 1)
            for h in (0, 1)})

    blocks = summed(within(rows.withColumn("_h", F.xxhash64(*rows.columns))), by, [
        F.max("_tc").alias("t"), F.max_by("_cx", "ord").alias("c"),
        F.max("_up0").alias("e0"), F.max("_up1").alias("e1")], touch=["_h"])
    blocks = _latch_carry(blocks, keys).select(
        *by, "s_in", F.when(F.col("s_in") == 0, F.col("e0")).otherwise(F.col("e1")).alias("e"))
    starts = carry_in(blocks, keys, "_blk", {"e_in": ("e", "last")}).drop("e")
    r = within(rows)
    r = r.withColumns({f"_en{h}": F.last(f"_up{h}", ignorenulls=True).over(before) for h in (0, 1)})
    r = r.join(starts, by)

    def pick(stem):
        return F.when(F.col("s_in") == 0, F.col(f"{stem}0")).otherwise(F.col(f"{stem}1"))

    out = r.withColumns({
        "held": pick("_pv") == 1,
        "up": pick("_up").isNotNull(),
        "down": (pick("_st") == 0) & (pick("_pv") == 1),
        "entry_ord": F.coalesce(pick("_en"), F.col("e_in")),
    })
    return out.drop("_tc", "_cx", "s_in", "e_in", *[f"{s}{h}" for s in ("_st", "_pv", "_up", "_en")
                                                   for h in (0, 1)])


def raw_trades(held: DataFrame, keys: list[str]) -> DataFrame:
    """One row per trade, before costs: fills at the next bar's open, path extremes.

    A trade still on after the last bar is valued at its close (``forced_exit``).
    """
    last = F.col("nxt_ts").isNull()
    h = F.col("held")
    opens = F.col("up") & ~last
    closes = F.col("down") & ~last
    trade = F.when(opens, F.col("ord") + 1).otherwise(F.col("entry_ord"))
    # A bar can be both held by one trade and, at its close, open nothing: up needs a flat
    # latch, so each row belongs to one trade only.
    rows = held.filter(h | opens).withColumn("_trade", trade)
    forced = last & h
    return rows.groupBy(*keys, F.col("_trade").alias("entry_ord")).agg(
        F.max(F.when(opens, F.col("nxt_ts"))).alias("entry_time"),
        F.max(F.when(opens, F.col("nxt_open"))).alias("entry_raw"),
        F.max(F.when(closes, F.col("ord") + 1).when(forced, F.col("ord"))).alias("exit_ord"),
        F.max(F.when(closes, F.col("nxt_ts")).when(forced, F.col("ts"))).alias("exit_time"),
        F.max(F.when(closes, F.col("nxt_open")).when(forced, F.col("close"))).alias("exit_raw"),
        F.max(forced).alias("forced_exit"),
        F.max(F.when(h, F.greatest("high", F.when(closes, F.col("nxt_high"))))).alias("path_high"),
        F.min(F.when(h, F.least("low", F.when(closes, F.col("nxt_low"))))).alias("path_low"),
        F.sum(F.when(h, F.col("close"))).alias("held_close_sum"),
    )


def ledger(trades: DataFrame, keys: list[str], costs: DataFrame, capital: float = 10_000.0,
           block: int = BLOCK) -> DataFrame:
    """Trade ledger per run and cost row, cash compounding through the trades of a run.

    ``costs`` comes from ``scenario_table``: a table of a few settings, broadcast.
    Sizing is proportional, so each trade multiplies cash by a factor and cash before a
    trade is a running product.
    """
    run = [*keys, "scenario", "size_pct"]
    c, s = F.col("commission"), F.col("size_pct") / 100
    t = trades.crossJoin(F.broadcast(costs))
    t = t.withColumns({"entry_price": F.col("entry_raw") * (1 + F.col("slippage")),
                       "exit_price": F.col("exit_raw") * (1 - F.col("slippage"))})
    grown = (F.col("exit_price") / F.col("entry_price")) * (1 - c) / (1 + c) - 1
    carried = F.col("carry_rate") * F.col("held_close_sum") / (F.col("entry_price") * (1 + c))
    t = t.withColumns({"_f": 1 + s * (grown - carried), "_blk": int_div(F.col("entry_ord"), block)})
    t = scan(t, run, ["entry_ord"], "_blk", {"_before": ("_f", "prod")}, inclusive=False)
    t = t.withColumn("cash_before", F.lit(float(capital)) * F.coalesce("_before", F.lit(1.0)))
    t = t.withColumn("notional", F.col("cash_before") * s / (1 + c))
    t = t.withColumn("quantity", F.col("notional") / F.col("entry_price"))
    t = t.withColumns({
        "gross_pnl": (F.col("exit_price") - F.col("entry_price")) * F.col("quantity"),
        "fees": F.col("notional") * c + F.col("exit_price") * F.col("quantity") * c,
        "bar_carry": F.col("quantity") * F.col("held_close_sum") * F.col("carry_rate"),
        "cash_after": F.col("cash_before") * F.col("_f"),
        "holding_bars": F.col("exit_ord") - F.col("entry_ord"),
    })
    t = t.withColumn("net_pnl", F.col("gross_pnl") - F.col("fees"))
    t = t.withColumn("return_pct", F.when(F.col("notional") > 0, F.col("net_pnl") / F.col("notional") * 100)
                     .otherwise(F.lit(0.0)))
    return t.drop("_f", "_blk", "_before", "entry_raw", "exit_raw")


def equity_curve(bars: DataFrame, trades: DataFrame, runs: DataFrame, bar_keys: list[str],
                 run_keys: list[str], capital: float = 10_000.0, block: int = BLOCK,
                 bar_carry: bool = False) -> DataFrame:
    """Mark-to-market equity per bar and run.

    ``bars`` carry ``ord``; ``trades`` is a ``ledger``; ``runs`` lists the run keys beyond
    the bar keys (one row per strategy, scenario and size; broadcast). A bar takes the
    latest trade at or before it, found by an as-of window over (rule, block), so a long
    trade or a long flat stretch is never one join key. Runs of one rule differ in ``SETTINGS``
    only and share their trades, so bars are matched once per rule, with the cash of its runs
    as an array, and become a row per run afterwards. ``bar_carry`` deducts the constant carry
    of ``CostModel.carry_rate`` while a trade is on.
    """
    run = [*bar_keys, *run_keys]
    rule = [c for c in run_keys if c not in SETTINGS]
    setting = [c for c in run_keys if c in SETTINGS]
    key = [*bar_keys, *rule]
    listed = F.broadcast(runs.select(*run_keys).distinct())
    shared = ["entry_ord", "exit_ord", "forced_exit"]
    cash = F.struct(*[F.col(c).alias(f"_{c}") for c in setting],
                    "cash_before", "cash_after", "quantity", F.col("size_pct").alias("size"), "carry_rate")
    trade = trades.join(listed, run_keys, "left_semi").groupBy(*key, *shared).agg(F.collect_list(cash).alias("cash"))
    trade = trade.select(*key, F.struct(*shared, "cash").alias("_t"))
    left = bars.select(*bar_keys, "ord", "ts", "close")
    if rule:
        left = left.crossJoin(F.broadcast(runs.select(*rule).distinct()))
    left = left.withColumns({"_side": F.lit(1), "_t": F.lit(None).cast(trade.schema["_t"].dataType)})
    right = trade.select(*key, F.col("_t.entry_ord").alias("ord"), F.lit(0).alias("_side"), "_t")
    both = left.unionByName(right, allowMissingColumns=True)
    both = both.withColumn("_blk", int_div(F.col("ord"), block))
    e = scan(both, key, ["ord", "_side"], "_blk", {"_m": ("_t", "last")}).filter("_side = 1")
    m = F.col("_m")
    if bar_carry:
        e = scan(e, key, ["ord"], "_blk", {"_cum": ("close", "sum")})
        e = e.withColumn("_start", F.when(F.col("ord") == m["entry_ord"], F.col("_cum") - F.col("close")))
        e = scan(e, key, ["ord"], "_blk", {"_base": ("_start", "last")})
    e = e.join(listed, rule) if rule else e.crossJoin(listed)

    def own(x):
        return reduce(and_, [x[f"_{c}"] == F.col(c) for c in setting], F.lit(True))

    e = e.withColumn("_c", F.get(F.filter(m["cash"], own), F.lit(0)))
    c = F.col("_c")
    done = F.coalesce(F.col("ord") >= m["exit_ord"], F.lit(False))
    held = c.isNotNull() & (~done | (m["forced_exit"] & (F.col("ord") == m["exit_ord"])))
    marked = c["cash_before"] * (1 - c["size"] / 100) + c["quantity"] * F.col("close")
    if bar_carry:
        marked = marked - c["quantity"] * c["carry_rate"] * (F.col("_cum") - F.col("_base"))
    equity = (F.when(c.isNull(), F.lit(float(capital)))
              .when(done, c["cash_after"]).otherwise(marked))
    return e.withColumns({"equity": equity, "in_position": held}).select(
        *run, "_blk", "ord", "ts", "close", "equity", "in_position")


def buy_and_hold(bars: DataFrame, keys: list[str], cost: CostModel = CostModel(),
                 capital: float = 10_000.0, block: int = BLOCK) -> DataFrame:
    """First open to last close per key, all in, with the draw-down of quantity * close."""
    from tickloom.operators.metrics import drawdown, equity_profile

    c = cost.commission
    ends = bars.groupBy(*keys).agg(F.min_by("open", "ord").alias("_o"), F.max_by("close", "ord").alias("_c"))
    ends = ends.withColumn("quantity", F.lit(capital / (1 + c)) / cost.entry_fill(F.col("_o")))
    ends = ends.withColumn("final_equity", cost.exit_fill(F.col("_c")) * F.col("quantity") * (1 - c))
    # The draw-down is the same for every positive quantity, up to scale.
    curve = bars.withColumns({"equity": F.col("close"), "_blk": int_div(F.col("ord"), block)})
    dd = drawdown(equity_profile(curve, keys), keys)
    return ends.join(dd, keys).select(
        *keys, F.lit(float(capital)).alias("initial_capital"), "final_equity",
        ((F.col("final_equity") / capital - 1) * 100).alias("total_return_pct"), "max_drawdown_pct",
        (F.col("max_drawdown_abs") * F.col("quantity")).alias("max_drawdown_abs"))
