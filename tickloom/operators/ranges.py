"""Extremes over spans of ordered rows, read in a few rows for each span however long it is.

Rows are cut into blocks. Inside a block each row knows the extremes from the block's start up to it and from it to the
block's end. Over blocks there are tables at doubling widths: level k holds the extremes of 2**k blocks from each block on.
A span over several blocks is then two rows (its ragged ends) and two ranges of one level, overlapping or not, that cover the
blocks between. A span within one block reads that block's rows, at most ``BLOCK_ROWS``.
"""
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.sequence import int_div
from tickloom.session import settled

BLOCK_ROWS = 128


def block_tables(rows: DataFrame, keys: list[str], high: str, low: str, widest: int, block: int = BLOCK_ROWS, ord_col: str = "ord",
                 settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(keys, level, from, top, bottom): extremes of 2**level blocks from block ``from`` on, for levels up to that of ``widest`` blocks."""
    level = rows.groupBy(*keys, int_div(F.col(ord_col), block).alias("from")).agg(F.max(high).alias("top"), F.min(low).alias("bottom"))
    level = settle(level)
    out, k = level.withColumn("level", F.lit(0)), 0
    while 2 << k <= widest:
        ahead = level.select(*keys, (F.col("from") - (1 << k)).alias("from"), F.col("top").alias("_t"), F.col("bottom").alias("_b"))
        # a missing neighbour (the end of the series, a gap) leaves what there is
        level = settle(level.join(ahead, [*keys, "from"], "full").select(
            *keys, "from", F.greatest("top", "_t").alias("top"), F.least("bottom", "_b").alias("bottom")))
        k += 1
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def span_extremes(spans: DataFrame, rows: DataFrame, keys: list[str], first: str, last: str, high: str, low: str, span_key: list[str],
                  block: int = BLOCK_ROWS, ord_col: str = "ord", settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """``spans`` with ``top`` and ``bottom``: the extremes of ``high`` and ``low`` over rows ``first`` to ``last`` (both with it).

    ``span_key`` tells spans apart. A span without rows, or with a null or backward end, has nulls.
    """
    lo, hi = F.col(first), F.col(last)
    s = spans.select(*dict.fromkeys([*span_key, *keys]), lo.cast("bigint").alias("_i"), hi.cast("bigint").alias("_j")).where("_i <= _j")
    s = s.withColumns({"_bi": int_div(F.col("_i"), block), "_bj": int_div(F.col("_j"), block)})
    between = F.col("_bj") - F.col("_bi") - 1
    widest = s.agg(F.max(between)).first()[0] or 0

    blk = int_div(F.col(ord_col), block)
    r = rows.select(*keys, F.col(ord_col).alias("_o"), F.col(high).alias("_h"), F.col(low).alias("_l"), blk.alias("_b"))
    w = Window.partitionBy(*keys, "_b").orderBy("_o")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    sides = r.withColumns({"_th": F.max("_h").over(down), "_tl": F.min("_l").over(down), "_hh": F.max("_h").over(up), "_hl": F.min("_l").over(up)})
    sides = sides.select(*keys, F.col("_o").alias("_at"), F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"_{side[0]}h").alias("top"), F.col(f"_{side[0]}l").alias("bottom"))
        for side in ("tail", "head")])).alias("_x"))
    sides = sides.select(*keys, "_at", F.col("_x.side").alias("_side"), "_x.top", "_x.bottom")

    many = s.where(F.col("_bi") < F.col("_bj"))
    # a span may begin or end in a gap: the ragged ends are looked up at rows of the series only
    ends = many.select(*span_key, *[k for k in keys if k not in span_key], F.explode(F.array(
        F.struct(F.lit("tail").alias("side"), F.col("_i").alias("at")), F.struct(F.lit("head").alias("side"), F.col("_j").alias("at")))).alias("_e"))
    ends = ends.select(*dict.fromkeys([*span_key, *keys]), F.col("_e.side").alias("_side"), F.col("_e.at").alias("_at")).join(
        sides, [*keys, "_side", "_at"]).select(*span_key, "top", "bottom")
    short = s.where(F.col("_bi") == F.col("_bj")).withColumnRenamed("_bi", "_b").join(r, [*keys, "_b"]).where(
        F.col("_o").between(F.col("_i"), F.col("_j"))).select(*span_key, F.col("_h").alias("top"), F.col("_l").alias("bottom"))
    found = ends.unionByName(short)
    if widest > 0:
        tables = block_tables(rows, keys, high, low, widest, block, ord_col, settle)
        level = F.floor(F.log2(between.cast("double"))).cast("int")
        inner = many.where(between > 0).withColumn("level", level)
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level"))
        inner = inner.withColumn("from", F.explode(F.array_distinct(F.array(F.col("_bi") + 1, F.col("_bj") - width))))
        found = found.unionByName(inner.select(*dict.fromkeys([*span_key, *keys]), "level", "from").join(
            tables, [*keys, "level", "from"]).select(*span_key, "top", "bottom"))
    best = found.groupBy(*span_key).agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"))
    return spans.join(best, span_key, "left")


def external_path(trades: DataFrame, bars: DataFrame, keys: list[str], trade_key: list[str],
                  settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """Trades (keys, entry_time, exit_time, entry_price) of any ledger with ``mfe`` and ``mae`` in percent over entry to exit bar.

    Times are those of bars; a trade whose entry or exit is no bar, or that has no entry price above 0, gets nulls.
    """
    from tickloom.operators.diagnostics import locate_trades

    placed = locate_trades(trades, bars, keys)
    seen = span_extremes(placed, bars, keys, "entry_ord", "exit_ord", "high", "low", trade_key, settle=settle)
    price = F.when(F.col("entry_price") > 0, F.col("entry_price"))
    return seen.withColumns({"mfe": F.greatest((F.col("top") / price - 1) * 100, F.when(F.col("top").isNotNull(), 0.0)),
                             "mae": F.least((F.col("bottom") / price - 1) * 100, F.when(F.col("bottom").isNotNull(), 0.0))}).drop("top", "bottom")
