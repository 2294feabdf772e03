"""Windowed indicators over blocked bars (see ``operators.sequence``).

Every function takes columns of a frame holding ``ord`` (position in the series) and
``_blk``; windows never leave a block, so the caller must have copied enough
look-back rows into it. ``LOOKBACK`` names the need per indicator.
"""
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.sequence import affine, block_no, block_window, carry_in, int_div, split, summed, upto

# The close buffer of the signal averages and the RSI / ATR lengths.
BUFFER = 60
RSI_PERIOD = 14
ATR_PERIOD = 14
DAY_MICROS = 86_400_000_000

# Rows of one sub-block of the long averages. A weight one sub-block back is below
# 2**-53 for every period up to 50, so a single carried value is enough.
SUB = 1024

LOOKBACK = {"buffered": BUFFER + 2, "long": 2 * SUB}

# Two averages closer than this share of their size count as equal; exact ties of a
# flat series survive the closed-form summation that way.
TIE = 1e-12


def buffered_ema(buffer: Column, period: int, ord_col: str = "ord") -> Column:
    """EMA over the last closes in ``buffer``, seeded by the mean of its first ``period``.

    Kept as a left fold: re-associating it would break exact ties on flat series.
    """
    k = 2.0 / (period + 1)
    seed = F.aggregate(F.slice(buffer, 1, period), F.lit(0.0), lambda a, x: a + x) / F.lit(float(period))
    fold = F.aggregate(F.slice(buffer, period + 1, BUFFER), seed,
                       lambda e, x: x * F.lit(k) + e * F.lit(1 - k))
    return F.when(F.col(ord_col) >= period - 1, fold)


def with_buffered_emas(bars: DataFrame, keys: list[str], periods=(9, 21, 50)) -> DataFrame:
    w = block_window(keys)
    out = bars.withColumn("_buf", F.collect_list("close").over(w.rowsBetween(1 - BUFFER, 0)))
    return out.withColumns({f"ema{p}": buffered_ema(F.col("_buf"), p) for p in periods}).drop("_buf")


def with_rsi(bars: DataFrame, keys: list[str], period: int = RSI_PERIOD) -> DataFrame:
    """Simple RSI of the last ``period`` differences; 100 when there is no loss."""
    w = block_window(keys)
    frame = w.rowsBetween(1 - period, 0)
    diff = F.col("close") - F.lag("close").over(w)
    out = bars.withColumn("_diff", diff)
    gain = F.sum(F.greatest(F.col("_diff"), F.lit(0.0))).over(frame) / period
    loss = F.sum(F.greatest(-F.col("_diff"), F.lit(0.0))).over(frame) / period
    out = out.withColumns({"_gain": gain, "_loss": loss})
    rsi = F.when(F.col("_loss") == 0, F.lit(100.0)).otherwise(
        100 - 100 / (1 + F.col("_gain") / F.col("_loss")))
    return out.withColumn("rsi", F.when(F.col("ord") >= period, rsi)).drop("_diff", "_gain", "_loss")


def true_range(keys: list[str]) -> Column:
    prev = F.lag("close").over(block_window(keys))
    return F.when(F.col("ord") >= 1, F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def with_long_averages(bars: DataFrame, keys: list[str], specs: dict[str, tuple[str, int, int, float]]
                       ) -> DataFrame:
    """Unbounded exponential averages e = k*x + (1-k)*e, as running sums plus one carry.

    ``specs``: name -> (value column, seed length, seed position, k). The seed at that
    position is the mean of the last seed-length values. One carry is exact only while a weight
    one sub-block back is below 2**-53 and its inverse is a finite double; ``with_running_averages`` takes any k.
    """
    for name, (_, _, _, k) in specs.items():
        if not 1e-250 < (1 - k) ** SUB <= 2.0 ** -53:
            raise ValueError(f"{name}: one carry does not hold the weight {k}; with_running_averages does")
    w = block_window(keys)
    sub = Window.partitionBy(*keys, "_blk", "_sub").orderBy("ord")
    r = F.pmod(F.col("ord"), F.lit(SUB)).cast("double")
    out = bars.withColumn("_sub", int_div(F.col("ord"), SUB))
    terms, locals_, carries, result = {}, {}, {}, {}
    for name, (x, length, at, k) in specs.items():
        d = 1 - k
        seed = F.avg(x).over(sub.rowsBetween(1 - length, 0))
        term = F.when(F.col("ord") == at, seed).when(F.col("ord") > at, F.col(x) * k)
        terms[f"_x_{name}"] = term * F.pow(F.lit(d), -r)
        locals_[f"_l_{name}"] = F.coalesce(
            F.sum(f"_x_{name}").over(upto(sub)), F.lit(0.0)) * F.pow(F.lit(d), r)
        ended = F.when(r == SUB - 1, F.col(f"_l_{name}"))
        carries[f"_c_{name}"] = F.last(ended, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1))
        whole = F.col(f"_l_{name}") + F.coalesce(F.col(f"_c_{name}"), F.lit(0.0)) * F.pow(F.lit(d), r + 1)
        result[name] = F.when(F.col("ord") >= at, whole)
    out = out.withColumns(terms).withColumns(locals_).withColumns(carries).withColumns(result)
    return out.drop("_sub", *terms, *locals_, *carries)


def with_running_averages(bars: DataFrame, keys: list[str], specs: dict[str, tuple[str, int, int, float]]) -> DataFrame:
    """The averages of ``with_long_averages`` for any k from 0 to 1, over numbered bars that need no look-back copies.

    A row is a map of the average before it: x / length is added while the seed is summed, then e becomes d*e + k*x with
    d = 1 - k. Inside a sub-block the maps have a closed form, a running sum of terms weighted by powers of d; what a
    sub-block does as a whole is one pair (a, b), and these are composed over all earlier sub-blocks.
    Sub-blocks are short enough for the powers of the smallest d to be finite.
    """
    decays = [1 - k for *_, k in specs.values() if k < 1]
    longest = min([SUB, *(int(-460 / math.log(d)) for d in decays if 0 < d < 1)])
    width = 1 << max(0, int(math.log2(max(1, longest))))
    by = [*keys, "_sub"]
    rows = bars.withColumn("_sub", block_no(F.col("ord"), width))
    terms = {}
    for name, (x, length, at, k) in specs.items():
        # decays since the row before the sub-block
        steps = F.greatest(F.col("ord") - at, F.lit(0)) - F.greatest(F.col("_sub") * width - 1 - at, F.lit(0))
        added = F.when(F.col("ord") > at, F.col(x) * k if k < 1 else F.lit(0.0)).when(F.col("ord") > at - length, F.col(x) / length)
        terms[f"_n_{name}"] = steps.cast("double")
        terms[f"_x_{name}"] = F.coalesce(added, F.lit(0.0)) * _power(k, -steps)
    rows = split(rows.withColumns(terms), by)
    wholes = summed(rows, by, [F.struct(F.max(f"_n_{name}").alias("n"), F.sum(f"_x_{name}").alias("x")).alias(f"_s_{name}") for name in specs])
    wholes = wholes.withColumns({f"_s_{name}": affine(_power(k, F.col(f"_s_{name}.n")), F.col(f"_s_{name}.x") * _power(k, F.col(f"_s_{name}.n")))
                                 for name, (*_, k) in specs.items()})
    carried = carry_in(wholes, keys, "_sub", {f"_c_{name}": (f"_s_{name}", "affine") for name in specs})
    window = Window.partitionBy(*by).orderBy("ord")
    rows = rows.withColumns({f"_l_{name}": F.sum(f"_x_{name}").over(upto(window)) for name in specs})
    out = rows.join(carried.select(*by, *(f"_c_{name}" for name in specs)), by)
    result = {}
    for name, (x, _, at, k) in specs.items():
        value = (F.col(f"_l_{name}") + F.col(f"_c_{name}.b")) * _power(k, F.col(f"_n_{name}"))
        result[name] = F.when(F.col("ord") > at, F.col(x) if k == 1 else value).when(F.col("ord") == at, value)
    return out.withColumns(result).drop("_sub", *terms, *(f"_{p}_{name}" for p in "lc" for name in specs))


def _power(k: float, steps: Column) -> Column:
    """(1 - k) ** steps; for k = 1 nothing before counts, and the seed is not weighted."""
    return F.pow(F.lit(1.0 - k), steps.cast("double")) if k < 1 else F.lit(1.0)


def long_ema_spec(period: int) -> tuple[str, int, int, float]:
    return ("close", period, period - 1, 2.0 / (period + 1))


def wilder_spec(value: str = "_tr", period: int = ATR_PERIOD) -> tuple[str, int, int, float]:
    return (value, period, period, 1.0 / period)


def cross_state(fast: str, slow: str, first: int) -> Column:
    """True above, False below or equal, NULL before the first computable position."""
    return F.when(F.col("ord") >= first, F.col(fast) > F.col(slow))


def apart(a: Column, b: Column) -> Column:
    """a > b for long averages, near-equal counting as equal."""
    return (a - b) > F.abs(b) * F.lit(TIE)


def with_cross(bars: DataFrame, keys: list[str], state: str, prefix: str) -> DataFrame:
    """Flags ``<prefix>golden`` and ``<prefix>death`` for changes of a cross state."""
    prev = F.lag(state).over(block_window(keys))
    return bars.withColumns({
        f"{prefix}golden": F.coalesce(F.col(state) & ~prev, F.lit(False)),
        f"{prefix}death": F.coalesce(~F.col(state) & prev, F.lit(False)),
    })


def crosses_in_rows(flip: Column, keys: list[str], rows: int) -> Column:
    return F.sum(flip.cast("int")).over(block_window(keys).rowsBetween(1 - rows, 0))


def crosses_in_time(flip: Column, keys: list[str], span_micros: int = DAY_MICROS) -> Column:
    """Flips with time > now - span, the current row included."""
    w = Window.partitionBy(*keys, "_blk").orderBy(F.unix_micros("ts"))
    return F.sum(flip.cast("int")).over(w.rangeBetween(1 - span_micros, 0))


def rolling_return_vol(keys: list[str], window: int = 24) -> Column:
    """Population deviation (%) of the last returns; needs the column ``_ret``; two at least."""
    frame = block_window(keys).rowsBetween(1 - window, 0)
    return F.when(F.count("_ret").over(frame) >= 2, F.stddev_pop("_ret").over(frame) * 100)


def bar_return(keys: list[str]) -> Column:
    prev = F.lag("close").over(block_window(keys))
    return F.when(prev > 0, F.col("close") / prev - 1)


def lagged_return(keys: list[str], rows: int) -> Column:
    prev = F.lag("close", rows).over(block_window(keys))
    return F.when(prev > 0, (F.col("close") / prev - 1) * 100)


def volume_ratio(keys: list[str], rows: int = 96) -> Column:
    mean = F.avg("volume").over(block_window(keys).rowsBetween(-rows, -1))
    return F.when(mean > 0, F.col("volume") / mean)


def prior_high(keys: list[str], rows: int) -> Column:
    return F.max("high").over(block_window(keys).rowsBetween(-rows, -1))


def forward_excursion(keys: list[str], rows: int) -> tuple[Column, Column]:
    """Best and worst move (%) of the next ``rows`` bars against this bar's open."""
    frame = block_window(keys).rowsBetween(1, rows)
    up = (F.max("high").over(frame) / F.col("open") - 1) * 100
    down = (F.min("low").over(frame) / F.col("open") - 1) * 100
    return up, down


def ticker_change_pct(open_: Column, close: Column) -> Column:
    return F.when(open_ > 0, (close - open_) / open_ * 100).otherwise(F.lit(0.0))
