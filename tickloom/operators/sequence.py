"""Ordered computation per key without ever putting one key into one task.

A series (all rows of one key, in time order) may be a third of the data, so no
operator here opens a window over a whole key. Instead

* rows are cut into chunks (by time) or blocks (by ordinal) of bounded length,
* look-back and look-ahead windows get the neighbouring rows they need copied
  into the block (``blocked``), and
* unbounded running values are computed inside the block and completed with a
  value carried in from all earlier blocks (``carry_in``). That carry is a scan
  over one summary row per block, done in two levels, so even its widest window
  sees only 1 / (BLOCK * FAN) of the series.

Rows and their block summaries read one shared exchange (``split``).
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
FAN = 1024


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def int_div(value: Column, by: int) -> Column:
    """Floor division of a bigint, exact for negative values too."""
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("bigint")


def block_no(value: Column, by: int = 1) -> Column:
    """Block number as a non-nullable column.

    Being non-nullable it draws no inferred IS NOT NULL filter, which would differ between
    the readers of one exchange and so keep Spark from sharing it.
    """
    return F.coalesce(int_div(value, by) if by != 1 else value.cast("bigint"), F.lit(0).cast("bigint"))


def time_chunk(ts: str | Column, seconds: float) -> Column:
    return int_div(micros(ts), int(seconds * 1_000_000))


#: A map x -> a * x + b that changes nothing; kind "affine" composes such structs (a, b).
IDENTITY = {"a": 1.0, "b": 0.0}


def affine(a: Column, b: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))


def compose(earlier: Column, later: Column) -> Column:
    """The map that does ``earlier`` and then ``later``."""
    return affine(earlier["a"] * later["a"], later["a"] * earlier["b"] + later["b"])


def _identity() -> Column:
    return affine(*[F.lit(x) for x in IDENTITY.values()])


def _running(kind: str, value: Column, window) -> Column:
    if kind == "affine":  # maps are composed in order; only summaries of blocks are, at most FAN in a window
        return F.aggregate(F.collect_list(value).over(window), _identity(), compose)
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "prod":
        return F.product(value).over(window)
    if kind == "max":
        return F.max(value).over(window)
    if kind == "min":
        return F.min(value).over(window)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    raise ValueError(f"unknown scan kind {kind!r}")


def _total(kind: str, value: Column, order: str) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
    if kind == "affine":
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("map"))))
        return F.aggregate(rows, _identity(), lambda whole, row: compose(whole, row["map"]))
    return {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min}[kind](value)


def merge(kind: str, earlier: Column, later: Column) -> Column:
    """Combine two partial results of a scan, ``earlier`` coming first in the order."""
    if kind == "last":
        return F.coalesce(later, earlier)
    if kind == "affine":
        return compose(F.coalesce(earlier, _identity()), F.coalesce(later, _identity()))
    both = {
        "sum": earlier + later,
        "prod": earlier * later,
        "max": F.greatest(earlier, later),
        "min": F.least(earlier, later),
    }[kind]
    return F.when(earlier.isNull(), later).when(later.isNull(), earlier).otherwise(both)


def split(df: DataFrame, by: list[str]) -> DataFrame:
    """Exchange on ``by`` that a summary and the rows themselves can both read.

    Spark reuses an exchange only when both readers ask for the same columns, so the
    summary side has to go through ``summed``, which touches them all. Without that the
    whole upstream plan would run once per reader, doubling with every further scan.
    """
    return df.repartition(*[F.col(c) for c in by])


def summed(df: DataFrame, by: list[str], aggs: list[Column], touch: list[str] | None = None) -> DataFrame:
    """groupBy(by).agg(aggs) reading every column of ``df`` (see ``split``)."""
    seen = F.max(F.xxhash64(*(touch or df.columns))).alias("_seen")
    return df.groupBy(*by).agg(*aggs, seen).filter(F.col("_seen").isNotNull()).drop("_seen")


def carry_in(blocks: DataFrame, keys: list[str], blk: str, specs: dict[str, tuple[str, str]],
             fan: int = FAN) -> DataFrame:
    """Exclusive scan over one row per (keys, blk).

    ``specs`` maps an output name to (summary column, kind). Adds, per spec, the
    combination of all earlier blocks (NULL in the first).
    """
    b = split(blocks.withColumn("_sup", block_no(F.col(blk), fan)), [*keys, "_sup"])
    before_sup = Window.partitionBy(*keys).orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys, "_sup").orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    sup = summed(b, [*keys, "_sup"], [
        _total(kind, F.col(c), blk).alias(f"_t_{name}") for name, (c, kind) in specs.items()])
    sup = sup.select(*keys, "_sup", *[
        _running(kind, F.col(f"_t_{name}"), before_sup).alias(f"_u_{name}")
        for name, (_, kind) in specs.items()])
    local = b.withColumns({
        f"_l_{name}": _running(kind, F.col(c), before) for name, (c, kind) in specs.items()})
    return local.join(sup, [*keys, "_sup"]).select(*blocks.columns, *[
        merge(kind, F.col(f"_u_{name}"), F.col(f"_l_{name}")).alias(name)
        for name, (_, kind) in specs.items()])


def with_ordinal(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                 name: str = "ord") -> DataFrame:
    """Dense 0-based position of each row in its key's order, for rows cut by ``chunk``.

    ``chunk`` must grow with the order. Only one count per chunk crosses chunks.
    """
    by = [*keys, "_chunk"]
    d = split(df.withColumn("_chunk", block_no(chunk)), by)
    counts = summed(d, by, [F.count(F.lit(1)).alias("_n")])
    offsets = carry_in(counts, keys, "_chunk", {"_off": ("_n", "sum")}).drop("_n")
    w = Window.partitionBy(*by).orderBy(*order)
    return (
        d.withColumn("_rn", F.row_number().over(w))
        .join(offsets, by)
        .withColumn(name, (F.coalesce("_off", F.lit(0)) + F.col("_rn") - 1).cast("bigint"))
        .drop("_chunk", "_rn", "_off")
    )


def blocked(df: DataFrame, back: int = 0, fwd: int = 0, block: int = BLOCK,
            ord_col: str = "ord") -> DataFrame:
    """Add ``_blk``; copy each row into the neighbouring blocks whose windows reach it."""
    o = F.col(ord_col)
    if not back and not fwd:
        return df.withColumn("_blk", int_div(o, block))
    first = F.greatest(int_div(o - fwd, block), F.lit(0).cast("bigint"))
    return df.withColumn("_blk", F.explode(F.sequence(first, int_div(o + back, block))))


def owned(df: DataFrame, block: int = BLOCK, ord_col: str = "ord") -> DataFrame:
    """Drop the copies ``blocked`` made, keeping each row once."""
    return df.filter(F.col("_blk") == int_div(F.col(ord_col), block))


def block_window(keys: list[str], order: list[str] | str = "ord", blk: str = "_blk"):
    return Window.partitionBy(*keys, blk).orderBy(*([order] if isinstance(order, str) else order))


def upto(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def scan(df: DataFrame, keys: list[str], order: list[str], blk: str,
         specs: dict[str, tuple[str, str]], inclusive: bool = True) -> DataFrame:
    """Running value per key over any length of series.

    ``specs`` maps an output name to (column, kind); with ``inclusive=False`` the
    current row is left out. Kind "affine" is for summaries (``carry_in``), not for rows.
    """
    if any(kind == "affine" for _, kind in specs.values()):
        raise ValueError("rows of affine maps have a closed form: see with_running_averages")
    by = [*keys, blk]
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    at = order[0]
    if len(order) > 1 and any(kind == "last" for _, kind in specs.values()):
        df, at = df.withColumn("_at", F.struct(*order)), "_at"
    d = split(df.withColumn(blk, block_no(F.col(blk))), by)
    totals = summed(d, by, [
        _total(kind, F.col(c), at).alias(f"_b_{name}") for name, (c, kind) in specs.items()])
    carried = carry_in(totals, keys, blk, {
        f"_c_{name}": (f"_b_{name}", kind) for name, (_, kind) in specs.items()})
    carried = carried.drop(*[f"_b_{name}" for name in specs])
    local = d.withColumns({
        f"_w_{name}": _running(kind, F.col(c), frame) for name, (c, kind) in specs.items()})
    out = local.join(carried, by).withColumns({
        name: merge(kind, F.col(f"_c_{name}"), F.col(f"_w_{name}"))
        for name, (_, kind) in specs.items()})
    return out.drop("_at", *[f"_c_{n}" for n in specs], *[f"_w_{n}" for n in specs])
