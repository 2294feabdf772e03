"""Exact order statistics per key for any group size, over several columns in one go.

A sketch of each key and column (KLL, one pass, a few kilobytes) bounds the values that a wanted rank can have. A second
pass counts the values inside the bounds one by one and all others by the zone between bounds they lie in, combined
before the exchange; the rows carry no bounds there, so that no task sorts them. Bounds of few groups are copied to every
task and rows then do not move at all; otherwise equal values are counted first and looked up by key. What is left per rank is about ``2 * MARGIN`` of the values. Where that is more than ``BUCKET_ROWS``,
it is cut at its own quantiles and only the part that holds the rank is kept, until it is not. So no sort sees a whole key.
"""
from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import finite
from tickloom.operators.joins import lookup
from tickloom.session import settled

#: Size of the sketches; their rank error is 2.296 / k ** 0.9021 in 99 of 100 cases.
SKETCH_K = 4000
#: Four times that error, which is ten standard deviations. A rank beyond raises an error, it is never guessed.
MARGIN = 4 * 2.296 / SKETCH_K ** 0.9021
#: Shares at which a sketch is asked for its values; a bound is the next one outside.
GRID = 400
#: Groups whose bounds are copied to every task, a few hundred bytes each.
FEW_GROUPS = 1 << 12
#: Distinct values that are sorted in one task for one rank.
BUCKET_ROWS = 1 << 20
#: Parts a bucket is cut into at once.
PARTS = 256


def _bounds(sketches: DataFrame, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The sketched groups with a list of (name, position, lowest, highest) for the wanted ranks."""
    n, wanted = F.col("_all"), []
    for name, rank in ranks.items():
        at = F.least(F.greatest(rank(n).cast("bigint"), F.lit(0)), n - 1)
        share = at / n
        wanted.append(F.struct(F.lit(name).alias("name"), at.alias("at"),
                               _grid(F.floor((share - MARGIN) * GRID), float("-inf")).alias("low"),
                               _grid(F.ceil((share + MARGIN) * GRID), float("inf")).alias("high")))
    return sketches.withColumn("_grid", _shares(GRID)).withColumn("_wanted", F.array(*wanted)).drop("_sketch", "_grid")


def _shares(parts: int) -> Column:
    """The values of a sketch at the shares 0, 1 / parts ... 1; these have to be constants."""
    return F.call_function("kll_sketch_get_quantile_double", F.col("_sketch"), F.array(*[F.lit(i / parts) for i in range(parts + 1)]))


def _grid(i: Column, beyond: float) -> Column:
    return F.when((i > 0) & (i < GRID), F.try_element_at("_grid", (i + 1).cast("int"))).otherwise(F.lit(beyond))


def _beside(rows: DataFrame, bounds: DataFrame, by: list[str], few: bool) -> DataFrame:
    """The rows with the bounds of their group."""
    if few:
        return rows.join(F.broadcast(bounds), by)
    return lookup(rows, bounds, by, "inner", counts=bounds.select(*by, F.col("_all").alias("_rows")))


def rank_values(df: DataFrame, keys: list[str], values: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, column, n_values, one column for each of ``ranks``): the value at 0-based sorted position ``ranks[name](n)``.

    Counts finite values only; a key without one in a column has no row for it.
    """
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in values]))
    rows = df.select(*keys, one.alias("_one")).select(*keys, F.col("_one.column").alias("column"), F.col("_one.v").alias("_v")).where(
        finite(F.col("_v")))
    by = [*keys, "column"]
    sketches = rows.groupBy(*by).agg(F.call_function("kll_sketch_agg_double", F.col("_v"), F.lit(SKETCH_K)).alias("_sketch"),
                                     F.count(F.lit(1)).alias("_all"))
    bounds = settled(_bounds(sketches, ranks))
    few = bounds.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    v, limits = F.col("_v"), [(F.col("_wanted")[i]["low"], F.col("_wanted")[i]["high"]) for i in range(len(ranks))]
    inside = reduce(or_, [(v >= low) & (v <= high) for low, high in limits])
    zone = reduce(add, [(v >= low).cast("int") + (v > high).cast("int") for low, high in limits])
    rows = rows.withColumn("_n", F.lit(1).cast("bigint")) if few else rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = _beside(rows, bounds, by, few).select(*by, "_v", "_n", zone.alias("_zone"), F.when(inside, v).alias("_in"))
    # values outside all bounds count together by zone; their least stands for them
    counted = placed.groupBy(*by, "_zone", "_in").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_least"))
    each = _beside(counted, bounds, by, few).withColumn("_w", F.explode("_wanted")).select(
        *by, "_all", F.col("_w.name").alias("_name"), F.col("_w.at").alias("_at"), F.col("_w.low").alias("_low"),
        F.col("_w.high").alias("_high"), "_least", "_in", "_n")
    within = F.col("_in").isNotNull() & F.col("_in").between(F.col("_low"), F.col("_high"))
    group = [*by, "_name"]
    # what lies below a rank's bounds is one number; what lies inside stays, value by value
    parts = each.groupBy(*group, F.when(within, F.col("_in")).alias("_v")).agg(
        F.sum(F.when(within, F.col("_n")).when(F.col("_least") < F.col("_low"), F.col("_n")).otherwise(0)).alias("_n"),
        F.first("_at").alias("_at"), F.first("_all").alias("_all"))
    # (the row without a value: it sorts first)
    kept = settled(parts)
    while kept.groupBy(*group).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > BUCKET_ROWS).limit(1).count():
        kept = settled(_cut(kept, group))
    run = Window.partitionBy(*group).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    to = kept.withColumn("_to", F.sum("_n").over(run))
    hit = (F.col("_at") < F.col("_to")) & (F.col("_at") >= F.col("_to") - F.col("_n"))
    return to.groupBy(*by).agg(F.max("_all").alias("n_values"), *[
        F.coalesce(F.max(F.when(hit & (F.col("_name") == name), F.col("_v"))),
                   F.raise_error(F.lit(f"rank {name} beyond its bounds")).cast("double")).alias(name) for name in ranks])


def _cut(kept: DataFrame, group: list[str]) -> DataFrame:
    """Of groups over the limit only the part between two of their quantiles that holds the rank; other groups whole."""
    sizes = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"), F.call_function("kll_sketch_agg_double", F.col("_v"), F.lit(SKETCH_K)).alias("_sketch"))
    cuts = F.when(F.col("_m") > BUCKET_ROWS, _shares(PARTS))
    cuts = sizes.select(*group, F.coalesce(cuts, F.array().cast("array<double>")).alias("_cuts"))
    rows = lookup(kept, cuts, group, "inner").withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    # values below all bounds lie in the first part
    sums = rows.groupBy(*group, "_part").agg(F.sum("_n").alias("_s"), F.first("_at").alias("_p"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = sums.withColumn("_before", before).where("_p >= _before AND _p < _before + _s").select(*group, "_part", "_before")
    return lookup(rows, wanted, [*group, "_part"], "inner").withColumn("_at", F.col("_at") - F.col("_before")).drop("_part", "_before")


def exact_quantiles(df: DataFrame, keys: list[str], value: str | list[str], quantiles: dict[str, float]) -> DataFrame:
    """Linear interpolation at position (n - 1) * q, like the textbook definition.

    With a list of values: (keys, column, quantiles), one row for each value column.
    """
    ranks = {}
    for name, q in quantiles.items():
        ranks[f"{name}_lo"] = lambda n, q=q: F.floor((n - 1) * F.lit(float(q)))
        ranks[f"{name}_hi"] = lambda n, q=q: F.ceil((n - 1) * F.lit(float(q)))
    values = [value] if isinstance(value, str) else value
    r = rank_values(df, keys, values, ranks)

    def between(name, q):
        pos = (F.col("n_values") - 1) * F.lit(float(q))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (lo + (hi - lo) * (pos - F.floor(pos))).alias(name)

    return r.select(*keys, *([] if isinstance(value, str) else ["column"]), *[between(name, q) for name, q in quantiles.items()])


def wide_medians(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, median_<value> ...): the medians of several columns from one pass over the rows."""
    m = exact_quantiles(df, keys, values, {"_median": 0.5})
    return m.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("_median"))).alias(f"median_{c}") for c in values])


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """sorted[floor(n / 2)]: the upper one of two middle values."""
    return rank_values(df, keys, [value], {name: lambda n: F.floor(n / 2)}).drop("n_values", "column")
