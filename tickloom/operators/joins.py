"""As-of and interval joins, snapshot comparison."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.sequence import BLOCK, block_no, int_div, scan, time_chunk

# Fixed value: how old a fallback mark may be.
MAX_STALENESS_MS = 5 * 60 * 1000


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str,
              fields: list[str], block: Callable[[Column], Column], strict: bool = False,
              name: str = "match") -> DataFrame:
    """Each left row with the latest right row at or before it (``strict``: before it).

    The match is a struct of ``right_time`` and ``fields``, NULL when there is none.
    Both sides are merged and read in time order per (on, block of time), so a hot key is
    cut by time; ``block`` maps a time column to a growing block number. Several right
    rows with one time must be reduced before (``keep_first``).
    """
    m = F.struct(F.col(right_time).alias("at"), *fields)
    r = right.select(*on, F.col(right_time).alias("_time"), m.alias("_m"),
                     F.lit(1 if strict else 0).alias("_side"), F.lit(False).alias("_left"))
    lf = left.withColumns({"_time": F.col(left_time), "_m": F.lit(None).cast(r.schema["_m"].dataType),
                           "_side": F.lit(0 if strict else 1), "_left": F.lit(True)})
    both = lf.unionByName(r, allowMissingColumns=True).withColumn("_blk", block_no(block(F.col("_time"))))
    out = scan(both, on, ["_time", "_side"], "_blk", {name: ("_m", "last")})
    return out.filter("_left").select(*left.columns, name)


def seconds_block(seconds: float) -> Callable[[Column], Column]:
    return lambda t: time_chunk(t, seconds)


def mark_price(events: DataFrame, marks: DataFrame, on: list[str], time: str, open_time: str,
               block: Callable[[Column], Column], millis: Callable[[Column], Column] = F.unix_millis,
               max_staleness_ms: int = MAX_STALENESS_MS) -> DataFrame:
    """Mark price of each event: the open of the bar opening at that very time, else the
    close of the bar before it if that is fresh enough; never a later bar."""
    j = asof_join(events, marks, on, time, open_time, ["open", "close"], block, name="_mark")
    m = F.col("_mark")
    age = millis(F.col(time)) - millis(m["at"])
    exact = F.col(time) == m["at"]
    return j.withColumns({
        "mark_price": F.when(exact, m["open"]).when(age <= max_staleness_ms, m["close"]),
        "mark_status": (F.when(m.isNull(), "NO_DATA").when(exact, "EXACT_OPEN")
                        .when(age <= max_staleness_ms, "PREVIOUS_FALLBACK").otherwise("TOO_STALE")),
        "staleness_ms": F.when(m.isNotNull(), age),
    }).drop("_mark")


def mark_coverage(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per mark status and the age of the marks used."""
    s = F.col("mark_status")
    used = F.when(s.isin("EXACT_OPEN", "PREVIOUS_FALLBACK"), F.col("staleness_ms"))
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(s == "EXACT_OPEN").alias("exact_open"),
        F.count_if(s == "PREVIOUS_FALLBACK").alias("previous_fallback"),
        F.count_if(s == "TOO_STALE").alias("too_stale"),
        F.count_if(s == "NO_DATA").alias("no_data"),
        F.avg(used).alias("avg_staleness_ms"), F.max(used).alias("max_staleness_ms"))


def aligned_ranges(first: Column, last: Column, levels: int = 62) -> Column:
    """The aligned ranges (level, place) that make up the buckets from ``first`` to ``last``.

    Range (l, p) holds buckets p * 2**l to (p + 1) * 2**l - 1. There are at most two of each level, so no more than twice
    the binary logarithm of the number of buckets.
    """
    def of(level: Column) -> Column:
        low = F.negative(F.call_function("shiftright", F.negative(first), level))  # rounded up
        high = F.call_function("shiftright", last + 1, level)
        odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
        piece = lambda place: F.struct(level.alias("level"), place.alias("place"))
        return F.array_compact(F.array(F.when((low < high) & odd(low), piece(low)), F.when((low < high) & odd(high), piece(high - 1))))

    top = F.least(F.lit(levels), F.ceil(F.log2((last - first + 2).cast("double"))).cast("int"))
    return F.when(last >= first, F.flatten(F.transform(F.sequence(F.lit(0), top), of)))


def interval_join(spans: DataFrame, events: DataFrame, on: list[str], start: str, end: str, time: str,
                  bucket: Callable[[Column], Column]) -> DataFrame:
    """Pairs with start < time < end, as an equi-join on (on, aligned range of time buckets).

    A span is cut into aligned ranges of buckets, so a long one costs a few rows, not one for each bucket it covers. An
    event has one row for each level of ranges in use; these levels, at most 63 numbers, are read from the spans first.
    ``bucket`` maps a time column to a growing number.
    """
    s = spans.withColumn("_range", F.explode(aligned_ranges(bucket(F.col(start)).cast("bigint"), bucket(F.col(end)).cast("bigint"))))
    used = sorted(r.level for r in s.select("_range.level").distinct().collect())
    s = s.withColumns({"_level": F.col("_range.level"), "_place": F.col("_range.place")}).drop("_range")
    levels = F.array(*[F.lit(x) for x in used]) if used else F.array().cast("array<int>")
    e = events.withColumn("_level", F.explode(levels))
    e = e.withColumn("_place", F.call_function("shiftright", bucket(F.col(time)).cast("bigint"), F.col("_level")))
    inside = (F.col(time) > F.col(start)) & (F.col(time) < F.col(end))
    return s.join(e, [*on, "_level", "_place"]).filter(inside).drop("_level", "_place")


#: Rows of one key that a look-up leaves in one task.
LOOKUP_ROWS = 1 << 20


def lookup(df: DataFrame, table: DataFrame, on: list[str], how: str = "left", spread: list[str] | None = None,
           counts: DataFrame | None = None) -> DataFrame:
    """Join with a table of one row per key, hot keys of ``df`` spread over several tasks.

    A counting pass over the keys finds those with more than ``LOOKUP_ROWS`` rows. Only their rows are salted, and only
    their table rows are copied, one for each ``LOOKUP_ROWS`` rows; all other keys are joined as they are. There are at
    most rows / ``LOOKUP_ROWS`` hot keys. ``spread`` names the columns that tell rows of one key apart (default: all);
    ``counts`` (on, _rows) saves the counting pass.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")) if counts is None else counts
    hot = counts.where(F.col("_rows") > LOOKUP_ROWS).select(
        *on, F.ceil(F.col("_rows") / LOOKUP_ROWS).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.pmod(F.xxhash64(*(spread or df.columns)), parts).cast("int")
    rows = df.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_parts")
    copies = table.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return rows.join(copies, [*on, "_salt"], how).drop("_salt")


def keep_first(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row per ``by``: the one with the lowest ``order``; combined before the exchange."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*").select(
        *df.columns)


def keep_last(df: DataFrame, by: list[str], order: Column | str) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*").select(
        *df.columns)


def latest_per_key(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """The last ``n`` rows per key. Spark turns the rank filter into a per-task limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def replace_from(existing: DataFrame, new: DataFrame, cutoff: Column, ts: str = "ts") -> DataFrame:
    """Rows before the cutoff kept, everything from it replaced by ``new``."""
    return existing.filter(F.col(ts) < cutoff).unionByName(new)


def compare_scenarios(df: DataFrame, keys: list[str], values: list[str], before: str, after: str,
                      scenario: str = "scenario") -> DataFrame:
    """Values of two scenarios side by side with their difference, one row per key."""
    def of(name, c):
        return F.max(F.when(F.col(scenario) == name, F.col(c)))

    out = df.filter(F.col(scenario).isin(before, after)).groupBy(*keys).agg(
        *[of(before, c).alias(f"{c}_before") for c in values],
        *[of(after, c).alias(f"{c}_after") for c in values])
    return out.withColumns({f"{c}_delta": F.col(f"{c}_after") - F.col(f"{c}_before") for c in values})


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(keys, values, "metric", "value")


def ordinal_block(block: int = BLOCK) -> Callable[[Column], Column]:
    return lambda o: int_div(o, block)
