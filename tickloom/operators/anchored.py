"""Greedy windows: each begins at the first event behind the one before it.

Cooldowns and error windows are anchored: the first event opens a window of ``span``, the first event behind that window
opens the next. Which events open one depends on the whole history, but not on a walk over it: every event has one
successor, the first event at or after its time plus the span, and the openers are what the first event reaches.
They are found by doubling: with the successor 2**k steps on known for each event, openers reached in fewer than 2**k steps
give those in fewer than 2**(k + 1). All steps are joins on (key, time), so a hot key is spread by time.
"""
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.joins import asof_join
from tickloom.operators.sequence import int_div, with_ordinal
from tickloom.session import settled

#: Width in microseconds of the blocks of time that searches run in.
CHUNK = 86_400_000_000


def successors(times: DataFrame, keys: list[str], at: str, span: int, chunk: int = CHUNK) -> DataFrame:
    """(keys, at, next): the first time of the key at or after ``at + span``, null behind the last. ``times`` is distinct."""
    # the search for the next is the search for the latest before, with the sign of time turned
    ahead = times.select(*keys, at, (-F.col(at) - span).alias("_aim"))
    back = times.select(*keys, (-F.col(at)).alias("at_us"))
    found = asof_join(ahead, back, keys, "_aim", "at_us", [], lambda t: int_div(t, chunk), name="_m")
    return found.select(*keys, at, (-F.col("_m.at")).alias("next"))


def openers(times: DataFrame, keys: list[str], at: str, span: int, settle: Callable[[DataFrame], DataFrame] = settled,
            chunk: int = CHUNK) -> DataFrame:
    """(keys, at): the times that open a window of ``span`` microseconds.

    ``times`` holds distinct (keys, at), at in microseconds. ``settle`` ends a frame's lineage; the number of rounds is the
    logarithm of the longest row of windows.
    """
    hops = settle(successors(times, keys, at, span, chunk).where("next IS NOT NULL"))
    marked = settle(times.groupBy(*keys).agg(F.min(at).alias(at)))
    while True:
        reached = settle(marked.join(hops, [*keys, at]).select(*keys, F.col("next").alias(at)))
        if reached.isEmpty():
            return marked
        marked = marked.unionByName(reached)
        further = hops.select(*keys, F.col(at).alias("next"), F.col("next").alias("_far"))
        hops = settle(hops.join(further, [*keys, "next"]).select(*keys, at, F.col("_far").alias("next")))


def _distinct_times(events: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return events.select(*keys, F.unix_micros(ts).alias("at_us")).distinct()


def allowed_entries(entries: DataFrame, keys: list[str], seconds: float, ts: str = "ts",
                    settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(keys, ts, allowed) for each time of an entry: false within ``seconds`` of the last allowed one."""
    times = _distinct_times(entries, keys, ts)
    found = openers(times, keys, "at_us", int(seconds * 1_000_000), settle).withColumn("_open", F.lit(True))
    return times.join(found, [*keys, "at_us"], "left").select(
        *keys, F.timestamp_micros("at_us").alias(ts), F.coalesce("_open", F.lit(False)).alias("allowed"))


def trips(errors: DataFrame, keys: list[str], order: list[str], limit: int, window_seconds: float, seconds: float, ts: str = "ts",
          settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(keys, tripped_at, expires_at, errors): errors from the ``limit``-th on within a window anchored at its first error.

    A window holds errors up to and with ``window_seconds`` after its first; ``order`` (ts first) tells errors apart.
    """
    width = int(window_seconds * 1_000_000)
    rows = errors.select(*keys, *dict.fromkeys([ts, *order])).withColumn("at_us", F.unix_micros(ts))
    rows = settle(with_ordinal(rows, keys, order, int_div(F.col("at_us"), CHUNK)))
    # a window ends with the microsecond behind its width
    found = openers(rows.select(*keys, "at_us").distinct(), keys, "at_us", width + 1, settle)
    first = rows.groupBy(*keys, "at_us").agg(F.min("ord").alias("_first")).join(found, [*keys, "at_us"])
    placed = asof_join(rows, first.withColumnRenamed("at_us", "_open"), keys, "at_us", "_open", ["_first"], lambda t: int_div(t, CHUNK), name="_m")
    nth = F.col("ord") - F.col("_m._first") + 1
    return placed.where(nth >= limit).select(
        *keys, F.col(ts).alias("tripped_at"), F.timestamp_micros(F.col("at_us") + int(seconds * 1_000_000)).alias("expires_at"),
        nth.cast("bigint").alias("errors"))
