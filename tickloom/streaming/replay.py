"""What a live run did with its bars, worked out again as a batch from the order of arrival."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.signals import signals
from tickloom.operators import positions
from tickloom.operators.joins import keep_first
from tickloom.operators.sequence import BLOCK, carry_in, time_chunk, with_ordinal
from tickloom.functions.scalars import interval_millis


def with_late(rows: DataFrame, batch: str, delay_seconds: float, ts: str = "ts") -> DataFrame:
    """Rows with ``late``: behind the watermark that held when their micro-batch began.

    That is the newest time of all earlier batches, in whole milliseconds, less the delay. Only one row per batch is
    scanned for it; ``batch`` is a growing number.
    """
    newest = rows.groupBy(batch).agg(F.max(F.unix_millis(ts)).alias("_newest")).withColumn("_all", F.lit(1))
    seen = carry_in(newest, ["_all"], batch, {"_newest_seen": ("_newest", "max")}).select(batch, "_newest_seen")
    behind = F.unix_micros(ts) < (F.col("_newest_seen") - int(delay_seconds * 1000)) * 1000
    return rows.join(seen, batch).withColumn("late", F.coalesce(behind, F.lit(False))).drop("_newest_seen")


def replay_signals(bars: DataFrame, rule: str, batch: str, delay_seconds: float, interval: str = "15m",
                   sequence: str | None = None) -> DataFrame:
    """(symbol, ts, close, action) of a live run of ``rule``: LONG and CLOSE of the bars in time, LATE for bars behind.

    ``bars`` holds final bars with the micro-batch each came in; of several of one time the first to come (``sequence``
    within a batch) counts. Equal to what ``stateful.live_signals`` gives for the same batches.
    """
    marked = with_late(bars, batch, delay_seconds)
    order = F.struct(batch, sequence) if sequence else F.struct(batch)
    used = keep_first(marked.where("NOT late").withColumn("_order", order), ["symbol", "ts"], "_order").drop("_order", "late", batch)
    chunk = time_chunk("ts", BLOCK * interval_millis(interval) / 1000)
    numbered = with_ordinal(used, ["symbol"], ["ts"], chunk)
    held = positions.hold(signals(numbered, [rule], interval=interval), ["symbol", "strategy"])
    acted = held.where("up OR down").select("symbol", "ts", "close", F.when(F.col("up"), "LONG").otherwise("CLOSE").alias("action"))
    return acted.unionByName(marked.where("late").select("symbol", "ts", "close", F.lit("LATE").alias("action")))


def arrival_batch(number: Column, per_batch: int) -> Column:
    return F.floor(number / per_batch).cast("bigint")
