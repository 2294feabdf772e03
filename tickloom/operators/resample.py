"""Ticks to bars and bars to coarser bars, aligned to UTC."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import interval_millis
from tickloom.operators.sequence import int_div, micros

SOURCE_MILLIS = 15 * 60 * 1000


def bucket_start(ts: str | Column, millis: int) -> Column:
    step = millis * 1000
    return F.timestamp_micros(int_div(micros(ts), step) * F.lit(step))


def ticks_to_bars(ticks: DataFrame, interval: str | int, keys=("symbol",), ts: str = "ts",
                  price: str = "price", seq: str | None = None) -> DataFrame:
    """One bar per key and interval that has ticks; volume is the tick count.

    ``seq`` is the arrival number deciding first and last (default: the time). It is a
    single primitive column so that the partial aggregation stays a hash aggregation.
    """
    seq = seq or ts
    return (
        ticks.groupBy(*keys, bucket_start(ts, interval_millis(interval)).alias("_bar"))
        .agg(
            F.min_by(price, seq).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, seq).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumnRenamed("_bar", "ts")
        .select(*keys, "ts", "open", "high", "low", "close", "volume")
    )


def _windows(bars: DataFrame, target: str | int, keys, source_millis: int) -> tuple[DataFrame, int]:
    millis = interval_millis(target)
    if millis <= 0 or millis % source_millis:
        raise ValueError(f"target must be a positive multiple of {source_millis} ms, got {millis}")
    grouped = bars.groupBy(*keys, bucket_start("ts", millis).alias("window_start")).agg(
        F.min("ts").alias("ts"),
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("count"),
    )
    return grouped, millis // source_millis


def resample(bars: DataFrame, target: str | int, keys=("symbol",),
             source_millis: int = SOURCE_MILLIS) -> DataFrame:
    """Bars of complete windows only; the bar carries its first source time."""
    grouped, per = _windows(bars, target, keys, source_millis)
    return grouped.filter(F.col("count") == per).select(
        *keys, "ts", "open", "high", "low", "close", "volume")


def incomplete_windows(bars: DataFrame, target: str | int, keys=("symbol",),
                       source_millis: int = SOURCE_MILLIS) -> DataFrame:
    """The windows ``resample`` leaves out, with their row count and the expected one."""
    grouped, per = _windows(bars, target, keys, source_millis)
    return grouped.filter(F.col("count") != per).select(
        *keys, "window_start", "count", F.lit(per).cast("bigint").alias("expected"))


def resample_audit(bars: DataFrame, targets=("1h", "4h"), keys=("symbol",),
                   source_millis: int = SOURCE_MILLIS) -> DataFrame:
    """Source rows, built bars and incomplete windows per key, one row per target."""
    parts = []
    for target in targets:
        grouped, per = _windows(bars, target, keys, source_millis)
        parts.append(grouped.groupBy(*keys).agg(
            F.lit(str(target)).alias("target"),
            F.sum("count").alias("source_rows"),
            F.count_if(F.col("count") == per).alias("bars"),
            F.count_if(F.col("count") != per).alias("incomplete"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
