"""Domain tables derived from the star-schema test tables."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.resample import ticks_to_bars
from tickloom.operators.sequence import BLOCK, time_chunk, with_ordinal
from tickloom.functions.scalars import interval_millis
from tickloom.session import prepare

# Tick values start at 0; prices must be positive and move by percents.
PRICE_BASE = 1000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", (F.col("value") + PRICE_BASE).alias("price"),
        F.col("event_id").alias("seq"))


def plain_bars(spark: SparkSession, sf_dir: str, interval: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), interval, seq="seq")


def number_bars(bars: DataFrame, interval: str, keys=("symbol",)) -> DataFrame:
    chunk = time_chunk("ts", BLOCK * interval_millis(interval) / 1000)
    return with_ordinal(bars, list(keys), ["ts"], chunk)


def bars(spark: SparkSession, sf_dir: str, interval: str = "15m") -> DataFrame:
    return number_bars(plain_bars(spark, sf_dir, interval), interval)
