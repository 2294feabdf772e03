"""Streaming market feeds: messages to typed rows, final bars, ticks to bars, latest values."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.indicators import ticker_change_pct

# Message fields of the three feeds.
KLINE = ("symbol string, interval string, bar_time bigint, open string, high string, low string, close string, "
         "volume string, isFinal boolean, warmup boolean")
TICKER = "symbol string, open string, close string, volume string, time bigint"
MARK = "symbol string, markPrice string, time bigint"


def _num(c):
    return F.col(c).try_cast("double").alias(c)


def parse_klines(messages: DataFrame, body: str = "value") -> DataFrame:
    """A bar without ``isFinal`` counts as final."""
    m = messages.select(F.from_json(F.col(body).cast("string"), KLINE).alias("m")).select("m.*")
    return m.select("symbol", "interval", F.timestamp_millis("bar_time").alias("ts"),
                    *[_num(c) for c in ("open", "high", "low", "close", "volume")],
                    F.coalesce("isFinal", F.lit(True)).alias("is_final"),
                    F.coalesce("warmup", F.lit(False)).alias("warmup"))


def parse_tickers(messages: DataFrame, body: str = "value") -> DataFrame:
    m = messages.select(F.from_json(F.col(body).cast("string"), TICKER).alias("m")).select("m.*")
    m = m.select("symbol", F.timestamp_millis("time").alias("ts"), *[_num(c) for c in ("open", "close", "volume")])
    return m.withColumn("change_pct", ticker_change_pct(F.col("open"), F.col("close")))


def parse_marks(messages: DataFrame, body: str = "value") -> DataFrame:
    m = messages.select(F.from_json(F.col(body).cast("string"), MARK).alias("m")).select("m.*")
    return m.select("symbol", F.timestamp_millis("time").alias("ts"),
                    F.col("markPrice").try_cast("double").alias("price")).filter("price is not null")


def final_bars(bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each final bar once per (symbol, interval, time), however often it is sent again.

    State is dropped ``delay`` after the latest bar time seen.
    """
    return bars.filter("is_final").withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["symbol", "interval", "ts"])


def tick_bars(ticks: DataFrame, interval: str = "15 minutes", delay: str = "1 minute",
              seq: str = "seq") -> DataFrame:
    """Tumbling OHLCV bars from ticks (symbol, ts, price, seq)."""
    return (ticks.withWatermark("ts", delay).groupBy(F.window("ts", interval), "symbol")
            .agg(F.min_by("price", seq).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", seq).alias("close"),
                 F.count(F.lit(1)).cast("double").alias("volume"))
            .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume"))


def latest(df: DataFrame, value: str = "price", key: str = "symbol") -> DataFrame:
    """Last value per key (update or complete output mode); of several at that time the largest."""
    return df.groupBy(key).agg(F.max_by(value, F.struct("ts", value)).alias(value), F.max("ts").alias("ts"))


def mark_backfill(bars: DataFrame, until: Column) -> DataFrame:
    """Rows of the initial backfill, up to ``until``, warm rules up without acting."""
    return bars.withColumn("warmup", F.col("warmup") | (F.col("ts") < until))
