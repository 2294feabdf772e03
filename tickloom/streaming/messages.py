"""Feed messages of several shapes to one typed table, what cannot be used to a reject table.

A message is parsed once, to a VARIANT; each field is the first of its alternative places that is there. Stateless, so it
works on streams and tables alike.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.indicators import ticker_change_pct

# Where the feeds put their fields, flat form first, then the short and nested forms.
PLACES = {
    "symbol": ["$.symbol", "$.s", "$.k.s"],
    "interval": ["$.interval", "$.k.i"],
    "time": ["$.bar_time", "$.closeTime", "$.k.T", "$.time", "$.E"],
    "open": ["$.open", "$.k.o", "$.o"],
    "high": ["$.high", "$.k.h", "$.h"],
    "low": ["$.low", "$.k.l", "$.l"],
    "close": ["$.close", "$.k.c", "$.c"],
    "volume": ["$.volume", "$.k.v", "$.v"],
    "mark_price": ["$.markPrice", "$.p"],
    "index_price": ["$.indexPrice", "$.i"],
    "funding_rate": ["$.fundingRate", "$.r"],
    "is_final": ["$.isFinal", "$.k.x"],
    "warmup": ["$.warmup"],
}
NUMBERS = ["open", "high", "low", "close", "volume", "mark_price", "index_price", "funding_rate"]


def _first(message: Column, name: str) -> Column:
    return F.coalesce(*[F.try_variant_get(message, place, "string") for place in PLACES[name]])


def _number(text: Column) -> Column:
    v = text.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def parse_feed(messages: DataFrame, body: str = "value") -> DataFrame:
    """All messages with kind (kline, mark, ticker), reject (why it cannot be used, or null), and typed fields.

    A bar needs its four prices and a time, a mark its mark price, a ticker its close. A bar that does not say so is
    final. Other columns of ``messages`` are kept; null and empty bodies are rejected.
    """
    rest = [c for c in messages.columns if c != body]
    m = messages.select(*rest, F.try_parse_json(F.col(body).cast("string")).alias("_m"))
    m = m.select("*", *[_first(F.col("_m"), name).alias(f"_{name}") for name in PLACES],
                 F.try_variant_get("_m", "$.k", "variant").isNotNull().alias("_nested"))
    kind = (F.when(F.col("_nested") | F.col("_interval").isNotNull(), "kline").when(F.col("_mark_price").isNotNull(), "mark")
            .when(F.col("_open").isNotNull() & F.col("_close").isNotNull(), "ticker"))
    m = m.select(*rest, F.col("_m").isNull().alias("_bad"), kind.alias("kind"), F.nullif("_symbol", F.lit("")).alias("symbol"),
                 F.col("_interval").alias("interval"), F.timestamp_millis(F.col("_time").try_cast("bigint")).alias("ts"),
                 *[_number(F.col(f"_{n}")).alias(n) for n in NUMBERS],
                 F.coalesce(F.col("_is_final").try_cast("boolean"), F.lit(True)).alias("is_final"),
                 F.coalesce(F.col("_warmup").try_cast("boolean"), F.lit(False)).alias("warmup"))
    prices = F.lit(False)
    for c in ("open", "high", "low", "close"):
        prices = prices | F.col(c).isNull()
    reject = (F.when(F.col("_bad"), "not JSON").when(F.col("kind").isNull(), "unknown shape").when(F.col("symbol").isNull(), "no symbol")
              .when((F.col("kind") == "kline") & F.col("ts").isNull(), "no time")
              .when(((F.col("kind") == "kline") & prices) | ((F.col("kind") == "mark") & F.col("mark_price").isNull())
                    | ((F.col("kind") == "ticker") & F.col("close").isNull()), "no price"))
    return m.withColumn("reject", reject).drop("_bad")


def bars(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject IS NULL AND kind = 'kline'").select(
        "symbol", "interval", "ts", "open", "high", "low", "close", "volume", "is_final", "warmup")


def marks(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject IS NULL AND kind = 'mark'").select(
        "symbol", "ts", F.col("mark_price").alias("price"), "index_price", "funding_rate")


def tickers(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject IS NULL AND kind = 'ticker'").select(
        "symbol", "ts", F.col("close").alias("price"), ticker_change_pct(F.col("open"), F.col("close")).alias("change_pct"), "volume")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject IS NOT NULL")
