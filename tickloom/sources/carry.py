"""Carry (funding) event sources and their provenance."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.joins import keep_first
from tickloom.operators.quality import synthetic_source
from tickloom.sources.bars import parse_number, read_csv_text
from tickloom.sources.files import file_rows, read_files

# The event file's columns and the archive's aliases for them.
EVENT_COLUMNS = ["symbol", "fundingTime", "fundingRate", "markPrice", "rateType", "source"]
EVENT_SCHEMA = ("symbol string, funding_time bigint, funding_rate double, mark_price double, rate_type string, "
                "source string, ingest_id bigint")
TIME_ALIASES = ["calc_time", "fundingtime", "calculate_time"]
RATE_ALIASES = ["last_funding_rate", "fundingrate"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) not in (None, [])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event file; optional columns become NULL, unknown ones are ignored, no file is no events."""
    if not _exists(spark, path):
        return spark.createDataFrame([], EVENT_SCHEMA)
    raw = read_csv_text(spark, path)

    def text(c):
        return F.nullif(F.col(c), F.lit("")) if c in raw.columns else F.lit(None).cast("string")

    return raw.select(
        text("symbol").alias("symbol"), text("fundingtime").try_cast("bigint").alias("funding_time"),
        parse_number(text("fundingrate")).alias("funding_rate"),
        parse_number(text("markprice")).alias("mark_price"), text("ratetype").alias("rate_type"),
        text("source").alias("source"), "ingest_id")


def read_archive(spark: SparkSession, path: str, source: str, symbol: Column | None = None, where: str | None = None,
                 glob: str | None = None) -> DataFrame:
    """Monthly archive files, each under an alias header of its own; unusable rows dropped, provenance attached.

    ``where`` is a condition on ``key=value`` folders, ``glob`` a pattern of file names: other files are not read.
    """
    raw = file_rows(read_files(spark, path, where, glob), {"time": TIME_ALIASES, "rate": RATE_ALIASES})
    sym = symbol if symbol is not None else F.regexp_extract("source_file", r"([^/]+?)-[^/]*$", 1)
    out = raw.select(sym.alias("symbol"), F.col("time").try_cast("bigint").alias("funding_time"), parse_number(F.col("rate")).alias("funding_rate"),
                     F.lit(None).cast("double").alias("mark_price"), F.lit(None).cast("string").alias("rate_type"),
                     F.lit(source).alias("source"), "ingest_id")
    return out.filter("funding_time is not null and funding_rate is not null")


def dedupe_events(*batches: DataFrame) -> DataFrame:
    """First event per symbol and time: of the earliest batch given that has it, there the first row."""
    events = None
    for number, batch in enumerate(batches):
        batch = batch.withColumn("ingest_id", F.struct(F.lit(number).alias("batch"), F.col("ingest_id").alias("row")))
        events = batch if events is None else events.unionByName(batch)
    return keep_first(events, ["symbol", "funding_time"], "ingest_id")


def provenance(events: DataFrame, keys=("symbol",)) -> DataFrame:
    """One row per key: range, counts by rate sign, direct and missing marks, repeats."""
    r, n = F.col("funding_rate"), F.col("_n")
    # Combined per time first, so that repeats are counted without a distinct.
    t = events.groupBy(*keys, "funding_time").agg(
        F.count(F.lit(1)).alias("_n"), F.count("mark_price").alias("_m"), F.count("funding_rate").alias("_r"),
        F.count_if(r > 0).alias("_p"), F.count_if(r < 0).alias("_g"), F.count_if(r == 0).alias("_z"),
        F.count_if(synthetic_source(F.col("source"))).alias("_s"))
    return t.groupBy(*keys).agg(
        F.min("funding_time").alias("first_time"), F.max("funding_time").alias("last_time"),
        F.sum(n).alias("events"), F.sum("_m").alias("direct_marks"),
        (F.sum(n) - F.sum("_m")).alias("missing_marks"), F.sum(n - 1).alias("duplicates"),
        (F.sum(n) - F.sum("_r")).alias("invalid"), F.sum("_p").alias("positive"),
        F.sum("_g").alias("negative"), F.sum("_z").alias("zero"), F.sum("_s").alias("synthetic"))


def write_events(events: DataFrame, path: str) -> None:
    names = dict(zip(["symbol", "funding_time", "funding_rate", "mark_price", "rate_type", "source"], EVENT_COLUMNS))
    have = [c for c in names if c in events.columns]
    (events.select(*[F.col(c).alias(names[c]) for c in have])
     .write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path))
