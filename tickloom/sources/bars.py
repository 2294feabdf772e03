"""Bar sources: CSV exports, headerless archives, mark-price folders; typed and checked."""
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.quality import DataError, dedupe_first, row_issues

REQUIRED = ["timestamp", "open", "high", "low", "close", "volume"]
BOM = "﻿"


def read_csv_files(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as trimmed strings under lower-case names; BOM, CRLF and blank lines ignored.

    Raises on an empty file or repeated header names. ``ingest_id`` numbers the rows in file
    order: the split's place in the file list and the row's place in its split.
    """
    df = (spark.read.option("header", True).option("inferSchema", False).option("sep", delimiter)
          .option("quote", "").option("ignoreLeadingWhiteSpace", True)
          .option("ignoreTrailingWhiteSpace", True).option("enforceSchema", False).csv(path))
    if not df.columns:
        raise DataError(f"empty file: {path}")
    header = _header(spark, path, delimiter)
    repeated = sorted({c for c in header if header.count(c) > 1})
    if repeated:
        raise DataError(f"duplicate header: {', '.join(repeated)}")
    return in_file_order(df, "_file").toDF(*header, "source_file", "ingest_id")


def read_csv_text(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``read_csv_files`` without the file names."""
    return read_csv_files(spark, path, delimiter).drop("source_file")


def in_file_order(df: DataFrame, *more: str) -> DataFrame:
    """The frame of a file scan with ``ingest_id``: by file name, then place in the file.

    ``more`` names further columns to keep, as ``_file``. Row numbers alone would follow how Spark packs files into tasks. A number is 2 ** 40 times the file's rank, plus the start of
    its split, plus the row's number in its task, which is less than a split has bytes.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    files = df.select(F.col("_metadata.file_path").alias("_file")).distinct().withColumn(
        "_rank", F.row_number().over(Window.orderBy("_file")) - 1)
    number = F.col("_rank").cast("long") * (1 << 40) + F.col("_block") + F.col("_row")
    return placed.join(files, "_file").select(*df.columns, *more, number.alias("ingest_id"))


def _header(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    first = spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(1).collect()
    if not first:
        raise DataError(f"empty file: {path}")
    return [c.strip().lower() for c in first[0][0].lstrip(BOM).rstrip("\r").split(delimiter)]


def missing_columns(columns: list[str], required=REQUIRED) -> list[str]:
    return [c for c in required if c not in columns]


def require_columns(df: DataFrame, required=REQUIRED) -> DataFrame:
    missing = missing_columns(df.columns, required)
    if missing:
        raise DataError(f"missing columns: {', '.join(missing)}")
    return df


def parse_time(text: Column) -> Column:
    """Epoch milliseconds or ISO text; NULL when neither."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d+$"), F.timestamp_millis(t.try_cast("bigint"))).otherwise(
        F.try_to_timestamp(t))


def parse_number(text: Column) -> Column:
    """Double, NULL standing for every unusable value."""
    v = F.trim(text).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def typed_bars(raw: DataFrame, symbol: Column | None = None) -> DataFrame:
    """String columns to bars. A time that cannot be read is an error when it is used."""
    require_columns(raw)
    ts = parse_time(F.col("timestamp"))
    checked = F.when(ts.isNull(), F.raise_error(F.concat(
        F.lit("unreadable timestamp: "), F.coalesce("timestamp", F.lit("NULL")))).cast("timestamp")).otherwise(ts)
    sym = symbol if symbol is not None else (
        F.col("symbol") if "symbol" in raw.columns else F.lit("SERIES"))
    return raw.select(sym.alias("symbol"), checked.alias("ts"),
                      *[parse_number(F.col(c)).alias(c) for c in REQUIRED[1:]], "ingest_id")


def load_bars(bars: DataFrame, mode: str = "fail", keys=("symbol",)):
    """Strict loading. ``fail``: raise on an empty table or any error, keep the first of each
    repeated time. ``quarantine``: (good rows, issue table) instead of raising."""
    issues = row_issues(bars, keys)
    errors = issues.filter("severity = 'error'")
    if mode == "quarantine":
        bad = errors.select(*keys, "ingest_id").distinct()
        good = bars.join(bad, [*keys, "ingest_id"], "left_anti")
        return dedupe_first(good, keys), issues
    if mode != "fail":
        raise ValueError(f"unknown mode {mode!r}")
    if bars.limit(1).count() == 0:
        raise DataError("no bars")
    found = errors.limit(10).collect()
    if found:
        raise DataError("; ".join(f"row {r['ingest_id']}: {r['message']}" for r in found))
    return dedupe_first(bars, keys)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, mode: str = "fail"):
    raw = read_csv_text(spark, path)
    return load_bars(typed_bars(raw, F.lit(symbol) if symbol else None), mode)


def read_bar_archive(spark: SparkSession, path: str, symbol: Column | None = None) -> DataFrame:
    """Files with or without a header: rows of six or more fields with a numeric first one."""
    raw = spark.read.text(path)
    sym = symbol if symbol is not None else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)-[^/]*$", 1)
    lines = in_file_order(raw.select("value", sym.alias("symbol"), "_metadata")).withColumn("_f", F.split(F.trim("value"), ","))
    rows = lines.filter((F.size("_f") >= 6) & F.col("_f")[0].rlike(r"^\s*\d+\s*$"))
    return rows.select("symbol", parse_time(F.col("_f")[0]).alias("ts"),
                       *[parse_number(F.col("_f")[i + 1]).alias(c) for i, c in enumerate(REQUIRED[1:])],
                       "ingest_id")


def read_mark_bars(spark: SparkSession, path: str, symbol: Column | None = None) -> DataFrame:
    """Mark-price bars of a folder: open time, open and close; header lines fall out."""
    bars = read_bar_archive(spark, path, symbol)
    return bars.filter("ts is not null").select("symbol", F.col("ts").alias("open_time"), "open", "close")
