"""Archive manifests and checksum audits."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE = "struct<month: string, url: string, file: string, sha256: string, rows: bigint, status: string>"
ASSET = (f"struct<klineRows: bigint, klineFirst: string, klineLast: string, fundingRows: bigint, "
         f"klineArchives: array<{ARCHIVE}>, fundingArchives: array<{ARCHIVE}>>")
SCHEMA = f"assets map<string, {ASSET}>"


def read_manifest(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """One row per asset: its statistics and archive lists."""
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("assets").alias("symbol", "asset")).select("symbol", "asset.*")


def manifest_archives(manifest: DataFrame, column: str = "klineArchives") -> DataFrame:
    return manifest.select("symbol", F.inline(column))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size per file of a folder or glob; each file is read by one task."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"))


def data_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows starting with a number per file; a file without any is not listed."""
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\d"))
    return rows.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(
        F.count(F.lit(1)).alias("rows"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """'<hex digest>  <file>' lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(
        F.regexp_replace(parts[1], r"^\*", "").alias("file"), F.lower(parts[0]).alias("expected_sha256"))


def expected_months(assets: DataFrame, start: str, end: str) -> DataFrame:
    """Every asset with every month start of [start, end]."""
    months = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    return assets.select("symbol", F.explode(months).alias("month"))


def audit_archives(expected: DataFrame, files: DataFrame, checksums: DataFrame, name: Column,
                   row_counts: DataFrame | None = None) -> DataFrame:
    """Status per expected archive: OK, NOT_AVAILABLE, CHECKSUM_MISMATCH or EMPTY_CSV.

    ``name`` gives the file name of an expected row; with ``row_counts`` (``data_rows``) a
    file without data rows is empty. Only files with status OK may be used.
    """
    e = expected.withColumn("file", name)
    j = e.join(files, "file", "left").join(checksums, "file", "left")
    if row_counts is not None:
        j = j.join(row_counts.select("file", "rows"), "file", "left")
        empty = F.coalesce(F.col("rows"), F.lit(0)) == 0
    else:
        empty = F.coalesce(F.col("bytes"), F.lit(0)) == 0
    wrong = F.col("expected_sha256").isNotNull() & (F.col("expected_sha256") != F.col("sha256"))
    return j.withColumn("status", F.when(F.col("sha256").isNull(), "NOT_AVAILABLE")
                        .when(wrong, "CHECKSUM_MISMATCH").when(empty, "EMPTY_CSV").otherwise("OK"))
