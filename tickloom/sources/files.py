"""Folders of delimited files that each have a header of their own, read and checked in one go.

A file is one row of Spark's binary file source: its digest is taken from the very bytes its rows come from, and its own
header says where each wanted column stands. Works with any store that Spark reads. A file is held whole by one task, so
it has to stay under 2 GB (archives come by month). Conditions on ``key=value`` folders prune the list of files.
"""
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.quality import DataError

BOM = "﻿"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints the session names, or in its warehouse folder where it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def _listing(spark: SparkSession, path: str, where: str | None, glob: str | None) -> DataFrame:
    read = spark.read.format("binaryFile")
    files = (read.option("pathGlobFilter", glob) if glob else read).load(path)
    return files.where(where) if where else files


def read_files(spark: SparkSession, path: str, where: str | None = None, glob: str | None = None, delimiter: str = ",",
               columns: list[str] | None = None) -> DataFrame:
    """One row per file: folder columns, path, file, rank, sha256, bytes, header and lines (array of its data lines).

    Names in a header are trimmed and lower-case; BOM, CRLF and blank lines are ignored. A file whose first field is a
    number has no header: its columns are ``columns``, in that order. ``rank`` is the file's place by path.
    """
    listed = _listing(spark, path, where, glob)
    folders = [c for c in listed.columns if c not in ("path", "modificationTime", "length", "content")]
    # only names are read for the ranks
    ranks = listed.select("path").withColumn("rank", F.row_number().over(Window.orderBy("path")) - 1)
    text = F.regexp_replace(F.col("content").cast("string"), f"^{BOM}", "")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    files = listed.join(ranks, "path").select(
        *folders, "path", F.element_at(F.split("path", "/"), -1).alias("file"), "rank", F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"), lines.alias("_lines"))
    first = F.transform(F.split(F.try_element_at("_lines", F.lit(1)), delimiter), lambda x: F.lower(F.trim(x)))
    bare = F.coalesce(first[0].rlike(r"^[-+]?\d+(\.\d*)?$"), F.lit(False))
    named = F.array(*[F.lit(c) for c in columns or []]).cast("array<string>")
    return files.select("*", F.when(bare, named).otherwise(F.coalesce(first, F.array().cast("array<string>"))).alias("header"),
                        F.when(bare, F.col("_lines")).otherwise(F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1)))).alias("lines")).drop("_lines")


def file_rows(files: DataFrame, wanted: dict[str, list[str]], optional: tuple[str, ...] = (), delimiter: str = ",") -> DataFrame:
    """The data lines of ``read_files`` as strings: folder columns, source_file, the wanted columns and ingest_id.

    ``wanted`` lists the names that a column may have in a header; the first found counts. A file without a column that
    is not optional is an error, and so is a header with one name twice. Empty fields are null. ``ingest_id`` numbers the rows by file and line.
    """
    place = {name: F.coalesce(*[F.nullif(F.array_position("header", a), F.lit(0)) for a in names]) for name, names in wanted.items()}
    faults = [F.when(F.size(F.array_distinct("header")) < F.size("header"), F.lit("duplicate header"))]
    faults += [F.when(place[n].isNull(), F.lit("none of " + ", ".join(wanted[n]))) for n in wanted if n not in optional]
    fault = F.coalesce(*faults)
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(" in "), F.col("file"))).cast("array<string>")).otherwise(F.col("lines"))
    keep = [c for c in files.columns if c not in ("path", "rank", "sha256", "bytes", "header", "lines", "status", "expected_sha256", "file")]
    rows = files.where(F.size("lines") > 0).select("*", F.posexplode(checked).alias("_at", "_line")).withColumn("_f", F.split("_line", delimiter))
    field = {n: F.nullif(F.trim(F.try_element_at("_f", at.cast("int"))), F.lit("")) for n, at in place.items()}
    return rows.select(*keep, F.col("path").alias("source_file"), *[c.alias(n) for n, c in field.items()],
                       (F.col("rank").cast("long") * (1 << 40) + F.col("_at")).alias("ingest_id"))


def with_status(files: DataFrame, checksums: DataFrame, on: list[str]) -> DataFrame:
    """Files with ``status`` OK, CHECKSUM_MISMATCH or EMPTY_CSV; ``checksums`` (on, expected_sha256) may lack some."""
    j = files.join(checksums.select(*on, "expected_sha256"), on, "left")
    wrong = F.col("expected_sha256").isNotNull() & (F.lower("expected_sha256") != F.col("sha256"))
    return j.withColumn("status", F.when(wrong, "CHECKSUM_MISMATCH").when(F.size("lines") == 0, "EMPTY_CSV").otherwise("OK"))


def audit(expected: DataFrame, checked: DataFrame, on: list[str]) -> DataFrame:
    """(on, file, data_rows, status) of every expected archive; one without a file is NOT_AVAILABLE."""
    found = checked.select(*on, "file", F.size("lines").cast("long").alias("data_rows"), "status")
    return expected.select(*on).join(found, on, "left").withColumn("status", F.coalesce("status", F.lit("NOT_AVAILABLE")))


def usable(checked: DataFrame) -> DataFrame:
    return checked.where("status = 'OK'")


def require_files(files: DataFrame, path: str) -> DataFrame:
    if files.limit(1).count() == 0:
        raise DataError(f"no files: {path}")
    return files


def folder_column(name: str) -> Column:
    """The value of a ``name=value`` folder as text, whatever type Spark took it for."""
    return F.url_decode(F.regexp_extract("source_file", f"/{name}=([^/]*)/", 1))
