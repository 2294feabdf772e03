"""Scalar column helpers shared by all operators."""
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds per interval unit.
UNIT_MILLIS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
YEAR_MILLIS = 365 * 86_400_000


def interval_millis(label: str | int) -> int:
    """'15m', '1h', '1d', '1w' or a bare number of minutes; an int is milliseconds already."""
    if isinstance(label, int):
        return label
    found = re.fullmatch(r"(\d+)\s*([mhdw]?)", str(label).strip(), re.IGNORECASE)
    if not found:
        raise ValueError(f"cannot parse interval {label!r}")
    return int(found[1]) * UNIT_MILLIS[(found[2] or "m").lower()]


def interval_millis_col(label: Column) -> Column:
    """Column form of ``interval_millis`` for string labels; NULL when it cannot be parsed."""
    text = F.lower(F.trim(label))
    pattern = r"^(\d+)\s*([mhdw]?)$"
    unit = F.create_map(*[F.lit(x) for kv in {**UNIT_MILLIS, "": 60_000}.items() for x in kv])
    number = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    return F.when(text.rlike(pattern), number * unit[F.regexp_extract(text, pattern, 2)])


def interval_label(millis: Column) -> Column:
    """'<n>m' for whole minutes, else rounded seconds '<n>s'; 'N/A' for NULL or 0."""
    minutes = (millis / 60_000).cast("bigint").cast("string")
    seconds = half_up(millis / 1000).cast("string")
    return (F.when(millis.isNull() | (millis == 0), "N/A")
            .when(millis % 60_000 == 0, F.concat(minutes, F.lit("m")))
            .otherwise(F.concat(seconds, F.lit("s"))))


def periods_per_year(millis: int) -> float | None:
    return YEAR_MILLIS / millis if millis > 0 else None


def finite(value: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def half_up(value: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(value + F.lit(0.5))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NULL when the denominator is NULL or 0."""
    return F.when(denominator != 0, numerator / denominator)


def epoch_millis(ts: str | Column) -> Column:
    return F.unix_millis(F.col(ts) if isinstance(ts, str) else ts)


def utc_year(ts: str | Column) -> Column:
    return F.year(F.col(ts) if isinstance(ts, str) else ts)


def sample_label(count: Column) -> Column:
    return (F.when(count < 30, "VERY LOW SAMPLE SIZE")
            .when(count <= 100, "LOW SAMPLE SIZE").otherwise("OK"))
