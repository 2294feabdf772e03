"""Checks of bar and carry tables: issue lists, summaries, continuity, guards."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import epoch_millis, finite, half_up
from tickloom.operators.joins import keep_first, lookup
from tickloom.operators.quantiles import upper_median
from tickloom.operators.sequence import BLOCK, block_no, scan

FIELDS = ("open", "high", "low", "close", "volume")
# Fixed values.
GAP_FACTOR = 5
HOLDOUT_START = "2026-01-01 00:00:00"


class DataError(ValueError):
    pass


def _with_previous(bars: DataFrame, keys: list[str], ingest: str) -> DataFrame:
    """Time of the row before (``_prev``) and of the last row that has one (``_seen``)."""
    d = bars.withColumns({"_row": F.struct(F.col("ts").alias("t")), "_blk": block_no(F.col(ingest), BLOCK)})
    d = scan(d, keys, [ingest], "_blk", {"_seen": ("ts", "last"), "_before": ("_row", "last")}, inclusive=False)
    return d.withColumn("_prev", F.col("_before.t")).drop("_row", "_before", "_blk")


def row_issues(bars: DataFrame, keys=("symbol",), ingest: str = "ingest_id") -> DataFrame:
    """Long table of errors and warnings, one line per finding.

    ``ingest`` is the unique arrival number; order checks run in that order. NULL or NaN
    numbers are one finding per field. Columns: keys, ingest, severity, type, field, message.
    """
    keys = list(keys)
    d = bars.withColumns({f: F.when(finite(F.col(f)), F.col(f)) for f in FIELDS})
    d = _with_previous(d, keys, ingest)
    firsts = d.filter("ts is not null").groupBy(*keys, "ts").agg(
        F.min(ingest).alias("_first"), F.count(F.lit(1)).alias("_same")).filter("_same > 1").drop("_same")
    # Repeats of one time may be many: spread them, and copy the few firsts.
    d = lookup(d, firsts, [*keys, "ts"], spread=[ingest])

    def issue(cond: Column, severity: str, kind: str, message: str, field: str | None = None):
        return F.when(cond, F.struct(
            F.lit(severity).alias("severity"), F.lit(kind).alias("type"),
            F.lit(field).cast("string").alias("field"), F.lit(message).alias("message")))

    o, h, low, c, v = (F.col(f) for f in FIELDS)
    upside = F.coalesce((h < o) | (h < c), F.lit(False))
    found = [issue(F.col(f).isNull(), "error", "nan", f"{f} is not a finite number", f) for f in FIELDS]
    found += [
        issue(c.isNull() | (c <= 0), "error", "non-positive-close", "close must be > 0"),
        F.coalesce(
            issue(h < low, "error", "ohlc", "high < low"),
            issue(upside, "error", "ohlc", "high must be >= open/close"),
            issue((low > o) | (low > c), "error", "ohlc", "low must be <= open/close")),
        issue(v < 0, "error", "negative-volume", "volume must be >= 0"),
        issue(F.col("ts") <= F.col("_seen"), "error", "out-of-order",
              "timestamp is not strictly greater than previous"),
        issue(F.col(ingest) > F.col("_first"), "warning", "duplicate-timestamp", "duplicate timestamp"),
    ]
    return d.select(*keys, ingest, F.explode(F.array_compact(F.array(*found))).alias("_i")).select(
        *keys, ingest, "_i.*")


def deltas(bars: DataFrame, keys=("symbol",), ingest: str = "ingest_id") -> DataFrame:
    """Milliseconds since the previous row in arrival order."""
    keys = list(keys)
    d = _with_previous(bars.select(*keys, "ts", ingest), keys, ingest)
    return d.withColumn("delta_ms", epoch_millis("ts") - epoch_millis("_prev")).drop("_prev", "_seen")


def gap_warnings(bars: DataFrame, keys=("symbol",), ingest: str = "ingest_id") -> DataFrame:
    """Rows later than their predecessor by more than five (upper) median steps.

    A key with fewer than three rows has no median and no warnings.
    """
    keys = list(keys)
    d = deltas(bars, keys, ingest)
    med = upper_median(d, keys, "delta_ms", "median_interval_ms")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows >= 3").drop("_rows")
    limits = med.join(n, keys)
    return lookup(d, limits, keys, "inner", [ingest]).filter(
        F.col("delta_ms") > F.col("median_interval_ms") * GAP_FACTOR).select(
        *keys, ingest, "ts", "delta_ms", F.col("median_interval_ms").cast("bigint").alias("median_interval_ms"))


def quality_summary(bars: DataFrame, keys=("symbol",), ingest: str = "ingest_id") -> DataFrame:
    """One row per key: counts per issue type, median step, gaps. ``valid`` is rows minus
    errors (a row can have several), as a report of the whole series."""
    keys = list(keys)
    t = F.col("type")
    issues = row_issues(bars, keys, ingest).groupBy(*keys).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(t == "nan").alias("nan_count"), F.count_if(t == "ohlc").alias("invalid_ohlc_count"),
        F.count_if(t == "non-positive-close").alias("non_positive_close_count"),
        F.count_if(t == "duplicate-timestamp").alias("duplicate_count"))
    total = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    gaps = gap_warnings(bars, keys, ingest).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("gap_count"), F.max("delta_ms").alias("largest_gap_ms"))
    med = upper_median(deltas(bars, keys, ingest), keys, "delta_ms", "median_interval_ms")
    out = total.join(issues, keys, "left").join(gaps, keys, "left").join(med, keys, "left")
    counts = ["errors", "nan_count", "invalid_ohlc_count", "non_positive_close_count", "duplicate_count",
              "gap_count"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return out.select(*keys, "total", (F.col("total") - F.col("errors")).alias("valid"), *counts,
                      F.when(F.col("total") >= 3, F.col("median_interval_ms").cast("bigint"))
                      .alias("median_interval_ms"), "largest_gap_ms")


def dedupe_first(bars: DataFrame, keys=("symbol",), ingest: str = "ingest_id") -> DataFrame:
    """First arrival per key and time."""
    return keep_first(bars, [*keys, "ts"], ingest)


def _steps(bars: DataFrame, keys: list[str], interval_ms: int) -> DataFrame:
    step = (BLOCK * interval_ms)
    t = bars.select(*keys, epoch_millis("ts").alias("_t")).groupBy(*keys, "_t").agg(
        F.count(F.lit(1)).alias("_n"))
    t = t.withColumn("_blk", block_no(F.floor(F.col("_t") / step)))
    t = scan(t, keys, ["_t"], "_blk", {"_prev": ("_t", "last")}, inclusive=False)
    return t.withColumn("delta_ms", F.col("_t") - F.col("_prev"))


def continuity(bars: DataFrame, interval_ms: int, keys=("symbol",)) -> DataFrame:
    """Expected and actual bars, missing bars, gaps and duplicates per key (times ascending).

    Every step other than the interval is a gap, a repeated time included.
    """
    keys = list(keys)
    d = F.col("delta_ms")
    gap = d.isNotNull() & (d != interval_ms)
    missing = F.when(gap, F.greatest(half_up(d / interval_ms) - 1, F.lit(0)))
    repeats = F.col("_n") - 1
    g = _steps(bars, keys, interval_ms).groupBy(*keys).agg(
        F.sum("_n").alias("actual_bars"), F.sum(repeats).alias("duplicate_bars"),
        F.count(F.lit(1)).alias("_unique"), F.coalesce(F.sum(missing), F.lit(0)).alias("_missing"),
        (F.count_if(gap) + F.sum(repeats)).alias("gap_count"),
        F.coalesce(F.max(F.when(gap, d)), F.lit(0)).alias("largest_gap_ms"),
        F.min("_t").alias("first_ms"), F.max("_t").alias("last_ms"))
    expected = F.floor((F.col("last_ms") - F.col("first_ms")) / interval_ms) + 1
    return g.select(*keys, expected.alias("expected_bars"), "actual_bars", "duplicate_bars",
                    F.greatest("_missing", expected - F.col("_unique")).alias("missing_bars"),
                    "gap_count", "largest_gap_ms", "first_ms", "last_ms")


def gap_list(bars: DataFrame, interval_ms: int, keys=("symbol",)) -> DataFrame:
    """Each step that is not the interval: where, how long, bars missing."""
    keys = list(keys)
    d = F.col("delta_ms")
    s = _steps(bars, keys, interval_ms)
    forward = s.filter(d.isNotNull() & (d != interval_ms)).select(*keys, F.col("_t").alias("at_ms"), "delta_ms")
    again = s.filter("_n > 1").select(
        *keys, F.col("_t").alias("at_ms"),
        F.explode(F.array_repeat(F.lit(0).cast("bigint"), (F.col("_n") - 1).cast("int"))).alias("delta_ms"))
    return forward.unionByName(again).withColumn(
        "missing", F.greatest(half_up(d / interval_ms) - 1, F.lit(0)))


def interval_estimate(bars: DataFrame, keys=("symbol",), ingest: str = "ingest_id") -> DataFrame:
    """Upper median of the positive steps per key."""
    d = deltas(bars, keys, ingest).filter("delta_ms > 0")
    return upper_median(d, list(keys), "delta_ms", "interval_ms").withColumn(
        "interval_ms", F.col("interval_ms").cast("bigint"))


def carry_integrity(events: DataFrame, keys=("symbol",), time: str = "funding_time", rate: str = "funding_rate",
                    ingest: str = "ingest_id", holdout: str = HOLDOUT_START) -> DataFrame:
    """Order, duplicates and rates of carry events (times in epoch ms), one row per key.

    Rows reaching the holdout only report the violation.
    """
    keys = list(keys)
    d = events.select(*keys, time, rate, ingest)
    d = d.withColumns({"_t": F.col(time), "_blk": block_no(F.col(ingest), BLOCK)})
    d = scan(d, keys, [ingest], "_blk", {"_prev": ("_t", "last")}, inclusive=False)
    r = F.col(rate)
    ok = finite(r)
    e = d.groupBy(*keys, time).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ingest).alias("_i0"), F.max(ingest).alias("_i1"),
        F.count_if(~ok).alias("_bad"), F.count_if(ok & (r > 0)).alias("_pos"),
        F.count_if(ok & (r < 0)).alias("_neg"), F.count_if(ok & (r == 0)).alias("_zero"),
        F.max(F.col(time) < F.col("_prev")).alias("_ooo"))
    t = F.col(time)
    g = e.groupBy(*keys).agg(
        F.min_by(time, "_i0").alias("first_time"), F.max_by(time, "_i1").alias("last_time"),
        F.sum("_n").alias("event_count"), F.sum(F.col("_n") - 1).alias("duplicate_count"),
        F.sum("_bad").alias("invalid_rate_count"),
        F.coalesce(F.sum(F.when(t.isNull() | (t <= 0), F.col("_n"))), F.lit(0)).alias("invalid_time_count"),
        F.sum("_pos").alias("positive_events"), F.sum("_neg").alias("negative_events"),
        F.sum("_zero").alias("zero_events"), F.coalesce(F.max("_ooo"), F.lit(False)).alias("out_of_order"))
    late = F.col("last_time") >= F.unix_millis(F.lit(holdout).cast("timestamp"))
    counts = ["duplicate_count", "invalid_rate_count", "invalid_time_count", "positive_events",
              "negative_events", "zero_events"]
    g = g.withColumn("holdout_violation", F.coalesce(late, F.lit(False)))
    g = g.withColumns({c: F.when(F.col("holdout_violation"), F.lit(0)).otherwise(F.col(c)).cast("bigint")
                       for c in counts})
    g = g.withColumn("out_of_order", F.col("out_of_order") & ~F.col("holdout_violation"))
    year = holdout[:4]

    def some(c, text):
        return F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))

    issues = F.array_compact(F.array(
        F.when(F.col("holdout_violation"), f"funding events extend into {year}"),
        F.when(F.col("out_of_order"), "events not in ascending order"),
        some("duplicate_count", " duplicate timestamps"), some("invalid_rate_count", " invalid funding rates"),
        some("invalid_time_count", " invalid timestamps")))
    status = (F.when(F.col("holdout_violation"), "HOLDOUT VIOLATION")
              .when(F.size("issues") > 0, "FUNDING DATA INCOMPLETE").otherwise("OK"))
    return g.withColumn("issues", issues).withColumn("status", status)


def with_expected_keys(report: DataFrame, expected: DataFrame, keys=("symbol",)) -> DataFrame:
    """Add expected keys that have no events at all."""
    out = expected.select(*keys).join(report, list(keys), "left")
    none = F.col("event_count").isNull()
    return out.withColumns({
        "issues": F.when(none, F.array(F.lit("no events"))).otherwise(F.col("issues")),
        "status": F.when(none, "FUNDING DATA INCOMPLETE").otherwise(F.col("status")),
        "event_count": F.coalesce("event_count", F.lit(0))})


def holdout_integrity(bars: DataFrame, events: DataFrame, keys=("symbol",), interval_ms: int = 900_000
                      ) -> DataFrame:
    """Gaps (steps over 1.5 intervals), repeats and event provenance per key, PASS or FAIL."""
    keys = list(keys)
    s = _steps(bars, keys, interval_ms).groupBy(*keys).agg(
        F.sum("_n").alias("bars"), F.sum(F.col("_n") - 1).alias("duplicate_bars"),
        F.count_if(F.col("delta_ms") > 1.5 * interval_ms).alias("gaps"))
    fake = synthetic_source(F.col("source"))
    e = events.groupBy(*keys, "funding_time").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(fake).alias("_f")).groupBy(*keys).agg(
        F.sum("_n").alias("events"), F.sum(F.col("_n") - 1).alias("duplicate_events"),
        F.sum("_f").alias("synthetic_events"))
    out = s.join(e, keys, "full_outer")
    counts = ["bars", "duplicate_bars", "gaps", "events", "duplicate_events", "synthetic_events"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    clean = (F.col("gaps") == 0) & (F.col("duplicate_bars") == 0) & (F.col("duplicate_events") == 0) & (
        F.col("synthetic_events") == 0) & (F.col("bars") > 0)
    return out.select(*keys, *counts, (F.col("events") - F.col("synthetic_events")).alias("official_events"),
                      F.when(clean, "PASS").otherwise("FAIL").alias("status"))


def synthetic_source(source: Column) -> Column:
    return F.coalesce(F.lower(source).rlike("synthetic|mock|fixture"), F.lit(False))


def common_end(feeds: DataFrame, start: Column, keys=("symbol",), ts: str = "ts") -> DataFrame:
    """Last time all keys and feeds reach; no valid period when that is before ``start``."""
    last = feeds.groupBy(*keys).agg(F.max(ts).alias("_last")).agg(F.min("_last").alias("common_end"))
    return last.withColumn("valid_period", F.coalesce(F.col("common_end") >= start, F.lit(False)))


def run_warnings(trades: Column, bars: Column, carry_included: Column, forced_exit: Column,
                 gap_count: Column, missing_bars: Column, sharpe: Column, duplicates: Column,
                 large_gaps: Column, segment: Column | None = None) -> Column:
    """Array of warning texts for one run."""
    def text(*parts):
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    items = [
        F.when(trades < 30, text("sample size too small (", trades, " trades)")),
        F.when(~carry_included, "funding rate not included"),
        F.when(bars < 200, "insufficient trading history (bars < 200)"),
        F.when(forced_exit, "position force-exited at end of backtest (forced research exit at last close)"),
        F.when(gap_count > 0, text("DATA CONTINUITY WARNING: ", missing_bars, " missing bar(s) in ", gap_count,
                                   " gap(s); results NOT marked VALIDATED")),
        F.when(sharpe.isNull() & (trades >= 2),
               "sharpe not computable (insufficient or degenerate equity returns)"),
        F.when(duplicates > 0, text("data quality: ", duplicates, " duplicate timestamp(s) dropped")),
        F.when(large_gaps > 0, text("data quality: ", large_gaps, " large gap(s) in candles")),
    ]
    if segment is not None:
        items.insert(0, F.when(segment.isNotNull(), text("segment: ", segment)))
    return F.array_compact(F.array(*items))


def require_no_holdout(df: DataFrame, ts: str = "ts", holdout: str = HOLDOUT_START) -> DataFrame:
    """Raise when any row reaches the holdout, else hand the frame on."""
    n = df.filter(F.col(ts) >= F.lit(holdout).cast("timestamp")).count()
    if n:
        raise DataError(f"HOLDOUT VIOLATION: {n} rows at or after {holdout}")
    return df


def holdout_locked(df: DataFrame, strategy: str, unlocked: bool = False, test_end: str | None = None,
                   ts: str = "ts", holdout: str = HOLDOUT_START) -> bool:
    """Research rules may not see the holdout unless it is unlocked."""
    from tickloom.functions.signals import research_rules

    if strategy not in research_rules() or unlocked:
        return False
    if test_end is not None and test_end > holdout:
        return True
    return df.filter(F.col(ts) >= F.lit(holdout).cast("timestamp")).limit(1).count() > 0
