import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers_bars import BARS, T0, bar_frame, candles
from tickloom.functions import scalars as sc
from tickloom.operators import carry, grid, joins, quality as q, resample as rs
from tickloom.operators.sequence import block_no, int_div

RAW = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, ingest_id bigint"


def raw(spark, rows):
    base = {"open": 100.0, "high": 101.0, "low": 99.0, "close": 100.0, "volume": 1.0}
    out = []
    for i, (minute, change) in enumerate(rows):
        v = {**base, **change}
        out.append(("X", T0 + dt.timedelta(minutes=minute), v["open"], v["high"], v["low"], v["close"], v["volume"], i))
    return spark.createDataFrame(out, RAW)


def test_row_issues(spark):
    nan = float("nan")
    df = raw(spark, [(0, {"open": nan}), (15, {"close": None}), (30, {"high": 95.0}), (45, {"close": 0.0, "low": -1.0}),
                     (60, {"volume": -1.0}), (60, {}), (50, {})])
    got = {(r.ingest_id, r.severity, r.type, r.field) for r in q.row_issues(df).collect()}
    assert got == {
        (0, "error", "nan", "open"), (1, "error", "nan", "close"), (1, "error", "non-positive-close", None),
        (2, "error", "ohlc", None), (3, "error", "non-positive-close", None),
        (4, "error", "negative-volume", None), (5, "error", "out-of-order", None),
        (5, "warning", "duplicate-timestamp", None), (6, "error", "out-of-order", None)}
    s = q.quality_summary(df).collect()[0]
    assert (s.total, s.errors, s.valid, s.nan_count, s.duplicate_count) == (7, 8, -1, 2, 1)


def test_gaps_dedupe_continuity(spark):
    df = raw(spark, [(0, {}), (15, {}), (30, {}), (45, {}), (45, {"close": 7.0}), (150, {})])
    g = q.gap_warnings(df).collect()
    assert [(r.ingest_id, r.delta_ms) for r in g] == [(5, 105 * 60_000)]
    kept = q.dedupe_first(df).filter(F.col("ts") == T0 + dt.timedelta(minutes=45)).collect()
    assert [r.close for r in kept] == [100.0]
    c = q.continuity(df, 900_000).collect()[0]
    assert (c.expected_bars, c.actual_bars, c.duplicate_bars, c.missing_bars, c.gap_count, c.largest_gap_ms) == (
        11, 6, 1, 6, 2, 105 * 60_000)
    assert sorted((r.delta_ms, r.missing) for r in q.gap_list(df, 900_000).collect()) == [(0, 0), (105 * 60_000, 6)]
    assert q.interval_estimate(df).collect()[0].interval_ms == 900_000


def funding(spark, times, rates=None):
    rates = rates or [0.0001] * len(times)
    return spark.createDataFrame([("X", t, r, i) for i, (t, r) in enumerate(zip(times, rates))],
                                 "symbol string, funding_time bigint, funding_rate double, ingest_id bigint")


def test_carry_integrity(spark):
    ok = q.carry_integrity(funding(spark, [100, 200, 300], [0.1, -0.1, 0.0])).collect()[0]
    assert (ok.status, ok.positive_events, ok.negative_events, ok.zero_events) == ("OK", 1, 1, 1)
    dup = q.carry_integrity(funding(spark, [100, 100])).collect()[0]
    assert dup.duplicate_count == 1 and dup.status == "FUNDING DATA INCOMPLETE"
    assert q.carry_integrity(funding(spark, [200, 100])).collect()[0].out_of_order
    late = q.carry_integrity(funding(spark, [100, 1_767_225_600_000])).collect()[0]
    assert late.status == "HOLDOUT VIOLATION" and late.positive_events == 0
    both = q.with_expected_keys(q.carry_integrity(funding(spark, [100])),
                                spark.createDataFrame([("X",), ("Y",)], "symbol string")).collect()
    assert {r.symbol: r.status for r in both} == {"X": "OK", "Y": "FUNDING DATA INCOMPLETE"}


def test_guards(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1),), (dt.datetime(2025, 1, 1),)], "ts timestamp")
    with pytest.raises(q.DataError, match="1 rows"):
        q.require_no_holdout(df)
    assert q.holdout_locked(df, "emaTrendFilter") and not q.holdout_locked(df, "emaTrendFilter", unlocked=True)
    assert not q.holdout_locked(df, "emaCrossover")
    assert q.require_no_holdout(df.filter("ts < '2026-01-01'")).count() == 1


def test_resample_exact(spark):
    rows = [("X", T0 + dt.timedelta(minutes=15 * i), c, h, c - 0.5, c, 1000.0 + i, i)
            for i, (c, h) in enumerate([(10.0, 10.0), (12.0, 13.0), (9.0, 9.5), (11.0, 11.5), (8.0, 8.0)])]
    bars = spark.createDataFrame(rows, BARS)
    (r,) = rs.resample(bars, "1h").collect()
    assert (r.ts, r.open, r.high, r.low, r.close, r.volume) == (T0, 10, 13, 8.5, 11, 4006)
    (w,) = rs.incomplete_windows(bars, "1h").collect()
    assert (w["count"], w.expected) == (1, 4)
    with pytest.raises(ValueError):
        rs.resample(bars, 1_000_000)


def test_train_test_split_is_half_open(spark):
    n = 80_000
    bars = spark.range(n).select((F.lit("2023-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int") * 15))
                                 .alias("ts"))
    s = grid.split_train_test(bars, ("2023-01-01", "2024-01-01"), ("2024-01-01", "2025-01-01"))
    got = {r.segment: r["count"] for r in s.groupBy("segment").count().collect()}
    assert got == {"train": 35_040, "test": 80_000 - 35_040 if n < 35_040 + 35_136 else 35_136}
    with pytest.raises(ValueError, match="overlap"):
        grid.split_train_test(bars, ("2023-01-01", "2024-01-02"), ("2024-01-01", "2025-01-01"))
    with pytest.raises(ValueError, match="test"):
        grid.require_segments(s.filter("segment = 'train'"))


def marks(spark, rows):
    return spark.createDataFrame([("X", *r) for r in rows], "symbol string, open_time bigint, open double, close double")


@pytest.mark.parametrize("bars, t, price, status", [
    ([(1000, 100.0, 101.0), (2000, 200.0, 201.0)], 2000, 200, "EXACT_OPEN"),
    ([(1000, 100.0, 101.0), (2000, 200.0, 201.0)], 1500, 101, "PREVIOUS_FALLBACK"),
    ([(1000, 100.0, 101.0)], 301_000, 101, "PREVIOUS_FALLBACK"),
    ([(1000, 100.0, 101.0)], 301_001, None, "TOO_STALE"),
    ([(5000, 100.0, 101.0)], 1000, None, "NO_DATA")])
def test_mark_price_boundaries(spark, bars, t, price, status):
    ev = spark.createDataFrame([("X", t)], "symbol string, t bigint")
    (r,) = joins.mark_price(ev, marks(spark, bars), ["symbol"], "t", "open_time", lambda c: int_div(c, 700),
                            millis=lambda c: c).collect()
    assert (r.mark_price, r.mark_status) == (price, status)


def test_asof_against_brute_force(spark):
    left = [(k, t) for k in ("a", "b") for t in range(0, 300, 7)]
    right = [(k, t, t * 2) for k in ("a",) for t in range(20, 200, 13)]
    lf = spark.createDataFrame(left, "k string, t bigint")
    rt = spark.createDataFrame(right, "k string, u bigint, v bigint")
    for strict in (False, True):
        out = joins.asof_join(lf, rt, ["k"], "t", "u", ["v"], lambda c: int_div(c, 10), strict).collect()
        assert len(out) == len(left)
        for r in out:
            ok = [u for k, u, _ in right if k == r.k and (u < r.t if strict else u <= r.t)]
            assert (r.match.at if r.match else None) == (max(ok) if ok else None)


def flows(spark, events, entry=0, exit_=1000, qty=2.0):
    t = spark.createDataFrame([("X", "t1", entry, exit_, qty, 5.0)],
                              "symbol string, id string, entry_time bigint, exit_time bigint, quantity double, net_pnl double")
    e = spark.createDataFrame([("X", *e) for e in events],
                              "symbol string, event_time bigint, rate double, mark_price double")
    f = carry.cashflows(t, e, ["symbol"], lambda c: block_no(c, 300))
    return carry.enrich(t, f.select("id", "cashflow"), ["id"]).collect()[0]


def test_carry_cashflows(spark):
    assert flows(spark, [(500, 0.001, 100.0)]).net_carry == pytest.approx(-0.20)
    assert flows(spark, [(500, -0.001, 100.0)]).carry_received == pytest.approx(0.20)
    none = flows(spark, [(500, 0.0, 100.0), (500, float("nan"), 100.0), (500, 0.001, 0.0)])
    assert none.carry_events == 0 and none.net_pnl_after == 5.0
    r = flows(spark, [(100, 0.0001, 100.0), (500, 0.0002, 100.0), (900, -0.0001, 100.0)])
    assert (r.carry_events, r.carry_paid, r.carry_received, r.net_carry) == pytest.approx((3, 0.06, 0.02, -0.04))
    edge = flows(spark, [(100, 0.1, 1.0), (200, 0.1, 1.0), (300, 0.1, 1.0), (50, 0.1, 1.0)], 100, 300)
    assert edge.carry_events == 1


def test_scalars(spark):
    assert sc.interval_millis("15m") == 900_000 and sc.interval_millis("90") == 5_400_000
    assert sc.interval_millis(250) == 250 and sc.periods_per_year(3_600_000) == 8760
    with pytest.raises(ValueError):
        sc.interval_millis("3y")
    df = spark.createDataFrame([("1h",), ("2W",), ("x",)], "t string").select(sc.interval_millis_col(F.col("t")))
    assert [r[0] for r in df.collect()] == [3_600_000, 1_209_600_000, None]
    row = spark.range(1).select(sc.half_up(F.lit(-2.5)), sc.interval_label(F.lit(3_600_000)),
                                sc.interval_label(F.lit(1500))).collect()[0]
    assert list(row) == [-2, "60m", "2s"]


def test_bars_helper(spark):
    assert bar_frame(spark, candles([1, 2])).count() == 2
