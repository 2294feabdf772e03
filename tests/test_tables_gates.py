import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from helpers_bars import T0
from tickloom.operators import gates, metrics as mt, reconcile as rc


def test_reconcile_scenario(spark):
    local = spark.createDataFrame(
        [("SOL", "LONG", 100.0, 1.0, 5.0, None, None), ("BTC", "LONG", 50_000.0, 0.01, 5.0, 48_000.0, None)],
        "symbol string, side string, entry_price double, quantity double, leverage double, stop_price double, profit_price double")
    remote = spark.createDataFrame(
        [("BTC", "0.02", "50000", "5"), ("ETH", "-0.5", "3000", "3"), ("XRP", "0", "1", "1")],
        "symbol string, positionAmt string, entryPrice string, leverage string")
    orders = spark.createDataFrame(
        [("BTC", "9000", "STOP_MARKET", "SELL", "CANCELED", "49500", "0", 0),
         ("BTC", "9001", "STOP_MARKET", "SELL", "NEW", "49000", "0", 1),
         ("BTC", "9003", "STOP", "SELL", "NEW", "48000", "0", 3),
         ("BTC", "9002", "TAKE_PROFIT_MARKET", "SELL", "PARTIALLY_FILLED", "52000", "0", 2),
         ("ETH", "9004", "STOP_MARKET", "SELL", "NEW", "3100", "0", 4)],
        "symbol string, order_id string, type string, side string, status string, stop_price string, price string, arrival bigint")
    got = {r.symbol: r for r in rc.reconcile_positions(local, remote, orders).collect()}
    assert set(got) == {"SOL", "BTC", "ETH"} and got["SOL"].action == "remove"
    b = got["BTC"]
    assert (b.action, b.stop_order_id, b.stop_price, b.profit_order_id, b.profit_price, b.quantity, b.repair_stop) == (
        "keep", "9001", 49_000, "9002", 52_000, 0.02, None)
    e = got["ETH"]
    assert (e.side, e.action, e.stop_order_id, e.repair_stop) == ("SHORT", "add", None, 3060.0)
    bare = rc.reconcile_positions(local.filter("symbol = 'BTC'").withColumn("stop_price", F.lit(None).cast("double")),
                                  remote.filter("symbol = 'BTC'"), orders.limit(0)).collect()[0]
    assert bare.repair_stop == 49_000
    pending = spark.createDataFrame([("BTC",)], "symbol string")
    assert "BTC" not in {r.symbol for r in rc.reconcile_positions(local, remote, orders, pending=pending).collect()}


def test_settlement_scenario(spark):
    messages = [
        {"i": 1, "s": "BTC", "X": "FILLED", "o": "MARKET", "ap": "50000", "z": "0.01", "n": "1.2", "N": "USDT"},
        {"orderId": 1, "symbol": "BTC", "orderStatus": "FILLED", "type": "MARKET", "avgPrice": "50000", "commission": "1.2"},
        {"i": 5002, "s": "BTC", "S": "SELL", "X": "FILLED", "o": "MARKET", "rp": "0.5", "R": True},
        {"o": {"i": 5002, "s": "BTC", "S": "SELL", "X": "FILLED", "o": "MARKET", "rp": "0.5", "n": "0.8", "N": "USDT"}},
        {"i": 7, "s": "BTC", "X": "NEW", "o": "STOP_MARKET"},
    ]
    m = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(messages)], "seq bigint, body string")
    f = rc.normalise_fills(m)
    rows = f.orderBy("seq").collect()
    assert [r.is_close for r in rows] == [False, False, True, True]
    assert {r.order_type for r in rows} == {"MARKET"} and rows[3].side == "SELL"
    s = rc.settle(f.withColumns({"account": F.lit("A"), "gross_pnl": F.col("realised")}), ["account"]).collect()[0]
    assert (s.trade_count, s.winning_trades) == (1, 0)
    assert (s.gross_pnl, s.total_commission, s.realised_pnl) == pytest.approx((0.5, 2.0, -1.5))
    assert 1000 + s.realised_pnl == pytest.approx(998.5)
    day = rc.daily_stats(
        f.withColumns({"account": F.lit("A"), "gross_pnl": F.col("realised"), "ts": F.lit(T0).cast("timestamp")}),
        spark.createDataFrame([("A", T0.date(), 1000.0)], "account string, day date, start_balance double"),
        ["account"]).collect()[0]
    assert day.current_balance == pytest.approx(998.5)


STATE = {"paused": False, "breaker": False, "pending": False, "cooling_down": False, "loss_cap": False, "slots_used": 0,
         "has_position": False, "balance": 1000.0, "margin_used": 0.0, "lot_step": 0.001, "tick": 0.01}
LIMITS = {"size_pct": 10, "leverage": 5, "max_notional": 0, "max_positions": 3, "stop_pct": 2, "profit_pct": 4}


@pytest.mark.parametrize("signal, state, limits, reason", [
    (("SHORT", 50_000.0), {"balance": 100_000.0}, {}, None),
    (("LONG", 100.0), {"paused": True}, {}, "trading paused"),
    (("CLOSE", 100.0), {"paused": True, "breaker": True, "has_position": True}, {}, None),
    (("CLOSE", 100.0), {}, {}, "no position to close"),
    (("LONG", 100.0), {"breaker": True, "pending": True}, {}, "circuit breaker tripped"),
    (("LONG", 100.0), {"cooling_down": True, "loss_cap": True}, {}, "signal cooldown"),
    (("LONG", 100.0), {"slots_used": 3}, {}, "max positions"),
    (("LONG", 100.0), {"has_position": True}, {}, "already has position"),
    (("LONG", 0.0), {}, {}, "invalid balance/price"),
    (("LONG", 100.0), {"balance": 5.0}, {}, "notional too small"),
    (("LONG", 1e7), {}, {}, "quantity zero after rounding"),
    (("LONG", 100.0), {"margin_used": 450.0}, {}, "margin ratio too low"),
    (("LONG", 100.0), {}, {"profit_pct": 1}, "reward below risk"),
    (("HOLD", 100.0), {}, {}, "unsupported direction")])
def test_screening(spark, signal, state, limits, reason):
    st = {**STATE, **state}
    s = spark.createDataFrame([("X", *signal)], "symbol string, direction string, price double")
    frame = spark.createDataFrame([("X", *st.values())],
                                  "symbol string, paused boolean, breaker boolean, pending boolean, cooling_down boolean, "
                                  "loss_cap boolean, slots_used int, has_position boolean, balance double, "
                                  "margin_used double, lot_step double, tick double")
    r = rc.screen_entries(s, frame, {**LIMITS, **limits}, ["symbol"]).collect()[0]
    assert r.reject_reason == reason
    if signal[0] == "SHORT":
        assert (r.stop, r.target, r.quantity) == (51_000, 48_000, 1.0)


@pytest.mark.parametrize("mark, reason", [
    (None, None), (0.0, None), (100.0, None), (600.0, "margin ratio too low")])
def test_screening_values_the_order_at_the_mark(spark, mark, reason):
    """500 of margin on a balance of 1,000 is the least ratio; the order's own margin counts at the last price."""
    st = {**STATE, "balance": 1000.0, "margin_used": 300.0}
    s = spark.createDataFrame([("X", "LONG", 100.0, mark)], "symbol string, direction string, price double, mark double")
    frame = spark.createDataFrame([("X", *st.values())],
                                  "symbol string, paused boolean, breaker boolean, pending boolean, cooling_down boolean, "
                                  "loss_cap boolean, slots_used int, has_position boolean, balance double, "
                                  "margin_used double, lot_step double, tick double")
    assert rc.screen_entries(s, frame, LIMITS, ["symbol"]).collect()[0].reject_reason == reason


def test_carry_gates(spark):
    good = (0.5, 0.4, 1.3, 1.0, 0.0, 1.0)
    rows = [("ok", "a", *good), ("ok", "b", *good), ("edge", "a", *good), ("edge", "b", 0.5, -0.1, 1.3, 1.0, 0.0, 1.0),
            ("stress", "a", *good[:4], -0.1, 0.9), ("none", "a", *good), ("none", "b", *[None] * 6), ("weeks", "a", *good)]
    assets = spark.createDataFrame(rows, "strategy string, symbol string, before_exp double, net_exp_pct double, "
                                   "net_profit_factor double, sharpe double, stress_exp double, stress_pf double")
    weeks = spark.createDataFrame([(s, e) for s in ("ok", "edge", "stress", "none") for e in (1.0, 1.0, -1.0)], "strategy string, net_exp double")
    got = {r.strategy: (r.base_pass, r.stress_pass, r.edge_destroyed, r.year_pass, r.verdict)
           for r in gates.carry_gates(assets, weeks, ["strategy"]).collect()}
    assert got == {"ok": (True, True, False, True, "SURVIVED"), "edge": (False, True, True, True, "FAILED"),
                   "stress": (True, False, False, True, "FAILED"), "none": (False, False, False, True, "FAILED"),
                   "weeks": (True, True, False, False, "FAILED")}


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).collect()[0].x


def test_gates(spark):
    f = F.lit
    assert one(spark, gates.asset_gate(f(0.5), f(1.4), f(1.0)))
    assert not one(spark, gates.asset_gate(f(0.5), f(1.02), f(1.0)))
    assert not one(spark, gates.asset_gate(f(0.5), f(None).cast("double"), f(1.0)))
    assert one(spark, gates.stress_ok(f(0.0), f(1.0)))
    assert one(spark, gates.cost_class(f(0.5), f(0.2), f(1.2), f(0.0), f(1.0))) == "COST ROBUST"
    assert one(spark, gates.cost_class(f(0.5), f(0.2), f(1.2), f(-0.1), f(0.9))) == "COST SENSITIVE"
    assert one(spark, gates.cost_class(f(0.5), f(-0.2), f(0.9), f(-0.1), f(0.9))) == "EDGE FAILS REALISTIC COST"
    assert one(spark, gates.cost_class(f(-0.5), f(-0.6), f(0.9), f(-0.7), f(0.9))) == "NO EDGE"
    assert one(spark, gates.grade(f(29), f(1.0), f(1.0), f(1.0), f(1.0))) == "A"
    assert one(spark, gates.grade(f(30), f(1.0), f(1.0), f(-1.0), f(1.0))) == "C"
    assert one(spark, gates.screening(f(40), f(1.0), f(1.5), f(0.5), f(True))) == "PASS SCREENING"
    assert one(spark, gates.pooled_final(f(49), f(1.0), f(2.0), f(1.0), f(4), f(1.0), f(2.0))) == "INCONCLUSIVE"
    assert one(spark, gates.edge_destroyed(f(0.1), f(0.0)))
    years = spark.createDataFrame([("a", e) for e in [1.0] * 6 + [-1.0] * 4] + [("b", e) for e in [1.0] * 3 + [-1.0] * 7],
                                  "k string, net_exp double")
    share = {r.k: r.s for r in years.groupBy("k").agg(gates.year_share().alias("s")).collect()}
    assert share["a"] >= 0.6 > share["b"]
    v = spark.createDataFrame([("m", x) for x in (-0.74, -0.75, 0.35, -0.64)] + [("s", -1.0), ("s", -2.0)],
                              "k string, net_exp double")
    got = {r.k: r.x for r in v.groupBy("k").agg(gates.regime_check().alias("x")).collect()}
    assert got == {"m": "mixed (not systematic)", "s": "SYSTEMATIC 2025 REGIME FAILURE"}


def test_concentration(spark):
    y = spark.createDataFrame([("a", 600.0), ("a", 300.0), ("a", -50.0), ("b", 400.0), ("b", 350.0), ("b", 250.0), ("c", -1.0)],
                              "k string, net_pnl double")
    got = {r.k: r for r in mt.year_concentration(y, ["k"]).collect()}
    assert got["a"].concentration == pytest.approx(2 / 3) and got["a"].concentrated
    assert got["b"].concentration == 0.4 and not got["b"].concentrated
    assert got["c"].concentration is None and not got["c"].concentrated


def test_upsert_and_unrealised(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "k string, p double, oid string")
    new = spark.createDataFrame([("a", None, None), ("c", 3.0, "z")], "k string, p double, oid string")
    got = {r.k: (r.p, r.oid) for r in rc.upsert(old, new, ["k"], ("oid",)).collect()}
    assert got == {"a": (1.0, None), "b": (2.0, "y"), "c": (3.0, "z")}
    p = spark.createDataFrame([("X", "SHORT", 100.0, 2.0), ("Y", "LONG", 50.0, 1.0)],
                              "symbol string, side string, entry_price double, quantity double")
    last = spark.createDataFrame([("X", 90.0, dt.datetime(2024, 1, 1))], "symbol string, price double, ts timestamp")
    assert {r.symbol: r.unrealised_pnl for r in rc.unrealised(p, last).collect()} == {"X": 20.0, "Y": 0.0}
