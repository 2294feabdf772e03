import math
import random

import pytest
from pyspark.sql import functions as F

from helpers_bars import T0, bar_frame, candles, lin
from reference_rules import flags, simulate
from tickloom.functions.signals import get_rule, list_rules, live_rules, signals
from tickloom.operators import grid, metrics as mt, positions as pos
from tickloom.operators.sequence import block_no

RUN = ["symbol", "strategy", "scenario", "size_pct"]
GOLDEN = {
    "flat": [100] * 120,
    "emaUpDown": [100] * 40 + lin(100, 130, 30) + lin(130, 100, 30),
    "emaDownUp": [100] * 40 + lin(100, 70, 30) + lin(70, 110, 30),
    "rsiUptrendPullbackRecovery": [100] * 70 + lin(100, 112, 25) + lin(112, 104, 8) + lin(104, 112, 12)
    + [112] * 10 + lin(112, 98, 20),
    "zigzag": [x for i in range(8) for x in lin(100, 115 if i % 2 else 85, 15)],
}


def random_walk(seed, n=700):
    rng = random.Random(seed)
    out, p = [], 100.0
    for _ in range(n):
        p *= math.exp(rng.gauss(0, 0.01))
        out.append(p)
    return out


@pytest.mark.parametrize("block", [64, 4096])
def test_rules_on_golden_and_random_paths(spark, block):
    paths = {**GOLDEN, "walk1": random_walk(1), "walk2": random_walk(2)}
    rules = ["emaCrossover", "rsiEma", "emaTrendFilter", "breakout24hTrend", "breakout24h1h", "breakout24h4h"]
    rows = {name: candles(xs, symbol=name) for name, xs in paths.items()}
    bars = bar_frame(spark, [r for rs in rows.values() for r in rs])
    got = {(r.symbol, r.strategy, r.ord): (r.set_long, r.reset)
           for r in signals(bars, rules, block=block).collect()}
    for name, rs in rows.items():
        for rule in rules:
            assert [got[name, rule, i] for i in range(len(rs))] == flags(rs, rule), (name, rule)


def test_rules_refuse_bars_of_another_length(spark):
    bars = bar_frame(spark, candles(GOLDEN["zigzag"]))
    with pytest.raises(ValueError, match="breakout24h1h"):
        signals(bars, ["emaCrossover", "breakout24h1h"], interval="15m")
    assert signals(bars, ["breakout24h4h"], interval=4 * 3_600_000).columns == signals(bars, ["breakout24h4h"]).columns


def held_actions(spark, xs, rule, **kw):
    h = pos.hold(signals(bar_frame(spark, candles(xs, **kw)), [rule]), ["symbol", "strategy"])
    return [(r.ord, "LONG" if r.up else "CLOSE") for r in h.filter("up or down").orderBy("ord").collect()]


def test_rsi_rule_exact_bars(spark):
    assert held_actions(spark, GOLDEN["rsiUptrendPullbackRecovery"], "rsiEma") == [(109, "LONG"), (126, "CLOSE")]


def test_breakout_excludes_the_current_high(spark):
    xs = [100] * 60 + lin(100, 150, 30)
    assert held_actions(spark, xs, "breakout24h4h", highs={60: 10_000.0})[0] == (60, "LONG")
    assert held_actions(spark, [100] * 120 + [105, 106, 107], "breakout24hTrend") == [(120, "LONG")]
    assert held_actions(spark, lin(100, 200, 120), "trendPullbackReclaim") == []


def test_no_look_ahead(spark):
    xs = random_walk(9, 300)
    base = held_actions(spark, xs, "emaCrossover")
    turn = base[3][0]
    changed = held_actions(spark, xs[:turn + 1] + [x * 3 for x in xs[turn + 1:]], "emaCrossover")
    assert changed[:4] == base[:4]


def test_registry():
    assert set(live_rules()) == {"emaCrossover", "rsiEma"} and len(list_rules()) == 10
    with pytest.raises(ValueError, match="unknown strategy"):
        get_rule("nope")


def ledger_of(spark, opens, closes, marks, cost, size=100.0, block=4096):
    rows = candles(closes, opens)
    flag = [(r[0], "rule", i // block, i, r[1], r[2], r[3], r[4], r[5], *(
        (rows[i + 1][1], rows[i + 1][2], rows[i + 1][3], rows[i + 1][4]) if i + 1 < len(rows) else (None,) * 4), *m)
        for i, (r, m) in enumerate(zip(rows, marks))]
    sig = spark.createDataFrame(flag, "symbol string, strategy string, _blk bigint, ord bigint, ts timestamp, "
                                "open double, high double, low double, close double, nxt_ts timestamp, "
                                "nxt_open double, nxt_high double, nxt_low double, set_long boolean, reset boolean")
    costs = pos.scenario_table(spark, {"C": cost}, (size,))
    trades = grid.run_ledger(sig, ["symbol", "strategy"], costs, block=block)
    eq = pos.equity_curve(bar_frame(spark, rows), trades, grid.run_list(costs, ["rule"]), ["symbol"],
                          ["strategy", "scenario", "size_pct"], block=block, bar_carry=cost.carry_rate > 0)
    return rows, trades, eq


COST = pos.CostModel(0.0004, 0.0002)


@pytest.mark.parametrize("exit_open, want", [
    (110, (109.978, 995.202799, 8.394882, 986.807916, 10986.807916)),
    (90, (89.982, -1003.198001, 7.595522, -1010.793523, 8989.206477))])
def test_hand_computed_ledger(spark, exit_open, want):
    opens = [100, 100, 110, exit_open]
    _, trades, eq = ledger_of(spark, opens, opens, [(True, False), (False, False), (False, True), (False, False)], COST)
    (t,) = trades.collect()
    assert t.entry_price == pytest.approx(100.02) and t.notional == pytest.approx(9996.001599, abs=1e-6)
    assert t.quantity == pytest.approx(99.940028, abs=1e-6)
    assert (t.exit_price, t.gross_pnl, t.fees, t.net_pnl) == pytest.approx(want[:4], abs=1e-6)
    assert t.holding_bars == 2 and not t.forced_exit
    assert eq.agg(F.max_by("equity", "ord")).collect()[0][0] == pytest.approx(want[4], abs=1e-6)


def test_forced_exit_and_exposure(spark):
    marks = [(True, False)] + [(False, False)] * 3
    _, trades, eq = ledger_of(spark, [100, 100, 105, 108], [100, 100, 105, 108], marks, pos.CostModel())
    (t,) = trades.collect()
    assert t.forced_exit and t.exit_price == 108
    assert eq.orderBy("ord").collect()[-1].equity == pytest.approx(10_800)
    marks = [(True, False), (False, False), (False, True), (False, False)]
    _, _, eq = ledger_of(spark, [100] * 4, [100] * 4, marks, pos.CostModel())
    assert eq.agg(F.avg(F.col("in_position").cast("int"))).collect()[0][0] == 0.5


def test_all_in_without_costs_is_buy_and_hold(spark):
    closes = [100 + (i % 7) / 2 for i in range(500)]
    rows, _, eq = ledger_of(spark, [100] * 500, closes, [(True, False)] + [(False, False)] * 499, pos.CostModel(), block=32)
    for r in eq.collect():
        assert r.equity == pytest.approx(10_000 if r.ord == 0 else closes[r.ord] * 100)


def test_toggle_and_random_marks_against_simulation(spark):
    rng = random.Random(4)
    for block in (16, 4096):
        closes = random_walk(rng.randrange(99), 400)
        opens = [closes[0]] + closes[:-1]
        marks = [(rng.random() < 0.1, rng.random() < 0.1) for _ in closes]
        rows, trades, eq = ledger_of(spark, opens, closes, marks, COST, 50.0, block)
        want, curve = simulate(rows, marks, 0.0004, 0.0002, 0.5)
        got = trades.orderBy("entry_ord").collect()
        assert [(t.entry_ord, t.exit_ord, t.forced_exit) for t in got] == [
            (w["entry_ord"], w["exit_ord"], w["forced"]) for w in want]
        for t, w in zip(got, want):
            assert t.net_pnl == pytest.approx(w["net_pnl"]) and t.quantity == pytest.approx(w["quantity"])
            path = rows[w["entry_ord"]:w["exit_ord"] + 1]
            assert t.path_high == max(r[3] for r in path) and t.path_low == min(r[4] for r in path)
        assert [r.equity for r in eq.orderBy("ord").collect()] == pytest.approx(curve)


def test_constant_carry(spark):
    closes = [100.0, 100, 102, 104, 101, 100, 99]
    marks = [(True, False)] + [(False, False)] * 3 + [(False, True)] + [(False, False)] * 2
    cost = pos.CostModel(0.001, 0.0, 0.0005)
    _, trades, eq = ledger_of(spark, closes, closes, marks, cost, 50.0, block=2)
    (t,) = trades.collect()
    paid = t.quantity * 0.0005 * sum(closes[1:5])
    assert t.bar_carry == pytest.approx(paid)
    assert t.cash_after == pytest.approx(10_000 + t.net_pnl - paid)
    e = [r.equity for r in eq.orderBy("ord").collect()]
    assert e[2] == pytest.approx(5000 + t.quantity * (102 - 0.0005 * (100 + 102)))
    assert e[-1] == pytest.approx(t.cash_after)


def curve(spark, values):
    rows = [("X", "r", i, T0.replace(hour=i // 4, minute=15 * (i % 4)), float(v), False) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, strategy string, ord bigint, ts timestamp, equity double, "
                               "in_position boolean").withColumn("_blk", block_no(F.col("ord"), 2))
    return mt.equity_metrics(mt.equity_profile(df, ["symbol"]), ["symbol"], 900_000).collect()[0]


def test_drawdown_and_ratios(spark):
    m = curve(spark, [100, 120, 110, 130, 80, 90])
    assert (m.max_drawdown_pct, m.max_drawdown_abs, m.peak_index, m.trough_index) == pytest.approx((50 / 1.3, 50, 3, 4))
    m = curve(spark, [100, 120, 90, 110, 80, 130])
    assert (m.max_drawdown_pct, m.peak_index, m.trough_index) == pytest.approx((100 / 3, 1, 4))
    m = curve(spark, [100, 110, 105, 112])
    rets = [0.1, 105 / 110 - 1, 112 / 105 - 1]
    mu = sum(rets) / 3
    sd = (sum((x - mu) ** 2 for x in rets) / 3) ** 0.5
    down = (min(rets) ** 2 / 3) ** 0.5
    assert m.sharpe == pytest.approx(mu / sd * 35040 ** 0.5) and m.sortino == pytest.approx(mu / down * 35040 ** 0.5)
    m = curve(spark, [100, 100, 100])
    assert m.sharpe is None and m.sortino is None and m.max_drawdown_pct == 0


def test_trade_metrics(spark):
    rows = [("X", i, n, n, 0.0, n / 10) for i, n in enumerate([10.0, 6.0, -4.0, -4.0])]
    t = spark.createDataFrame(rows, "symbol string, entry_ord bigint, net_pnl double, gross_pnl double, fees double, "
                              "return_pct double")
    m = mt.trade_metrics(t, ["symbol"]).collect()[0]
    assert (m.gross_profit, m.gross_loss, m.net_profit_factor, m.win_rate_pct, m.avg_win, m.avg_loss) == (
        16, -8, 2, 50, 8, -4)
    assert mt.losing_streak(t, ["symbol"], ["entry_ord"]).collect()[0].max_losing_streak == 2
    pairs = [(8.0, 10.0), (-7.0, -6.0), (11.0, 12.0), (-4.0, -4.0)]
    t = spark.createDataFrame([("X", n, g, 0.0, n) for n, g in pairs],
                              "symbol string, net_pnl double, gross_pnl double, fees double, return_pct double")
    m = mt.trade_metrics(t, ["symbol"]).collect()[0]
    assert m.gross_profit_factor == pytest.approx(2.2) and m.net_profit_factor == pytest.approx(19 / 11)
    wins = mt.trade_metrics(t.filter("net_pnl > 0"), ["symbol"]).collect()[0]
    assert wins.net_profit_factor is None and wins.avg_loss is None


def test_cost_model_rejects_bad_rates():
    with pytest.raises(ValueError):
        pos.CostModel(commission=1.0)
