from helpers_bars import bar_frame, candles, lin
from tickloom.functions.signals import python_rule
from tickloom.operators import gates, positions as pos


def test_python_rule_by_blocks(spark):
    """A 3-bar momentum rule in pandas gives the same positions whatever the block length."""
    xs = [x for i in range(6) for x in lin(100, 115 if i % 2 else 85, 15)]

    def rule(pdf):
        move = pdf["close"] - pdf["close"].shift(3)
        return (move > 2).tolist(), (move < -2).tolist()

    got = []
    for block in (8, 4096):
        s = python_rule(bar_frame(spark, candles(xs)), rule, back=3, block=block)
        h = pos.hold(s, ["symbol", "strategy"])
        got.append([(r.ord, r.up) for r in h.filter("up or down").orderBy("ord").collect()])
    state, want = False, []
    for i in range(3, len(xs)):
        d = xs[i] - xs[i - 3]
        if (d > 2 and not state) or (d < -2 and state):
            state = d > 2
            want.append((i, state))
    assert got[0] == got[1] == want


def test_best_candidate(spark):
    df = spark.createDataFrame([("a", 4, 1.2), ("b", 5, 1.1), ("c", 5, 1.3), ("d", None, 9.0)], "s string, pos int, pf double")
    assert gates.best_candidate(df, ["pos", "pf"]).collect()[0].s == "c"
