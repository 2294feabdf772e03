import itertools
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.operators import diagnostics, joins, quantiles, ranges
from tickloom.operators import sequence as sq
from tickloom.operators.positions import hold
from tickloom.operators.quantiles import exact_quantiles, upper_median


def test_ordinals_across_chunks(spark):
    rng = random.Random(3)
    rows = [(k, t) for k in "ab" for t in sorted(rng.sample(range(5000), 300))]
    rng.shuffle(rows)
    df = sq.with_ordinal(spark.createDataFrame(rows, "k string, t bigint"), ["k"], ["t"], sq.int_div(F.col("t"), 70))
    got = {(r.k, r.t): r.ord for r in df.collect()}
    for k in "ab":
        for i, t in enumerate(sorted(t for kk, t in rows if kk == k)):
            assert got[k, t] == i


def test_scan_equals_running_values(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.uniform(0.9, 1.1), rng.choice([None, i])) for k in "ab" for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o bigint, x double, y bigint")
    df = df.withColumn("_blk", sq.int_div(F.col("o"), 7))
    spec = {"s": ("x", "sum"), "p": ("x", "prod"), "m": ("x", "max"), "l": ("y", "last")}
    for inclusive in (True, False):
        got = {(r.k, r.o): r for r in sq.scan(df, ["k"], ["o"], "_blk", spec, inclusive).collect()}
        for k in "ab":
            xs, seen = [], None
            for kk, o, x, y in (r for r in rows if r[0] == k):
                if inclusive:
                    xs.append(x)
                    seen = y if y is not None else seen
                row = got[k, o]
                if xs:
                    assert row.s == pytest.approx(sum(xs)) and row.m == max(xs)
                    p = 1.0
                    for v in xs:
                        p *= v
                    assert row.p == pytest.approx(p)
                else:
                    assert row.s is None and row.m is None and row.p is None
                assert row.l == seen
                if not inclusive:
                    xs.append(x)
                    seen = y if y is not None else seen


def test_scan_reads_the_upstream_once(spark):
    src = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.rand(7).alias("x"))
    src = src.groupBy("k", "o").agg(F.max("x").alias("x")).withColumn("_blk", sq.int_div(F.col("o"), 50))
    out = sq.scan(src, ["k"], ["o"], "_blk", {"s": ("x", "sum")})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Range (0, 1000") == 1 and "ReusedExchange" in plan


def test_blocked_window_equals_plain_window(spark):
    rows = [("a", i, float((i * 37) % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, ord bigint, x double")
    b = sq.blocked(df, back=20, fwd=3, block=16)
    w = sq.block_window(["k"])
    b = b.withColumns({"s": F.sum("x").over(w.rowsBetween(-20, 0)), "n": F.lead("x", 3).over(w)})
    got = {r.ord: r for r in sq.owned(b, 16).collect()}
    assert len(got) == 500
    for i in range(500):
        assert got[i].s == pytest.approx(sum(r[2] for r in rows[max(0, i - 20):i + 1]))
        assert got[i].n == (rows[i + 3][2] if i + 3 < 500 else None)


def test_latch_across_blocks(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(6):
        state, entry = False, None
        for i in range(200):
            up, down = rng.random() < 0.08, rng.random() < 0.08
            want[k, i] = (state, entry)
            was = state
            state = (not state) if up and down else True if up else False if down else state
            if state and not was:
                entry = i + 1
            rows.append((k, i, i // 9, up, down))
    df = spark.createDataFrame(rows, "k int, ord bigint, _blk bigint, set_long boolean, reset boolean")
    for r in hold(df, ["k"]).collect():
        assert (r.held, r.entry_ord) == want[r.k, r.ord]


def test_exact_order_statistics_under_skew(spark):
    rng = random.Random(2)
    rows = [("hot", float(rng.choice([1, 1, 1, 2, 500, rng.random()]))) for _ in range(3000)]
    rows += [("one", 4.0), ("even", 1.0), ("even", 2.0), ("even", 3.0), ("even", 4.0), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "x", {"q1": 0.25, "q2": 0.5}).collect()}
    hot = sorted(x for k, x in rows if k == "hot")
    for name, q in (("q1", 0.25), ("q2", 0.5)):
        at = (len(hot) - 1) * q
        want = hot[int(at)] + (hot[min(int(at) + 1, len(hot) - 1)] - hot[int(at)]) * (at - int(at))
        assert got["hot"][name] == pytest.approx(want)
    assert got["one"].q1 == 4.0 and got["even"].q2 == 2.5
    assert {r.k: r.median for r in upper_median(df, ["k"], "x").collect()}["even"] == 3.0
    assert exact_quantiles(df, [], "x", {"q": 1.0}).collect()[0].q == 500.0


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_order_statistics_of_many_values(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", limit)  # small: buckets are cut again
    rng = random.Random(4)
    rows = [(k, rng.gauss(0, 1), float(rng.randrange(50)), None) for k in ["hot"] * 20000 + ["cold"] * 300]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    at = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q99": 0.99, "top": 1.0}
    got = {(r.k, r.column): r for r in exact_quantiles(df, ["k"], ["x", "y", "z"], at).collect()}
    assert set(got) == {(k, c) for k in ("hot", "cold") for c in "xy"}
    for (k, c), r in got.items():
        xs = sorted(row["kxy".index(c)] for row in rows if row[0] == k)
        for name, q in at.items():
            p = (len(xs) - 1) * q
            assert r[name] == pytest.approx(xs[int(p)] + (xs[min(int(p) + 1, len(xs) - 1)] - xs[int(p)]) * (p - int(p)))


def test_look_ups_spread_hot_keys_only(spark, monkeypatch):
    monkeypatch.setattr(joins, "LOOKUP_ROWS", 100)
    rows = [("hot", i) for i in range(1000)] + [(f"k{i}", i) for i in range(1000)] + [(None, 7)]
    df = spark.createDataFrame(rows, "k string, i long")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(900)], "k string, v long")
    out = joins.lookup(df, table, ["k"])
    got = {(r.k, r.i): r.v for r in out.collect()}
    assert got == {(k, i): 1 if k == "hot" else i if k and i < 900 else None for k, i in rows} and out.columns == ["k", "i", "v"]
    copies = [r for r in _rows_of(out, "Generate")]
    assert copies == [910]  # ten of the hot row, one of each other


def _rows_of(df, node):
    """Output rows of the plan nodes of a kind, from the executed plan."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith(node) and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def test_long_spans_are_cut_into_few_ranges(spark):
    spans = [("a", 0, 100_000), ("a", 17, 18), ("a", -900, 70), ("a", 5, 5), ("b", 3, 4000)]
    events = [(k, t) for k in "ab" for t in range(-1000, 5000, 7)]
    s = spark.createDataFrame(spans, "k string, lo long, hi long")
    out = joins.interval_join(s, spark.createDataFrame(events, "k string, t long"), ["k"], "lo", "hi", "t", lambda c: c)
    assert {tuple(r) for r in out.select("k", "lo", "hi", "t").collect()} == {
        (k, lo, hi, t) for k, lo, hi in spans for kk, t in events if k == kk and lo < t < hi}
    for lo, hi in [(0, 100_000), (-900, 70), (12345, 99_999), (3, 3)]:
        one = spark.range(1).select(F.explode(joins.aligned_ranges(F.lit(lo), F.lit(hi))).alias("p")).select("p.*").collect()
        assert len(one) <= 2 * (hi - lo + 1).bit_length()
        assert sorted(x for level, place in one for x in range(place << level, (place + 1) << level)) == list(range(lo, hi + 1))


@pytest.mark.parametrize("period", [1, 2, 3, 50, 200, 1000])
def test_averages_of_any_period(spark, period):
    rng = random.Random(period)
    xs = [100 + rng.uniform(-5, 5) for _ in range(4 * ind.SUB + 30)]
    bars = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "symbol string, ord bigint, close double")
    specs = {"e": ind.long_ema_spec(period), "w": ind.wilder_spec("close", period)}
    got = {r.ord: r for r in ind.with_running_averages(bars, ["symbol"], specs).collect()}
    for name, (_, length, at, k) in specs.items():
        e = sum(xs[at - length + 1:at + 1]) / length
        assert all(got[i][name] is None for i in range(at)) and got[at][name] == pytest.approx(e, rel=1e-10)
        for i in range(at + 1, len(xs)):
            e = xs[i] * k + e * (1 - k)
            assert got[i][name] == pytest.approx(e, rel=1e-10)


def test_one_carry_refuses_what_it_cannot_hold(spark):
    bars = spark.createDataFrame([("a", 0, 0, 1.0)], "symbol string, ord bigint, _blk bigint, close double")
    with pytest.raises(ValueError, match="with_running_averages"):
        ind.with_long_averages(bars, ["symbol"], {"e": ind.long_ema_spec(200)})


def test_extremes_of_spans(spark, monkeypatch):
    rng = random.Random(12)
    series = [("a", i, rng.random(), rng.random()) for i in range(700) if i % 50 != 3] + [("b", i, 1.0, -float(i)) for i in range(5)]
    spans = [(i, "a", min(x, y), max(x, y)) for i in range(300) for x, y in [(rng.randrange(700), rng.randrange(700))] if x % 50 != 3 and y % 50 != 3]
    spans += [(900, "a", 5, 4), (901, "b", 0, 4), (902, "c", 0, 1), (903, "a", None, 4)]
    rows = spark.createDataFrame(series, "k string, ord long, high double, low double")
    got = ranges.span_extremes(spark.createDataFrame(spans, "id long, k string, i long, j long"), rows, ["k"], "i", "j", "high", "low", ["id"], block=8)
    for r in got.collect():
        inside = [s for s in series if s[0] == r.k and r.i is not None and r.i <= s[1] <= r.j]
        assert (r.top, r.bottom) == ((max(s[2] for s in inside), min(s[3] for s in inside)) if inside else (None, None))


def test_long_averages_over_several_sub_blocks(spark):
    rng = random.Random(8)
    xs = [100 + rng.uniform(-5, 5) for _ in range(3 * ind.SUB + 50)]
    rows = [("a", i, 0, x) for i, x in enumerate(xs)]
    bars = spark.createDataFrame(rows, "symbol string, ord bigint, _blk bigint, close double")
    periods = (4, 9, 50)
    got = {r.ord: r for r in ind.with_long_averages(
        bars, ["symbol"], {f"e{p}": ind.long_ema_spec(p) for p in periods}).collect()}
    for p in periods:
        k, e = 2 / (p + 1), sum(xs[:p]) / p
        for i in range(p, len(xs)):
            e = k * xs[i] + (1 - k) * e
            assert got[i][f"e{p}"] == pytest.approx(e, rel=1e-12)
        assert got[p - 2][f"e{p}"] is None


def test_negative_numbers_floor(spark):
    df = spark.createDataFrame([(-1,), (-8,), (-9,), (7,), (8,)], "v bigint").select(sq.int_div(F.col("v"), 8))
    assert list(itertools.chain.from_iterable(df.collect())) == [-1, -1, -2, 0, 1]


@pytest.fixture
def settled_plans(monkeypatch):
    """The executed plans of the frames that the quantiles end the lineage of."""
    plans, settle = [], quantiles.settled
    monkeypatch.setattr(quantiles, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    return plans


def test_quantiles_sort_no_rows_with_bounds(spark, settled_plans):
    df = spark.range(5000).selectExpr("id % 3 AS k", "cast(pmod(id * 7919, 5000) AS double) AS x")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    for k, r in got.items():
        xs = sorted(float(i * 7919 % 5000) for i in range(5000) if i % 3 == k)
        for name, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
            p = (len(xs) - 1) * q
            assert r[name] == pytest.approx(xs[int(p)] + (xs[min(int(p) + 1, len(xs) - 1)] - xs[int(p)]) * (p - int(p)))
    assert settled_plans and not any("SortAggregate" in p or "SortMergeJoin" in p for p in settled_plans)


def test_quantiles_of_many_groups_are_looked_up(spark, monkeypatch, settled_plans):
    monkeypatch.setattr(quantiles, "FEW_GROUPS", 2)
    monkeypatch.setattr(joins, "LOOKUP_ROWS", 500)  # small: the hot key is spread
    rows = [(k, float(i % 40), None if i % 7 else float(i)) for k, n in (("hot", 3000), ("cold", 30), ("one", 1)) for i in range(n)]
    got = {(r.k, r.column): r for r in exact_quantiles(
        spark.createDataFrame(rows, "k string, x double, y double"), ["k"], ["x", "y"], {"low": 0.0, "q2": 0.5}).collect()}
    for (k, c), r in got.items():
        xs = sorted(row["kxy".index(c)] for row in rows if row[0] == k and row["kxy".index(c)] is not None)
        p = (len(xs) - 1) * 0.5
        assert r.low == xs[0] and r.q2 == pytest.approx((xs[int(p)] + xs[min(int(p + 0.5), len(xs) - 1)]) / 2)
    assert len(got) == 6 and not any("SortAggregate" in p for p in settled_plans)


def _trades(spark):
    return spark.range(900).selectExpr(
        "if(id % 4 = 0, 'b', 'a') AS symbol", "cast(id % 50 AS double) AS mfe", "-cast(id % 7 AS double) AS mae",
        "cast(id % 11 - 5 AS double) AS net_return_pct", "cast(id % 13 - 5 AS double) AS gross_return_pct", "1.0D AS cost_pct")


def test_excursion_medians_sort_no_trades(spark, settled_plans):
    got = {(r.symbol, r.outcome): r for r in diagnostics.excursion_table(_trades(spark), ["symbol"]).collect()}
    rows = [("ab"[i % 4 == 0], i % 50, -(i % 7), i % 11 - 5) for i in range(900)]
    assert len(got) == 6
    for (symbol, outcome), r in got.items():
        own = [x for x in rows if x[0] == symbol and outcome in ("all", "winners" if x[3] > 0 else "losers")]
        assert (r["count"], r.median_mfe, r.median_mae) == (len(own), median(x[1] for x in own), median(x[2] for x in own))
    assert settled_plans and not any("SortAggregate" in p or "SortMergeJoin" in p for p in settled_plans)


def test_cost_medians_sort_no_trades(spark, settled_plans):
    got = {r.symbol: r for r in diagnostics.cost_decomposition(_trades(spark), ["symbol"]).collect()}
    for symbol, r in got.items():
        own = [i for i in range(900) if "ab"[i % 4 == 0] == symbol]
        assert (r.median_gross, r.median_net) == (median(i % 13 - 5 for i in own), median(i % 11 - 5 for i in own))
    assert len(got) == 2 and settled_plans and not any("SortAggregate" in p or "SortMergeJoin" in p for p in settled_plans)
