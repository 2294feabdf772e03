import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from helpers_bars import T0, bar_frame, candles, lin
from tickloom.functions.signals import signals
from tickloom.operators import positions as pos
from tickloom.streaming import bars as st, stateful as sf


def drop(folder, name, lines, age):
    p = folder / name
    p.write_text("\n".join(json.dumps(x) for x in lines))
    when = time.time() - age
    os.utime(p, (when, when))


def run(spark, df, name, tmp_path, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert not q.isActive
    return spark.table(name).collect()


def text(spark, folder):
    return spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))


def kline(t, final, close="1"):
    return {"symbol": "X", "interval": "15m", "bar_time": t, "open": "1", "high": "2", "low": "1", "close": close,
            "volume": "3", **({} if final is None else {"isFinal": final})}


def test_final_bars_once(spark, tmp_path):
    d = tmp_path / "k"
    d.mkdir()
    h = 3_600_000
    drop(d, "b.json", [kline(1 * h, None), kline(2 * h, True), kline(3 * h, False)], 60)
    drop(d, "a.json", [kline(1 * h, True), kline(2 * h, True), kline(3 * h, True), kline(4 * h, False)], 30)
    rows = run(spark, st.final_bars(st.parse_klines(text(spark, d)), "10 hours"), "finals", tmp_path)
    assert sorted(r.ts.hour for r in rows) == [1, 2, 3]


def test_tick_bars_and_latest(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    ticks = [("2024-01-01T00:00:10Z", 5.0, 1), ("2024-01-01T00:10:00Z", 7.0, 2), ("2024-01-01T00:14:59Z", 6.0, 3),
             ("2024-01-01T00:15:00Z", 9.0, 4), ("2024-01-01T02:00:00Z", 1.0, 5)]
    for i, (t, p, s) in enumerate(ticks):
        drop(d, f"{i}.json", [{"symbol": "X", "ts": t, "price": p, "seq": s}], 100 - i * 10)
    s = text(spark, d).select(F.from_json("value", "symbol string, ts timestamp, price double, seq bigint").alias("m")).select("m.*")
    got = {r.ts.minute: r for r in run(spark, st.tick_bars(s), "tb", tmp_path)}
    b = got[0]
    assert (b.open, b.high, b.low, b.close, b.volume) == (5, 7, 5, 6, 3) and got[15].open == 9
    rows = run(spark, st.latest(s), "last", tmp_path, "complete")
    assert [(r.symbol, r.price) for r in rows] == [("X", 1.0)]


def test_ticker_and_marks(spark):
    m = spark.createDataFrame([(json.dumps({"symbol": "X", "open": "100", "close": "110", "time": 0}),),
                               (json.dumps({"symbol": "X", "open": "0", "close": "1", "time": 0}),)], "value string")
    assert [r.change_pct for r in st.parse_tickers(m).collect()] == pytest.approx([10.0, 0.0])
    k = spark.createDataFrame([('{"symbol":"X","markPrice":"1.5","time":1}',), ('{"symbol":"X","markPrice":"n/a"}',)], "value string")
    assert [r.price for r in st.parse_marks(k).collect()] == [1.5]


FAR = T0 + dt.timedelta(days=30)


def live(spark, tmp_path, rule, batches):
    """(what came in time, late times) of a stream that reads the given lists of bars one micro-batch each."""
    d = tmp_path / f"live_{rule}"
    d.mkdir()
    for i, part in enumerate(batches):
        drop(d, f"{99 - i}.json", [{"symbol": r[0], "ts": r[1].isoformat() + "Z", "close": r[5], "warmup": False} for r in part], 9000 - i * 10)
    s = text(spark, d).select(F.from_json("value", "symbol string, ts timestamp, close double, warmup boolean").alias("m")).select("m.*")
    out = run(spark, sf.live_signals(s, rule), f"sig_{rule}", tmp_path)
    return sorted((r.ts, r.action) for r in out if not r.late), sorted(r.ts for r in out if r.late)


@pytest.mark.parametrize("rule", ["emaCrossover", "rsiEma"])
def test_live_signals_equal_batch(spark, tmp_path, rule):
    xs = [100] * 70 + lin(100, 112, 25) + lin(112, 104, 8) + lin(104, 112, 12) + [112] * 10 + lin(112, 98, 20)
    rows = candles(xs)
    h = pos.hold(signals(bar_frame(spark, rows), [rule]), ["symbol", "strategy"])
    want = [(r.ts, "LONG" if r.up else "CLOSE") for r in h.filter("up or down").orderBy("ts").collect()]
    assert want
    # bars cross batches by up to three places, repeat, and each batch is in reverse
    moved = sorted(rows + rows[40:60], key=lambda r: r[7] + (7 * r[7]) % 4)
    end = [("END", FAR, 1.0, 1.0, 1.0, 1.0, 1.0, 0)]
    got, late = live(spark, tmp_path, rule, [*[moved[lo:lo + 25][::-1] for lo in range(0, len(moved), 25)], end])
    assert got == want and late == []


def test_bars_behind_the_watermark_come_out_late(spark, tmp_path):
    rows = candles([100] * 70 + lin(100, 130, 30) + lin(130, 100, 30))
    held_back = [rows[10], rows[80]]
    rest = [r for r in rows if r not in held_back]
    end = [("END", FAR, 1.0, 1.0, 1.0, 1.0, 1.0, 0)]
    numbered = [(*r[:7], i) for i, r in enumerate(rest)]
    h = pos.hold(signals(bar_frame(spark, numbered), ["emaCrossover"]), ["symbol", "strategy"])
    want = [(r.ts, "LONG" if r.up else "CLOSE") for r in h.filter("up or down").orderBy("ts").collect()]
    got, late = live(spark, tmp_path, "emaCrossover", [rest[:60], rest[60:], held_back, end])
    assert got == want and late == [r[1] for r in held_back]


def test_in_order_asks_for_its_state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        with pytest.raises(ValueError, match="RocksDB"):
            sf.cooldown(spark.createDataFrame([], "symbol string, ts timestamp"))
    finally:
        spark.conf.set(name, before)


def stream(spark, tmp_path, rows, schema, name):
    """One row for each micro-batch, and a last one that moves the watermark past all of them."""
    d = tmp_path / name
    d.mkdir()
    end = dict.fromkeys(rows[0]) | {"symbol": "END", "account": "END", "ts": FAR.isoformat() + "Z", "pnl": 1.0}
    for i, r in enumerate([*rows, {k: end[k] for k in rows[0]}]):
        drop(d, f"{i}.json", [r], 1000 - i * 10)
    return text(spark, d).select(F.from_json("value", schema).alias("m")).select("m.*")


def at(seconds):
    return (T0 + dt.timedelta(seconds=seconds)).isoformat() + "Z"


def test_cooldown(spark, tmp_path):
    s = stream(spark, tmp_path, [{"symbol": "X", "ts": at(t)} for t in (100, 0, 300, 299, 500, 9000, 8000)], "symbol string, ts timestamp", "c")
    got = sorted((r.ts, r.allowed) for r in run(spark, sf.cooldown(s, delay="10 minutes"), "cool", tmp_path) if not r.late)
    assert [ok for _, ok in got] == [True, False, False, True, False, True]
    assert [(r.symbol, r.ts, r.allowed) for r in spark.table("cool").where("late").collect()] == [("X", T0 + dt.timedelta(seconds=8000), None)]


def test_breakers(spark, tmp_path):
    pnl = [-1, -1, 0, -1, -1, -1, -1, -1, -1]
    s = stream(spark, tmp_path, [{"account": "A", "ts": at(i ^ 1), "pnl": pnl[i ^ 1] if i < 8 else -1} for i in range(8)],
               "account string, ts timestamp, pnl double", "l")
    (r,) = run(spark, sf.loss_breaker(s), "loss", tmp_path)
    assert r.tripped_at == T0 + dt.timedelta(seconds=7) and r.expires_at == r.tripped_at + dt.timedelta(hours=1)
    times = [0, 200, 302, 301, 303, 304, 305, 306, 307, 308, 310, 309]
    s = stream(spark, tmp_path, [{"account": "A", "ts": at(t)} for t in times], "account string, ts timestamp", "e")
    (r,) = run(spark, sf.error_breaker(s), "errs", tmp_path)
    assert r.tripped_at == T0 + dt.timedelta(seconds=310) and r.errors == 10
