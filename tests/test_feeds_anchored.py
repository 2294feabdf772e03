"""Archives with headers of their own, message shapes, anchored windows and replays against plain versions."""
import datetime as dt
import hashlib
import random
import re

import pytest

from helpers_bars import T0, candles, lin
from tickloom.operators import anchored
from tickloom.sources import carry as scar, files
from tickloom.streaming import messages, replay


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def test_files_of_one_folder_have_their_own_headers(spark, tmp_path):
    put(tmp_path / "symbol=AAA/month=2024-01/a.csv", "﻿calc_time,interval,last_funding_rate\r\n100,8,0.1\r\n\r\n200,8,x\r\n")
    put(tmp_path / "symbol=AAA/month=2024-02/a.csv", "FundingRate , fundingTime\n0.2,300\n,400\n")
    put(tmp_path / "symbol=BBB/month=2024-02/b.csv", "calculate_time,fundingrate\n500,0.5\n")
    put(tmp_path / "symbol=BBB/month=2024-03/c.csv", "calc_time,last_funding_rate\n")
    rows = scar.read_archive(spark, str(tmp_path), "S", files.folder_column("symbol"))
    assert sorted((r.symbol, r.funding_time, r.funding_rate) for r in rows.collect()) == [("AAA", 100, 0.1), ("AAA", 300, 0.2), ("BBB", 500, 0.5)]
    assert [r.funding_time for r in rows.orderBy("ingest_id").collect()] == [100, 300, 500]
    part = scar.read_archive(spark, str(tmp_path), "S", files.folder_column("symbol"), where="month = '2024-02'")
    assert sorted(r.funding_time for r in part.collect()) == [300, 500]
    # the other months are not even listed
    read = files.read_files(spark, str(tmp_path), where="month = '2024-02'")
    assert all("month=2024-02" in r.path for r in read.collect())
    assert re.search(r"PartitionFilters: \[.*month", read._jdf.queryExecution().toString())


def test_files_without_a_column_are_an_error(spark, tmp_path):
    put(tmp_path / "a.csv", "calc_time,last_funding_rate\n1,0.1\n")
    put(tmp_path / "b.csv", "calc_time,other\n1,0.1\n")
    with pytest.raises(Exception, match="none of last_funding_rate, fundingrate in b.csv"):
        scar.read_archive(spark, str(tmp_path), "S").collect()
    put(tmp_path / "b.csv", "calc_time,Calc_Time,last_funding_rate\n1,2,0.1\n")
    with pytest.raises(Exception, match="duplicate header in b.csv"):
        scar.read_archive(spark, str(tmp_path), "S").collect()


def test_headerless_files_take_the_given_columns(spark, tmp_path):
    put(tmp_path / "a.csv", "100,1.5\n200,2.5\n")
    put(tmp_path / "b.csv", "value,time\n3.5,300\n")
    found = files.read_files(spark, str(tmp_path), columns=["time", "value"])
    rows = files.file_rows(found, {"time": ["time"], "value": ["value"], "note": ["note"]}, optional=("note",))
    assert [(r.time, r.value, r.note) for r in rows.orderBy("ingest_id").collect()] == [("100", "1.5", None), ("200", "2.5", None), ("300", "3.5", None)]


def test_digests_are_checked_against_the_bytes_read(spark, tmp_path):
    bodies = {"01": "calc_time,fundingrate\n1,0.1\n", "02": "calc_time,fundingrate\n2,0.2\n", "03": "calc_time,fundingrate\n"}
    for month, body in bodies.items():
        put(tmp_path / f"m=x{month}/f.csv", body)
    sums = spark.createDataFrame([("x01", hashlib.sha256(bodies["01"].encode()).hexdigest().upper()), ("x02", "0" * 64)], "m string, expected_sha256 string")
    checked = files.with_status(files.read_files(spark, str(tmp_path)), sums, ["m"])
    expected = spark.createDataFrame([(f"x0{i}",) for i in range(1, 5)], "m string")
    got = {r.m: (r.data_rows, r.status) for r in files.audit(expected, checked, ["m"]).collect()}
    assert got == {"x01": (1, "OK"), "x02": (1, "CHECKSUM_MISMATCH"), "x03": (0, "EMPTY_CSV"), "x04": (None, "NOT_AVAILABLE")}
    rows = files.file_rows(files.usable(checked), {"time": ["calc_time"]})
    assert [r.time for r in rows.collect()] == ["1"]


def test_message_shapes(spark):
    said = [
        '{"symbol":"X","interval":"15m","bar_time":1000,"open":"1","high":"2","low":"0.5","close":"1.5","volume":"9"}',
        '{"e":"kline","s":"Y","k":{"T":2000,"i":"1h","o":1,"h":2,"l":1,"c":"1.25","v":3,"x":false}}',
        '{"symbol":"X","markPrice":"5","indexPrice":"5.5","fundingRate":"0.0001","time":3}',
        '{"s":"Z","p":"6","i":"6.5","r":"-0.0002","E":4}', '{"symbol":"X","open":"0","close":"1"}', '{"symbol":"X","open":"2","close":"3","time":5}',
        "", None, "{", "[1]", '{"a":1}', '{"open":"1","close":"2"}', '{"symbol":"X","interval":"15m","open":"1","high":"1","low":"1","close":"1"}',
        '{"symbol":"X","markPrice":"n/a"}', '{"symbol":"X","interval":"15m","bar_time":1,"open":"1","high":"NaN","low":"1","close":"1"}']
    p = messages.parse_feed(spark.createDataFrame(list(enumerate(said)), "n int, value string"))
    got = {r.n: r for r in p.collect()}
    assert [got[i].kind for i in range(6)] == ["kline", "kline", "mark", "mark", "ticker", "ticker"] and not any(got[i].reject for i in range(6))
    assert [got[i].reject for i in range(6, 15)] == [
        "not JSON", "not JSON", "not JSON", "unknown shape", "unknown shape", "no symbol", "no time", "no price", "no price"]
    assert {(r.symbol, r.interval, r.close, r.is_final) for r in messages.bars(p).collect()} == {("X", "15m", 1.5, True), ("Y", "1h", 1.25, False)}
    assert {(r.symbol, r.price, r.index_price, r.funding_rate) for r in messages.marks(p).collect()} == {("X", 5.0, 5.5, 0.0001), ("Z", 6.0, 6.5, -0.0002)}
    assert {(r.price, r.change_pct) for r in messages.tickers(p).collect()} == {(1.0, 0.0), (3.0, 50.0)}
    assert messages.rejects(p).count() == 9


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_anchored_windows_equal_a_walk(spark):
    rng = random.Random(1)
    times = {"hot": sorted(rng.sample(range(400_000), 900)), "few": [5], "even": list(range(0, 3000, 300)), "close": list(range(50))}
    rows = [(k, at(t)) for k, ts in times.items() for t in ts for _ in range(1 + (t % 7 == 0))]
    df = spark.createDataFrame(rows, "account string, ts timestamp")
    got = {(r.account, r.ts): r.allowed for r in anchored.allowed_entries(df, ["account"], 300).collect()}
    want = {}
    for k, ts in times.items():
        last = None
        for t in ts:
            want[k, at(t)] = last is None or t - last >= 300
            last = t if want[k, at(t)] else last
    assert got == want

    numbered = spark.createDataFrame([(a, t, i) for i, (a, t) in enumerate(rows)], "account string, ts timestamp, n long")
    trips = sorted(tuple(r) for r in anchored.trips(numbered, ["account"], ["ts", "n"], 3, 300, 3600).collect())
    walk = []
    for k, ts in times.items():
        start, count = None, 0
        for t in (t for t in ts for _ in range(1 + (t % 7 == 0))):
            if start is None or t - start > 300:
                start, count = t, 0
            count += 1
            if count >= 3:
                walk.append((k, at(t), at(t + 3600), count))
    assert trips == sorted(walk)


def test_replay_tells_late_bars_by_earlier_batches(spark):
    rows = [("X", at(60 * t), b) for t, b in [(1, 0), (5, 0), (2, 1), (4, 1), (9, 2), (6, 3), (7, 3), (30, 4), (8, 4)]]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, batch long")
    late = {(r.ts, r.batch) for r in replay.with_late(df, "batch", 120).where("late").collect()}
    assert late == {(at(120), 1), (at(360), 3)}


def test_replay_equals_the_rule_on_the_bars_in_time(spark):
    from tickloom.functions.signals import signals
    from tickloom.operators import positions as pos
    from helpers_bars import bar_frame

    bars = candles([100] * 70 + lin(100, 130, 30) + lin(130, 100, 30))
    came = [(*r[:7], 99 if i in (10, 80) else i // 8) for i, r in enumerate(bars)]
    df = spark.createDataFrame([*came, *came[20:24]], "symbol string, ts timestamp, open double, high double, low double, close double, volume double, batch long")
    got = {(r.ts, r.action) for r in replay.replay_signals(df, "emaCrossover", "batch", 3600).collect()}
    kept = [(*r[:7], i) for i, r in enumerate(x for i, x in enumerate(bars) if i not in (10, 80))]
    h = pos.hold(signals(bar_frame(spark, kept), ["emaCrossover"]), ["symbol", "strategy"]).filter("up or down").collect()
    assert got == {(r.ts, "LONG" if r.up else "CLOSE") for r in h} | {(bars[10][1], "LATE"), (bars[80][1], "LATE")}
