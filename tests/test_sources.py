import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from helpers_bars import T0
from tickloom.operators.quality import DataError
from tickloom.sources import bars as sb, carry as scar, manifest as mf, sinks


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_csv_with_bom_crlf_and_blank_lines(spark, tmp_path):
    p = write(tmp_path / "a.csv", "﻿Timestamp, Open ,High,Low,Close,Volume\r\n1704067200000, 1 ,2,0.5,1.5,10\r\n\r\n"
              "2024-01-01T00:15:00Z,1,2,0.5,1.6,x\r\n\r\n")
    raw = sb.read_csv_text(spark, p)
    assert raw.columns == ["timestamp", "open", "high", "low", "close", "volume", "ingest_id"] and raw.count() == 2
    rows = sb.typed_bars(raw, F.lit("X")).orderBy("ts").collect()
    assert [r.ts for r in rows] == [T0, T0 + dt.timedelta(minutes=15)]
    assert rows[0].open == 1.0 and rows[1].volume is None


def test_csv_errors(spark, tmp_path):
    with pytest.raises(DataError, match="duplicate header"):
        sb.read_csv_text(spark, write(tmp_path / "d.csv", "a,A\n1,2\n"))
    with pytest.raises(DataError, match="empty"):
        sb.read_csv_text(spark, write(tmp_path / "e.csv", ""))
    raw = sb.read_csv_text(spark, write(tmp_path / "m.csv", "ts,open,high\n1,2,3\n"))
    assert sb.missing_columns(raw.columns) == ["timestamp", "low", "close", "volume"]
    with pytest.raises(DataError, match="missing columns"):
        sb.typed_bars(raw)


HEAD = "timestamp,open,high,low,close,volume\n"


def test_load_policies(spark, tmp_path):
    dup = sb.read_bars(spark, write(tmp_path / "dup.csv", HEAD + "100,1,2,1,2,1\n100,1,2,1,1.5,1\n200,1,2,1,2,1\n"), "X",
                       mode="quarantine")
    good, issues = dup
    assert {r.type for r in issues.collect()} == {"out-of-order", "duplicate-timestamp"}
    assert [r.close for r in good.orderBy("ts").collect()] == [2.0, 2.0]
    with pytest.raises(DataError, match="strictly greater"):
        sb.read_bars(spark, write(tmp_path / "o.csv", HEAD + "300,1,2,1,2,1\n200,1,2,1,2,1\n"), "X")
    ok = sb.read_bars(spark, write(tmp_path / "k.csv", HEAD + "".join(
        f"{i * 900000},1,2,1,2,1\n" for i in range(60))), "X")
    assert ok.count() == 60


def test_archive_and_marks(spark, tmp_path):
    d = tmp_path / "arch"
    d.mkdir()
    write(d / "AAA-15m-2024-01.csv", "open_time,open,high,low,close,volume,x\n1000,1,2,1,2,5,9\nbad\n")
    write(d / "BBB-15m-2024-02.csv", "2000,1,2,1,3,6,9\n")
    got = {(r.symbol, r.close, r.volume) for r in sb.read_bar_archive(
        spark, str(d), F.regexp_extract(F.input_file_name(), r"([A-Z]+)-15m", 1)).collect()}
    assert got == {("AAA", 2.0, 5.0), ("BBB", 3.0, 6.0)}
    assert sb.read_mark_bars(spark, str(d), F.lit("Z")).columns == ["symbol", "open_time", "open", "close"]


def test_carry_files(spark, tmp_path):
    a = scar.read_archive(spark, write(tmp_path / "AAA-rate.csv", "calc_time,interval,last_funding_rate\n100,8,0.0001\n200,8,x\n"),
                          "OFFICIAL", F.lit("AAA"))
    assert [(r.funding_time, r.funding_rate, r.source) for r in a.collect()] == [(100, 0.0001, "OFFICIAL")]
    assert scar.read_events(spark, str(tmp_path / "none.csv")).count() == 0
    out = str(tmp_path / "events")
    scar.write_events(a, out)
    back = scar.read_events(spark, out + "/*.csv").collect()
    assert [(r.symbol, r.funding_time, r.funding_rate, r.mark_price) for r in back] == [("AAA", 100, 0.0001, None)]
    twice = a.unionByName(a.withColumn("ingest_id", F.col("ingest_id") + 5).withColumn("funding_rate", F.lit(9.0)))
    assert [r.funding_rate for r in scar.dedupe_events(twice).collect()] == [0.0001]
    p = scar.provenance(twice).collect()[0]
    assert (p.events, p.duplicates, p.missing_marks, p.positive) == (2, 1, 2, 2)


def test_manifest_and_checksums(spark, tmp_path):
    m = {"assets": {"AAA": {"klineRows": 3, "klineArchives": [{"month": "2024-01", "sha256": "q", "status": "OK"}],
                            "fundingArchives": []}}}
    man = mf.read_manifest(spark, write(tmp_path / "m.json", json.dumps(m, indent=1)))
    assert man.collect()[0].klineRows == 3
    assert mf.manifest_archives(man).collect()[0].month == "2024-01"
    d = tmp_path / "z"
    d.mkdir()
    sums = ""
    for month, body, digest in [("2024-01", "1,2\n", None), ("2024-02", "3,4\n", "0" * 64), ("2024-03", "open_time,open\n", None)]:
        write(d / f"AAA-{month}.csv", body)
        sums += f"{digest or hashlib.sha256(body.encode()).hexdigest()}  AAA-{month}.csv\n"
    checks = mf.read_checksums(spark, write(tmp_path / "SUMS", sums))
    exp = mf.expected_months(man, "2024-01-01", "2024-04-01")
    name = F.concat("symbol", F.lit("-"), F.date_format("month", "yyyy-MM"), F.lit(".csv"))
    got = {str(r.month): r.status for r in mf.audit_archives(exp, mf.file_digests(spark, str(d)), checks, name,
                                                                        mf.data_rows(spark, str(d))).collect()}
    assert got == {"2024-01-01": "OK", "2024-02-01": "CHECKSUM_MISMATCH", "2024-03-01": "EMPTY_CSV",
                   "2024-04-01": "NOT_AVAILABLE"}


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame(
        [("X", "r", T0, 1.123456789, T0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8)],
        "symbol string, strategy string, entry_time timestamp, entry_price double, exit_time timestamp, exit_price double, "
        "quantity double, gross_pnl double, fees double, net_pnl double, return_pct double, holding_bars bigint")
    sinks.write_ledger(t, str(tmp_path / "l"))
    r = spark.read.option("header", True).csv(str(tmp_path / "l")).collect()[0]
    assert r.entryTime == "2024-01-01T00:00:00.000Z" and r.entryPrice == "1.12345679" and r.holdingBars == "8"
    sinks.write_summary(spark.createDataFrame([("X", 1.0, ["w"])], "symbol string, sharpe double, w array<string>"),
                        str(tmp_path / "s"), ["symbol"], "w")
    assert spark.read.json(str(tmp_path / "s")).collect()[0].results.sharpe == 1.0
    e = spark.createDataFrame([("X", T0, 1.00004)], "symbol string, ts timestamp, equity double")
    sinks.write_equity(e, str(tmp_path / "e"), ["symbol"])
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).collect()[0].equity == "1.0"
    b = spark.createDataFrame([("X", T0, 1.0), ("X", T0 + dt.timedelta(days=40), 2.0)], "symbol string, ts timestamp, close double")
    sinks.write_bars(b, str(tmp_path / "b"))
    sinks.write_bars(b.filter("close = 2.0").withColumn("close", F.lit(3.0)), str(tmp_path / "b"))
    assert sorted(r.close for r in spark.read.parquet(str(tmp_path / "b")).collect()) == [1.0, 3.0]


def test_files_of_a_folder_in_name_order(spark, tmp_path):
    start = 1_700_000_000_000
    for name, first, n in (("a-1.csv", 0, 10), ("a-2.csv", 10, 40), ("a-3.csv", 50, 5)):
        rows = [f"{start + (first + i) * 60_000},1,2,0.5,1,9" for i in range(n)]
        (tmp_path / name).write_text("timestamp,open,high,low,close,volume\n" + "\n".join(rows) + "\n")
    assert sb.read_bars(spark, str(tmp_path), "X").count() == 55


def test_dedupe_keeps_the_first_batch(spark):
    from tickloom.sources.carry import dedupe_events

    a, b = (spark.createDataFrame([("X", 1, rate, 0)], "symbol string, funding_time long, funding_rate double, ingest_id long")
            for rate in (0.1, 0.9))
    assert [dedupe_events(*p).first().funding_rate for p in ((a, b), (b, a))] == [0.1, 0.9]
