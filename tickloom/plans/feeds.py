"""Queries of sources and sinks: tables written as the files a feed would deliver, and read back; with their DuckDB SQL."""
from pyspark.sql import functions as F

from tickloom.functions import scalars as sc
from tickloom.operators import metrics as mt
from tickloom.plans import derive
from tickloom.plans.catalog import BAR_MS, CAPITAL, RUN, carry_events, curves, ledgers, marks, query
from tickloom.plans.oracle import BAR, ms, oracle, r, rs
from tickloom.sources import bars as sb, carry as scar, files, manifest, sinks
from tickloom.streaming import messages


def _millis(c):
    return sc.epoch_millis(c).cast("string")


def _lines(rows, folders, line, header=None):
    """Rows as text in ``folders`` (key=value), one file per folder, its header first."""
    out = rows.select(*folders, F.lit(1).alias("_part"), line.alias("value"))
    if header is not None:
        heads = rows.select(*folders).distinct()
        out = heads.select(*folders, F.lit(0).alias("_part"), header.alias("value")).unionByName(out)
    path = files.scratch_folder(rows.sparkSession)
    (out.repartition(*folders).sortWithinPartitions(*folders, "_part", "value").drop("_part")
     .write.partitionBy(*folders).text(path))
    return path


# Bars

@query
def csv_load(spark, sf):
    """Bars through CSV files with a header: read, typed, checked, loaded strictly."""
    b = derive.plain_bars(spark, sf, "15m")
    path = files.scratch_folder(spark)
    (b.select("symbol", sc.epoch_millis("ts").alias("Timestamp"), F.col("open").alias("Open"), "high", "low", "close", "volume")
     .repartitionByRange("symbol", "Timestamp").sortWithinPartitions("symbol", "Timestamp").write.option("header", True).csv(path))
    raw = sb.read_csv_text(spark, path)
    return sb.load_bars(sb.typed_bars(raw)).select("symbol", "ts", "open", "high", "low", "close", "volume")


oracle("csv_load", f"SELECT symbol, ts, {BAR} FROM b15", "b15")


@query
def bar_archive(spark, sf):
    """Headerless bar archives by symbol."""
    b = derive.plain_bars(spark, sf, "15m")
    path = _lines(b, ["symbol"], F.concat_ws(",", _millis("ts"), "open", "high", "low", "close", "volume", F.lit("9")))
    symbol = F.regexp_extract(F.col("_metadata.file_path"), "/symbol=([^/]+)/", 1)
    return sb.read_bar_archive(spark, path, symbol).drop("ingest_id")


oracle("bar_archive", f"SELECT symbol, ts, {BAR} FROM b15", "b15")


@query
def mark_folder(spark, sf):
    """Mark-price folder, half of its files with a header line."""
    m = marks(spark, sf).withColumn("part", F.pmod(F.day("open_time"), F.lit(2)))
    head = F.when(F.col("part") == 1, "open_time,open,high,low,close,ignore").otherwise("0,x,x,x,x,x")
    line = F.concat_ws(",", _millis("open_time"), "open", F.lit("0"), F.lit("0"), "close", F.lit("0"))
    path = _lines(m, ["symbol", "part"], line, head)
    symbol = F.regexp_extract(F.col("_metadata.file_path"), "/symbol=([^/]+)/", 1)
    return sb.read_mark_bars(spark, path, symbol).where("open IS NOT NULL")


oracle("mark_folder", f"SELECT symbol, open_time, {rs('open', 'close')} FROM marks", "marks")


# Carry archives: five months by week, every second one under other names

def _monthly(spark, sf):
    month = F.date_format(F.add_months(F.lit("2024-01-01").cast("date"), F.floor((F.day("event_time") - 1) / 7).cast("int")), "yyyy-MM")
    return carry_events(spark, sf).withColumn("month", month)


def _archives(spark, sf):
    e = _monthly(spark, sf)
    odd = F.substring("month", -2, 2).cast("int") % 2 == 1
    line = F.when(odd, F.concat_ws(",", _millis("event_time"), F.lit("1"), "rate")).otherwise(F.concat_ws(",", "rate", _millis("event_time")))
    head = F.when(odd, "calc_time,funding_interval_hours,last_funding_rate").otherwise("FundingRate, FundingTime")
    return _lines(e, ["symbol", "month"], line, head)


@query
def funding_archive(spark, sf):
    """Monthly carry archives of two layouts, read for three of their months."""
    path = _archives(spark, sf)
    rows = scar.read_archive(spark, path, "OFFICIAL", files.folder_column("symbol"), where="month BETWEEN '2024-02' AND '2024-04'")
    return rows.select("symbol", "funding_time", "funding_rate", "source")


WEEK_MONTH = "strftime(DATE '2024-01-01' + to_months(((day(ts) - 1) // 7)::INT), '%Y-%m')"
oracle("funding_archive", f"""SELECT symbol, epoch_ms(event_time) AS funding_time, {r('rate', 'funding_rate')}, 'OFFICIAL' AS source FROM cev
 WHERE {WEEK_MONTH.replace('ts', 'event_time')} BETWEEN '2024-02' AND '2024-04'""", "cev")


@query
def archive_audit(spark, sf):
    """Every symbol and month from January to July against the files: digests of one month are wrong, two have no file."""
    path = _archives(spark, sf)
    found = files.read_files(spark, path)
    sums = found.select("symbol", "month", F.when((F.col("month") == "2024-03") & (F.col("symbol") > "m"), F.repeat(F.lit("0"), 64))
                        .otherwise(F.col("sha256")).alias("expected_sha256"))
    months = F.explode(F.array(*[F.lit(f"2024-{m:02}") for m in range(1, 8)])).alias("month")
    expected = carry_events(spark, sf).select("symbol").distinct().select("symbol", months)
    return files.audit(expected, files.with_status(found, sums, ["symbol", "month"]), ["symbol", "month"]).drop("file")


oracle("archive_audit", f"""SELECT e.symbol, e.month, n AS data_rows, CASE WHEN n IS NULL THEN 'NOT_AVAILABLE'
 WHEN e.month = '2024-03' AND e.symbol > 'm' THEN 'CHECKSUM_MISMATCH' ELSE 'OK' END AS status
 FROM (SELECT DISTINCT symbol, '2024-0' || m AS month FROM cev, range(1, 8) t(m)) e
 LEFT JOIN (SELECT symbol, {WEEK_MONTH.replace('ts', 'event_time')} AS month, count(*) AS n FROM cev GROUP BY 1, 2) USING (symbol, month)""", "cev")


@query
def event_file(spark, sf):
    """Carry events through their file format."""
    path = files.scratch_folder(spark)
    scar.write_events(carry_events(spark, sf).select("symbol", sc.epoch_millis("event_time").alias("funding_time"),
                                                     F.col("rate").alias("funding_rate"), F.lit(None).cast("double").alias("mark_price"),
                                                     F.lit("REGULAR").alias("rate_type"), F.lit("OFFICIAL").alias("source")), path)
    return scar.read_events(spark, f"{path}/*.csv").drop("ingest_id")


oracle("event_file", f"""SELECT symbol, epoch_ms(event_time) AS funding_time, {r('rate', 'funding_rate')}, NULL::DOUBLE AS mark_price,
 'REGULAR' AS rate_type, 'OFFICIAL' AS source FROM cev""", "cev")


# Result files

@query
def ledger_file(spark, sf):
    """The crossover ledger through its CSV file."""
    t = ledgers(spark, sf, ["emaCrossover"], only=("BASE",))
    path = files.scratch_folder(spark)
    sinks.write_ledger(t, path)
    back = spark.read.option("header", True).csv(path)
    kinds = dict(t.dtypes)
    back = back.select(*[F.col(there).cast(kinds[here]).alias(here) for here, there in sinks.LEDGER_COLUMNS.items()])
    # whole units of the file's eight decimals, so that nothing is rounded twice
    return back.withColumn("return_e8", F.round(F.col("return_pct") * 1e8).cast("bigint")).drop("return_pct")


oracle("ledger_file", f"""SELECT symbol, strategy, entry_time, {ms('entry_price')}, exit_time, {ms('exit_price', 'quantity', 'gross_pnl', 'fees', 'net_pnl')},
 round(return_pct * 1e8)::BIGINT AS return_e8, holding_bars::BIGINT AS holding_bars FROM m_led WHERE strategy = 'emaCrossover' AND scenario = 'BASE'""", "m_led")


@query
def equity_file(spark, sf):
    """The crossover equity curve through its CSV files, one folder for each run."""
    t = ledgers(spark, sf, ["emaCrossover"], only=("BASE",))
    path = files.scratch_folder(spark)
    sinks.write_equity(curves(spark, sf, t, ["emaCrossover"]).where("scenario = 'BASE'"), path, ["symbol", "scenario"])
    back = spark.read.option("header", True).csv(path)
    return back.select("symbol", "scenario", F.col("timestamp").cast("timestamp").alias("ts"), F.round(F.col("equity").cast("double") * 1e4).cast("bigint").alias("equity_e4"))


oracle("equity_file", "SELECT symbol, scenario, ts, round(equity * 1e4)::BIGINT AS equity_e4 FROM m_eq WHERE strategy = 'emaCrossover' AND scenario = 'BASE'", "m_eq")


@query
def summary_file(spark, sf):
    """Run metrics through their JSON summaries."""
    t = ledgers(spark, sf, ["emaCrossover"])
    m = mt.run_metrics(curves(spark, sf, t, ["emaCrossover"]), t, RUN, BAR_MS, CAPITAL)
    path = files.scratch_folder(spark)
    sinks.write_summary(m.select(*RUN, "trade_count", "total_return_pct", "max_drawdown_pct"), path, RUN)
    return spark.read.json(path).select("meta.symbol", "meta.strategy", "meta.scenario", F.col("meta.size_pct").cast("double").alias("size_pct"),
                                        "results.trade_count", "results.total_return_pct", "results.max_drawdown_pct")


oracle("summary_file", f"""SELECT symbol, strategy, scenario, size_pct, trade_count, {rs('total_return_pct', 'max_drawdown_pct')}
 FROM m_all WHERE strategy = 'emaCrossover'""", "m_all")


@query
def manifest_assets(spark, sf):
    """A manifest of the archives of each symbol, written as one JSON document and read as rows."""
    e = _monthly(spark, sf).groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("rows"))
    archive = F.struct("month", F.concat("symbol", F.lit("-"), "month", F.lit(".csv")).alias("file"), "rows", F.lit("OK").alias("status"))
    assets = e.groupBy("symbol").agg(F.struct(F.sum("rows").alias("fundingRows"), F.sort_array(F.collect_list(archive)).alias("fundingArchives")).alias("a"))
    doc = assets.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "a"))).alias("assets")).select(F.to_json(F.struct("assets")).alias("value"))
    path = files.scratch_folder(spark)
    doc.write.text(path)
    return manifest.manifest_archives(manifest.read_manifest(spark, path), "fundingArchives").select("symbol", "month", "file", "rows", "status")


oracle("manifest_assets", f"""SELECT symbol, month, symbol || '-' || month || '.csv' AS file, count(*) AS rows, 'OK' AS status FROM
 (SELECT symbol, {WEEK_MONTH.replace('ts', 'event_time')} AS month FROM cev) GROUP BY 1, 2""", "cev")


# Messages

@query
def feed_messages(spark, sf):
    """Each tick as a message of one of eight shapes, among them broken, unknown and unusable ones."""
    t = derive.ticks(spark, sf)
    ms_, price = _millis("ts"), F.col("price").cast("string")
    index, rate = (F.col("price") + 1).cast("string"), ((F.col("price") - 1050) / 100_000).cast("string")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    flat = [lambda c: text('{"symbol":"', F.col("symbol"), '","interval":"15m","bar_time":', ms_, ',"open":"', price, '","high":"', index,
                           '","low":"', price, '","close":"', c, '","volume":"3","isFinal":', F.when(F.col("seq") % 16 == 0, "false").otherwise("true"), "}")]
    shapes = [
        flat[0](price),
        text('{"e":"kline","s":"', F.col("symbol"), '","k":{"T":', ms_, ',"i":"15m","o":"', price, '","h":"', index, '","l":"', price, '","c":"', price,
             '","v":"3","x":true}}'),
        text('{"symbol":"', F.col("symbol"), '","markPrice":"', price, '","indexPrice":"', index, '","fundingRate":"', rate, '","time":', ms_, "}"),
        text('{"e":"markPriceUpdate","s":"', F.col("symbol"), '","p":"', price, '","i":"', index, '","r":"', rate, '","E":', ms_, "}"),
        text('{"symbol":"', F.col("symbol"), '","open":"', price, '","close":"', index, '","volume":"7","time":', ms_, "}"),
        text('{"symbol":"', F.col("symbol")),
        text('{"hello":', price, "}"),
        flat[0](F.lit("n/a"))]
    body = F.element_at(F.array(*shapes), (F.col("seq") % 8 + 1).cast("int"))
    p = messages.parse_feed(t.select("seq", body.alias("value")))
    used = F.col("reject").isNull()
    change = F.when(used & (F.col("kind") == "ticker"), (F.col("close") - F.col("open")) / F.col("open") * 100)
    return p.select("seq", "kind", "reject", *[F.when(used, F.col(c)).alias(c) for c in (
        "symbol", "ts", "open", "high", "close", "mark_price", "index_price", "funding_rate", "is_final")], change.alias("change_pct"))


oracle("feed_messages", f"""SELECT seq, CASE WHEN k IN (0, 1, 7) THEN 'kline' WHEN k IN (2, 3) THEN 'mark' WHEN k = 4 THEN 'ticker' END AS kind,
 CASE k WHEN 5 THEN 'not JSON' WHEN 6 THEN 'unknown shape' WHEN 7 THEN 'no price' END AS reject, CASE WHEN k < 5 THEN symbol END AS symbol,
 CASE WHEN k < 5 THEN make_timestamp(epoch_us(ts) // 1000 * 1000) END AS ts, {r('CASE WHEN k IN (0, 1, 4) THEN price END', 'open')},
 {r('CASE WHEN k IN (0, 1) THEN price + 1 END', 'high')}, {r('CASE WHEN k IN (0, 1) THEN price WHEN k = 4 THEN price + 1 END', 'close')},
 {r('CASE WHEN k IN (2, 3) THEN price END', 'mark_price')}, {r('CASE WHEN k IN (2, 3) THEN price + 1 END', 'index_price')},
 {r('CASE WHEN k IN (2, 3) THEN (price - 1050) / 100000 END', 'funding_rate')},
 CASE WHEN k < 5 THEN NOT (k = 0 AND seq % 16 = 0) END AS is_final, {r('CASE WHEN k = 4 THEN (price + 1 - price) / price * 100 END', 'change_pct')}
 FROM (SELECT *, seq % 8 AS k FROM ticks)""", "ticks")
