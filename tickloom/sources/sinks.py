"""Sinks: ledgers, equity curves, run summaries, partitioned bar tables."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The ledger's file columns, in order, with the decimals written.
LEDGER_COLUMNS = {
    "symbol": "symbol", "strategy": "strategy", "entry_time": "entryTime", "entry_price": "entryPrice",
    "exit_time": "exitTime", "exit_price": "exitPrice", "quantity": "quantity", "gross_pnl": "grossPnl",
    "fees": "fees", "net_pnl": "netPnl", "return_pct": "returnPct", "holding_bars": "holdingBars",
}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def ledger_rows(trades: DataFrame) -> DataFrame:
    types = dict(trades.dtypes)

    def out(c):
        if types[c] == "double":
            return F.round(c, 8)
        return F.date_format(c, ISO) if types[c] == "timestamp" else F.col(c)

    return trades.select(*[out(c).alias(n) for c, n in LEDGER_COLUMNS.items()])


def write_ledger(trades: DataFrame, path: str) -> None:
    ledger_rows(trades).write.mode("overwrite").option("header", True).csv(path)


def equity_rows(equity: DataFrame, keys: list[str]) -> DataFrame:
    return equity.select(*keys, F.date_format("ts", ISO).alias("timestamp"), F.round("equity", 4).alias("equity"))


def write_equity(equity: DataFrame, path: str, keys: list[str]) -> None:
    equity_rows(equity, keys).write.mode("overwrite").partitionBy(*keys).option("header", True).csv(path)


def write_summary(metrics: DataFrame, path: str, meta: list[str], warnings: str | None = None) -> None:
    """One JSON object per run: meta, results and warnings."""
    rest = [c for c in metrics.columns if c not in meta and c != warnings]
    parts = [F.struct(*meta).alias("meta"), F.struct(*rest).alias("results")]
    if warnings:
        parts.append(F.col(warnings).alias("warnings"))
    metrics.select(*parts).write.mode("overwrite").json(path)


def write_bars(bars: DataFrame, path: str, keys=("symbol",)) -> None:
    """Bar table by key and month; only the months present are replaced."""
    d = bars.withColumn("month", F.date_format("ts", "yyyy-MM"))
    # Spread by key and month: a file set per month, none of them larger than a month of one key.
    (d.repartition(*keys, "month").sortWithinPartitions(*keys, "ts").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "month").parquet(path))
