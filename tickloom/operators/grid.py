"""Folds, scenarios and sizes as key columns of one plan."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import positions as pos
from tickloom.operators.sequence import BLOCK


def periods_table(spark, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """Named half-open UTC ranges [start, end)."""
    rows = [(n, a, b) for n, (a, b) in periods.items()]
    p = spark.createDataFrame(rows, "period string, period_start string, period_end string")
    return p.withColumns({c: F.col(c).cast("timestamp") for c in ("period_start", "period_end")})


def slice_periods(df: DataFrame, periods: DataFrame, ts: str = "ts") -> DataFrame:
    """Each row once per period holding it (periods may overlap); the few periods are broadcast."""
    inside = (F.col(ts) >= F.col("period_start")) & (F.col(ts) < F.col("period_end"))
    return df.join(F.broadcast(periods), inside)


def split_train_test(df: DataFrame, train: tuple[str, str], test: tuple[str, str], ts: str = "ts") -> DataFrame:
    """Rows of two half-open, non-overlapping ranges with a ``segment`` label."""
    if not (train[0] < train[1] and test[0] < test[1]):
        raise ValueError("a range must end after it starts")
    if max(train[0], test[0]) < min(train[1], test[1]):
        raise ValueError("train and test ranges overlap")

    def within(r):
        return (F.col(ts) >= F.lit(r[0]).cast("timestamp")) & (F.col(ts) < F.lit(r[1]).cast("timestamp"))

    return df.withColumn("segment", F.when(within(train), "train").when(within(test), "test")).filter(
        F.col("segment").isNotNull())


def require_segments(df: DataFrame, names=("train", "test")) -> DataFrame:
    """Raise when a segment of ``split_train_test`` has no rows."""
    have = {r[0] for r in df.select("segment").distinct().limit(len(names) + 1).collect()}
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"no rows in segment: {', '.join(missing)}")
    return df


def fold_signals(signals: DataFrame, folds: DataFrame) -> DataFrame:
    """Signals of every fold: bars up to the fold's end, the last of which acts no more.

    Rules only look back, so they are evaluated once for all folds.
    """
    s = signals.crossJoin(F.broadcast(folds)).filter(F.col("ts") < F.col("period_end"))
    inside = F.col("nxt_ts") < F.col("period_end")
    return s.withColumns({c: F.when(inside, F.col(c)) for c in ("nxt_open", "nxt_high", "nxt_low")}).withColumn(
        "nxt_ts", F.when(inside, F.col("nxt_ts")))


def fold_bars(bars: DataFrame, folds: DataFrame) -> DataFrame:
    return bars.crossJoin(F.broadcast(folds)).filter(F.col("ts") < F.col("period_end"))


def scored(df: DataFrame, ts: str) -> DataFrame:
    """Only what falls into the fold's own range; trades count by entry time."""
    return df.filter((F.col(ts) >= F.col("period_start")) & (F.col(ts) < F.col("period_end")))


def run_ledger(signals: DataFrame, keys: list[str], costs: DataFrame, capital: float = 10_000.0,
               block: int = BLOCK) -> DataFrame:
    """Signals to trades once per rule, then to ledgers for every cost row."""
    trades = pos.raw_trades(pos.hold(signals, keys), keys)
    return pos.ledger(trades, keys, costs, capital, block)


def run_list(costs: DataFrame, strategies: list[str]) -> DataFrame:
    names = F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy")
    return costs.select(names, "scenario", "size_pct")
