"""Keyed state machines on streams: live signals, cooldown, breakers.

All run on ``in_order``: rows wait in the state of their key until the watermark has passed them and are then
applied in order of time, whatever order they arrived in. A row that arrives behind the watermark is not applied and
not lost either: it comes out with ``late`` set. So the rows that are not late give what a batch over them gives
(``streaming.replay`` states which rows those are).

The state needs the RocksDB store: set ``spark.sql.streaming.stateStore.providerClass`` to ``STATE_STORE``.
"""
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Fixed values.
BUFFER = 60
COOLDOWN_SECONDS = 300
LOSS_LIMIT = 5
ERROR_LIMIT = 10
ERROR_WINDOW_SECONDS = 300
BREAKER_SECONDS = 3600


def ema(prices: list[float], period: int) -> float | None:
    if len(prices) < period:
        return None
    k = 2.0 / (period + 1)
    value = sum(prices[:period]) / period
    for price in prices[period:]:
        value = price * k + value * (1 - k)
    return value


def rsi(prices: list[float], period: int = 14) -> float | None:
    if len(prices) <= period:
        return None
    steps = [b - a for a, b in zip(prices[-period - 1:], prices[-period:])]
    gain = sum(max(s, 0.0) for s in steps) / period
    loss = sum(max(-s, 0.0) for s in steps) / period
    return 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)


def crossover_flags(prices: list[float], seen: int, memory: tuple) -> tuple[bool, bool, tuple]:
    """(set, reset, memory) of the 9/21 crossover; memory is (previous cross state,)."""
    fast, slow = ema(prices, 9), ema(prices, 21)
    if slow is None:
        return False, False, memory
    above = float(fast > slow)
    before = memory[0]
    return before == 0.0 and above == 1.0, before == 1.0 and above == 0.0, (above, *memory[1:])


def rsi_flags(prices: list[float], seen: int, memory: tuple) -> tuple[bool, bool, tuple]:
    """(set, reset, memory) of the RSI pullback rule; memory is (fast above slow, RSI)."""
    if len(prices) < 51:
        return False, False, memory
    fast, slow, trend, now = ema(prices, 9), ema(prices, 21), ema(prices, 50), rsi(prices)
    was_above, was = memory
    known = was is not None
    up = known and was <= 40 < now < 55 and prices[-1] > trend and fast > slow
    down = known and ((was_above == 1.0 and not fast > slow) or (was >= 60 > now))
    return up, down, (float(fast > slow), now)


RULES: dict[str, Callable] = {"emaCrossover": crossover_flags, "rsiEma": rsi_flags}

# --- rows in order of time ----------------------------------------------------------

class InOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark passes them.

    ``pending`` is a map from (time, further order) to the row, so a row sent twice is held once; a timer just behind each
    time wakes the key. ``step`` takes the rows that are due, in order, and the key's memory (None at first), and gives
    output rows and the memory to keep.
    """

    def __init__(self, columns: list[str], kinds: dict[str, str], order: list[str], step: Callable, memory: str, fields: list[str]):
        self.columns, self.kinds, self.order, self.step, self.memory, self.fields = columns, kinds, order, step, memory, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        places = ", ".join(f"{c} {self.kinds[c]}" for c in self.order)
        self.pending = handle.getMapState("pending", f"at bigint{', ' * bool(places)}{places}",
                                          ", ".join(f"{c} {self.kinds[c]}" for c in self.columns))
        self.kept = handle.getValueState("kept", self.memory)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        late, times = [], set()
        for part in rows:
            names = list(part.columns)
            for row in part.itertuples(index=False, name=None):
                row = dict(zip(names, row))
                at = row["at_micros"]
                if at < watermark * 1000:
                    late.append((*key, at, *[None] * len(self.fields), True))
                    continue
                place = (at, *[row[c] for c in self.order])
                if not self.pending.containsKey(place):
                    self.pending.updateValue(place, tuple(row[c] for c in self.columns))
                    times.add(at // 1000 + 1)
        for at in times:
            self.handle.registerTimer(at)
        yield self._frame(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((tuple(place), tuple(row)) for place, row in self.pending.iterator() if place[0] < watermark)
        if due:
            for place, _ in due:
                self.pending.removeKey(place)
            kept = tuple(self.kept.get()) if self.kept.exists() else None
            out, kept = self.step([(place[0], *row) for place, row in due], kept)
            if kept is not None:
                self.kept.update(kept)
            yield self._frame(key, [(*key, at, *fields, False) for at, *fields in out])
        else:
            yield self._frame(key, [])

    def _frame(self, key, rows) -> pd.DataFrame:
        names = [*(f"key_{i}" for i in range(len(key))), "at_micros", *self.fields, "late"]
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], columns: list[str], step: Callable, memory: str, out: str, delay: str,
             order: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ts, ``out``, late): ``step`` over the rows (keys, ts, columns) of each key, in order of ts and ``order``.

    Rows up to ``delay`` behind the newest of the stream are waited for. Rows farther behind come out as
    (keys, ts, nulls, late = true). ``memory`` is the schema of what a key remembers between steps. The watermark of
    ``rows`` is set here; an earlier one on another column is not allowed.
    """
    provider = rows.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if provider != STATE_STORE:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass is {provider!r}, has to be {STATE_STORE!r}")
    kinds = dict(rows.dtypes)
    fields = StructType.fromDDL(out)
    # a copy of the time without the mark of an event-time column: Spark would drop late rows before the state sees them
    held = rows.withWatermark("ts", delay).select(*keys, F.unix_micros("ts").alias("at_micros"), *dict.fromkeys([*columns, *order]))
    schema = ", ".join([*(f"key_{i} {kinds[k]}" for i, k in enumerate(keys)), "at_micros bigint", out, "late boolean"])
    done = held.groupBy(*keys).transformWithStateInPandas(
        InOrder(columns, kinds, list(order), step, memory, fields.names), schema, "Append", "EventTime")
    return done.select(*(F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)), F.timestamp_micros("at_micros").alias("ts"), *fields.names, "late")


def on_time(out: DataFrame) -> DataFrame:
    """What was done with the rows that came in time."""
    return out.where("NOT late").drop("late")


def late_rows(out: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and times of the rows that came behind the watermark."""
    return out.where("late").select(*keys, "ts")


# --- what is done with them ---------------------------------------------------------

def signal_steps(rule: str, needs_position: bool) -> Callable:
    flags = RULES[rule]

    def step(rows, memory):
        prices, seen, m0, m1, held = memory or ([], 0, None, None, False)
        prices, known = list(prices), (m0, m1)
        out = []
        for at, close, warm in rows:
            prices = [*prices, float(close)][-BUFFER:]
            seen += 1
            up, down, known = flags(prices, seen, known)
            if warm:
                continue
            if up and not (needs_position and held):
                held = True
                out.append((at, float(close), "LONG"))
            elif down and (held or not needs_position):
                held = False
                out.append((at, float(close), "CLOSE"))
        return out, (prices, seen, *known, held)
    return step


def live_signals(bars: DataFrame, rule: str = "emaCrossover", needs_position: bool = True, delay: str = "1 hour") -> DataFrame:
    """(symbol, ts, close, action, late): LONG and CLOSE by final bar; on the bars in time equal to the batch rule.

    ``bars``: symbol, ts, close, warmup; of several bars of one time the first to arrive counts. Warm-up rows feed the
    state but do not act. With ``needs_position`` the state tracks the position the emitted actions imply.
    """
    return in_order(bars, ["symbol"], ["close", "warmup"], signal_steps(rule, needs_position),
                    "prices array<double>, seen bigint, m0 double, m1 double, held boolean", "close double, action string", delay)


def cooldown(entries: DataFrame, seconds: float = COOLDOWN_SECONDS, delay: str = "1 minute") -> DataFrame:
    """(symbol, ts, allowed, late): false within ``seconds`` of the last allowed entry. Entries (symbol, ts) of one time are one."""
    span = int(seconds * 1_000_000)

    def step(rows, memory):
        last, out = memory[0] if memory else None, []
        for at, *_ in rows:
            ok = last is None or at - last >= span
            last = at if ok else last
            out.append((at, ok))
        return out, (last,)

    return in_order(entries.withColumn("one", F.lit(1)), ["symbol"], ["one"], step, "last bigint", "allowed boolean", delay)


def _expiring(out: DataFrame, seconds: float) -> DataFrame:
    return out.withColumnRenamed("ts", "tripped_at").withColumn(
        "expires_at", F.timestamp_micros(F.unix_micros("tripped_at") + int(seconds * 1_000_000)))


def loss_breaker(closes: DataFrame, key: str = "account", limit: int = LOSS_LIMIT, seconds: float = BREAKER_SECONDS,
                 delay: str = "1 minute", order: tuple[str, ...] = ("pnl",)) -> DataFrame:
    """A row per trip: ``limit`` losses in a row; a trip restarts the count. ``order`` tells closes of one time apart."""
    def step(rows, memory):
        streak, out = memory[0] if memory else 0, []
        for at, pnl in rows:
            streak = streak + 1 if pnl < 0 else 0
            if streak >= limit:
                out.append((at, limit))
                streak = 0
        return out, (streak,)

    done = in_order(closes, [key], ["pnl"], step, "streak int", "losses int", delay, order)
    return _expiring(done, seconds).select(key, "tripped_at", "expires_at", "late")


def error_breaker(errors: DataFrame, key: str = "account", limit: int = ERROR_LIMIT, window_seconds: float = ERROR_WINDOW_SECONDS,
                  seconds: float = BREAKER_SECONDS, delay: str = "1 minute", order: tuple[str, ...] = ()) -> DataFrame:
    """A row per error from the ``limit``-th on within a window anchored at its first error.

    A window ends only when an error comes later than ``window_seconds`` after its start, so
    it is neither sliding nor a session. ``order`` names the columns that tell errors of one time apart.
    """
    width = int(window_seconds * 1_000_000)

    def step(rows, memory):
        start, count = memory or (None, 0)
        out = []
        for at, *_ in rows:
            if start is None or at - start > width:
                start, count = at, 0
            count += 1
            if count >= limit:
                out.append((at, count))
        return out, (start, count)

    done = in_order(errors.withColumn("one", F.lit(1)), [key], ["one"], step, "start bigint, errors int", "errors int", delay, order)
    return _expiring(done, seconds).select(key, "tripped_at", "expires_at", "errors", "late")
