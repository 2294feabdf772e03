"""Signal rules as pairs of boolean columns: ``set_long`` and ``reset``.

Rules do not know whether a position is held; ``operators.positions`` turns the two
columns into positions. Each rule reads feature columns of ``with_signal_features``.
"""
from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions.scalars import interval_millis
from tickloom.operators.sequence import BLOCK, block_window, blocked, owned

# Thresholds of the rules.
RSI_ENTRY, RSI_ENTRY_CAP, RSI_EXIT = 40, 55, 60
MAX_DAY_CROSSES = 4
MAX_ATR_PCT = 0.629
BREAKOUT_BARS = {"15m": 96, "1h": 24, "4h": 6}


@dataclass(frozen=True)
class Rule:
    name: str
    set_long: Callable[[bool], Column]
    reset: Callable[[], Column]
    interval: str = "15m"
    live: bool = False
    needs: frozenset = frozenset()


def _c(name):
    return F.col(name)


def _trend_up():
    return (_c("close") > _c("ema50")) & (_c("ema50") > _c("_ema50_prev"))


def _death():
    return _c("_t_death")


def _breakout(bars: int):
    def rule(strict_warmup: bool) -> Column:
        # The rule is live once the highs, the current one included, reach the window;
        # strict_warmup asks for that many prior highs.
        seen = _c("ord") + (0 if strict_warmup else 1)
        return (_c("ord") >= 49) & (seen >= bars) & _trend_up() & (_c("close") > _c(f"_high{bars}"))
    return rule


RULES: dict[str, Rule] = {r.name: r for r in [
    Rule("emaCrossover", lambda _: _c("_s_golden"), lambda: _c("_s_death"), live=True),
    Rule("rsiEma",
         lambda _: (_c("ord") >= 51) & (_c("close") > _c("ema50")) & (_c("ema9") > _c("ema21"))
         & (_c("rsi") > RSI_ENTRY) & (_c("_rsi_prev") <= RSI_ENTRY) & (_c("rsi") < RSI_ENTRY_CAP),
         lambda: (_c("ord") >= 51) & (_c("_s_death")
                                      | ((_c("rsi") < RSI_EXIT) & (_c("_rsi_prev") >= RSI_EXIT))),
         live=True, needs=frozenset({"rsi"})),
    Rule("emaTrendFilter", lambda _: _c("_t_golden") & _trend_up(), _death),
    Rule("emaTrendDensityFilter",
         lambda _: _c("_t_golden") & _trend_up() & (_c("_day_crosses") < MAX_DAY_CROSSES),
         _death, needs=frozenset({"density"})),
    Rule("emaTrendVolFilter",
         lambda _: _c("_t_golden") & _trend_up() & (_c("atr14") / _c("close") * 100 < MAX_ATR_PCT),
         _death, needs=frozenset({"atr"})),
    Rule("emaConfirmation",
         lambda _: _c("_confirm") & (_c("ema9") > _c("ema21")) & (_c("close") > _c("_high_prev")),
         lambda: _c("_s_death")),
    Rule("trendPullbackReclaim",
         lambda _: (_c("ord") >= 50) & _trend_up() & (_c("ema9") > _c("ema21"))
         & (_c("_close_prev") <= _c("_ema9_prev")) & (_c("close") > _c("ema9")), _death),
    Rule("breakout24hTrend", _breakout(96), _death, needs=frozenset({96})),
    Rule("breakout24h1h", _breakout(24), _death, "1h", needs=frozenset({24})),
    Rule("breakout24h4h", _breakout(6), _death, "4h", needs=frozenset({6})),
]}


def list_rules() -> list[str]:
    return list(RULES)


def live_rules() -> list[str]:
    return [r.name for r in RULES.values() if r.live]


def research_rules() -> list[str]:
    return [r.name for r in RULES.values() if not r.live]


def get_rule(name: str) -> Rule:
    if name not in RULES:
        raise ValueError(f"unknown strategy {name!r}; available: {', '.join(RULES)}")
    return RULES[name]


def register_rule(rule: Rule) -> None:
    """Add a user rule: two column builders over the feature columns."""
    RULES[rule.name] = rule


def look_back(rules: list[Rule], interval: str | int) -> int:
    needs = frozenset().union(*[r.needs for r in rules])
    back = ind.LOOKBACK["buffered"]
    for need in needs:
        if isinstance(need, int):
            back = max(back, need)
    if "density" in needs:
        back = max(back, ind.DAY_MICROS // (interval_millis(interval) * 1000) + ind.LOOKBACK["buffered"])
    if "atr" in needs:
        back = max(back, ind.LOOKBACK["long"])
    return back


def with_signal_features(bars: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """Feature columns for ``rules`` on blocked bars; only what the rules need."""
    needs = frozenset().union(*[r.needs for r in rules])
    w = block_window(keys)
    out = ind.with_buffered_emas(bars, keys)
    if "rsi" in needs:
        out = ind.with_rsi(out, keys)
        out = out.withColumn("_rsi_prev", F.lag("rsi").over(w))
    out = out.withColumns({"_s": ind.cross_state("ema9", "ema21", 20),
                           "_t": ind.cross_state("ema9", "ema21", 49)})
    out = ind.with_cross(ind.with_cross(out, keys, "_s", "_s_"), keys, "_t", "_t_")
    more = {
        "_ema50_prev": F.lag("ema50").over(w),
        "_ema9_prev": F.lag("ema9").over(w),
        "_close_prev": F.lag("close").over(w),
        "_high_prev": F.lag("high").over(w),
        "_confirm": F.coalesce(F.lag("_s_golden").over(w), F.lit(False)),
    }
    if "density" in needs:
        more["_day_crosses"] = ind.crosses_in_time(F.col("_t_golden") | F.col("_t_death"), keys)
    for need in needs:
        if isinstance(need, int):
            more[f"_high{need}"] = ind.prior_high(keys, need)
    out = out.withColumns(more)
    if "atr" in needs:
        out = out.withColumn("_tr", ind.true_range(keys))
        out = ind.with_long_averages(out, keys, {"atr14": ind.wilder_spec()})
    return out


def signals(bars: DataFrame, strategies: list[str], keys=("symbol",), interval: str | int | None = None,
            strict_warmup: bool = False, block: int = BLOCK) -> DataFrame:
    """Long table of rule outputs: keys, strategy, ord, ts, bar, next bar, set_long, reset.

    ``bars`` must carry ``ord``. Rules made for bars of another length than ``interval`` are refused; with no
    ``interval`` the bars are taken to have the length the rules ask for. Rows stay in their block (``_blk``) so that the position
    operators need no further exchange; the next bar's columns are NULL on the last bar.
    """
    keys = list(keys)
    rules = [get_rule(s) for s in strategies]
    other = [f"{r.name} ({r.interval})" for r in rules
             if interval is not None and interval_millis(r.interval) != interval_millis(interval)]
    if other:
        raise ValueError(f"rules for bars of another length than {interval}: {', '.join(other)}")
    if interval is None:
        interval = min((r.interval for r in rules), key=interval_millis)
    back = look_back(rules, interval)
    if "atr" in frozenset().union(*[r.needs for r in rules]) and block % ind.SUB:
        raise ValueError(f"block must be a multiple of {ind.SUB} for rules over long averages")
    b = blocked(bars, back=back, fwd=1, block=block)
    f = with_signal_features(b, keys, rules)
    w = block_window(keys)
    f = f.withColumns({f"nxt_{c}": F.lead(c).over(w) for c in ("ts", "open", "high", "low")})
    f = owned(f, block)
    pairs = [F.struct(F.lit(r.name).alias("strategy"),
                      F.coalesce(r.set_long(strict_warmup), F.lit(False)).alias("set_long"),
                      F.coalesce(r.reset(), F.lit(False)).alias("reset")) for r in rules]
    base = [*keys, "_blk", "ord", "ts", "open", "high", "low", "close",
            "nxt_ts", "nxt_open", "nxt_high", "nxt_low"]
    return f.select(*base, F.explode(F.array(*pairs)).alias("_r")).select(*base, "_r.*")


def python_rule(bars: DataFrame, rule: Callable, back: int, keys=("symbol",), strategy: str = "custom",
                block: int = BLOCK) -> DataFrame:
    """Signals of a Python rule that needs at most ``back`` earlier bars.

    ``rule`` gets the bars of one block as a pandas frame in order, ``back`` bars of its past
    included, and returns two boolean sequences (set_long, reset). It never sees a whole
    series, so blocks of a long one run in parallel.
    """
    keys = list(keys)
    cols = [*keys, "_blk", "ord", "ts", "open", "high", "low", "close", "volume"]
    b = blocked(bars, back=back, fwd=1, block=block).select(*cols)
    types = dict(b.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", set_long boolean, reset boolean"

    def one_block(pdf):
        pdf = pdf.sort_values("ord")
        # The bar after the block is only there for its fill; the rule must not see it.
        own = pdf[pdf["ord"] < (pdf["_blk"].iloc[0] + 1) * block]
        up, down = rule(own)
        own = own.assign(set_long=list(up), reset=list(down))
        tail = pdf[pdf["ord"] >= (pdf["_blk"].iloc[0] + 1) * block].assign(set_long=False, reset=False)
        return type(pdf)({c: list(own[c]) + list(tail[c]) for c in own.columns})

    f = b.groupBy(*keys, "_blk").applyInPandas(one_block, schema)
    w = block_window(keys)
    f = f.withColumns({f"nxt_{c}": F.lead(c).over(w) for c in ("ts", "open", "high", "low")})
    return owned(f, block).withColumn("strategy", F.lit(strategy)).drop("volume")
