"""Row-by-row statements of the rules for small series, to test the window plans against."""


def ema(xs, p):
    if len(xs) < p:
        return None
    e = sum(xs[:p]) / p
    for x in xs[p:]:
        e = x * (2 / (p + 1)) + e * (1 - 2 / (p + 1))
    return e


def rsi(xs, p=14):
    if len(xs) <= p:
        return None
    d = [b - a for a, b in zip(xs[-p - 1:], xs[-p:])]
    g, lo = sum(x for x in d if x > 0) / p, sum(-x for x in d if x < 0) / p
    return 100.0 if lo == 0 else 100 - 100 / (1 + g / lo)


def flags(rows, rule):
    """(set, reset) per bar. rows: (symbol, ts, o, h, l, c, v, ord)."""
    out = []
    closes = [r[5] for r in rows]
    prev = {}
    for i, r in enumerate(rows):
        buf = closes[max(0, i - 59):i + 1]
        e9, e21, e50 = (ema(buf, p) for p in (9, 21, 50))
        first = 20 if rule in ("emaCrossover", "emaConfirmation") else 50 if rule == "rsiEma" else 49
        now = {}
        up = down = False
        if i >= first:
            now = {"above": e9 > e21, "e50": e50, "rsi": rsi(buf)}
            golden = prev.get("above") is False and now["above"]
            death = prev.get("above") is True and not now["above"]
            rising = e50 is not None and prev.get("e50") is not None and e50 > prev["e50"] and r[5] > e50
            if rule == "emaCrossover":
                up, down = golden, death
            elif rule == "rsiEma":
                p = prev.get("rsi")
                up = p is not None and p <= 40 < now["rsi"] < 55 and r[5] > e50 and e9 > e21
                down = death or (p is not None and p >= 60 > now["rsi"])
            elif rule == "emaTrendFilter":
                up, down = golden and rising, death
            else:
                n = {"breakout24hTrend": 96, "breakout24h1h": 24, "breakout24h4h": 6}[rule]
                highs = [x[3] for x in rows[max(0, i - n):i]]
                up = i + 1 >= n and rising and bool(highs) and r[5] > max(highs)
                down = death
        out.append((bool(up), bool(down)))
        prev = now
    return out


def simulate(rows, marks, commission, slippage, size, capital=10_000.0):
    """Trades and equity of next-bar execution, one long position at a time."""
    cash, held, entry, pending = capital, False, None, None
    trades, curve = [], []
    for i, (r, (up, down)) in enumerate(zip(rows, marks)):
        if pending == "in":
            price = r[2] * (1 + slippage)
            notional = cash * size / (1 + commission)
            entry = (i, price, notional / price, notional)
            cash -= notional * (1 + commission)
            held = True
        elif pending == "out":
            cash, held = close(trades, entry, i, r[2] * (1 - slippage), commission, cash, False), False
        pending = None
        curve.append(cash + entry[2] * r[5] if held else cash)
        if up and not held:
            pending = "in"
        elif down and held:
            pending = "out"
    if held:
        cash = close(trades, entry, len(rows) - 1, rows[-1][5] * (1 - slippage), commission, cash, True)
        curve[-1] = cash
    return trades, curve


def close(trades, entry, i, price, commission, cash, forced):
    at, paid, qty, notional = entry
    gross, fees = (price - paid) * qty, notional * commission + price * qty * commission
    trades.append({"entry_ord": at, "exit_ord": i, "entry_price": paid, "exit_price": price, "quantity": qty,
                   "gross_pnl": gross, "fees": fees, "net_pnl": gross - fees, "forced": forced})
    return cash + price * qty * (1 - commission)
