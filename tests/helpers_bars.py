"""Bars of the tests: literal candles and the frame that holds them."""
import datetime as dt

T0 = dt.datetime(2024, 1, 1)


def lin(a, b, n):
    return [a + (b - a) * (i + 1) / n for i in range(n)]


def candles(closes, opens=None, step_min=15, symbol="X", highs=None):
    opens = opens or closes
    out = []
    for i, (o, c) in enumerate(zip(opens, closes)):
        h = max(o, c) if highs is None or i not in highs else highs[i]
        out.append((symbol, T0 + dt.timedelta(minutes=step_min * i), float(o), float(h), float(min(o, c)),
                    float(c), 1000.0, i))
    return out


BARS = ("symbol string, ts timestamp, open double, high double, low double, close double, volume double, "
        "ord bigint")


def bar_frame(spark, rows):
    return spark.createDataFrame(rows, BARS)
