"""Small fixtures of bars."""

from datetime import datetime, timedelta

import numpy as np

START = datetime(2023, 1, 3, 14, 30)


def wave(n=180, start=START, seconds=60, price=12000.0, instrument="A"):
    """A slow wave with varying ranges and volumes."""
    out = []
    for i in range(n):
        close = price + 0.03 * i + 2 * np.sin(i / 5)
        open_ = close - 0.3 * np.cos(i / 3)
        high, low = max(open_, close) + 0.5 + 0.2 * np.sin(i) ** 2, min(open_, close) - 0.4 - 0.1 * np.cos(i) ** 2
        out.append((instrument, start + timedelta(seconds=seconds * i), float(open_), float(high), float(low), float(close), float(100 + 13 * i % 101)))
    return out


def flat(n=60, price=100.0, start=START, instrument="A"):
    return [(instrument, start + timedelta(minutes=i), price, price + 0.5, price - 0.5, price, 10.0) for i in range(n)]


SCHEMA = "instrument string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
