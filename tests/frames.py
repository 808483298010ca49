"""Small panels for tests."""

from __future__ import annotations

import datetime as dt
import math
import random

from tidepanel.operators.grid import regular_grid

START = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


def panel(spark, **series):
    """``panel(spark, a=[1, None, 3])``: hourly P, with Q = 10 P; None is a NULL value."""
    rows = [
        (sid, at(i), None if p is None else float(p), None if p is None else 10.0 * p)
        for sid, values in series.items()
        for i, p in enumerate(values)
    ]
    return spark.createDataFrame(rows, "sid string, ts timestamp_ntz, P double, Q double")


def gridded(spark, **series):
    return regular_grid(panel(spark, **series), "H")


def column(df, name="P", sid="a", order="k"):
    return [r[name] for r in df.where(df.sid == sid).orderBy(order).collect()]


VALUES_SEED = 11


def noisy(spark, series, freq="H"):
    """``noisy(spark, {"a": (rows, level)})``: gridded daily waves with noise around a level, complete."""
    rng = random.Random(VALUES_SEED)
    rows = []
    for sid, (n, level) in series.items():
        value = 0.0
        for i in range(n):
            value = 0.6 * value + rng.gauss(0, 1)
            rows.append((sid, at(i), level + 3 * math.sin(i / 4) + value, rng.gauss(0, 1) + 0.3 * value))
    return regular_grid(spark.createDataFrame(rows, "sid string, ts timestamp_ntz, P double, Q double"), freq)
