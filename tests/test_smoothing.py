"""Smoothing against the recursion, row by row."""
import datetime as dt
import math

import numpy as np
import pytest

from tidegauge.operators.axis import DAILY, Axis
from tidegauge.operators.recursive import smooth, span, wilder

DAY0 = dt.date(1950, 1, 1)


def slow(x, alpha, least):
    y, gap, n, out = None, 0, 0, []
    for v in x:
        gap += 1
        if v is not None:
            d = (1 - alpha) ** gap
            y = v if y is None else (d * y + alpha * v) / (d + alpha)
            gap, n = 0, n + 1
        out.append(y if n >= least else None)
    return out


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    n = 6000
    walk = np.cumsum(rng.normal(size=n)) + 100
    return {
        "plain": walk.tolist(), "gaps": [None if rng.random() < 0.3 else float(v) for v in walk], "late": [None] * 700 + walk[700:].tolist(),
        "holes": [float(v) if i % 1500 < 400 else None for i, v in enumerate(walk)], "signs": [float(v) for v in rng.normal(size=n) * 10.0 ** rng.integers(-3, 6, n)],
        "flat": [5.0] * 3000, "none": [None] * 40, "one": [None, 3.5, None], "zeros": [1.0] + [0.0] * 3000}


SPECS = {"fast": ("value", span(2), 1), "e12": ("value", span(12), 12), "e200": ("value", span(200), 200), "w14": ("value", wilder(14), 14), "w1": ("value", wilder(1), 1),
         "other": ("half", span(20), 3)}


@pytest.mark.parametrize("rows", [None, 50, 900])
def test_smoothing_row_by_row(spark, series, rows):
    data = [(k, DAY0 + dt.timedelta(days=i), v, None if v is None or i % 2 else v / 2, "x") for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "series_id string, date date, value double, half double, tag string")
    got = smooth(df, DAILY, SPECS, target_rows=rows)
    assert got.columns == [*df.columns, *SPECS] and got.count() == len(data)
    table = {}
    for r in got.orderBy("series_id", "date").collect():
        table.setdefault(r.series_id, []).append(r)
    for k, x in series.items():
        for out, (col, alpha, least) in SPECS.items():
            want = slow([r[col] for r in table[k]], alpha, least)
            have = [r[out] for r in table[k]]
            assert [v is None for v in want] == [v is None for v in have], (k, out)
            scale = max((abs(v) for v in x if v is not None), default=1.0)
            assert all(a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-11 * scale) for a, b in zip(want, have)), (k, out)


def test_ticks_are_sized(spark):
    rows = [("s", i, float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "series_id string, tick long, value double")
    got = smooth(df, Axis(("series_id",), ("tick",)), {"e": ("value", span(5), 1)}, target_rows=60).orderBy("tick").collect()
    assert np.allclose([r.e for r in got], slow([r[2] for r in rows], span(5), 1), rtol=1e-12)
