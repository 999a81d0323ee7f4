"""Neighbour-based mutual information against an estimate point by point."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.scalars import digamma
from tidegauge.operators import profile as Q, selection as S
from tidegauge.plans import views as V
from tidegauge.plans.table_queries import COLS

DAY0 = dt.date(2020, 1, 1)


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def slow(points, neighbours):
    """points: (value, label)"""
    size = {c: sum(1 for _, d in points if d == c) for _, c in points}
    points = [(v, c) for v, c in points if size[c] > 1]
    terms = []
    for i, (v, c) in enumerate(points):
        same = sorted((abs(u - v), u) for j, (u, d) in enumerate(points) if d == c and j != i)
        k = min(neighbours, len(same))
        d = same[k - 1][0]
        if d == 0:
            m = sum(u == v for u, _ in points)
        else:
            low = max((u for x, u in same if x == d and u < v), default=v - d)
            high = min((u for x, u in same if x == d and u > v), default=v + d)
            m = sum(low < u < high for u, _ in points)
        terms.append(psi(k) - psi(size[c]) - psi(m))
    return max(0.0, psi(len(points)) + sum(terms) / len(terms)) if terms else None


def test_digamma(spark):
    got = spark.range(1, 400).select("id", digamma(F.col("id").cast("double")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-11) for r in got)


@pytest.mark.parametrize("rows", [7, 50, 10 ** 6])
def test_information_point_by_point(spark, rows):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, 240)
    label[5] = 9                                                          # a label with one value takes no part
    columns = {"tied": np.round(rng.normal(label, 1.0), 1), "far": rng.normal(label * 2, 0.5), "none": rng.normal(size=240), "flat": np.ones(240),
               "few": np.where(rng.random(240) < 0.1, rng.normal(label), 0.0)}
    days = [DAY0 + dt.timedelta(days=i) for i in range(240)]
    long = [(c, d, None if (i + len(c)) % 11 == 0 else float(x[i])) for c, x in columns.items() for i, d in enumerate(days)]
    labels = [(d, int(c) if i % 17 else None) for i, (d, c) in enumerate(zip(days, label))]
    at = dict(labels)
    got = S.neighbour_information(spark.createDataFrame(long, "column_name string, date date, value double"),
                                  spark.createDataFrame(labels, "date date, label int"), target_rows=rows).collect()
    want = {c: slow([(v, at[d]) for n, d, v in long if n == c and v is not None and at[d] is not None], 3) for c in columns}
    assert {r.column_name for r in got} == set(columns)
    assert all(r.mutual_information == pytest.approx(want[r.column_name], abs=1e-9) for r in got), want
    assert want["far"] > want["tied"] > want["none"]


def test_information_of_the_test_tables(spark, sf):
    sf = sf.replace("sf0.01", "sf0.001")
    long = Q.to_long(V.wide(spark, sf), COLS).where("value is not null")
    labels = long.select("date").distinct().select("date", (F.month("date") % 3).alias("label"))
    got = {r.column_name: r.mutual_information for r in S.neighbour_information(long, labels, target_rows=100).collect()}
    points = {}
    for r in long.collect():
        points.setdefault(r.column_name, []).append((r.value, r.date.month % 3))
    assert set(got) == set(points)
    assert all(got[c] == pytest.approx(slow(p, 3), abs=1e-9) for c, p in points.items())
    assert not any(math.isnan(x) for x in got.values())


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], "column_name string, date date, value double")
    assert S.neighbour_information(empty, spark.createDataFrame([], "date date, label int")).collect() == []
