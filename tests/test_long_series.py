"""Chunked execution of long series equals plain windows, whatever the chunk size."""
import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from tidegauge.functions import rolling as R
from tidegauge.operators import chunks, evaluate as E, joins, recursive
from tidegauge.operators.axis import DAILY

DAY0 = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def frame(spark):
    """One series with most of the rows, gaps, and two short ones."""
    rng = random.Random(7)
    rows = []
    for name, n in (("hot", 900), ("b", 40), ("c", 1)):
        for i in range(n):
            rows.append((name, DAY0 + dt.timedelta(days=i * rng.choice((1, 1, 1)) + 0), None if rng.random() < 0.3 else round(rng.uniform(1, 9), 3)))
    return spark.createDataFrame(rows, "series_id string, date date, value double").persist()


def rows(df, *cols):
    return {(r.series_id, r.date): tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols)
            for r in df.collect()}


@pytest.mark.parametrize("size", [7, 60, 333])
def test_hot_series_are_cut_and_balanced(frame, size):
    lay = chunks.lay_out(frame, DAILY, size)
    assert lay.hot
    counts = {(r.series_id, r._chunk): r["count"] for r in lay.df.groupBy("series_id", "_chunk").count().collect()}
    assert sum(counts.values()) == 941
    assert max(n for (s, _), n in counts.items() if s == "hot") <= 2 * size
    assert {c for s, c in counts if s == "c"} == {0}


def test_no_cut_below_target(frame):
    assert not chunks.lay_out(frame, DAILY, 1000).hot


@pytest.mark.parametrize("size", [7, 60, 333])
def test_unbounded_frames(frame, size):
    want = frame.select("series_id", "date", R.running_sum(DAILY, "value").alias("s"), F.row_number().over(DAILY.base()).cast("long").alias("p"),
                        R.ffill(DAILY, "value").alias("f"), R.running_min(DAILY, "value").alias("m"))
    lay = chunks.lay_out(frame, DAILY, size)
    df = chunks.running_sum(lay, {"s": F.col("value")})
    lay = chunks.Layout(df, DAILY, lay.cuts)
    lay = chunks.Layout(chunks.positions(lay, "p"), DAILY, lay.cuts)
    lay = chunks.Layout(chunks.fill_forward(lay, {"f": F.col("value")}), DAILY, lay.cuts)
    df = lay.done(chunks.running_min(lay, "m", F.col("value")))
    assert rows(df, "s", "p", "f", "m") == rows(want, "s", "p", "f", "m")


@pytest.mark.parametrize("size", [3, 60, 333])
def test_bounded_frames_reach_over_chunks(frame, size):
    def build(df, ax):
        return df.select(*ax.keys, R.sma(ax, "value", 20, 5).alias("s"), R.lead(ax, "value", 4).alias("l"),
                         F.count(F.lit(1)).over(ax.centred(9)).alias("n"))
    got = chunks.by_chunk(frame, DAILY, build, before=19, after=4, target_rows=size)
    assert rows(got, "s", "l", "n") == rows(build(frame, DAILY), "s", "l", "n")


@pytest.mark.parametrize("size", [5, 60, 333])
def test_smoothing(frame, size):
    specs = {"a": ("value", recursive.span(10), 5), "b": ("value", recursive.wilder(14), 0)}
    want = recursive.smooth(frame, DAILY, specs)
    got = recursive.smooth(frame, DAILY, specs, long_series=True, target_rows=size)
    assert rows(got, "a", "b") == rows(want, "a", "b")


def test_spells(frame):
    df = frame.withColumn("state", F.floor("value").cast("int"))
    def key(d):
        return sorted((r.series_id, r.start, r.end, r.label, r.n_rows) for r in d.collect())
    assert key(E.spells(df, "state", DAILY, long_series=True, target_rows=50)) == key(E.spells(df, "state", DAILY))


def test_asof(spark, frame):
    right = frame.where("day(date) % 9 = 0").select("series_id", F.col("date").alias("seen"), F.col("value").alias("v"))
    a = joins.asof(frame, right, ["series_id"], "date", "seen", ["v", "seen"])
    b = joins.asof(frame, right, ["series_id"], "date", "seen", ["v", "seen"], long_series=True, target_rows=40)
    assert rows(a, "v", "seen") == rows(b, "v", "seen")
    known = {(r.series_id, r.seen): r.v for r in right.collect()}
    for (s, d), (v, seen) in rows(a, "v", "seen").items():
        before = [t for (k, t) in known if k == s and t <= d]
        assert seen == (max(before) if before else None)
        assert v == (known[(s, max(before))] if before else None)


@pytest.mark.parametrize("size", [4, 1000])
def test_exact_percentiles(spark, frame, size):
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.series_id: [r[k] for k in qs] for r in chunks.percentiles(frame, ["series_id"], "value", qs, size).collect()}
    want = {r.series_id: r.p for r in frame.where("value is not null").groupBy("series_id").agg(F.percentile("value", list(qs.values())).alias("p")).collect()}
    assert set(got) == set(want)
    for k in got:
        assert got[k] == pytest.approx(want[k])


def test_copies_of_one_value_stay_together(spark):
    df = spark.createDataFrame([("a", 1.0)] * 50 + [("a", float(i)) for i in range(100)], "g string, v double")
    got = chunks.percentiles(df, ["g"], "v", {"m": 0.5}, target_rows=5).first().m
    assert got == df.agg(F.percentile("v", 0.5)).first()[0]


def test_chunks_are_found_by_halving(spark):
    """Every row's chunk is the number of cuts at or before it; no row is held against all cuts."""
    data = spark.createDataFrame([("a", None if i % 50 == 7 else float(i * 7919 % 1000) / 3) for i in range(1000)] + [("b", 1.0), (None, 2.0)], "k string, t double")
    lay = chunks.lay_out(data, chunks.Axis(("k",), ("t",)), 30)
    cuts = {r.k: r._cuts for r in lay.cuts.collect()}
    assert len(cuts["a"]) > 20
    for r in lay.df.collect():
        assert r._chunk == sum(c <= r.t for c in cuts.get(r.k, [])) if r.t is not None else r._chunk == 0
    assert "lambda" not in lay.df._jdf.queryExecution().toString()


def test_a_layout_reads_its_rows_once_and_counts_them_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(r):
        seen.add(1)
        return r
    data = spark.createDataFrame(spark.sparkContext.parallelize([("a", float(i)) for i in range(400)], 2).map(passed), "k string, t double")
    out = chunks.percentiles(data, ["k"], "t", {"p": 0.5}, target_rows=50)
    assert out.first().p == 199.5
    assert seen.value <= 800                                    # one pass counts, one writes


def test_releases_of_both_sides_are_written_once(spark):
    from tidegauge.plans.vintage_queries import asof_parts
    for side in asof_parts(spark, "/root/testdata/sf0.001"):
        assert "lineitem" not in side._jdf.queryExecution().toString() and "Join" not in side._jdf.queryExecution().optimizedPlan().toString()
