"""Hand-made tables for the corners: gaps, ties, flat series, month ends, first rows."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import rolling as R, scalars as C
from tidegauge.operators import evaluate as E, impute, panel, recursive, signals, vintage
from tidegauge.operators.axis import DAILY, Axis

DAY0 = dt.date(2024, 1, 1)


def series(spark, values, **more):
    rows = [("s", DAY0 + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, date date, value double")
    return df


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None), (got, want)
        if w is not None:
            assert g == pytest.approx(w, abs=1e-9), (got, want)


def test_change_pads_gaps(spark):
    df = series(spark, [1, 2, None, 4, 5]).withColumn("f", R.ffill(DAILY, "value"))
    near(column(df.withColumn("c", R.change(DAILY, "f", 1)), "c"), [None, 1.0, 0.0, 1.0, 0.25])


def test_change_pct_does_not_pad(spark):
    df = series(spark, [1, 2, None, 4]).withColumn("c", R.change_pct(DAILY, "value", 1))
    near(column(df, "c"), [None, 100.0, None, None])


def test_change_of_zero_base_is_missing(spark):
    near(column(series(spark, [0, 2]).withColumn("c", R.change(DAILY, "value", 1)), "c"), [None, None])


@pytest.mark.parametrize("size", [None, 2, 1])
def test_ema_with_gap(spark, size):
    df = series(spark, [1, 2, None, 4])
    out = recursive.smooth(df, DAILY, {"e": ("value", recursive.span(3), 0)}, long_series=size is not None, target_rows=size)
    near(column(out, "e"), [1, 1.5, 1.5, 19 / 6])


def test_ema_least_observations(spark):
    out = recursive.smooth(series(spark, [None, 1, 2, 4]), DAILY, {"e": ("value", recursive.span(3), 2)})
    near(column(out, "e"), [None, None, 1.5, 2.75])


def test_centred_even_frame(spark):
    df = series(spark, range(10)).withColumn("n", F.collect_list("value").over(DAILY.centred(4)))
    assert column(df, "n")[5] == [3.0, 4.0, 5.0, 6.0]


def test_first_release_is_per_column(spark):
    d = [DAY0 + dt.timedelta(days=i) for i in range(3)]
    df = spark.createDataFrame([(d[0], d[1], None, 3.0), (d[0], d[2], 7.0, 4.0)],
                               "reference_date date, release_date date, value double, other double")
    r = vintage.first_release(df, ["value", "other"]).first()
    assert (r.release_date, r.value_pit, r.other_pit) == (d[1], 7.0, 3.0)
    r = vintage.first_complete_release(df).first()
    assert (r.release_date, r.value) == (d[2], 7.0)


def test_flat_series(spark):
    rows = [("s", DAY0 + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(40)]
    bars = spark.createDataFrame(rows, "series_id string, date date, open double, high double, low double, close double, volume double")
    last = signals.technical(bars).orderBy(F.desc("date")).first()
    assert last.rsi_14 == 0 and last.stochastic_k is None and last.williams_r is None and last.adx == 0
    z = bars.withColumn("z", R.zscore(DAILY, "close", 10))
    assert column(z, "z") == [None] * 40


def test_rsi_without_losses(spark):
    rows = [("s", DAY0 + dt.timedelta(days=i), 1.0, 2.0 + i, 0.5 + i, 1.0 + i, 1.0) for i in range(30)]
    bars = spark.createDataFrame(rows, "series_id string, date date, open double, high double, low double, close double, volume double")
    assert signals.technical(bars).orderBy(F.desc("date")).first().rsi_14 == 100


def test_advance_decline_ratio(spark):
    df = spark.createDataFrame([(1, 3, 0), (2, 0, 0), (3, 1, 2)], "k int, adv int, dec int")
    assert column(df.withColumn("r", panel.ad_ratio("adv", "dec")), "r", "k") == [math.inf, None, 0.5]
    days = spark.createDataFrame([("s", DAY0 + dt.timedelta(days=i), 50.0, 50.0, 1.0 * i, math.inf if i == 2 else 1.0) for i in range(8)],
                                 "series_id string, date date, pct_above_sma50 double, pct_above_sma200 double, ad_line double, ad_ratio double")
    assert column(signals.breadth_second(days), "ad_ratio_sma_5d")[6] is None


def test_month_ends(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 2, 10),)], "d date")
    got = df.select(C.month_end("d").alias("a"), C.month_end("d", 1).alias("b")).collect()
    assert [r.a for r in got] == [dt.date(2024, 1, 31), dt.date(2024, 2, 29)]
    assert [r.b for r in got] == [dt.date(2024, 2, 29), dt.date(2024, 2, 29)]


def test_sandwich(spark):
    df = series(spark, [None, 1, None, None, None, 9, None])
    near(column(impute.sandwich(df, out="o"), "o"), [None, 1, 5, 7, 8, 9, None])
    near(column(impute.sandwich(df, out="o", stepwise=F.lit(True)), "o"), [None, 1, 9, 9, 9, 9, None])


def test_interpolate_holds_edges(spark):
    near(column(impute.interpolate(series(spark, [None, 2, None, 6, None]), out="o"), "o"), [2, 2, 4, 6, 6])


def test_percentile_rank_ties_and_gaps(spark):
    near(column(series(spark, [2, 5, 5]).withColumn("r", R.percentile_rank(DAILY, "value", 3, 1)), "r"), [1.0, 1.0, 2.5 / 3])
    near(column(series(spark, [2, None, 5]).withColumn("r", R.percentile_rank(DAILY, "value", 3, 1)), "r"), [1.0, None, None])


def test_spells_and_entries(spark):
    df = series(spark, [1, 0, 0, 1, 0])
    s = [(r.label, r.n_rows, r.days) for r in E.spells(df, "value", DAILY).orderBy("start").collect()]
    assert s == [(1.0, 1, 1), (0.0, 2, 2), (1.0, 1, 1), (0.0, 1, 1)]
    e = E.entries(df, "value", DAILY).orderBy("date").collect()
    assert [(r.label, (r.date - DAY0).days) for r in e] == [(1.0, 0), (0.0, 1), (1.0, 3), (0.0, 4)]


def test_smart_money_starts_at_initial(spark):
    rows = [("s", DAY0 + dt.timedelta(days=i), 10.0, 11.0) for i in range(3)]
    bars = spark.createDataFrame(rows, "series_id string, date date, open double, close double")
    near(column(signals.smart_money(bars, initial=7.0), "smi_value"), [7.0, 9.0, 11.0])


def test_table_label(spark):
    df = spark.createDataFrame([("3. Market Internals (Under the Hood)",), ("0. S&P 500 Base",)], "t string")
    assert column(df.withColumn("l", C.table_label("t")), "l", "t") == ["theme_sandp500_base", "theme_market_internals"]


def test_scalar_texts(spark):
    df = spark.createDataFrame([("45.2%", "1,234.5", "-", "2024-02-30")], "a string, b string, c string, d string")
    r = df.select(C.percent_text("a"), C.grouped_number("b"), C.dashed_number("c"), C.date_text("d"), C.dashed_number(F.lit("0.65"))).first()
    assert tuple(r) == (45.2, 1234.5, None, None, 0.65)


def test_running_averages_equal_plain_ones(spark):
    df = series(spark, [1.1, 2.7, None, 4.2, 5.9, 6.3, 6.3, 6.3, 6.3, 1e9, 0.3, 0.3, 0.3])
    df = R.with_running_averages(df, DAILY, "value", {"a": 2, "b": 3}).withColumns({
        "x": R.sma(DAILY, "value", 2), "y": R.sma(DAILY, "value", 3)})
    for r in df.collect():
        assert (r.a is None) == (r.x is None) and (r.b is None) == (r.y is None)
        if r.a is not None:
            assert r.a == pytest.approx(r.x, rel=1e-6)
    last = df.orderBy(F.desc("date")).first()
    assert last.a == 0.3 and last.b == 0.3          # exactly, after the huge value left the frame


def test_repeated_releases_are_settled(spark):
    d = [DAY0 + dt.timedelta(days=i) for i in range(2)]
    df = spark.createDataFrame([(d[0], d[1], 5.0), (d[0], d[1], 4.0)], "reference_date date, release_date date, value double")
    assert vintage.first_release(vintage.one_per_release(df, ["value"]), ["value"]).first().value_pit == 4.0
