"""Column profiles of a wide feature table, and descriptive statistics.

The table goes to long form (column_name, date, value); every profile is then one
grouped pass whose parallelism is the number of columns.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.functions.scalars import days_between
from tidegauge.operators.axis import Axis
from tidegauge.operators.chunks import TARGET_ROWS, percentiles

COLUMNS = Axis(("column_name",))

# fixed values: feature prefix -> (source table, theme)
PREFIX_THEMES = {
    "ti_gspc_": ("technical_indicators", "1. Simple Technical Trend and Momentum Signals"),
    "vol_": ("volatility_indicators", "2. Volatility and Market Stress Indicators"),
    "pcr_": ("put_call_ratios", "3. Market Internals (Under the Hood Checkup)"),
    "breadth_": ("index_breadth_indicators", "3. Market Internals (Under the Hood Checkup)"),
    "stk_bond_diff_": ("intermarket_stock_bond_returns_diff", "4. Intermarket Relationships"),
    "spy_tlt_ratio_": ("intermarket_ratios", "4. Intermarket Relationships"),
    "gold_silver_ratio_": ("intermarket_ratios", "4. Intermarket Relationships"),
    "copper_gold_ratio_": ("intermarket_ratios", "4. Intermarket Relationships"),
    "junk_spread_": ("investment_grade_junk_bond_yield_spread_signals", "5. Credit and Bond Market Tells"),
    "corp_oas_": ("corporate_bond_oas", "5. Credit and Bond Market Tells"),
    "tsy_spread_": ("treasury_yield_spreads", "5. Credit and Bond Market Tells"),
    "em_tbill_spread_": ("em_corporate_vs_tbill_spread", "5. Credit and Bond Market Tells"),
    "fg_": ("cnn_fear_greed_index", "6. Sentiment and Behavior Gauges"),
    "conf_": ("consumer_confidence_signals", "6. Sentiment and Behavior Gauges"),
    "aaii_": ("aaii_sentiment_signals", "6. Sentiment and Behavior Gauges"),
    "finra_": ("finra_margin_statistics_signals", "6. Sentiment and Behavior Gauges"),
    "sentconf_": ("sentiment_confidence_indices", "6. Sentiment and Behavior Gauges"),
    "nfp_": ("non_farm_payrolls_signals", "7. Macro Economic Data and Forecasts"),
    "icj_": ("initial_jobless_claims_signals", "7. Macro Economic Data and Forecasts"),
    "cpi_": ("cpi_signals", "7. Macro Economic Data and Forecasts"),
    "retail_": ("retail_sales_signals", "7. Macro Economic Data and Forecasts"),
    "m2_": ("m2_money_supply_signals", "7. Macro Economic Data and Forecasts"),
    "houst_": ("housing_starts_signals", "7. Macro Economic Data and Forecasts"),
    "hpi_": ("housing_prices_signals", "7. Macro Economic Data and Forecasts"),
    "smi_": ("smart_money_index", "8. Market Structure & Fund Flow Indicators"),
    "djt_vs_gspc_": ("relative_strength_metrics", "9. Sector and Micro-Market Tells"),
    "rut_vs_gspc_": ("relative_strength_metrics", "9. Sector and Micro-Market Tells"),
    "qqq_vs_dju_": ("relative_strength_metrics", "9. Sector and Micro-Market Tells"),
    "xlv_vs_gspc_": ("relative_strength_metrics", "9. Sector and Micro-Market Tells"),
    "dxy_": ("dxy_signals", "10. Global Markets and Currency Signals"),
    "em_": ("em_equity_signals", "10. Global Markets and Currency Signals"),
    "oil_": ("oil_price_signals", "10. Global Markets and Currency Signals"),
    "bdi_": ("bdi_signals", "10. Global Markets and Currency Signals"),
    "gex_": ("gex_signals", "11. Advanced Derivative-Based Metrics"),
    "sp500_": ("sp500_derived_indicators", "0. S&P 500 Base Market Data & Derived Features"),
    "regime_": ("hmm_regime_output", "Market Regime Information"),
}


def to_long(wide: DataFrame, columns, keep=("date",)):
    cols = [F.col(c).cast("double").alias(c) for c in columns]
    return wide.select(*keep, *cols).unpivot(list(keep), list(columns), "column_name", "value")


def classify(names: DataFrame, prefixes: dict = PREFIX_THEMES, column="column_name", longest=False):
    """Source and theme by the first matching prefix in map order, or by the longest.

    The map is a constant of some forty entries, so it is written into the plan.
    """
    order = sorted(prefixes, key=len, reverse=True) if longest else list(prefixes)
    pick = F.coalesce(*[F.when(F.col(column).startswith(p), F.struct(
        F.lit(prefixes[p][0]).alias("s"), F.lit(prefixes[p][1]).alias("t"))) for p in order])
    unknown = F.lit("Unknown")
    return names.withColumns({"source_table": F.coalesce(pick["s"], unknown), "theme": F.coalesce(pick["t"], unknown)})


def null_counts(wide: DataFrame, columns):
    """NULL count and percentage per column: one pass over the wide table."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    counts = wide.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    return counts.unpivot(["_rows"], list(columns), "column_name", "null_count").select(
        "column_name", "null_count", (100 * F.try_divide("null_count", "_rows")).alias("null_pct"))


def describe(long: DataFrame, by=("column_name",), x="value", target_rows=TARGET_ROWS):
    """count, mean, std, min, quartiles (linear interpolation) and max.

    Groups of more than ``target_rows`` distinct values are cut (see ``chunks``); ``None``
    says that there are none.
    """
    by = list(by)
    plain = long.groupBy(*by).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    quartiles = percentiles(long, by, x, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, target_rows)
    return plain.join(quartiles, by, "left")


BLOCK = 64                       # columns of a block
CHUNK_BYTES = 1 << 26            # of rows reduced to sums at once


def _gathered(arrays):
    """Rows of several batches in one array of about CHUNK_BYTES."""
    held, size = [], 0
    for x in arrays:
        held.append(x)
        size += x.nbytes
        if size >= CHUNK_BYTES:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def block_sums(x, names, sums, diagonal=True):
    """Sums over the rows of ``x`` of all pairs of its columns, two blocks of columns at a time.

    ``sums`` (x, slice of columns, slice of columns) gives matrices; they come as rows a, b,
    s0, s1, ... of the upper triangle.
    """
    n = len(names)
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            left, right = slice(i, min(i + BLOCK, n)), slice(j, min(j + BLOCK, n))
            found = sums(x, left, right)
            a, b = np.indices(found[0].shape).reshape(2, -1)
            upper = a + i < b + j if not diagonal else a + i <= b + j
            a, b = a[upper], b[upper]
            yield pd.DataFrame({"a": names[a + i], "b": names[b + j], **{f"s{k}": m[a, b] for k, m in enumerate(found)}})


def moments(wide: DataFrame, columns):
    """Pairwise-complete counts, covariances and correlations of all column pairs.

    Rows become matrices of partial sums before anything is shuffled, one for two blocks of
    columns at a time, so a task holds CHUNK_BYTES of rows and matrices of BLOCK by BLOCK,
    however many columns there are; no row pairs are formed. Values are centred on the column
    means first, so the sums do not cancel.
    """
    columns = list(columns)
    data = wide.select(*[F.col(c).cast("double").alias(c) for c in columns])
    means = data.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = np.array([means[c] or 0.0 for c in columns])
    names = np.array(columns, dtype=object)

    def sums(x, left, right):
        a, b = x[:, left] - centre[left], x[:, right] - centre[right]
        m, w = (~np.isnan(a)).astype("float64"), (~np.isnan(b)).astype("float64")
        a, b = np.nan_to_num(a), np.nan_to_num(b)
        return m.T @ w, a.T @ w, m.T @ b, (a * a).T @ w, m.T @ (b * b), a.T @ b

    def partial(batches):
        for x in _gathered(pdf.to_numpy("float64") for pdf in batches):
            yield from block_sums(x, names, sums)

    schema = "a string, b string, " + ", ".join(f"s{k} double" for k in range(6))
    s = data.mapInPandas(partial, schema).groupBy("a", "b").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    c, sx, sy, sxx, syy, sxy = (F.col(f"s{k}") for k in range(6))
    cov = F.when(c > 1, (sxy - F.try_divide(sx * sy, c)) / (c - 1))
    vx, vy = (sxx - F.try_divide(sx * sx, c)), (syy - F.try_divide(sy * sy, c))
    corr = F.when(F.col("a") == F.col("b"), F.when(vx > 0, 1.0)).otherwise(
        F.try_divide(sxy - F.try_divide(sx * sy, c), F.sqrt(vx * vy)))
    return s.select("a", "b", c.cast("long").alias("n"), cov.alias("covariance"), corr.alias("correlation"))


def theme_correlation(pairs: DataFrame, themes: DataFrame):
    """Mean absolute correlation between (or within) themes.

    ``pairs``: upper triangle from ``moments``; ``themes``: column_name, theme, one row
    per column. A pair counts once; a theme of one column has no inner value.
    """
    a = themes.select(F.col("column_name").alias("a"), F.col("theme").alias("_ta"))
    b = themes.select(F.col("column_name").alias("b"), F.col("theme").alias("_tb"))
    df = pairs.where("a <> b").join(a, "a").join(b, "b")
    return df.groupBy(F.least("_ta", "_tb").alias("theme_a"), F.greatest("_ta", "_tb").alias("theme_b")) \
             .agg(F.avg(F.abs("correlation")).alias("mean_abs_corr"))


def strongest_pairs(pairs: DataFrame, k=50):
    """The k most positive and the k most negative pairs."""
    p = pairs.where("a <> b and correlation is not null").select("a", "b", "correlation")
    top = p.orderBy(F.desc("correlation"), "a", "b").limit(k).withColumn("side", F.lit("positive"))
    low = p.orderBy(F.asc("correlation"), "a", "b").limit(k).withColumn("side", F.lit("negative"))
    return top.unionByName(low)


def business_day_count(first, last):
    """Weekdays between two dates, both included."""
    def upto(d):
        days = F.datediff(d, F.lit("1970-01-05").cast("date"))      # a Monday
        weeks = F.floor(days / 7)
        return weeks * 5 + F.least(days - weeks * 7, F.lit(5))
    return upto(F.date_add(last, 1)) - upto(first)


def cadence(long: DataFrame, ax=COLUMNS):
    """Typical gap between a column's valid dates, named by bands of days."""
    date = ax.order[0]
    valid = long.where("value is not null").withColumn("gap", F.datediff(date, F.lag(date).over(ax.base())))
    g = valid.groupBy(*ax.by).agg(
        F.count("*").alias("n"), F.mode("gap", True).alias("gap"), F.min(date).alias("first"),
        F.max(date).alias("last"), F.count_if(F.weekday(date) < 5).alias("on_weekdays"))
    span = business_day_count(F.col("first"), F.col("last"))
    daily = (F.try_divide("on_weekdays", "n") > 0.8) & (F.try_divide(F.col("n"), span) > 0.6)
    d, num = F.col("gap"), F.col("gap").cast("string")
    # fixed values: bands of days and their names
    name = (F.when(F.col("n") < 2, "Insufficient data")
            .when(d.between(0, 3) & daily, "Daily (Business)")
            .when(d.between(0, 3), F.concat(F.lit("Daily-like (Mode: "), num, F.lit(" days)")))
            .when(d.between(5, 9), "Weekly")
            .when(d.between(18, 24), "Monthly (Business Days approx)")
            .when(d.between(25, 35), "Monthly (Calendar approx)")
            .when(d.between(58, 70), "Quarterly (Business Days approx)")
            .when(d.between(80, 100), "Quarterly (Calendar approx)")
            .otherwise(F.concat(F.lit("Irregular (Mode: "), num, F.lit(" days)"))))
    days = F.when(F.col("n") < 2, None).when(name == "Daily (Business)", 1).otherwise(d)
    return g.select(*ax.by, name.alias("general_cadence"), days.alias("typical_cadence_days"))


def valid_span(long: DataFrame, ax=COLUMNS):
    date = F.col(ax.order[0])
    valid = F.col("value").isNotNull()
    return long.groupBy(*ax.by).agg(
        F.count_if(~valid).alias("null_count"), (F.count("value") == 0).alias("is_all_null"),
        F.min(F.when(valid, date)).alias("first_valid_date"), F.max(F.when(valid, date)).alias("last_valid_date"))


def interior_nulls(long: DataFrame, spans: DataFrame, cadences: DataFrame, ax=COLUMNS):
    """NULL rows strictly inside a column's valid span, one row each.

    Business-daily columns only count weekdays. ``spans`` and ``cadences`` have one
    row per column.
    """
    date = F.col(ax.order[0])
    df = long.where("value is null").join(spans, list(ax.by)).join(cadences, list(ax.by))
    inside = date.between(F.col("first_valid_date"), F.col("last_valid_date"))
    counted = (F.col("general_cadence") != "Daily (Business)") | (F.weekday(date) < 5)
    df = df.where(inside & counted).select(*ax.by, *ax.order)
    return df.withColumn("gap_days", days_between(date, F.lag(date).over(ax.base())))


def column_profile(wide: DataFrame, columns, date="date", prefixes=PREFIX_THEMES):
    """One row per column: NULLs, span, cadence, source and theme, interior NULL dates.

    The date arrays hold at most one entry per row of the table for that column.
    """
    ax = Axis(("column_name",), (date,))
    long = to_long(wide, columns, (date,))
    spans, cad = valid_span(long, ax), cadence(long, ax)
    inner = interior_nulls(long, spans, cad, ax)
    packed = inner.groupBy("column_name").agg(
        F.count("*").alias("n_interior"), F.array_sort(F.collect_list(date)).alias("dates"))
    dates = F.coalesce("dates", F.array().cast("array<date>"))
    gaps = F.when(F.size(dates) > 1, F.transform(
        F.sequence(F.lit(2), F.size(dates)),
        lambda i: F.datediff(F.element_at(dates, i), F.element_at(dates, i - 1)))) \
        .otherwise(F.array().cast("array<int>"))
    df = spans.join(cad, "column_name", "left").join(packed, "column_name", "left")
    return classify(df, prefixes).select(
        "column_name", F.col("null_count").alias("nan_count"), F.col("is_all_null").alias("is_all_nan"),
        "source_table", "theme", F.col("first_valid_date").alias("first_valid_data_date"),
        F.coalesce("general_cadence", F.lit("Insufficient data")).alias("general_cadence"), "typical_cadence_days",
        (F.size(dates) > 0).alias("has_extraordinary_nans"), dates.alias("extraordinary_nan_dates"),
        gaps.alias("extraordinary_nan_timedeltas_days"),
        F.coalesce("n_interior", F.lit(0)).alias("num_extraordinary_nans"))


def class_shares(df: DataFrame, label, by=()):
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Axis(tuple(by) or (F.lit(1),)).whole()))


def cardinality(long: DataFrame, few=15):
    """Distinct values per column and whether they are few."""
    counts = (long.where("value is not null").groupBy("column_name", "value").agg(F.lit(1).alias("_o"))
                  .groupBy("column_name").agg(F.count("*").alias("n_distinct")))
    return counts.withColumn("is_low_cardinality", F.col("n_distinct") < few)


def release_lags(df: DataFrame, date, reference, by):
    """Describe how many days a release trails its reference date."""
    return describe(df.withColumn("value", days_between(date, reference).cast("double")), by)


def five_numbers(long: DataFrame, by, x="value", target_rows=TARGET_ROWS):
    """min, quartiles and max per group."""
    return describe(long, by, x, target_rows).select(*by, "count", "min", "p25", "p50", "p75", "max")
