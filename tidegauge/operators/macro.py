"""Signals on point-in-time macro and survey series."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions.scalars import flag
from tidegauge.operators.axis import Axis
from tidegauge.operators.joins import asof
from tidegauge.operators.signals import padded, some_present
from tidegauge.operators.vintage import REF, REL, first_release, month_end_last

MONTHLY = Axis(("series_id",), (REF,))

# fixed values: rows per year, month, quarter and half-year by frequency
PERIODS = {"D": (252, 21, 63, 126), "W": (52, 4, 13, 26), "M": (12, 1, 3, 6)}

# fixed values: series, frequency and the signals kept for it
MACRO_SETS = {
    "non_farm_payrolls": ("PAYEMS", "M", [
        "yoy_change", "mom_change", "change_3m_annualized", "change_6m_annualized",
        "yoy_change_zscore_24m", "yoy_change_percentile_36m", "yoy_change_vs_sma12m_diff"]),
    "initial_jobless_claims": ("ICSA", "W", [
        "value_pit_4wk_ma", "change_1wk", "change_4wk_ma_yoy", "change_4wk_ma_zscore_52wk",
        "change_4wk_ma_percentile_104wk"]),
    "cpi": ("CPIAUCSL", "M", [
        "yoy_change", "mom_change", "change_3m_annualized", "change_6m_annualized",
        "yoy_change_zscore_24m", "yoy_change_percentile_36m"]),
    "retail_sales": ("RSAFS", "M", [
        "yoy_change", "mom_change", "change_3m_annualized", "yoy_change_zscore_24m",
        "yoy_change_percentile_36m"]),
    "m2_money_supply": ("M2SL", "M", [
        "yoy_change", "mom_change", "change_3m_annualized", "yoy_change_zscore_24m",
        "yoy_change_percentile_60m"]),
    "housing_starts": ("HOUST", "M", [
        "yoy_change", "mom_change", "change_3m_sma", "yoy_change_zscore_24m"]),
    "housing_prices": ("CSUSHPINSA", "M", [
        "yoy_change", "mom_change", "yoy_change_zscore_36m", "yoy_change_percentile_60m"]),
    "consumer_confidence": ("UMCSENT", "M", [
        "value_mom_diff", "value_yoy_diff", "value_sma_3m", "value_sma_6m", "value_zscore_24m",
        "value_percentile_36m"]),
}


def macro_signals(raw: DataFrame, frequency: str, wanted, ax=MONTHLY):
    """``wanted`` signals of vintage rows ``series_id, reference_date, release_date, value``.

    Windows named in a signal (``..._zscore_36m``) are computed as named.
    """
    year, month, quarter, half = PERIODS[frequency]
    pit = first_release(raw, ["value"], ax.by).withColumnRenamed("value_pit", "v")
    df = padded(pit, ax, "v").withColumns({
        "yoy_change": R.change(ax, "_f_v", year),
        "mom_change": R.change(ax, "_f_v", month), "change_1wk": R.change(ax, "_f_v", month),
        "change_3m_annualized": R.annualised_change(ax, "v", quarter, year),
        "change_6m_annualized": R.annualised_change(ax, "v", half, year),
        "value_pit_4wk_ma": R.sma(ax, "v", 4), "change_3m_sma": R.sma(ax, "v", 3),
        "value_mom_diff": R.difference(ax, "v", month), "value_yoy_diff": R.difference(ax, "v", year)})
    if any(w.startswith("change_4wk_ma") for w in wanted):
        df = padded(df, ax, "value_pit_4wk_ma")
        df = df.withColumn("change_4wk_ma_yoy", R.change(ax, "_f_value_pit_4wk_ma", year))
    late = {}
    for name in wanted:
        m = re.fullmatch(r"(yoy_change|value|change_4wk_ma)_(zscore|percentile|sma|vs_sma)_?(\d+)(m|w|wk)(_diff)?", name)
        if not m:
            continue
        n = int(m[3])
        x = {"yoy_change": "yoy_change", "value": "v", "change_4wk_ma": "change_4wk_ma_yoy"}[m[1]]
        late[name] = {"zscore": lambda: R.zscore(ax, x, n), "percentile": lambda: R.percentile_rank(ax, x, n),
                      "sma": lambda: R.sma(ax, x, n),
                      "vs_sma": lambda: F.col(x) - R.sma(ax, x, n)}[m[2]]()
    df = df.withColumns(late) if late else df
    return some_present(df, wanted).select(*ax.keys, REL, F.col("v").alias("value_pit"), *wanted)


def survey_signals(raw: DataFrame, ax=Axis((), (REF,)), values=(
        "bullish_pct", "neutral_pct", "bearish_pct", "bull_bear_spread_pct", "bullish_8wk_ma_pct")):
    pit = first_release(raw, values, ax.by)
    out = {"bull_bear_spread_pct_sma_4wk": R.sma(ax, "bull_bear_spread_pct_pit", 4),
           "bull_bear_spread_pct_zscore_52wk": R.zscore(ax, "bull_bear_spread_pct_pit", 52),
           "bullish_pct_percentile_52wk": R.percentile_rank(ax, "bullish_pct_pit", 52),
           "bearish_pct_percentile_52wk": R.percentile_rank(ax, "bearish_pct_pit", 52)}
    df = some_present(pit.withColumns(out), out)
    return df.select(*ax.keys, REL, *[f"{v}_pit" for v in values], *out)


def margin_signals(raw: DataFrame, index_close: DataFrame, ax=MONTHLY):
    """``raw``: debit, free_credit_cash, free_credit_margin; ``index_close``: date, close.

    Debt is also shown relative to the latest month-end index level on record since
    the first reference date, and to free credit (a missing balance counts as 0).
    """
    values = ("debit_balances", "free_credit_cash", "free_credit_margin")
    pit = first_release(raw, values, ax.by)
    # both ends of the reference dates: one row, read as scalar subqueries
    first, last = (raw.agg(f(REF)).scalar() for f in (F.min, F.max))
    monthly = month_end_last(index_close.where(F.col("date").between(first, last)), "close")
    seen = asof(pit.select(REF).distinct(), monthly, [], REF, "date", ["close"])
    df = padded(pit.join(seen, REF, "left"), ax, "debit_balances_pit")
    debt = "_f_debit_balances_pit"
    credit = sum((F.coalesce(F.col(f"{c}_pit"), F.lit(0.0)) for c in values[1:]), F.lit(0.0))
    out = {"debit_balances_yoy_change": R.change(ax, debt, 12), "debit_balances_roc_3m": R.change(ax, debt, 3),
           "debit_balances_roc_6m": R.change(ax, debt, 6),
           "normalized_margin_debt": F.try_divide("debit_balances_pit", "close"),
           "margin_debt_vs_free_credit_ratio": F.try_divide(F.col("debit_balances_pit"), credit)}
    df = df.withColumns(out)
    z = "debit_balances_yoy_change_zscore_24m"
    df = df.withColumn(z, R.zscore(ax, "debit_balances_yoy_change", 24))
    return some_present(df, [*out, z]).select(*ax.keys, REL, *[f"{v}_pit" for v in values], *out, z)


PAIR = ("high_yield_series_id", "investment_grade_series_id")


def bond_spread_signals(raw: DataFrame, ax=Axis(PAIR, (REF,))):
    pit = padded(first_release(raw, ["spread_value"], ax.by), ax, "spread_value_pit")
    x, f = "spread_value_pit", "_f_spread_value_pit"
    out = {"spread_value_sma_21d": R.sma(ax, x, 21), "spread_value_sma_63d": R.sma(ax, x, 63),
           "spread_value_vs_sma63d_diff": F.col(x) - R.sma(ax, x, 63),
           "spread_value_roc_21d": R.change(ax, f, 21), "spread_value_roc_63d": R.change(ax, f, 63),
           "spread_value_zscore_252d": R.zscore(ax, x, 252),
           "spread_value_percentile_252d": R.percentile_rank(ax, x, 252),
           "spread_widening_signal_5d": flag((F.col(x) > R.sma(ax, x, 5)) & (R.change(ax, f, 5) > 0))}
    return some_present(pit.withColumns(out), out).select(*ax.keys, REL, x, *out)
