"""Composite daily signals: each builder maps a frame to a frame of named signals.

Builders stage their windows with ``withColumns``. All windows of a builder share
one partitioning and order, so Spark shuffles and sorts a series once. A date cut
(``start``) is applied after the windows, never before, so that the first rows kept
still see their full look-back.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions.scalars import band, flag, side
from tidegauge.operators import recursive
from tidegauge.operators.axis import DAILY, Axis
from tidegauge.operators.chunks import by_chunk, filled


def padded(df, ax: Axis, *cols):
    """Add ``_f_<col>``: the column filled forward, the base of padded changes.

    Columns already there (``chunks.by_chunk`` fills long series) are left alone.
    """
    todo = {f"_f_{c}": R.ffill(ax, c) for c in cols if f"_f_{c}" not in df.columns}
    return df.withColumns(todo) if todo else df


def some_present(df, cols):
    """Keep rows where at least one of ``cols`` is present."""
    return df.dropna(how="all", subset=list(cols))


def from_date(df, ax, start):
    return df if start is None else df.where(F.col(ax.order[0]) >= F.to_date(F.lit(start)))


def _finish(df, ax, start, keep, signals, drop_empty=True):
    df = from_date(df, ax, start)
    if drop_empty:
        df = some_present(df, signals)
    return df.select(*ax.keys, *keep, *signals)


def _three_month_z(ax, col="_r63"):
    return R.zscore(ax, col, 63, 21)


# -- single series -----------------------------------------------------------

def dollar_index(df: DataFrame, ax=DAILY, x="value", start=None):
    df = padded(df, ax, x)
    df = df.withColumns({"_r63": R.change(ax, f"_f_{x}", 63), "_r1": R.change(ax, f"_f_{x}", 1),
                         "_k": R.observation_number(ax, x)})
    out = {"pct_change_21d": R.change(ax, f"_f_{x}", 21),
           "z_score_return_3m": _three_month_z(ax),
           "percentile_rank_1y": R.percentile_rank(ax, x, 252),
           "volatility_30d": R.volatility(ax, "_r1", 30, 15),
           "slope_30d_regression": R.slope(ax, x, "_k")}
    return _finish(df.withColumns(out), ax, start, [x], list(out))


def oil(df: DataFrame, ax=DAILY, x="value", start=None):
    df = padded(df, ax, x)
    df = df.withColumns({"_r63": R.change(ax, f"_f_{x}", 63), "_r1": R.change(ax, f"_f_{x}", 1)})
    out = {"pct_change_1m": R.change(ax, f"_f_{x}", 21), "pct_change_6m": R.change(ax, f"_f_{x}", 126),
           "z_score_return_3m": _three_month_z(ax), "volatility_30d": R.volatility(ax, "_r1", 30, 15)}
    return _finish(df.withColumns(out), ax, start, [x], list(out))


def gamma_exposure(df: DataFrame, ax=DAILY, x="value", rank_window=252, z_window=63):
    out = {"percentile_rank_1y": R.percentile_rank(ax, x, rank_window),
           "z_score_3m": R.zscore(ax, x, z_window, z_window // 3)}
    return _finish(df.withColumns(out), ax, None, [x], list(out))


def freight_index(df: DataFrame, oil_price: DataFrame, ax=DAILY, x="value"):
    """``oil_price``: one price per date (column ``oil_price``), the same for all series."""
    df = df.join(oil_price, list(ax.order), "left")
    df = padded(df, ax, x, "oil_price").withColumn("_r63", R.change(ax, f"_f_{x}", 63))
    df = df.withColumns({"pct_change_1m": R.change(ax, f"_f_{x}", 21),
                         "z_score_return_3m": _three_month_z(ax)})
    df = df.select(*ax.keys, x, "pct_change_1m", "z_score_return_3m", "_f_oil_price")
    df = recursive.smooth(df, ax, {"_e30": (x, recursive.span(30), 30),
                                   "_e90": (x, recursive.span(90), 90)})
    df = df.withColumns({"ema_30_minus_ema_90": F.col("_e30") - F.col("_e90"),
                         "oil_ratio": F.try_divide(x, "_f_oil_price")})
    return _finish(df, ax, None, [x], ["pct_change_1m", "z_score_return_3m",
                                       "ema_30_minus_ema_90", "oil_ratio"])


def sentiment_set(df: DataFrame, cols, ax=DAILY, changes=(1, 3, 6), averages=(3, 6), ranks=(12, 24)):
    df = padded(df, ax, *cols)
    out = {}
    for c in cols:
        out |= {f"{c}_roc_{k}m": R.change(ax, f"_f_{c}", k) for k in changes}
        out |= {f"{c}_sma_{n}m": R.sma(ax, c, n) for n in averages}
        out |= {f"{c}_percentile_{n // 12}y": R.percentile_rank(ax, c, n) for n in ranks}
    return _finish(df.withColumns(out), ax, None, list(cols), list(out), drop_empty=False)


def smart_money(bars: DataFrame, ax=DAILY, initial=0.0, changes=(5, 20, 60), averages=(20, 50),
                ranks=(252, 504), start=None):
    """Cumulated close - 2*open + previous close; the first row holds ``initial``."""
    df = bars.withColumn("_step", F.col("close") - 2 * F.col("open") + F.lag("close").over(ax.base()))
    df = df.withColumn("smi_value", F.coalesce(R.running_sum(ax, "_step"), F.lit(0.0)) + initial)
    out = {f"smi_roc_{k}d": R.change(ax, "smi_value", k) for k in changes}
    out |= {f"smi_sma_{n}d": R.sma(ax, "smi_value", n) for n in averages}
    out |= {f"smi_percentile_{n}d": R.percentile_rank(ax, "smi_value", n) for n in ranks}
    df = df.withColumns(out).withColumns({
        "smi_vs_sma20_signal": side("smi_value", "smi_sma_20d"),
        "smi_sma20_vs_sma50_signal": side("smi_sma_20d", "smi_sma_50d")})
    signals = [*out, "smi_vs_sma20_signal", "smi_sma20_vs_sma50_signal"]
    return _finish(df, ax, start, ["smi_value"], signals, drop_empty=False)


RETURNS = (1, 5, 21, 63, 126, 252, 512)
LOG_VOLS = (1, 5, 21, 63, 126, 252)


def index_derived(bars: DataFrame, ax=DAILY, price="close", returns=RETURNS, vols=LOG_VOLS,
                  z_window=63, start=None):
    df = padded(bars, ax, price).withColumn("_l", R.log_difference(ax, price))
    out = {f"ret_{k}d": R.change(ax, f"_f_{price}", k) for k in returns}
    for n in vols:
        out[f"log_vol_{n}d"] = (F.abs("_l") * R.TRADING_DAYS ** 0.5 if n == 1 else
                                R.volatility(ax, "_l", n, max(2, n // 2), population=True))
    z = {f"{c}_zscore_{z_window}d": R.zscore(ax, c, z_window) for c in out}
    return _finish(df.withColumns(out).withColumns(z), ax, start, [price], [*out, *z])


# -- two series on common dates ----------------------------------------------

def on_common_dates(a: DataFrame, b: DataFrame, ax=DAILY, names=("a", "b"), x="value"):
    """Inner join of every series of ``a`` with the one series ``b`` on the date."""
    a = a.select(*ax.keys, F.col(x).alias(names[0]))
    return a.join(b.select(*ax.order, F.col(x).alias(names[1])), list(ax.order))


def em_equity(df: DataFrame, ax=DAILY, price="a", market="b", start=None):
    df = padded(df, ax, price, market)
    df = df.withColumns({"_r63": R.change(ax, f"_f_{price}", 63), "_r1": R.change(ax, f"_f_{price}", 1),
                         "_m1": R.change(ax, f"_f_{market}", 1), "_sma": R.sma(ax, price, 200, 100)})
    out = {"pct_return_21d": R.change(ax, f"_f_{price}", 21),
           "z_score_return_3m": _three_month_z(ax),
           "above_sma_200": flag(F.col(price) > F.col("_sma")),
           "relative_performance": F.try_divide(price, market),
           "beta_90d": R.beta(ax, "_r1", "_m1")}
    return _finish(df.withColumns(out), ax, start, [F.col(price).alias("close_price")], list(out))


def relative_strength(df: DataFrame, ax=DAILY, a="a", b="b", log_steps=(1, 5, 20), period=20, windows=(20, 60)):
    df = padded(df, ax, a, b).withColumns({
        "rs_ratio": F.try_divide(a, b),
        f"return_spread_{period}d": R.change(ax, f"_f_{a}", period) - R.change(ax, f"_f_{b}", period)})
    spread = f"return_spread_{period}d"
    out = {f"log_diff_{d}d": R.log_difference(ax, "rs_ratio", d) for d in log_steps}
    out |= {f"z_score_spread_{period}d_window{n}d": R.zscore(ax, spread, n) for n in windows}
    return df.withColumns(out).select(*ax.keys, "rs_ratio", spread, *out)


def intermarket_ratio(df: DataFrame, ax=DAILY, a="a", b="b", start=None):
    df = df.withColumn("raw_ratio", F.try_divide(a, b)).where("raw_ratio is not null")
    out = {f"roc_{k}d": R.change(ax, "raw_ratio", k) for k in (21, 63, 126, 252)}
    out |= {f"sma_{n}d": R.sma(ax, "raw_ratio", n) for n in (20, 50, 200)}
    out |= {f"zscore_value_{n}d": R.zscore(ax, "raw_ratio", n) for n in (63, 252)}
    out["percentile_1y"] = R.percentile_rank(ax, "raw_ratio", 252)
    df = df.withColumns(out).withColumns({"vs_sma20_signal": side("raw_ratio", "sma_20d"),
                                          "sma20_vs_sma50_signal": side("sma_20d", "sma_50d")})
    return _finish(df, ax, start, ["raw_ratio"], [*out, "vs_sma20_signal", "sma20_vs_sma50_signal"])


def stock_bond_difference(df: DataFrame, ax=DAILY, stock="a", bond="b", start=None):
    df = df.dropna(subset=[stock, bond])
    df = df.withColumn("return_diff_20d", R.change(ax, stock, 20) - R.change(ax, bond, 20))
    out = {f"return_diff_20d_sma_{n}": R.sma(ax, "return_diff_20d", n) for n in (20, 50)}
    out |= {f"return_diff_20d_zscore_{n}d": R.zscore(ax, "return_diff_20d", n) for n in (63, 252)}
    df = df.withColumns(out).where("return_diff_20d is not null")
    return _finish(df, ax, start, ["return_diff_20d"], list(out), drop_empty=False)


# -- bars --------------------------------------------------------------------

TECHNICAL = ["sma_20", "sma_50", "sma_100", "sma_200", "ema_20", "ema_50", "ema_100", "ema_200",
             "macd", "macd_histogram", "rsi_14", "roc", "adx", "stochastic_k", "stochastic_d", "williams_r"]


def technical(bars: DataFrame, ax=DAILY):
    """Averages, MACD, RSI, rate of change, ADX, stochastic and Williams %R."""
    up, down = R.difference(ax, "high"), -R.difference(ax, "low")
    step = R.difference(ax, "close")
    raw = {f"sma_{n}": R.sma(ax, "close", n) for n in (20, 50, 100, 200)}
    raw |= {"roc": R.change_pct(ax, "close", 12), "_tr": R.true_range(ax),
            "_low": R.lowest(ax, "low", 14), "_high": R.highest(ax, "high", 14),
            "_gain": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))),
            "_loss": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))),
            # no move on the first row: directional movement is 0 there, not NULL
            "_plus": F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)),
            "_minus": F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0))}
    df = bars.withColumns(raw)
    spread = F.col("_high") - F.col("_low")
    df = df.withColumns({"_k": 100 * F.try_divide(F.col("close") - F.col("_low"), spread),
                         "_w": -100 * F.try_divide(F.col("_high") - F.col("close"), spread)})
    df = df.withColumns({"stochastic_k": R.ffill(ax, "_k"), "williams_r": R.ffill(ax, "_w")})
    df = df.withColumn("stochastic_d", R.sma(ax, "stochastic_k", 3))
    averages = {f"ema_{n}": ("close", recursive.span(n), n) for n in (20, 50, 100, 200)}
    averages |= {"_e12": ("close", recursive.span(12), 12), "_e26": ("close", recursive.span(26), 26)}
    averages |= {f"_s{c}": (c, recursive.wilder(14), 14) for c in ("_tr", "_gain", "_loss", "_plus", "_minus")}
    df = df.select(*ax.keys, *[c for c in TECHNICAL if c in df.columns], "close",
                   "_tr", "_gain", "_loss", "_plus", "_minus")
    df = recursive.smooth(df, ax, averages)
    plus, minus = (100 * F.try_divide(f"_s_{d}", "_s_tr") for d in ("plus", "minus"))
    df = df.withColumns({"macd": F.col("_e12") - F.col("_e26"), "_di_plus": plus, "_di_minus": minus,
                         "rsi_14": rsi("_s_gain", "_s_loss")})
    # gaps of the directional index count as 0 and enter its average, warm-up rows too
    df = df.withColumn("_dx", F.coalesce(100 * F.try_divide(
        F.abs(F.col("_di_plus") - F.col("_di_minus")), F.col("_di_plus") + F.col("_di_minus")), F.lit(0.0)))
    df = recursive.smooth(df, ax, {"_signal": ("macd", recursive.span(9), 9),
                                   "adx": ("_dx", recursive.wilder(14), 14)})
    df = df.withColumn("macd_histogram", F.col("macd") - F.col("_signal"))
    return some_present(df, TECHNICAL).select(*ax.keys, *TECHNICAL)


def rsi(gain, loss):
    """100 - 100 / (1 + gain/loss); no loss gives 100, neither gain nor loss gives 0."""
    g, l = F.col(gain), F.col(loss)
    return (F.when((g == 0) & (l == 0), 0.0).when(l == 0, 100.0)
            .otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(g, l))))


def technical_second(tech: DataFrame, price: DataFrame, ax=DAILY):
    """Signals on top of ``technical``; ``price`` has the axis keys and ``close_price``."""
    df = tech.join(price, [*ax.by, *ax.order], "left")
    df = padded(df, ax, "macd_histogram")
    out = {"price_vs_sma50_pct_diff": F.try_divide(F.col("close_price") - F.col("sma_50"), F.col("sma_50")),
           "price_vs_sma200_pct_diff": F.try_divide(F.col("close_price") - F.col("sma_200"), F.col("sma_200")),
           "sma20_vs_sma50_signal": side("sma_20", "sma_50"),
           "sma50_vs_sma200_signal": side("sma_50", "sma_200"),
           "rsi_14_zscore_60d": R.zscore(ax, "rsi_14", 60),
           "rsi_14_percentile_252d": R.percentile_rank(ax, "rsi_14", 252),
           "macd_hist_roc_5d": R.change(ax, "_f_macd_histogram", 5),
           "adx_level_signal": band("adx"),
           "stoch_k_oversold_signal": flag(F.col("stochastic_k") < 20),
           "stoch_k_overbought_signal": flag(F.col("stochastic_k") > 80)}
    return df.withColumns(out).select(*ax.keys, *out)


def volatility_table(vix: DataFrame, vvix: DataFrame, skew: DataFrame, bars: DataFrame, ax=Axis(by=()),
                     atr_window=14):
    """Fear gauges and ATR side by side, one row per date.

    The four inputs (``date, value``; bars with prices) are stacked long and pivoted
    by one grouping instead of chained outer joins. The one time axis is cut by years.
    """
    one = Axis((), ax.order)
    named = [df.select(F.lit(n).alias("_name"), *ax.order, F.col("value"))
             for n, df in (("vix", vix), ("vvix", vvix), ("skew_index", skew))]
    long = reduce(DataFrame.unionByName, named)
    gauge = one.within("_name")
    long = long.withColumns({"_s20": R.sma(gauge, "value", 20), "_s50": R.sma(gauge, "value", 50)})
    tr = by_chunk(bars, one, lambda d, a: d.withColumn("_tr", R.true_range(a)), before=1).select(*ax.order, "_tr")
    atr = recursive.smooth(tr, one, {"atr": ("_tr", recursive.wilder(atr_window), atr_window)})
    both = long.unionByName(atr.select(*ax.order, "atr"), allowMissingColumns=True)

    def of(name, col="value"):
        return F.max(F.when(F.col("_name") == name, F.col(col)))
    table = both.groupBy(*ax.order).agg(
        of("vix").alias("vix"), of("vix", "_s20").alias("vix_sma_20"), of("vix", "_s50").alias("vix_sma_50"),
        of("vvix").alias("vvix"), F.max("atr").alias("atr"), of("skew_index").alias("skew_index"))
    cols = ["vix", "vix_sma_20", "vix_sma_50", "vvix", "atr", "skew_index"]
    return some_present(filled(table, one, [c for c in cols if c != "atr"]), cols).select(*ax.order, *cols)


def volatility_second(df: DataFrame, ax=DAILY, price="close_price"):
    """Signals on a volatility table that already carries the as-of price."""
    df = padded(df, ax, "vix", "vvix")
    out = {"vix_roc_21d": R.change(ax, "_f_vix", 21), "vix_roc_63d": R.change(ax, "_f_vix", 63),
           "vix_zscore_63d": R.zscore(ax, "vix", 63),
           "vix_percentile_252d": R.percentile_rank(ax, "vix", 252),
           "vix_vs_sma20_signal": side("vix", "vix_sma_20"),
           "vvix_roc_21d": R.change(ax, "_f_vvix", 21), "vvix_zscore_63d": R.zscore(ax, "vvix", 63),
           "vvix_percentile_252d": R.percentile_rank(ax, "vvix", 252),
           "vix_vvix_ratio": F.try_divide("vix", "vvix"),
           "skew_index_zscore_63d": R.zscore(ax, "skew_index", 63),
           "skew_index_percentile_252d": R.percentile_rank(ax, "skew_index", 252),
           "atr_pct_of_price": 100 * F.try_divide("atr", price)}
    return df.withColumns(out).select(*ax.keys, *out)


def put_call_second(df: DataFrame, ax=DAILY, x="value"):
    df = padded(df, ax, x)
    out = {"sma_5d": R.sma(ax, x, 5), "sma_21d": R.sma(ax, x, 21),
           "vs_sma21d_diff": F.col(x) - R.sma(ax, x, 21),
           "roc_5d": R.change(ax, f"_f_{x}", 5), "roc_21d": R.change(ax, f"_f_{x}", 21),
           "zscore_63d": R.zscore(ax, x, 63), "percentile_252d": R.percentile_rank(ax, x, 252)}
    return df.withColumns(out).select(*ax.keys, x, *out)


def breadth_second(df: DataFrame, ax=DAILY):
    """An infinite advance/decline ratio counts as missing here."""
    df = df.withColumn("_ratio", F.when(F.col("ad_ratio") < float("inf"), F.col("ad_ratio")))
    df = padded(df, ax, "pct_above_sma50", "pct_above_sma200", "ad_line")
    out = {f"{c}_roc_21d": R.change(ax, f"_f_{c}", 21) for c in ("pct_above_sma50", "pct_above_sma200", "ad_line")}
    out |= {"ad_line_sma_21d_diff": F.col("ad_line") - R.sma(ax, "ad_line", 21),
            "ad_ratio_sma_5d": R.sma(ax, "_ratio", 5)}
    return df.withColumns(out).select(*ax.keys, *out)


def fear_greed_second(df: DataFrame, ax=DAILY, x="value", fear=25, greed=75):
    df = padded(df, ax, x)
    out = {"sma_5d": R.sma(ax, x, 5), "sma_21d": R.sma(ax, x, 21),
           "vs_sma21d_diff": F.col(x) - R.sma(ax, x, 21), "roc_5d": R.change(ax, f"_f_{x}", 5),
           "is_extreme_fear_signal": flag(F.col(x) < fear), "is_extreme_greed_signal": flag(F.col(x) > greed),
           "percentile_252d": R.percentile_rank(ax, x, 252)}
    return df.withColumns(out).select(*ax.keys, x, *out)
