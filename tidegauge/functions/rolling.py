"""Rolling-window column expressions over an :class:`Axis`.

Each function returns a Column for ``df.withColumn``. A window expression may
not contain another one, so functions that need two steps (percent change of a
forward-filled value, say) take the first step's column as input.

Missing is NULL throughout and every division is ``try_divide``, so a zero
denominator gives NULL, never an error or an infinity.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tidegauge.operators.axis import Axis

TRADING_DAYS = 252


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def enough(ax: Axis, x, n, least, value: Column) -> Column:
    """``value`` where the frame of n rows has at least ``least`` observations."""
    return F.when(F.count(_c(x)).over(ax.last(n)) >= least, value)


# -- filling -----------------------------------------------------------------

def ffill(ax: Axis, x) -> Column:
    return F.last(_c(x), ignorenulls=True).over(ax.past())


def bfill(ax: Axis, x) -> Column:
    return F.first(_c(x), ignorenulls=True).over(ax.future())


# -- change ------------------------------------------------------------------

def change(ax: Axis, x, k) -> Column:
    """Fraction change over k rows. Feed it ``ffill`` output for the padded form."""
    x = _c(x)
    return F.try_divide(x, F.lag(x, k).over(ax.base())) - 1


def change_pct(ax: Axis, x, k) -> Column:
    """100 * change over k rows, unpadded."""
    x, before = _c(x), F.lag(_c(x), k).over(ax.base())
    return 100 * F.try_divide(x - before, before)


def annualised_change(ax: Axis, x, k, per_year) -> Column:
    x = _c(x)
    return F.pow(F.try_divide(x, F.lag(x, k).over(ax.base())), F.lit(per_year / k)) - 1


def difference(ax: Axis, x, k=1) -> Column:
    x = _c(x)
    return x - F.lag(x, k).over(ax.base())


def log_difference(ax: Axis, x, k=1) -> Column:
    x = F.ln(_c(x))
    return x - F.lag(x, k).over(ax.base())


def lead(ax: Axis, x, k) -> Column:
    return F.lead(_c(x), k).over(ax.base())


# -- level and dispersion ----------------------------------------------------

def sma(ax: Axis, x, n, least=None) -> Column:
    x = _c(x)
    return enough(ax, x, n, n if least is None else least, F.avg(x).over(ax.last(n)))


def with_running_averages(df, ax: Axis, x, windows: dict):
    """Full-window averages ``out -> n`` from running sums, for many or long windows.

    ``sma`` re-adds its n rows at every row; this takes the difference of two running
    sums instead, so the work per row does not grow with n, all in the series' one sort
    order. A frame of equal values gives exactly that value, so that comparing a flat
    series with its average stays decided.
    """
    base, past = ax.base(), ax.past()
    v = _c(x)
    df = df.withColumns({"_sum": F.sum(v).over(past), "_seen": F.count(v).over(past),
                         "_row": F.row_number().over(base),
                         "_moved": ~v.eqNullSafe(F.lag(v).over(base))})
    df = df.withColumn("_since", F.max(F.when(F.col("_moved"), F.col("_row"))).over(past))

    def within(col, n):
        return F.col(col) - F.coalesce(F.lag(col, n).over(base), F.lit(0))
    flat = {n: F.col("_row") - F.coalesce("_since", F.lit(1)) + 1 >= n for n in windows.values()}
    out = {o: F.when(within("_seen", n) >= n, F.when(flat[n], v).otherwise(within("_sum", n) / n))
           for o, n in windows.items()}
    return df.withColumns(out).drop("_sum", "_seen", "_row", "_moved", "_since")


def zscore(ax: Axis, x, n, least=None) -> Column:
    x, w = _c(x), ax.last(n)
    z = F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))
    return enough(ax, x, n, n // 2 if least is None else least, z)


def percentile_rank(ax: Axis, x, n, least=None) -> Column:
    """Average rank of the current value in its frame, over the frame length.

    NULL when any row of the frame is NULL. The frame is an array of at most n
    values, so the state per row is bounded by the window length.
    """
    x, w = _c(x), ax.last(n)
    frame = F.collect_list(x).over(w)
    # a smaller value counts 1, an equal one 1/2, and the row itself rounds it up
    rank = F.aggregate(frame, F.lit(0.5), lambda acc, v: acc + F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0))
    rows = F.count(F.lit(1)).over(w)
    least = n // 2 if least is None else least
    return F.when((F.count(x).over(w) == rows) & (rows >= least), rank / rows)


def volatility(ax: Axis, returns, n, least, population=False, per_year=TRADING_DAYS) -> Column:
    std = F.stddev_pop if population else F.stddev_samp
    r = _c(returns)
    return enough(ax, r, n, least, std(r).over(ax.last(n))) * math.sqrt(per_year)


def beta(ax: Axis, y, x, n=90, least=45) -> Column:
    """Rolling covariance of y with x over the variance of x, on paired rows."""
    y, x, w = _c(y), _c(x), ax.last(n)
    pairs = F.count(F.when(y.isNotNull(), x)).over(w)
    cov = F.when(pairs >= least, F.covar_samp(y, x).over(w))
    return F.try_divide(cov, enough(ax, x, n, least, F.var_samp(x).over(w)))


def observation_number(ax: Axis, x) -> Column:
    """Running count of non-NULL values; the x axis for ``slope``."""
    return F.count(_c(x)).over(ax.past())


def slope(ax: Axis, y, position, n=30, least=15) -> Column:
    """Least-squares slope of y over its last n rows, NULLs squeezed out.

    A slope ignores shifts of x, so the running observation number stands for 0..m-1.
    """
    y = _c(y)
    return enough(ax, y, n, least, F.regr_slope(y, _c(position)).over(ax.last(n)))


def lowest(ax: Axis, x, n) -> Column:
    return enough(ax, x, n, n, F.min(_c(x)).over(ax.last(n)))


def highest(ax: Axis, x, n) -> Column:
    return enough(ax, x, n, n, F.max(_c(x)).over(ax.last(n)))


def true_range(ax: Axis, high="high", low="low", close="close") -> Column:
    before = F.lag(_c(close)).over(ax.base())
    h, l = _c(high), _c(low)
    return F.greatest(h - l, F.abs(h - before), F.abs(l - before))


# -- running -----------------------------------------------------------------

def running_sum(ax: Axis, x) -> Column:
    return F.sum(_c(x)).over(ax.past())


def running_min(ax: Axis, x) -> Column:
    return F.min(_c(x)).over(ax.past())


# -- states ------------------------------------------------------------------

def smoothed_state(ax: Axis, state, n, trailing=False) -> Column:
    """Most frequent state of a centred frame, the smallest on ties.

    A centred frame looks ahead; ``trailing=True`` uses past rows only.
    """
    w = ax.last(n) if trailing else ax.centred(n)
    return F.mode(_c(state), True).over(w)


def changed(ax: Axis, x) -> Column:
    """1 where the value differs from the previous row; the first row counts."""
    x = _c(x)
    before = F.lag(x).over(ax.base())
    first = F.row_number().over(ax.base()) == 1
    return F.when(first | ~x.eqNullSafe(before), 1).otherwise(0)
