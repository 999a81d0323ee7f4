"""Filling gaps: interpolation, sandwich fill, and the workflow by column class."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import rolling as R
from tidegauge.operators.axis import DAILY, Axis

# fixed values: name endings that decide how a column may be filled
STEP_ENDINGS = ("_signal", "_is_extreme_fear_signal", "_is_extreme_greed_signal")
NEVER_ENDINGS = ("_ref_date",)
LOW_CARDINALITY = 15


def interpolate(df: DataFrame, ax: Axis = DAILY, x="value", out="value"):
    """Linear by row position between valid neighbours; edges hold the nearest value."""
    pos = F.row_number().over(ax.base())
    df = df.withColumn("_p", pos)
    at = F.when(F.col(x).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(x).alias("v")))
    df = df.withColumns({"_a": F.last(at, True).over(ax.past()), "_b": F.first(at, True).over(ax.future())})
    a, b = F.col("_a"), F.col("_b")
    share = F.try_divide(F.col("_p") - a["p"], b["p"] - a["p"])
    filled = (F.when(F.col(x).isNotNull(), F.col(x)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"])
              .otherwise(a["v"] + (b["v"] - a["v"]) * share))
    return df.withColumn(out, filled).drop("_p", "_a", "_b")


def sandwich(df: DataFrame, ax: Axis = DAILY, x="value", out="value", stepwise=None, eligible=None):
    """Fill NULLs that have valid rows on both sides.

    Step columns take the next value. Others take the mean of their neighbours, row
    after row, each seeing the fills before it: the i-th NULL between L and R becomes
    R - (R - L) / 2**i. NULL rows that are not ``eligible`` stay and do not count.
    """
    stepwise = F.lit(False) if stepwise is None else stepwise
    eligible = F.lit(True) if eligible is None else eligible
    null = F.col(x).isNull()
    df = df.withColumns({"_l": R.ffill(ax, x), "_r": R.bfill(ax, x),
                         "_run": F.count(F.col(x)).over(ax.past()),
                         "_fill": null & eligible})
    run = ax.within("_run")
    i = F.count_if("_fill").over(run.past())
    df = df.withColumn("_i", i)
    mean = F.col("_r") - (F.col("_r") - F.col("_l")) / F.pow(F.lit(2.0), F.col("_i"))
    value = F.when(F.col("_fill") & F.col("_l").isNotNull() & F.col("_r").isNotNull(),
                   F.when(stepwise, F.col("_r")).otherwise(mean)).otherwise(F.col(x))
    return df.withColumn(out, value).drop("_l", "_r", "_run", "_fill", "_i")


def column_classes(long: DataFrame, column="column_name", x="value"):
    """Per column: ``never``, ``step`` or ``smooth``, from its name or its distinct values."""
    name = F.col(column)

    def ends(endings):
        cond = F.lit(False)
        for e in endings:
            cond = cond | name.endswith(e)
        return cond
    # a column has at most one value per date; the distinct count combines map-side
    few = (long.where(F.col(x).isNotNull()).groupBy(column, x).agg(F.lit(1).alias("_one"))
               .groupBy(column).agg(F.count("*").alias("_distinct")))
    kind = (F.when(ends(NEVER_ENDINGS), "never").when(ends(STEP_ENDINGS), "step")
            .when(F.col("_distinct") < LOW_CARDINALITY, "step").otherwise("smooth"))
    return few.select(column, kind.alias("kind"))


def impute(wide: DataFrame, columns, date="date", business_daily=None, by=()):
    """Sandwich-fill interior gaps, then fill forward; all-NULL columns are dropped.

    Works on the long form, one window partition per column, and returns
    ``by, date, column_name, value``. ``business_daily``: frame of the columns with
    daily cadence, whose weekend gaps are left to the forward fill.
    """
    ax = Axis((*by, "column_name"), (date,))
    long = wide.select(*by, date, *[F.col(c).cast("double").alias(c) for c in columns]) \
               .unpivot([*by, date], list(columns), "column_name", "value")
    df = long.join(column_classes(long), "column_name")      # inner: all-NULL columns have no class
    if business_daily is None:
        eligible = F.lit(True)
    else:
        df = df.join(business_daily.select("column_name", F.lit(True).alias("_daily")), "column_name", "left")
        eligible = F.col("_daily").isNull() | (F.weekday(date) < 5)
    df = sandwich(df, ax, stepwise=F.col("kind") == "step", eligible=eligible & (F.col("kind") != "never"))
    filled = F.when(F.col("kind") == "never", F.col("value")).otherwise(R.ffill(ax, "value"))
    return df.withColumn("value", filled).select(*ax.keys, "value")
