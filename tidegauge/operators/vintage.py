"""Bitemporal frames: what was published for a reference date, and when.

All of these are aggregations: they combine map-side and never gather a group. Input
has one row per key, reference date and release date (``one_per_release`` makes it
so). Values and dates then aggregate in fixed-width hash buffers; ordering by a struct
would make Spark sort every input partition first.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

REF, REL = "reference_date", "release_date"


def one_per_release(df: DataFrame, values, keys=()):
    """Settle repeated releases: the smallest value per column."""
    return df.groupBy(*keys, REF, REL).agg(*[F.min(v).alias(v) for v in values])


def first_release(df: DataFrame, values, keys=(), suffix="_pit"):
    """First published value per reference date, per value column.

    Each column takes its earliest non-NULL value, so a value may come from a later
    release than the ``release_date`` shown, which is the earliest of all.
    """
    earliest = [F.min_by(v, F.when(F.col(v).isNotNull(), F.col(REL))).alias(v + suffix) for v in values]
    return df.groupBy(*keys, REF).agg(F.min(REL).alias(REL), *earliest)


def first_complete_release(df: DataFrame, value="value", keys=()):
    """First release that has a value; value and date come from one row."""
    df = df.dropna(subset=[REF, REL, value])
    return df.groupBy(*keys, REF).agg(F.min(REL).alias(REL), F.min_by(value, REL).alias(value))


def latest_reference(df: DataFrame, values, keys=()):
    """Per release date the row with the latest reference date, NULL values included."""
    return df.groupBy(*keys, REL).agg(F.max(REF).alias(REF), *[F.max_by(v, REF).alias(v) for v in values])


def keep_first(df: DataFrame, keys, order):
    """One row per key: the first by ``order``, which must leave no ties."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
              .select(*keys, "_r.*"))


def month_end_last(df: DataFrame, value, keys=(), date="date"):
    """Last value of each calendar month, dated at the month's end."""
    return (df.where(F.col(value).isNotNull())
              .groupBy(*keys, F.last_day(date).alias(date)).agg(F.max_by(value, date).alias(value)))


def credit_spread(high_yield: DataFrame, investment_grade: DataFrame):
    """Difference of two vintage series' first releases; released with the later one.

    Both sides are stacked and grouped once, which is a full outer join in one shuffle.
    """
    both = (first_complete_release(high_yield).withColumn("_s", F.lit(0))
            .unionByName(first_complete_release(investment_grade).withColumn("_s", F.lit(1))))

    def of(s, col):
        return F.max(F.when(F.col("_s") == s, F.col(col)))
    df = both.groupBy(REF).agg(of(0, "value").alias("hy"), of(1, "value").alias("ig"), F.max(REL).alias(REL))
    return (df.withColumn("spread_value", F.col("hy") - F.col("ig"))
              .dropna(subset=["spread_value", REL]).select(REF, REL, "spread_value"))
