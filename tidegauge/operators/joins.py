"""Calendar and time joins."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidegauge.operators.axis import Axis
from tidegauge.operators.chunks import TARGET_ROWS, by_years, fill_forward, lay_out


def business_days(bounds: DataFrame, start="start", end="end", out="date"):
    """One row per weekday between the dates of each row of ``bounds``."""
    keys = [c for c in bounds.columns if c not in (start, end)]
    days = bounds.select(*keys, F.explode(F.sequence(start, end)).alias(out))
    return days.where(F.weekday(out) < 5)


def span_of(df: DataFrame, date="date", by=()):
    """First and last date, the input of ``business_days``."""
    return df.groupBy(*by).agg(F.min(date).alias("start"), F.max(date).alias("end"))


def side_by_side(frames: dict, value="value", on=("date",)):
    """Full outer join of named series on the date: stack, then group once."""
    stacked = reduce(DataFrame.unionByName, [
        df.select(*on, F.lit(n).alias("_name"), F.col(value).alias("_v")) for n, df in frames.items()])
    return stacked.groupBy(*on).agg(*[
        F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in frames])


def on_spine(spine: DataFrame, frames: dict, on="date"):
    """Left joins of daily frames to a spine; columns get the frame's prefix.

    Each frame has one row per date. Frames are joined one by one: all sides hash to
    the same partitioning of the date, so the spine is shuffled once.
    """
    out = spine
    for prefix, df in frames.items():
        cols = [c for c in df.columns if c != on]
        out = out.join(df.select(on, *[F.col(c).alias(prefix + c) for c in cols]), on, "left")
    return out


def asof(left: DataFrame, right: DataFrame, by, left_time, right_time, values,
         long_series=False, target_rows=TARGET_ROWS):
    """Each left row with the last right row at or before its time.

    ``right`` has one row per key and time. Its latest row is taken even where its
    values are NULL. Both sides are stacked and the right row is carried forward,
    releases sorting before the rows that may see them. Hot keys are cut into chunks
    and the last release is carried across the cuts, with ``long_series=True`` also where the
    time is a date; without keys the years are the chunks.
    """
    by = list(by)
    rows = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
                       F.struct(*left.columns).alias("_l"))
    news = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
                        F.struct(*values).alias("_r"))
    both = rows.unionByName(news, allowMissingColumns=True)
    ax = Axis(tuple(by), ("_t", "_side"))
    lay = lay_out(both, ax, target_rows if long_series else None) if by else by_years(both, ax)
    both = lay.done(fill_forward(lay, {"_r": F.col("_r")}))
    return both.where("_side = 1").select("_l.*", "_r.*")


def asof_rows(left: DataFrame, right: DataFrame, by, left_time, right_time, values, **how):
    """``asof`` for raw rows, many per key and time.

    The match depends on key and time alone: it is found once per distinct pair and
    joined back, an equi-join whose hot pairs AQE splits.
    """
    times = left.select(*by, left_time).distinct()
    found = asof(times, right, by, left_time, right_time, values, **how)
    return left.join(found, [*by, left_time], "left")


def members_with_prices(members: DataFrame, prices: DataFrame, keys=("date", "ticker")):
    """Exploded index members with their prices; members without a price survive."""
    return members.join(prices, list(keys), "left")
