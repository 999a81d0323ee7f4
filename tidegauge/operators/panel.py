"""Ticker panels: index breadth, validity ranges, source fallback."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions.scalars import member_list
from tidegauge.operators.axis import Axis
from tidegauge.operators.joins import business_days, members_with_prices

TICKERS = Axis(("ticker",))


def price_states(prices: DataFrame, ax=TICKERS, short=50, long=200):
    """Moving averages and daily direction of every ticker."""
    df = R.with_running_averages(prices, ax, "close", {"sma_short": short, "sma_long": long})
    step = R.difference(ax, "close")
    return df.withColumns({"advancing": step > 0, "declining": step < 0})


def daily_members(lists: DataFrame, last_date):
    """(date, ticker) of every business day from dated comma lists ``date, tickers``.

    A list is in force until the next one; lists dated on weekends never come into
    force. Each list's stretch of days is generated from its own and the next list's
    date, so no list is carried row by row. A day with an empty list keeps one row
    without a ticker.
    """
    marks = lists.select("date", (F.weekday("date") < 5).alias("_on")).distinct()
    last = F.greatest(marks.agg(F.max("date")).scalar(), F.lit(last_date))
    calendar = Axis((F.lit("index"),))                                  # one row per list
    spans = marks.where("_on").select(
        F.col("date").alias("list_date"), F.col("date").alias("start"),
        F.coalesce(F.date_sub(F.lead("date").over(calendar.base()), 1), last).alias("end"))
    days = business_days(spans)
    exploded = lists.where(F.weekday("date") < 5).select(
        F.col("date").alias("list_date"), F.explode_outer(member_list("tickers")).alias("ticker"))
    return days.join(exploded, "list_date").select("date", "ticker")


def index_breadth(lists: DataFrame, prices: DataFrame, short=50, long=200):
    """Share of members above their averages, advance/decline line and ratio by day.

    One membership join on (date, ticker) and one aggregation per date; days without
    prices stay with empty counts. The line is accumulated over the per-date totals.
    """
    states = price_states(prices, short=short, long=long)
    members = daily_members(lists, prices.agg(F.max("date")).scalar())
    members = members.withColumn("ticker", F.col("ticker").try_cast(prices.schema["ticker"].dataType))
    counts = members_with_prices(members, states).groupBy("date").agg(
        F.count("sma_short").alias("n_short"), F.count("sma_long").alias("n_long"),
        F.count_if(F.col("close") > F.col("sma_short")).alias("above_short"),
        F.count_if(F.col("close") > F.col("sma_long")).alias("above_long"),
        F.count_if("advancing").alias("adv"), F.count_if("declining").alias("dec"))
    line = F.sum(F.col("adv") - F.col("dec")).over(Axis((F.lit("index"),)).past())
    return counts.select(
        "date", (100 * F.try_divide("above_short", "n_short")).alias(f"pct_above_sma{short}"),
        (100 * F.try_divide("above_long", "n_long")).alias(f"pct_above_sma{long}"),
        line.alias("ad_line"), ad_ratio("adv", "dec").alias("ad_ratio"))


def ad_ratio(adv, dec):
    """Advances over declines; infinite when only advances, missing when neither."""
    adv, dec = F.col(adv), F.col(dec)
    return F.when(dec > 0, adv / dec).when(adv > 0, F.lit(float("inf")))


def first_source(frames, key="ticker"):
    """Per key all rows of the first frame that has the key.

    Only (key, priority) pairs are grouped, then matched back by a semi join, so a
    hot key's rows are never gathered.
    """
    tagged = reduce(DataFrame.unionByName, [f.withColumn("priority", F.lit(i)) for i, f in enumerate(frames)])
    best = tagged.groupBy(key).agg(F.min("priority").alias("priority"))
    return tagged.join(best, [key, "priority"], "left_semi")


PRICE_COLUMNS = ("open", "high", "low", "close", "adjusted_close", "volume")


def within_validity(prices: DataFrame, ranges: DataFrame, today, lookback=250, key="ticker"):
    """Prices inside each ticker's validity, extended ``lookback`` days back.

    ``ranges``: key, start_date, end_date (open ends run to ``today``); a range without
    a start is skipped. Rows without any price are dropped.
    """
    ranges = ranges.where("start_date is not null").select(
        key, F.date_sub("start_date", lookback).alias("_from"),
        F.coalesce("end_date", F.to_date(F.lit(today))).alias("_to"))
    found = prices.join(ranges, key).where(F.col("date").between(F.col("_from"), F.col("_to")))
    have = [c for c in PRICE_COLUMNS if c in prices.columns]
    return found.dropna(how="all", subset=have).select(*prices.columns)


def not_yet_done(df: DataFrame, done: DataFrame, key="ticker"):
    """Rows whose key the output does not hold yet."""
    return df.join(done.select(key), key, "left_anti")
