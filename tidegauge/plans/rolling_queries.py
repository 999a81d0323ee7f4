"""W: rolling-window primitives."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions.scalars import flag
from tidegauge.operators import chunks, recursive
from tidegauge.operators.axis import DAILY, Axis
from tidegauge.plans import views as V
from tidegauge.plans.registry import query

W = "(partition by series_id order by date)"
UPTO = "(partition by series_id order by date rows between unbounded preceding and current row)"
AFTER = "(partition by series_id order by date rows between current row and unbounded following)"
LONG = 400     # chunk size that forces the long-series path on the test tables


def last_n(n):
    return f"(partition by series_id order by date rows between {n - 1} preceding and current row)"


def pick(df, digits, *cols, keys=("series_id", "date")):
    """Keys plus rounded columns, the shape every checked result has."""
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in cols])


@query("w1_change_padded", f"""
select series_id, date, round(f / nullif(lag(f, 5) over {W}, 0) - 1, 6) as change_5
from (select *, last_value(value ignore nulls) over {UPTO} as f from v_gaps) t""", ["v_gaps"])
def w1(spark, sf):
    df = V.gaps(spark, sf).withColumn("f", R.ffill(DAILY, "value"))
    return pick(df.withColumn("change_5", R.change(DAILY, "f", 5)), 6, "change_5")


@query("w1b_change_pct_unpadded", f"""
select series_id, date,
       round(100 * (value - lag(value, 5) over {W}) / nullif(lag(value, 5) over {W}, 0), 4) as roc_5
from v_gaps""", ["v_gaps"])
def w1b(spark, sf):
    df = V.gaps(spark, sf).withColumn("roc_5", R.change_pct(DAILY, "value", 5))
    return pick(df, 4, "roc_5")


SMA_SQL = f"""
select series_id, date,
       case when count(value) over {last_n(20)} >= 20 then round(avg(value) over {last_n(20)}, 4) end as sma_20,
       case when count(value) over {last_n(63)} >= 30 then round(avg(value) over {last_n(63)}, 4) end as sma_63
from """


def _sma(df, ax):
    return df.withColumns({"sma_20": R.sma(ax, "value", 20), "sma_63": R.sma(ax, "value", 63, 30)}) \
             .select(*ax.keys, "sma_20", "sma_63")


@query("w2_moving_average", SMA_SQL + "v_series", ["v_series"])
def w2(spark, sf):
    return pick(_sma(V.series(spark, sf), DAILY), 4, "sma_20", "sma_63")


@query("w2_moving_average_long_series", SMA_SQL + "v_series", ["v_series"])
def w2_long(spark, sf):
    df = chunks.by_chunk(V.series(spark, sf), DAILY, _sma, before=62, target_rows=LONG)
    return pick(df, 4, "sma_20", "sma_63")


@query("w2_moving_average_hourly", """
select series_id, ts_hour,
       case when count(value) over w >= 24 then round(avg(value) over w, 8) end as sma_24
from v_hourly window w as (partition by series_id order by ts_hour rows between 23 preceding and current row)
""", ["v_hourly"])
def w2_hourly(spark, sf):
    ax = Axis(order=("ts_hour",))
    df = V.hourly(spark, sf).withColumn("sma_24", R.sma(ax, "value", 24))
    return pick(df, 8, "sma_24", keys=("series_id", "ts_hour"))


Z = """case when count(value) over {w} >= {m}
            then round((value - avg(value) over {w}) / nullif(stddev_samp(value) over {w}, 0), 6) end"""


@query("w3_zscore", f"""
select series_id, date, {Z.format(w=last_n(63), m=31)} as z_63, {Z.format(w=last_n(60), m=20)} as z_60
from v_gaps""", ["v_gaps"])
def w3(spark, sf):
    df = V.gaps(spark, sf).withColumns({"z_63": R.zscore(DAILY, "value", 63),
                                        "z_60": R.zscore(DAILY, "value", 60, 20)})
    return pick(df, 6, "z_63", "z_60")


@query("w3_zscore_hourly", f"""
select series_id, ts_hour, {Z.format(w="w", m=24)} as z_48 from v_hourly
window w as (partition by series_id order by ts_hour rows between 47 preceding and current row)""", ["v_hourly"])
def w3_hourly(spark, sf):
    ax = Axis(order=("ts_hour",))
    df = V.hourly(spark, sf).withColumn("z_48", R.zscore(ax, "value", 48))
    return pick(df, 6, "z_48", keys=("series_id", "ts_hour"))


RANK = """case when count(value) over {w} = count(*) over {w} and count(*) over {w} >= {m} then round(
  (len(list_filter(list(value) over {w}, lambda v: v < value))
   + (len(list_filter(list(value) over {w}, lambda v: v = value)) + 1) / 2.0) / count(*) over {w}, 6) end"""


@query("w4_percentile_rank", f"""
select series_id, date, {RANK.format(w=last_n(252), m=126)} as rank_252 from v_series""", ["v_series"])
def w4(spark, sf):
    df = V.series(spark, sf).withColumn("rank_252", R.percentile_rank(DAILY, "value", 252))
    return pick(df, 6, "rank_252")


@query("w4_percentile_rank_gaps", f"""
select series_id, date, {RANK.format(w=last_n(12), m=6)} as rank_12 from v_gaps""", ["v_gaps"])
def w4_gaps(spark, sf):
    df = V.gaps(spark, sf).withColumn("rank_12", R.percentile_rank(DAILY, "value", 12))
    return pick(df, 6, "rank_12")


@query("w5_rolling_beta", f"""
select series_id, date,
       case when count(case when ry is not null then rx end) over {last_n(90)} >= 45
             and count(rx) over {last_n(90)} >= 45
            then round(covar_samp(ry, rx) over {last_n(90)} / nullif(var_samp(rx) over {last_n(90)}, 0), 6) end as beta_90
from (select series_id, date, y / lag(y) over {W} - 1 as ry, x / lag(x) over {W} - 1 as rx
      from (select a.series_id, a.date, a.value as y, b.value as x from v_series a
            join v_series b on a.date = b.date and b.series_id = '1-URGENT' and a.series_id <> '1-URGENT') p) r
""", ["v_series"])
def w5(spark, sf):
    s = V.series(spark, sf)
    market = s.where("series_id = '1-URGENT'").select("date", F.col("value").alias("x"))
    df = s.where("series_id <> '1-URGENT'").join(market, "date")
    df = df.withColumns({"ry": R.change(DAILY, "value", 1), "rx": R.change(DAILY, "x", 1)})
    return pick(df.withColumn("beta_90", R.beta(DAILY, "ry", "rx")), 6, "beta_90")


@query("w6_rolling_slope", f"""
select series_id, date,
       case when count(value) over {last_n(30)} >= 15 then round(regr_slope(value, k) over {last_n(30)}, 6) end as slope_30
from (select series_id, date, ln(value) as value, count(value) over {UPTO} as k from v_gaps) t""", ["v_gaps"])
def w6(spark, sf):
    df = V.gaps(spark, sf).withColumns({"k": R.observation_number(DAILY, "value"), "l": F.ln("value")})
    return pick(df.withColumn("slope_30", R.slope(DAILY, "l", "k")), 6, "slope_30")


FILL_SQL = f"""
select series_id, date, last_value(value ignore nulls) over {UPTO} as filled,
       first_value(value ignore nulls) over {AFTER} as back_filled from v_gaps"""


@query("w7_fill", FILL_SQL, ["v_gaps"])
def w7(spark, sf):
    return V.gaps(spark, sf).select("series_id", "date", R.ffill(DAILY, "value").alias("filled"),
                                    R.bfill(DAILY, "value").alias("back_filled"))


@query("w7_fill_long_series", f"""
select series_id, date, last_value(value ignore nulls) over {UPTO} as filled from v_gaps""", ["v_gaps"])
def w7_long(spark, sf):
    lay = chunks.lay_out(V.gaps(spark, sf), DAILY, LONG)
    df = lay.done(chunks.fill_forward(lay, {"filled": F.col("value")}))
    return df.select("series_id", "date", "filled")


@query("w8_volatility", f"""
select series_id, date,
  case when count(r) over {last_n(30)} >= 15 then round(stddev_samp(r) over {last_n(30)} * sqrt(252), 6) end as vol_30,
  case when count(l) over {last_n(21)} >= 10 then round(stddev_pop(l) over {last_n(21)} * sqrt(252), 6) end as log_vol_21,
  round(abs(l) * sqrt(252), 6) as log_vol_1
from (select series_id, date, value / lag(value) over {W} - 1 as r, ln(value) - lag(ln(value)) over {W} as l
      from v_series) t""", ["v_series"])
def w8(spark, sf):
    df = V.series(spark, sf).withColumns({"r": R.change(DAILY, "value", 1),
                                          "l": R.log_difference(DAILY, "value", 1)})
    df = df.withColumns({"vol_30": R.volatility(DAILY, "r", 30, 15),
                         "log_vol_21": R.volatility(DAILY, "l", 21, 10, population=True),
                         "log_vol_1": F.abs("l") * (252 ** 0.5)})
    return pick(df, 6, "vol_30", "log_vol_21", "log_vol_1")


def ema_sql(x, alpha, n):
    """Closed form of the recursion for series without gaps; ``rn`` numbers the rows."""
    return (f"case when rn >= {n} then sum(case when rn = 1 then {x} else {alpha} * {x} end"
            f" * pow(1 - {alpha}, -rn)) over {UPTO} * pow(1 - {alpha}, rn) end")


EMA_SQL = f"""
select series_id, date, round({ema_sql('close', '(2.0::double / 13)', 12)}, 3) as ema_12,
       round({ema_sql('close', '(2.0::double / 101)', 100)}, 3) as ema_100
from (select *, row_number() over {W} as rn from v_bars) t"""
EMAS = {"ema_12": ("close", recursive.span(12), 12), "ema_100": ("close", recursive.span(100), 100)}


@query("w9_ema", EMA_SQL, ["v_bars"])
def w9(spark, sf):
    df = V.bars(spark, sf).select("series_id", "date", "close")
    return pick(recursive.smooth(df, DAILY, EMAS), 3, *EMAS)


@query("w9_ema_long_series", EMA_SQL, ["v_bars"])
def w9_long(spark, sf):
    df = V.bars(spark, sf).select("series_id", "date", "close")
    return pick(recursive.smooth(df, DAILY, EMAS, long_series=True, target_rows=LONG), 3, *EMAS)


@query("w10_wilder", f"""
select series_id, date, round({ema_sql('close', '(1.0::double / 14)', 14)}, 3) as wilder_14
from (select *, row_number() over {W} as rn from v_bars) t""", ["v_bars"])
def w10(spark, sf):
    df = V.bars(spark, sf).select("series_id", "date", "close")
    return pick(recursive.smooth(df, DAILY, {"wilder_14": ("close", recursive.wilder(14), 14)}), 3, "wilder_14")


CUMSUM_SQL = f"""
select series_id, date, round(sum(volume) over {UPTO}, 2) as total, row_number() over {W} as position,
       round(min(low) over {UPTO}, 2) as lowest from v_bars"""


@query("w11_cumulative_sum", CUMSUM_SQL, ["v_bars"])
def w11(spark, sf):
    df = V.bars(spark, sf).withColumns({
        "total": R.running_sum(DAILY, "volume"), "lowest": R.running_min(DAILY, "low"),
        "position": F.row_number().over(DAILY.base())})
    return pick(df, 2, "total", "lowest", keys=("series_id", "date", "position"))


@query("w11_cumulative_sum_long_series", CUMSUM_SQL, ["v_bars"])
def w11_long(spark, sf):
    lay = chunks.lay_out(V.bars(spark, sf), DAILY, LONG)
    df = chunks.running_sum(lay, {"total": F.col("volume"), "position": F.lit(1)})
    df = chunks.running_min(chunks.Layout(df, DAILY, lay.cuts), "lowest", F.col("low"))
    return pick(lay.done(df), 2, "total", "lowest", keys=("series_id", "date", "position"))


@query("w12_range_extremes", f"""
select series_id, date,
       case when count(low) over {last_n(14)} >= 14 then min(low) over {last_n(14)} end as low_14,
       case when count(high) over {last_n(14)} >= 14 then max(high) over {last_n(14)} end as high_14
from v_bars""", ["v_bars"])
def w12(spark, sf):
    return V.bars(spark, sf).select("series_id", "date", R.lowest(DAILY, "low", 14).alias("low_14"),
                                    R.highest(DAILY, "high", 14).alias("high_14"))


def states(spark, sf):
    return V.series(spark, sf).select("series_id", "date",
                                      (F.floor(F.col("value") / 10000) % 3).cast("int").alias("state"))


STATES = {"v_state": """select series_id, date, cast(floor(value / 10000) as int) % 3 as state from v_series"""}


def mode_sql(w):
    c = [f"sum(case when state = {i} then 1 else 0 end) over {w}" for i in range(3)]
    return f"case when {c[0]} >= {c[1]} and {c[0]} >= {c[2]} then 0 when {c[1]} >= {c[2]} then 1 else 2 end"


@query("w13_smoothed_state", f"""
select series_id, date, state,
  {mode_sql('(partition by series_id order by date rows between 100 preceding and 99 following)')} as smoothed,
  {mode_sql(last_n(20))} as trailing
from v_state""", ["v_series"], STATES)
def w13(spark, sf):
    return states(spark, sf).select(
        "series_id", "date", "state", R.smoothed_state(DAILY, "state", 200).alias("smoothed"),
        R.smoothed_state(DAILY, "state", 20, trailing=True).alias("trailing"))


@query("w13_smoothed_state_long_series", f"""
select series_id, date,
  {mode_sql('(partition by series_id order by date rows between 100 preceding and 99 following)')} as smoothed
from v_state""", ["v_series"], STATES)
def w13_long(spark, sf):
    def build(df, ax):
        return df.select(*ax.keys, R.smoothed_state(ax, "state", 200).alias("smoothed"))
    return chunks.by_chunk(states(spark, sf), DAILY, build, 100, 99, LONG) \
                 .select("series_id", "date", "smoothed")


@query("w14_lag_lead_diff", f"""
select series_id, date, lag(value) over {W} as before, lead(value, 126) over {W} as ahead_126,
       round(value - lag(value, 1) over {W}, 4) as diff_1 from v_series""", ["v_series"])
def w14(spark, sf):
    return V.series(spark, sf).select(
        "series_id", "date", F.lag("value").over(DAILY.base()).alias("before"),
        R.lead(DAILY, "value", 126).alias("ahead_126"), F.round(R.difference(DAILY, "value"), 4).alias("diff_1"))


@query("w15_log_ratio_difference", f"""
select series_id, date, {", ".join(f"round(ln(r) - lag(ln(r), {d}) over {W}, 6) as log_diff_{d}" for d in (1, 5, 20))}
from (select a.series_id, a.date, a.value / nullif(b.value, 0) as r from v_series a
      join v_series b on a.date = b.date and b.series_id = '5-LOW' and a.series_id <> '5-LOW') t""", ["v_series"])
def w15(spark, sf):
    s = V.series(spark, sf)
    low = s.where("series_id = '5-LOW'").select("date", F.col("value").alias("x"))
    df = s.where("series_id <> '5-LOW'").join(low, "date").withColumn("r", F.try_divide("value", "x"))
    cols = {f"log_diff_{d}": R.log_difference(DAILY, "r", d) for d in (1, 5, 20)}
    return pick(df.withColumns(cols), 6, *cols)


@query("w16_annualised_change", f"""
select series_id, date, round(pow(high / nullif(lag(high, 63) over {W}, 0), 252.0 / 63) - 1, 4) as ann_63,
       round(pow(high / nullif(lag(high, 126) over {W}, 0), 252.0 / 126) - 1, 4) as ann_126
from v_bars""", ["v_bars"])
def w16(spark, sf):
    df = V.bars(spark, sf).withColumns({"ann_63": R.annualised_change(DAILY, "high", 63, 252),
                                        "ann_126": R.annualised_change(DAILY, "high", 126, 252)})
    return pick(df, 4, "ann_63", "ann_126")


@query("w22_true_range", f"""
select series_id, date, round(tr, 4) as tr,
       case when count(tr) over {last_n(10)} >= 10 then round(avg(tr) over {last_n(10)}, 4) end as atr_10
from (select *, greatest(high - low, abs(high - lag(close) over {W}), abs(low - lag(close) over {W})) as tr
      from v_bars) t""", ["v_bars"])
def w22(spark, sf):
    df = V.bars(spark, sf).withColumn("tr", R.true_range(DAILY))
    return pick(df.withColumn("atr_10", R.sma(DAILY, "tr", 10)), 4, "tr", "atr_10")


@query("w23_running_best", """
select series_id as study, ts_hour as trial, value as score,
       min(value) over (partition by series_id order by ts_hour rows between unbounded preceding and current row) as best
from v_hourly""", ["v_hourly"])
def w23(spark, sf):
    ax = Axis(order=("ts_hour",))
    return V.hourly(spark, sf).select(F.col("series_id").alias("study"), F.col("ts_hour").alias("trial"),
                                      F.col("value").alias("score"), R.running_min(ax, "value").alias("best"))
