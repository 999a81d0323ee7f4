"""G1-G2, G4-G20: composite signals and their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import chunks, joins, signals as S
from tidegauge.operators.axis import DAILY, Axis
from tidegauge.plans import views as V
from tidegauge.plans.registry import query
from tidegauge.plans.rolling_queries import LONG, UPTO, W, Z, ema_sql, last_n, pick

KEYS = "series_id, date"


def roc(x, k, digits=6):
    return f"round({x} / nullif(lag({x}, {k}) over {W}, 0) - 1, {digits})"


def sma(x, n, digits=4, least=None):
    return f"case when count({x}) over {last_n(n)} >= {least or n} then round(avg({x}) over {last_n(n)}, {digits}) end"


def raw_sma(x, n, least=None):
    return f"case when count({x}) over {last_n(n)} >= {least or n} then avg({x}) over {last_n(n)} end"


def z(x, n, least=None):
    w = last_n(n)
    return (f"case when count({x}) over {w} >= {least or n // 2} then "
            f"round(({x} - avg({x}) over {w}) / nullif(stddev_samp({x}) over {w}, 0), 6) end")


def rank(x, n, by="series_id", order="date"):
    w = f"(partition by {by} order by {order} rows between {n - 1} preceding and current row)"
    return (f"case when count({x}) over {w} = count(*) over {w} and count(*) over {w} >= {n // 2} then round("
            f"(len(list_filter(list({x}) over {w}, lambda v: v < {x})) + "
            f"(len(list_filter(list({x}) over {w}, lambda v: v = {x})) + 1) / 2.0) / count(*) over {w}, 6) end")


def fill(x):
    return f"last_value({x} ignore nulls) over {UPTO}"


def select(columns: dict, source, where=None, keys=KEYS):
    body = ",\n".join(f"{e} as {n}" for n, e in columns.items())
    q = f"select {keys},\n{body}\nfrom {source}"
    return q if where is None else f"select * from ({q}) z where {where}"


def any_present(cols):
    return "coalesce(" + ", ".join(f"cast({c} as varchar)" for c in cols) + ") is not null"


def sign(e):
    return f"cast(sign({e}) as int)"


# -- single series -----------------------------------------------------------
# the slope is compared on logs, whose values sit on no rounding edge

LEVEL = {"v_level": "select series_id, date, ln(value) as value from v_series",
         "g_base": f"select *, value / lag(value, 63) over {W} - 1 as r63, value / lag(value) over {W} - 1 as r1, "
                   f"count(value) over {UPTO} as k from v_level"}
G4 = {"pct_change_21d": roc("value", 21), "z_score_return_3m": z("r63", 63, 21),
      "percentile_rank_1y": rank("value", 252),
      "volatility_30d": f"case when count(r1) over {last_n(30)} >= 15 then round(stddev_samp(r1) over {last_n(30)} * sqrt(252), 6) end",
      "slope_30d_regression": f"case when count(value) over {last_n(30)} >= 15 then round(regr_slope(value, k) over {last_n(30)}, 6) end"}


@query("g4_dollar_index", select(G4, "g_base", any_present(G4)), ["v_series"], LEVEL)
def g4(spark, sf):
    df = V.series(spark, sf).withColumn("value", F.ln("value"))
    return pick(S.dollar_index(df), 6, *G4)


MONEY = {"g_base": f"select *, value / lag(value, 63) over {W} - 1 as r63, value / lag(value) over {W} - 1 as r1 from v_series"}
G6 = {"pct_change_1m": roc("value", 21), "pct_change_6m": roc("value", 126), "z_score_return_3m": z("r63", 63, 21),
      "volatility_30d": G4["volatility_30d"]}


@query("g6_oil", select(G6, "g_base", any_present(G6)), ["v_series"], MONEY)
def g6(spark, sf):
    return pick(S.oil(V.series(spark, sf)), 6, *G6)


@query("g6_oil_long_series", select(G6, "g_base", any_present(G6)), ["v_series"], MONEY)
def g6_long(spark, sf):
    return pick(chunks.by_chunk(V.series(spark, sf), DAILY, S.oil, before=126, fill=("value",), target_rows=LONG), 6, *G6)


G7 = {"pct_change_1m": roc("value", 21), "z_score_return_3m": z("r63", 63, 21),
      "ema_30_minus_ema_90": f"round({ema_sql('value', '(2.0::double / 31)', 30)} - {ema_sql('value', '(2.0::double / 91)', 90)}, 2)",
      "oil_ratio": f"round(value / nullif({fill('oil')}, 0), 6)"}


@query("g7_freight_index", select(G7, "g_base", any_present(G7)), ["v_series"], {
    "g_base": f"""select s.series_id, s.date, s.value, o.value as oil, row_number() over (partition by s.series_id order by s.date) as rn,
       s.value / lag(s.value, 63) over (partition by s.series_id order by s.date) - 1 as r63
       from v_series s left join v_series o on s.date = o.date and o.series_id = '5-LOW' where s.series_id <> '5-LOW'"""})
def g7(spark, sf):
    s = V.series(spark, sf)
    oil = s.where("series_id = '5-LOW'").select("date", F.col("value").alias("oil_price"))
    df = S.freight_index(s.where("series_id <> '5-LOW'"), oil)
    return df.select("series_id", "date", *[F.round(c, 2 if "ema" in c else 6).alias(c) for c in G7])


G8 = {"percentile_rank_1y": rank("value", 252), "z_score_3m": z("value", 63, 21)}


@query("g8_gamma_exposure", select(G8, "v_gaps", any_present(G8)), ["v_gaps"])
def g8(spark, sf):
    return pick(S.gamma_exposure(V.gaps(spark, sf)), 6, *G8)


G12 = {"smi_value": "round(smi, 2)", **{f"smi_roc_{k}d": roc("smi", k, 4) for k in (5, 20, 60)},
       "smi_sma_20d": sma("smi", 20, 5), "smi_sma_50d": sma("smi", 50, 5),
       "smi_percentile_252d": rank("smi", 252), "smi_percentile_504d": rank("smi", 504),
       "smi_vs_sma20_signal": sign(f"smi - {raw_sma('smi', 20)}"),
       "smi_sma20_vs_sma50_signal": sign(f"{raw_sma('smi', 20)} - {raw_sma('smi', 50)}")}


@query("g12_smart_money", select(G12, "g_base"), ["v_bars"], {
    "g_base": f"""select series_id, date, coalesce(sum(step) over {UPTO}, 0) as smi
       from (select *, close - 2 * open + lag(close) over {W} as step from v_bars) t"""})
def g12(spark, sf):
    df = S.smart_money(V.bars(spark, sf))
    digits = {c: 2 if c == "smi_value" else 4 if "roc" in c else 5 if "sma_" in c and "signal" not in c else 6 for c in G12}
    return df.select("series_id", "date", *[
        F.col(c) if c.endswith("signal") else F.round(c, digits[c]).alias(c) for c in G12])


G13 = {}
for _c in ("value", "n"):
    G13 |= {f"{_c}_roc_{k}m": roc(_c, k) for k in (1, 3, 6)}
    G13 |= {f"{_c}_sma_{n}m": sma(_c, n, 8) for n in (3, 6)}
    G13 |= {f"{_c}_percentile_{n // 12}y": rank(_c, n) for n in (12, 24)}


@query("g13_sentiment_set", select(G13, "g_base"), ["v_hourly"],
       {"g_base": "select series_id, ts_hour as date, value, cast(n as double) as n from v_hourly"})
def g13(spark, sf):
    df = V.hourly(spark, sf).select("series_id", F.col("ts_hour").alias("date"), "value", F.col("n").cast("double").alias("n"))
    df = S.sentiment_set(df, ("value", "n"))
    return df.select("series_id", "date", *[F.round(c, 8 if "sma" in c else 6).alias(c) for c in G13])


G14_BASE = {f"ret_{k}d": f"close / nullif(lag(close, {k}) over {W}, 0) - 1" for k in S.RETURNS}
for _n in S.LOG_VOLS:
    G14_BASE[f"log_vol_{_n}d"] = ("abs(l) * sqrt(252)" if _n == 1 else
        f"case when count(l) over {last_n(_n)} >= {max(2, _n // 2)} then stddev_pop(l) over {last_n(_n)} * sqrt(252) end")
G14 = {c: f"round({c}, 6)" for c in G14_BASE} | {f"{c}_zscore_63d": z(c, 63) for c in G14_BASE}


@query("g14_index_derived", select(G14, "g_base", any_present(G14)), ["v_bars"], {
    "g_log": f"select *, ln(close) - lag(ln(close)) over {W} as l from v_bars",
    "g_base": select(G14_BASE, "g_log")})
def g14(spark, sf):
    return pick(S.index_derived(V.bars(spark, sf)), 6, *G14)


# -- two series --------------------------------------------------------------

TWO = {"v_two": """select a.series_id, a.date, a.value as a, b.value as b from v_series a join v_series b
       on a.date = b.date and b.series_id = '1-URGENT' and a.series_id <> '1-URGENT'"""}


def two(spark, sf):
    s = V.series(spark, sf)
    return S.on_common_dates(s.where("series_id <> '1-URGENT'"), s.where("series_id = '1-URGENT'"))


G5 = {"pct_return_21d": roc("a", 21), "z_score_return_3m": z("r63", 63, 21),
      "above_sma_200": f"coalesce(cast(a > {raw_sma('a', 200, 100)} as int), 0)",
      "relative_performance": "round(a / nullif(b, 0), 6)",
      "beta_90d": f"""case when count(case when r1 is not null then m1 end) over {last_n(90)} >= 45
         then round(covar_samp(r1, m1) over {last_n(90)} / nullif(var_samp(m1) over {last_n(90)}, 0), 6) end"""}


@query("g5_em_equity", select(G5, "g_base"), ["v_series"], TWO | {
    "g_base": f"select *, a / lag(a, 63) over {W} - 1 as r63, a / lag(a) over {W} - 1 as r1, b / lag(b) over {W} - 1 as m1 from v_two"})
def g5(spark, sf):
    df = S.em_equity(two(spark, sf))
    return df.select("series_id", "date", *[F.col(c) if c == "above_sma_200" else F.round(c, 6).alias(c) for c in G5])


G9 = {"rs_ratio": "round(r, 6)", **{f"log_diff_{d}d": f"round(ln(r) - lag(ln(r), {d}) over {W}, 6)" for d in (1, 5, 20)},
      "return_spread_20d": "round(s, 6)", "z_score_spread_20d_window20d": z("s", 20), "z_score_spread_20d_window60d": z("s", 60)}


@query("g9_relative_strength", select(G9, "g_base"), ["v_series"], TWO | {
    "g_base": f"select *, a / nullif(b, 0) as r, (a / lag(a, 20) over {W} - 1) - (b / lag(b, 20) over {W} - 1) as s from v_two"})
def g9(spark, sf):
    return pick(S.relative_strength(two(spark, sf)), 6, *G9)


G10 = {"raw_ratio": "round(r, 6)", **{f"roc_{k}d": roc("r", k) for k in (21, 63, 126, 252)},
       **{f"sma_{n}d": sma("r", n, 6) for n in (20, 50, 200)}, **{f"zscore_value_{n}d": z("r", n) for n in (63, 252)},
       "percentile_1y": rank("r", 252), "vs_sma20_signal": sign(f"r - {raw_sma('r', 20)}"),
       "sma20_vs_sma50_signal": sign(f"{raw_sma('r', 20)} - {raw_sma('r', 50)}")}


@query("g10_intermarket_ratio", select(G10, "g_base", any_present([c for c in G10 if c != "raw_ratio"])), ["v_series"],
       TWO | {"g_base": "select *, a / nullif(b, 0) as r from v_two"})
def g10(spark, sf):
    df = S.intermarket_ratio(two(spark, sf))
    return df.select("series_id", "date", *[F.col(c) if c.endswith("signal") else F.round(c, 6).alias(c) for c in G10])


G11 = {"return_diff_20d": "round(s, 6)", "return_diff_20d_sma_20": sma("s", 20, 6), "return_diff_20d_sma_50": sma("s", 50, 6),
       "return_diff_20d_zscore_63d": z("s", 63), "return_diff_20d_zscore_252d": z("s", 252)}


@query("g11_stock_bond_difference", select(G11, "g_base", "return_diff_20d is not null"), ["v_series"], TWO | {
    "g_base": f"select *, (a / lag(a, 20) over {W} - 1) - (b / lag(b, 20) over {W} - 1) as s from v_two"})
def g11(spark, sf):
    return pick(S.stock_bond_difference(two(spark, sf)), 6, *G11)


# -- bars --------------------------------------------------------------------

A14 = "(1.0::double / 14)"
TECH = {
    "t1": f"""select *, row_number() over {W} as rn, close - lag(close) over {W} as d, high - lag(high) over {W} as up,
       lag(low) over {W} - low as dn, greatest(high - low, abs(high - lag(close) over {W}), abs(low - lag(close) over {W})) as tr,
       case when count(*) over {last_n(14)} >= 14 then min(low) over {last_n(14)} end as lo,
       case when count(*) over {last_n(14)} >= 14 then max(high) over {last_n(14)} end as hi from v_bars""",
    "t2": f"""select *, greatest(d, 0) as gain, greatest(-d, 0) as loss,
       coalesce(case when up > dn and up > 0 then up end, 0) as pdm, coalesce(case when dn > up and dn > 0 then dn end, 0) as mdm,
       100 * (close - lo) / nullif(hi - lo, 0) as k0, -100 * (hi - close) / nullif(hi - lo, 0) as w0 from t1""",
    # gains and losses start on the second row, so their recursion is numbered from there
    "t3": f"""select *, {fill('k0')} as k, {fill('w0')} as w,
       {ema_sql('close', '(2.0::double / 13)', 12)} as e12, {ema_sql('close', '(2.0::double / 27)', 26)} as e26,
       {ema_sql('tr', A14, 14)} as atr, {ema_sql('pdm', A14, 14)} as sp, {ema_sql('mdm', A14, 14)} as sm,
       case when rn >= 15 then sum(case when rn = 2 then gain when rn > 2 then {A14} * gain end * pow(1 - {A14}, -rn)) over {UPTO} * pow(1 - {A14}, rn) end as sg,
       case when rn >= 15 then sum(case when rn = 2 then loss when rn > 2 then {A14} * loss end * pow(1 - {A14}, -rn)) over {UPTO} * pow(1 - {A14}, rn) end as sl
       from t2""",
    "t4": f"""select *, e12 - e26 as m, 100 * sp / nullif(atr, 0) as pdi, 100 * sm / nullif(atr, 0) as mdi from t3""",
    "t5": f"""select *, coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) as dx from t4""",
    "t6": f"""select *, {ema_sql('dx', A14, 14)} as adx0,
       case when rn >= 34 then sum(case when rn = 26 then m when rn > 26 then 0.2::double * m end * pow(0.8::double, -rn)) over {UPTO} * pow(0.8::double, rn) end as ms
       from t5"""}
G1 = {**{f"sma_{n}": sma("close", n, 5) for n in (20, 50, 100, 200)},
      **{f"ema_{n}": f"round({ema_sql('close', f'(2.0::double / {n + 1})', n)}, 3)" for n in (20, 50, 100, 200)},
      "macd": "round(m, 3)", "macd_histogram": "round(m - ms, 3)",
      "rsi_14": "case when sg = 0 and sl = 0 then 0 when sl = 0 then 100 else round(100 - 100 / (1 + sg / sl), 4) end",
      "roc": f"round(100 * (close - lag(close, 12) over {W}) / nullif(lag(close, 12) over {W}, 0), 4)",
      "adx": "round(adx0, 4)", "stochastic_k": "round(k, 4)", "stochastic_d": sma("k", 3, 4), "williams_r": "round(w, 4)"}
TECH_DIGITS = {c: 5 if c.startswith("sma") else 3 if c.startswith(("ema", "macd")) else 4 for c in G1}


@query("g1_technical", select(G1, "t6", any_present(G1)), ["v_bars"], TECH)
def g1(spark, sf):
    df = S.technical(V.bars(spark, sf))
    return df.select("series_id", "date", *[F.round(c, d).alias(c) for c, d in TECH_DIGITS.items()])


G16_RAW = {"sma_20": raw_sma("close", 20), "sma_50": raw_sma("close", 50), "sma_200": raw_sma("close", 200),
           "rsi": "case when sg = 0 and sl = 0 then 0 when sl = 0 then 100 else 100 - 100 / (1 + sg / sl) end",
           "h": "m - ms", "adx": "adx0", "k": "k", "close": "close", "rc": f"lag(close, 12) over {W}"}
G16 = {"price_vs_sma50_pct_diff": "round((close - sma_50) / nullif(sma_50, 0), 6)",
       "price_vs_sma200_pct_diff": "round((close - sma_200) / nullif(sma_200, 0), 6)",
       "sma20_vs_sma50_signal": sign("sma_20 - sma_50"), "sma50_vs_sma200_signal": sign("sma_50 - sma_200"),
       "rsi_14_zscore_60d": z("rsi", 60), "rsi_14_percentile_252d": rank("rsi", 252), "macd_hist_roc_5d": roc("h", 5, 4),
       "adx_level_signal": "case when adx < 20 then 0 when adx < 40 then 1 when adx is not null then 2 end",
       "stoch_k_oversold_signal": "coalesce(cast(k < 20 as int), 0)", "stoch_k_overbought_signal": "coalesce(cast(k > 80 as int), 0)"}


@query("g16_technical_second_stage", select(G16, "t8"), ["v_bars"], TECH | {
    "t7": select(G16_RAW, "t6"), "t8": "select * from t7 where coalesce(sma_20, rsi, h, adx, k, rc) is not null"})
def g16(spark, sf):
    bars = V.bars(spark, sf)
    df = S.technical_second(S.technical(bars), bars.select("series_id", "date", F.col("close").alias("close_price")))
    return df.select("series_id", "date", *[
        F.col(c) if c.endswith("signal") else F.round(c, 4 if "macd" in c else 6).alias(c) for c in G16])


ONE = "(order by date)"
ONE_UPTO = "(order by date rows between unbounded preceding and current row)"


def one_n(n):
    return f"(order by date rows between {n - 1} preceding and current row)"


VOL_SQL = {
    "x1": f"""select series_id, date, value,
       case when count(*) over {last_n(20)} >= 20 then avg(value) over {last_n(20)} end as s20,
       case when count(*) over {last_n(50)} >= 50 then avg(value) over {last_n(50)} end as s50 from v_series""",
    "x2": f"""select date, {ema_sql('tr', A14, 14)} as atr from (select *, row_number() over {W} as rn,
       greatest(high - low, abs(high - lag(close) over {W}), abs(low - lag(close) over {W})) as tr from v_bars where series_id = 'A') t""",
    "x3": """select date, max(vix) as vix, max(vix_sma_20) as vix_sma_20, max(vix_sma_50) as vix_sma_50, max(vvix) as vvix,
       max(atr) as atr, max(skew_index) as skew_index from (
       select date, value as vix, s20 as vix_sma_20, s50 as vix_sma_50, null as vvix, null as atr, null as skew_index from x1 where series_id = '1-URGENT'
       union all select date, null, null, null, value, null, null from x1 where series_id = '2-HIGH'
       union all select date, null, null, null, null, null, value from x1 where series_id = '3-MEDIUM'
       union all select date, null, null, null, null, atr, null from x2) u group by date""",
    "x4": "select date, atr, " + ", ".join(f"last_value({c} ignore nulls) over {ONE_UPTO} as {c}" for c in
           ("vix", "vix_sma_20", "vix_sma_50", "vvix", "skew_index")) + " from x3"}
VOL_DIGITS = {"vix": 2, "vix_sma_20": 4, "vix_sma_50": 4, "vvix": 2, "atr": 3, "skew_index": 2}


def volatility_table(spark, sf):
    s, bars = V.series(spark, sf), V.bars(spark, sf).where("series_id = 'A'").drop("series_id")
    def of(name):
        return s.where(F.col("series_id") == name).select("date", "value")
    return S.volatility_table(of("1-URGENT"), of("2-HIGH"), of("3-MEDIUM"), bars)


@query("g2_volatility_table", "select date, " + ", ".join(f"round({c}, {d}) as {c}" for c, d in VOL_DIGITS.items()) +
       " from x4 where coalesce(vix, vix_sma_20, vix_sma_50, vvix, atr, skew_index) is not null", ["v_series", "v_bars"], VOL_SQL)
def g2(spark, sf):
    return volatility_table(spark, sf).select("date", *[F.round(c, d).alias(c) for c, d in VOL_DIGITS.items()])


G17 = {"vix_roc_21d": roc("vix", 21), "vix_roc_63d": roc("vix", 63), "vix_zscore_63d": z("vix", 63), "vix_percentile_252d": rank("vix", 252),
       "vix_vs_sma20_signal": sign("vix - vix_sma_20"), "vvix_roc_21d": roc("vvix", 21), "vvix_zscore_63d": z("vvix", 63),
       "vvix_percentile_252d": rank("vvix", 252), "vix_vvix_ratio": "round(vix / nullif(vvix, 0), 6)",
       "skew_index_zscore_63d": z("skew_index", 63), "skew_index_percentile_252d": rank("skew_index", 252),
       "atr_pct_of_price": "round(100 * atr / nullif(price, 0), 4)"}


@query("g17_volatility_second_stage", select(G17, "x5", keys="date"), ["v_series", "v_bars"], VOL_SQL | {
    "x5": """select 1 as series_id, t.*, p.close as price from (select * from x4 where coalesce(vix, vvix, atr, skew_index) is not null) t
       asof left join (select date, close from v_bars where series_id = 'N') p on t.date >= p.date"""})
def g17(spark, sf):
    key = F.lit(1).alias("series_id")
    table = volatility_table(spark, sf).select(key, "*")
    price = V.bars(spark, sf).where("series_id = 'N'").select(key, F.col("date").alias("price_date"), F.col("close").alias("close_price"))
    df = S.volatility_second(joins.asof(table, price, ["series_id"], "date", "price_date", ["close_price"]))
    return df.select("date", *[F.col(c) if c.endswith("signal") else F.round(c, 4 if "atr" in c else 6).alias(c) for c in G17])


GAP_BASE = {"g_base": f"select *, {fill('value')} as f from v_gaps"}
G18 = {"sma_5d": sma("value", 5, 4), "sma_21d": sma("value", 21, 4), "vs_sma21d_diff": f"round(value - {raw_sma('value', 21)}, 4)",
       "roc_5d": roc("f", 5), "roc_21d": roc("f", 21), "zscore_63d": z("value", 63), "percentile_252d": rank("value", 252)}


@query("g18_put_call_second_stage", select(G18, "g_base"), ["v_gaps"], GAP_BASE)
def g18(spark, sf):
    df = S.put_call_second(V.gaps(spark, sf))
    return df.select("series_id", "date", *[F.round(c, 4 if "sma" in c else 6).alias(c) for c in G18])


@query("g18_put_call_second_stage_long_series", select(G18, "g_base"), ["v_gaps"], GAP_BASE)
def g18_long(spark, sf):
    df = chunks.by_chunk(V.gaps(spark, sf), DAILY, S.put_call_second, before=252, fill=("value",), target_rows=LONG)
    return df.select("series_id", "date", *[F.round(c, 4 if "sma" in c else 6).alias(c) for c in G18])


G20 = {"sma_5d": G18["sma_5d"], "sma_21d": G18["sma_21d"], "vs_sma21d_diff": G18["vs_sma21d_diff"], "roc_5d": roc("f", 5),
       "is_extreme_fear_signal": "coalesce(cast(value < 100000 as int), 0)",
       "is_extreme_greed_signal": "coalesce(cast(value > 500000 as int), 0)", "percentile_252d": rank("value", 252)}


@query("g20_fear_greed_second_stage", select(G20, "g_base"), ["v_gaps"], GAP_BASE)
def g20(spark, sf):
    df = S.fear_greed_second(V.gaps(spark, sf), fear=100000, greed=500000)
    return df.select("series_id", "date", *[
        F.col(c) if c.endswith("signal") else F.round(c, 4 if "sma" in c else 6).alias(c) for c in G20])
