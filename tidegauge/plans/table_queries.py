"""Panels, the master table, column profiles and imputation."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions import scalars as C
from tidegauge.operators import impute as I, joins, master as M, panel as P, profile as Q, signals as S
from tidegauge.operators.axis import DAILY, Axis
from tidegauge.plans import views as V
from tidegauge.plans.registry import query
from tidegauge.plans.rolling_queries import STATES, UPTO, W, last_n, states
from tidegauge.plans.signal_queries import raw_sma, roc, select, sma

# -- breadth -----------------------------------------------------------------

LISTS = {"v_lists": "select date, string_agg(cast(ticker as varchar), ',' order by ticker) as tickers from v_member group by date"}


def lists(spark, sf):
    return V.members(spark, sf).groupBy("date").agg(
        F.array_join(F.array_sort(F.collect_list("ticker")).cast("array<string>"), ",").alias("tickers"))


@query("c8_member_lists", """
select date, ticker, n from (select date, count(*) as n from v_member group by date) c join v_member using (date)""", ["v_member"])
def c8(spark, sf):
    doubled = lists(spark, sf).withColumn("tickers", F.concat_ws(",", "tickers", "tickers"))     # repeats must vanish
    m = doubled.withColumn("m", C.member_list("tickers"))
    return m.select("date", F.explode("m").alias("ticker"), F.size("m").cast("long").alias("n")) \
            .withColumn("ticker", F.col("ticker").cast("long"))


BREADTH = LISTS | {
    "b_days": """select date, list_date from (
       select cast(d as date) as date from (select unnest(generate_series((select min(date) from v_lists),
         greatest((select max(date) from v_lists), (select max(date) from v_panel)), interval 1 day)) as d) t
       where isodow(cast(d as date)) < 6) s
       asof join (select date as list_date from v_lists where isodow(date) < 6) l on s.date >= l.list_date""",
    "b_states": """select ticker, date, close, case when count(*) over w50 >= 50 then avg(close) over w50 end as s50,
       case when count(*) over w200 >= 200 then avg(close) over w200 end as s200,
       close - lag(close) over (partition by ticker order by date) as step from v_panel
       window w50 as (partition by ticker order by date rows between 49 preceding and current row),
              w200 as (partition by ticker order by date rows between 199 preceding and current row)""",
    "b_counts": """select d.date, count(s50) as n50, count(s200) as n200, count(*) filter (where close > s50) as a50,
       count(*) filter (where close > s200) as a200, count(*) filter (where step > 0) as adv, count(*) filter (where step < 0) as dec
       from b_days d join v_member m on m.date = d.list_date join b_states p on p.date = d.date and p.ticker = m.ticker group by d.date""",
    "breadth": """select d.date, 100.0 * a50 / nullif(n50, 0) as pct_above_sma50, 100.0 * a200 / nullif(n200, 0) as pct_above_sma200,
       cast(sum(coalesce(adv - dec, 0)) over (order by d.date) as bigint) as ad_line,
       case when dec > 0 then adv * 1.0::double / dec when adv > 0 then 'Infinity'::double end as ad_ratio
       from b_days d left join b_counts c on d.date = c.date"""}


def breadth(spark, sf):
    return P.index_breadth(lists(spark, sf), V.panel(spark, sf))


@query("g3_index_breadth", """
select date, round(pct_above_sma50, 4) as pct_above_sma50, round(pct_above_sma200, 4) as pct_above_sma200, ad_line,
       round(ad_ratio, 6) as ad_ratio from breadth""", ["v_member", "v_panel"], BREADTH)
def g3(spark, sf):
    df = breadth(spark, sf)
    return df.select("date", F.round("pct_above_sma50", 4).alias("pct_above_sma50"),
                     F.round("pct_above_sma200", 4).alias("pct_above_sma200"), "ad_line", F.round("ad_ratio", 6).alias("ad_ratio"))


G19 = {"pct_above_sma50_roc_21d": roc("p50", 21), "pct_above_sma200_roc_21d": roc("p200", 21), "ad_line_roc_21d": roc("ad_line", 21),
       "ad_line_sma_21d_diff": f"round(ad_line - {raw_sma('ad_line', 21)}, 4)", "ad_ratio_sma_5d": sma("ratio", 5, 6)}


@query("g19_breadth_second_stage", select(G19, "b2", keys="date"), ["v_member", "v_panel"], BREADTH | {
    "b1": "select 1 as series_id, *, case when ad_ratio < 'Infinity'::double then ad_ratio end as ratio from breadth",
    "b2": f"select series_id, date, cast(ad_line as double) as ad_line, ratio, last_value(pct_above_sma50 ignore nulls) over {UPTO} as p50, "
          f"last_value(pct_above_sma200 ignore nulls) over {UPTO} as p200 from b1"})
def g19(spark, sf):
    df = S.breadth_second(breadth(spark, sf).withColumn("series_id", F.lit(1)))
    return df.select("date", *[F.round(c, 4 if "diff" in c else 6).alias(c) for c in G19])


@query("t5_advances_declines", """
select date, count(*) as n, count(*) filter (where step > 0) as advances, count(*) filter (where step < 0) as declines,
  round(count(*) filter (where step > 0) * 1.0::double / nullif(count(*) filter (where step < 0), 0), 6) as ratio
from (select *, close - lag(close) over (partition by ticker order by date) as step from v_panel) t group by date""", ["v_panel"])
def t5(spark, sf):
    df = P.price_states(V.panel(spark, sf))
    return df.groupBy("date").agg(
        F.count("*").alias("n"), F.count_if("advancing").alias("advances"), F.count_if("declining").alias("declines")) \
        .withColumn("ratio", F.round(F.try_divide("advances", "declines"), 6))


# -- panel sources -----------------------------------------------------------

@query("s11_first_source_wins", """
select ticker, date, close, 0 as priority from a union all
select ticker, date, close, 1 from b where ticker not in (select ticker from a)""", ["v_panel"], {
    "a": "select * from v_panel where ticker % 3 = 0",
    "b": "select ticker, date, close * 2 as close from v_panel where ticker % 2 = 0"})
def s11(spark, sf):
    p = V.panel(spark, sf)
    return P.first_source([p.where("ticker % 3 = 0"), p.where("ticker % 2 = 0").withColumn("close", F.col("close") * 2)]) \
            .select("ticker", "date", "close", "priority")


RANGES = """select ticker, case when ticker % 7 = 0 then null else date '1996-01-01' + cast(ticker as int) end as start_date,
  case when ticker % 2 = 0 then date '1997-06-01' end as end_date from (select distinct ticker from v_panel) t"""


@query("s12_validity_with_lookback", f"""
select p.ticker, p.date, p.close from v_panel p join ranges r on p.ticker = r.ticker
where r.start_date is not null and p.date between r.start_date - 250 and coalesce(r.end_date, date '2001-01-01')""",
       ["v_panel"], {"ranges": RANGES})
def s12(spark, sf):
    prices = V.panel(spark, sf)
    ranges = prices.select("ticker").distinct().select(
        "ticker", F.when(F.col("ticker") % 7 != 0, F.date_add(F.lit("1996-01-01").cast("date"), F.col("ticker").cast("int"))).alias("start_date"),
        F.when(F.col("ticker") % 2 == 0, F.lit("1997-06-01").cast("date")).alias("end_date"))
    return P.within_validity(prices, ranges, "2001-01-01").select("ticker", "date", "close")


@query("s13_resume_skips_done", """
select ticker, date, close from v_panel where ticker not in (select ticker from v_panel where ticker % 3 = 1 and close > 90000)""", ["v_panel"])
def s13(spark, sf):
    p = V.panel(spark, sf)
    return P.not_yet_done(p, p.where("ticker % 3 = 1 and close > 90000")).select("ticker", "date", "close")


# -- master table ------------------------------------------------------------

RATIO = {"v_ratio": """select a.date, a.series_id as ratio_name, a.value / b.value as raw_ratio, a.value - b.value as gap from v_series a
       join v_series b on a.date = b.date and b.series_id = '1-URGENT' and a.series_id <> '1-URGENT'"""}
RATIO_KEYS = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def ratios(spark, sf):
    s = V.series(spark, sf)
    base = s.where("series_id = '1-URGENT'").select("date", F.col("value").alias("b"))
    return s.where("series_id <> '1-URGENT'").join(base, "date").select(
        "date", F.col("series_id").alias("ratio_name"), F.try_divide("value", "b").alias("raw_ratio"), (F.col("value") - F.col("b")).alias("gap"))


def _ratio_pivot(digits=True):
    parts = []
    for k in RATIO_KEYS:
        for v in ("raw_ratio", "gap"):
            e = f"avg(case when ratio_name = '{k}' then {v} end)"
            parts.append((M.ratio_name(v, k), f"round({e}, 4)" if digits else e))
    return parts


def quoted(n):
    return f'"{n}"'


@query("t7_named_pivot", "select date, " + ", ".join(f"{e} as {quoted(n)}" for n, e in _ratio_pivot()) + " from v_ratio group by date",
       ["v_series"], RATIO)
def t7(spark, sf):
    df = M.pivot_named(ratios(spark, sf), "ratio_name", ["raw_ratio", "gap"], M.ratio_name)
    return df.select("date", *[F.round(f"`{n}`", 4).alias(n) for n, _ in _ratio_pivot()])


@query("t7_treasury_pivot", "select date, " + ", ".join(
    f"max(case when series_id = '{k}' then value end) as {quoted(M.treasury_name('value', k))}" for k in V.WIDE.values()) +
    " from v_series group by date", ["v_series"])
def t7_treasury(spark, sf):
    return M.pivot_named(V.series(spark, sf), "series_id", ["value"], M.treasury_name, keys=list(V.WIDE.values()))


DAILY_PARTS = {"bar_a_": "A", "bar_n_": "N"}
VINTAGE_PARTS = {"cpi_": "A", "nfp_": "R"}
MASTER = STATES | RATIO | {
    "m_labels": f"select date, state as regime_t, lead(state, 126) over (order by date) as regime_t_plus_6m from v_state where series_id = '1-URGENT'",
    "m_spine": """select cast(d as date) as date from (select unnest(generate_series((select min(date) from m_labels),
       (select max(date) from m_labels), interval 1 day)) as d) t where isodow(cast(d as date)) < 6""",
    **{f"m_{s}": f"""select release_date, max(reference_date) as reference_date, max_by(value, reference_date) as value,
       max_by(coalesce(value2, -1), reference_date) as v2 from v_vintage where series_id = '{s}' group by release_date""" for s in "ANR"},
    "m_pivot": "select date, " + ", ".join(f"{e} as {quoted(n)}" for n, e in _ratio_pivot(False)) + " from v_ratio group by date"}


def master_sql(daily, vintages):
    return ("select s.date, l.regime_t, l.regime_t_plus_6m, "
              + ", ".join(f"{p[:-1]}.{c} as {p}{c}" for p in daily for c in ("open", "high", "low", "close", "volume")) + ", "
              + ", ".join(f"{p[:-1]}.reference_date as {p}ref_date, {p[:-1]}.value as {p}value, case when {p[:-1]}.v2 >= 0 then {p[:-1]}.v2 end as {p}value2"
                          for p in vintages) + ", "
              + ", ".join(f"round(p.{quoted(n)}, 4) as {quoted(n)}" for n, _ in _ratio_pivot(False))
              + " from m_spine s join m_labels l on s.date = l.date "
              + " ".join(f"left join v_bars {p[:-1]} on {p[:-1]}.date = s.date and {p[:-1]}.series_id = '{k}'" for p, k in daily.items())
              + " " + " ".join(f"asof left join m_{k} {p[:-1]} on s.date >= {p[:-1]}.release_date" for p, k in vintages.items())
              + " left join m_pivot p on p.date = s.date where l.regime_t is not null")


def master(spark, sf, daily, vintages):
    bars, releases = V.bars(spark, sf), V.vintage(spark, sf)
    labels = states(spark, sf).where("series_id = '1-URGENT'").select("date", F.col("state").alias("regime_t"))
    wide = M.pivot_named(ratios(spark, sf), "ratio_name", ["raw_ratio", "gap"], M.ratio_name, keys=RATIO_KEYS)
    df = M.master_table(labels, {p: bars for p in daily}, {p: releases for p in vintages}, [wide],
                        filters={p: {"series_id": k, "absent": "x"} for p, k in {**daily, **vintages}.items()})
    rounded = {n for n, _ in _ratio_pivot(False)}
    return df.select(*[F.round(f"`{c}`", 4).alias(c) if c in rounded else F.col(f"`{c}`") for c in df.columns])


EVERY_DAILY = {"bar_a_": "A", "bar_n_": "N", "bar_r_": "R"}
EVERY_VINTAGE = {"cpi_": "A", "gdp_": "N", "nfp_": "R"}


@query("g26_master_table_every_series", master_sql(EVERY_DAILY, EVERY_VINTAGE), ["v_series", "v_bars", "v_vintage"], MASTER)
def g26_every(spark, sf):
    return master(spark, sf, EVERY_DAILY, EVERY_VINTAGE)


@query("g26_master_table", master_sql(DAILY_PARTS, VINTAGE_PARTS), ["v_series", "v_bars", "v_vintage"], MASTER)
def g26(spark, sf):
    return master(spark, sf, DAILY_PARTS, VINTAGE_PARTS)


@query("p1_feature_columns", "select series_id, date, open as x_open, high as x_high, low as x_low, close as x_close, volume as x_volume from v_bars",
       ["v_bars"])
def p1(spark, sf):
    df = M.scan(V.bars(spark, sf), {"no_such_column": 1})
    return df.select("series_id", "date", *[F.col(c).alias(f"x_{c}") for c in M.feature_columns(df)])


@query("s17_filtered_scan", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem
where l_returnflag = 'R' and l_linestatus = 'F' and l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01'""")
def s17(spark, sf):
    df = M.scan(V.table(spark, sf, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F", "absent": "x"})
    return df.where("l_shipdate >= timestamp_ntz '1996-01-01' and l_shipdate < timestamp_ntz '1997-01-01'") \
             .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("p2_drop_empty_rows", "select * from v_wide where coalesce(f_urgent, f_high) is not null", ["v_wide"])
def p2(spark, sf):
    return S.some_present(V.wide(spark, sf), ["f_urgent", "f_high"])


@query("p3_drop_rows_missing_keys", "select * from v_wide where f_urgent is not null and f_high is not null", ["v_wide"])
def p3(spark, sf):
    return V.wide(spark, sf).dropna(subset=["f_urgent", "f_high"])


@query("p4_warm_up_cut", f"""
select * from (select series_id, date, {sma('value', 63)} as sma_63 from v_series) t where date >= date '1998-01-01'""", ["v_series"])
def p4(spark, sf):
    df = V.series(spark, sf).withColumn("sma_63", R.sma(DAILY, "value", 63))
    return S.from_date(df, DAILY, "1998-01-01").select("series_id", "date", F.round("sma_63", 4).alias("sma_63"))


@query("p5_complete_columns", "select date, f_low, cast(null as double) as absent, f_high from v_wide", ["v_wide"])
def p5(spark, sf):
    return M.complete_columns(V.wide(spark, sf), {"date": "date", "f_low": "double", "absent": "double", "f_high": "double"})


@query("p6_informative_columns", "select date, f_urgent, f_high, f_medium, f_none, f_low from v_wide", ["v_wide"])
def p6(spark, sf):
    df = V.wide(spark, sf).withColumns({"flat": F.lit(1.5), "empty": F.lit(None).cast("double"), "label": F.lit("x")})
    return df.select("date", *M.informative_columns(df))


@query("p7_drop_non_stationary", "select date, f_high, f_low from v_wide", ["v_wide"])
def p7(spark, sf):
    # a far-off column stands in for one the summary calls non-stationary
    df = V.wide(spark, sf).select("date", "f_high", "f_low", (F.col("f_high") + 1e9).alias("f_far"))
    summary = Q.describe(Q.to_long(df, ["f_high", "f_low", "f_far"])).select(
        "column_name", F.when(F.col("mean") > 1e8, "Non-Stationary").otherwise("Stationary").alias("overall_stationarity"))
    return M.drop_non_stationary(df, summary)


@query("p8_theme_table", "select date, f_high, f_low, f_urgent from v_wide", ["v_wide"])
def p8(spark, sf):
    return M.theme_table(V.wide(spark, sf), ["f_urgent", "f_low", "f_high", "not_there"])


@query("p9_melt", """
select date, 'Urgent' as priority, f_urgent as value from v_wide union all select date, 'Low', f_low from v_wide""", ["v_wide"])
def p9(spark, sf):
    names = F.create_map(F.lit("f_urgent"), F.lit("Urgent"), F.lit("f_low"), F.lit("Low"))
    df = V.wide(spark, sf).unpivot(["date"], ["f_urgent", "f_low"], "column_name", "value")
    return df.select("date", names[F.col("column_name")].alias("priority"), "value")


@query("w14_label_ahead", """
select series_id, date, state as regime_t, lead(state, 126) over (partition by series_id order by date) as regime_t_plus_6m from v_state""",
       ["v_series"], STATES)
def labels_ahead(spark, sf):
    df = states(spark, sf).select("series_id", "date", F.col("state").alias("regime_t"))
    return M.labels_ahead(df, by=["series_id"]).select("series_id", "date", "regime_t", "regime_t_plus_6m")


# -- profiles ----------------------------------------------------------------

COLS = list(V.WIDE)
LONG = {"v_long": "select series_id as column_name, date, value from v_gaps"}


@query("t9_transition_shares", """
select a, b, n, round(n / sum(n) over (partition by a), 6) as share from (
 select state as a, ahead as b, count(*) as n from (select state, lead(state, 126) over (partition by series_id order by date) as ahead from v_state) t
 where ahead is not null group by 1, 2) u""", ["v_series"], STATES)
def t9(spark, sf):
    df = states(spark, sf).withColumn("b", R.lead(DAILY, "state", 126)).where("b is not null").withColumnRenamed("state", "a")
    return Q.class_shares(df, "b", ["a"]).select("a", "b", "n", F.round("share", 6).alias("share"))


@query("t10_null_counts", " union all ".join(
    f"select '{c}' as column_name, count(*) - count({c}) as null_count, round(100.0 * (count(*) - count({c})) / count(*), 4) as null_pct from v_wide"
    for c in COLS), ["v_wide"])
def t10(spark, sf):
    return Q.null_counts(V.wide(spark, sf), COLS).select("column_name", "null_count", F.round("null_pct", 4).alias("null_pct"))


DESCRIBE = ("count(value) as count, round(avg(value), 3) as mean, round(stddev_samp(value), 3) as std, min(value) as min, "
            "round(quantile_cont(value, 0.25), 4) as p25, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.75), 4) as p75, max(value) as max")


def described(df, by):
    return df.select(*by, "count", *[F.round(c, 3).alias(c) for c in ("mean", "std")], "min",
                     *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("t11_describe", f"select column_name, {DESCRIBE} from v_long group by column_name", ["v_gaps"], LONG)
def t11(spark, sf):
    return described(Q.describe(Q.to_long(V.wide(spark, sf), COLS)), ["column_name"])


PRICE_QUANTILES = """
select l_returnflag as flag, round(quantile_cont(l_extendedprice, 0.25), 4) as p25, round(quantile_cont(l_extendedprice, 0.5), 4) as p50,
  round(quantile_cont(l_extendedprice, 0.9), 4) as p90 from lineitem group by l_returnflag"""


@query("t11_exact_percentiles_hot_groups", PRICE_QUANTILES)
def t11_hot(spark, sf):
    from tidegauge.operators.chunks import percentiles
    df = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    out = percentiles(df, ["flag"], "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p90": 0.9}, target_rows=5000)
    return out.select("flag", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p90")])


PAIRS = {"pairs": " union all ".join(
    f"select '{a}' as a, '{b}' as b, count(case when {b} is not null then {a} end) as n, covar_samp({a}, {b}) as cov, corr({a}, {b}) as r from v_wide"
    for i, a in enumerate(COLS) for b in COLS[i:])}


@query("t12_covariance_correlation", "select a, b, n, round(cov, 1) as covariance, round(r, 6) as correlation from pairs", ["v_wide"], PAIRS)
def t12(spark, sf):
    return Q.moments(V.wide(spark, sf), COLS).select("a", "b", "n", F.round("covariance", 1).alias("covariance"),
                                                     F.round("correlation", 6).alias("correlation"))


THEMES = {"f_u": ("t", "Fast"), "f_h": ("t", "Fast"), "f_m": ("t", "Slow"), "f_": ("t", "Rest")}


def themes(spark, sf):
    return Q.classify(spark.createDataFrame([(c,) for c in COLS], "column_name string"), THEMES)


THEME_SQL = {"themes": "select * from (values ('f_urgent', 'Fast'), ('f_high', 'Fast'), ('f_medium', 'Slow'), ('f_none', 'Rest'), ('f_low', 'Rest')) t(c, theme)"}


@query("t13_theme_correlation", """
select least(x.theme, y.theme) as theme_a, greatest(x.theme, y.theme) as theme_b, round(avg(abs(r)), 6) as mean_abs_corr
from pairs join themes x on pairs.a = x.c join themes y on pairs.b = y.c where a <> b group by 1, 2""", ["v_wide"], PAIRS | THEME_SQL)
def t13(spark, sf):
    df = Q.theme_correlation(Q.moments(V.wide(spark, sf), COLS), themes(spark, sf))
    return df.select("theme_a", "theme_b", F.round("mean_abs_corr", 6).alias("mean_abs_corr"))


@query("o6_strongest_pairs", """
(select a, b, round(r, 6) as correlation, 'positive' as side from pairs where a <> b order by r desc limit 3) union all
(select a, b, round(r, 6), 'negative' from pairs where a <> b order by r limit 3)""", ["v_wide"], PAIRS)
def o6(spark, sf):
    df = Q.strongest_pairs(Q.moments(V.wide(spark, sf), COLS), 3)
    return df.select("a", "b", F.round("correlation", 6).alias("correlation"), "side")


PROFILE = {
    "q_gap": "select *, date - lag(date) over (partition by column_name order by date) as gap from v_long where value is not null",
    "q_mode": """select column_name, gap from (select column_name, gap, row_number() over (partition by column_name order by count(*) desc, gap) as k
       from q_gap where gap is not null group by column_name, gap) t where k = 1""",
    "q_stat": """select column_name, count(*) as n, min(date) as first, max(date) as last, count(*) filter (where isodow(date) < 6) as wd
       from q_gap group by column_name""",
    "q_cad": """select s.*, m.gap, case when m.gap <= 3 and wd * 1.0 / n > 0.8 and n * 1.0 /
         len(list_filter(generate_series(first, last, interval 1 day), lambda d: isodow(d) < 6)) > 0.6 then 'Daily (Business)'
         when m.gap <= 3 then 'Daily-like (Mode: ' || m.gap || ' days)' when m.gap between 5 and 9 then 'Weekly'
         when m.gap between 18 and 24 then 'Monthly (Business Days approx)' when m.gap between 25 and 35 then 'Monthly (Calendar approx)'
         when m.gap between 58 and 70 then 'Quarterly (Business Days approx)' when m.gap between 80 and 100 then 'Quarterly (Calendar approx)'
         else 'Irregular (Mode: ' || m.gap || ' days)' end as cadence from q_stat s left join q_mode m using (column_name)""",
    "q_inner": """select l.column_name, l.date, l.date - lag(l.date) over (partition by l.column_name order by l.date) as gap_days from v_long l join q_cad c using (column_name)
       where l.value is null and l.date between c.first and c.last and (c.cadence <> 'Daily (Business)' or isodow(l.date) < 6)""",
    "q_inner_all": """select column_name, count(*) as n, string_agg(cast(date as varchar), ',' order by date) as dates,
       string_agg(cast(gap_days as varchar), ',' order by date) as gaps from q_inner group by column_name""",
    "q_nulls": "select column_name, count(*) - count(value) as nulls, min(case when value is not null then date end) as first, max(case when value is not null then date end) as last from v_long group by column_name"}


@query("t14_cadence", """
select column_name, cadence as general_cadence, cast(case when cadence = 'Daily (Business)' then 1 else gap end as int) as typical_cadence_days from q_cad""",
       ["v_gaps"], LONG | PROFILE)
def t14(spark, sf):
    return Q.cadence(Q.to_long(V.wide(spark, sf), COLS))


@query("t15_valid_span", """
select column_name, nulls as null_count, first is null as is_all_null, first as first_valid_date, last as last_valid_date from q_nulls""",
       ["v_gaps"], LONG | PROFILE)
def t15(spark, sf):
    return Q.valid_span(Q.to_long(V.wide(spark, sf), COLS))


@query("t16_interior_nulls", "select column_name, date, cast(gap_days as int) as gap_days from q_inner", ["v_gaps"], LONG | PROFILE)
def t16(spark, sf):
    long = Q.to_long(V.wide(spark, sf), COLS)
    return Q.interior_nulls(long, Q.valid_span(long), Q.cadence(long))


G27_SQL = """
select n.column_name, n.nulls as nan_count, n.first is null as is_all_nan, 'parquet' as source_table,
  case when n.column_name in ('f_urgent', 'f_high') then 'Fast' when n.column_name = 'f_medium' then 'Slow' else 'Rest' end as theme,
  n.first as first_valid_data_date, c.cadence as general_cadence,
  cast(case when c.cadence = 'Daily (Business)' then 1 else c.gap end as int) as typical_cadence_days,
  i.n is not null as has_extraordinary_nans, coalesce(i.dates, '') as dates, coalesce(i.gaps, '') as gaps, coalesce(i.n, 0) as num_extraordinary_nans
from q_nulls n left join q_cad c using (column_name) left join q_inner_all i using (column_name)"""


def _profile(wide):
    prefixes = {p: ("parquet", t) for p, (_, t) in THEMES.items()}
    df = Q.column_profile(wide, COLS, prefixes=prefixes)
    return df.withColumns({"dates": F.array_join(F.col("extraordinary_nan_dates").cast("array<string>"), ","),
                           "gaps": F.array_join(F.col("extraordinary_nan_timedeltas_days").cast("array<string>"), ",")}) \
             .drop("extraordinary_nan_dates", "extraordinary_nan_timedeltas_days")


@query("g27_column_profile", G27_SQL, ["v_gaps"], LONG | PROFILE)
def g27(spark, sf):
    return _profile(V.wide(spark, sf))


@query("g27_column_profile_business_days", G27_SQL, ["v_gaps"],
       {"v_long": "select series_id as column_name, date, value from v_gaps where isodow(date) < 6"} | PROFILE)
def g27_business(spark, sf):
    return _profile(V.wide(spark, sf).where(F.weekday("date") < 5))


@query("c10_prefix_themes", """
select p_partkey, name, case when name like 'vol_%' then 'volatility_indicators' when name like 'em_tbill_spread_%' then 'em_corporate_vs_tbill_spread'
  when name like 'em_%' then 'em_equity_signals' when name like 'cpi_%' then 'cpi_signals' else 'Unknown' end as source_table
from (select p_partkey, case p_partkey % 5 when 0 then 'vol_' when 1 then 'em_tbill_spread_' when 2 then 'em_' when 3 then 'cpi_' else 'zzz_' end
  || cast(p_size as varchar) as name from part) t""")
def c10(spark, sf):
    k = F.col("p_partkey") % 5
    prefix = F.when(k == 0, "vol_").when(k == 1, "em_tbill_spread_").when(k == 2, "em_").when(k == 3, "cpi_").otherwise("zzz_")
    names = V.table(spark, sf, "part").select("p_partkey", F.concat(prefix, F.col("p_size").cast("string")).alias("name"))
    return Q.classify(names, column="name").select("p_partkey", "name", "source_table")


@query("c10_longest_prefix_themes", """
select p_partkey, case p_partkey % 3 when 0 then 'Tbill' when 1 then 'Emerging' else 'Unknown' end as theme from part""")
def c10_longest(spark, sf):
    prefixes = {"em_": ("a", "Emerging"), "em_tbill_": ("b", "Tbill")}
    k = F.col("p_partkey") % 3
    name = F.concat(F.when(k == 0, "em_tbill_").when(k == 1, "em_").otherwise("zz_"), F.col("p_size").cast("string"))
    return Q.classify(V.table(spark, sf, "part").select("p_partkey", name.alias("name")), prefixes, "name", longest=True).select("p_partkey", "theme")


@query("t24_class_shares", """
select label, n, round(n / sum(n) over (), 6) as share from (select label, count(*) as n from embeddings group by label) t""")
def t24(spark, sf):
    return Q.class_shares(V.table(spark, sf, "embeddings"), "label").select("label", "n", F.round("share", 6).alias("share"))


@query("t24_cardinality", """
select column_name, count(distinct value) as n_distinct, count(distinct value) < 15 as is_low_cardinality from (
 select 'l_quantity' as column_name, l_quantity as value from lineitem union all select 'l_discount', l_discount from lineitem
 union all select 'l_tax', l_tax from lineitem union all select 'l_linenumber', l_linenumber from lineitem) t group by column_name""")
def t24_cardinality(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return Q.cardinality(Q.to_long(V.table(spark, sf, "lineitem"), cols, ()))


@query("t25_release_lags", f"select series_id, {DESCRIBE} from (select series_id, cast(release_date - reference_date as double) as value from v_vintage) t group by series_id",
       ["v_vintage"])
def t25(spark, sf):
    return described(Q.release_lags(V.vintage(spark, sf), "release_date", "reference_date", ["series_id"]), ["series_id"])


@query("t26_five_numbers_by_state", """
select feature, state, count(value) as count, min(value) as min, round(quantile_cont(value, 0.25), 4) as p25,
  round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.75), 4) as p75, max(value) as max
from (select 'high' as feature, cast(floor(volume) as int) % 3 as state, high as value from v_bars
      union all select 'low', cast(floor(volume) as int) % 3, low from v_bars) t group by feature, state""", ["v_bars"])
def t26(spark, sf):
    df = V.bars(spark, sf).select((F.floor("volume") % 3).cast("int").alias("state"), "high", "low")
    df = Q.five_numbers(df.unpivot(["state"], ["high", "low"], "feature", "value"), ["feature", "state"])
    return df.select("feature", "state", "count", "min", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("t26_parameter_counts", """
select o_orderpriority as param, o_orderstatus as value, count(*) as n from orders group by 1, 2""")
def t26_counts(spark, sf):
    return V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("param"), F.col("o_orderstatus").alias("value")) \
            .agg(F.count("*").alias("n"))


# -- filling -----------------------------------------------------------------

NEIGHBOURS = {"n1": f"select *, row_number() over {W} as p from v_gaps",
              "n2": f"""select *, last_value(case when value is not null then p end ignore nulls) over {UPTO} as pa, last_value(value ignore nulls) over {UPTO} as va,
       first_value(case when value is not null then p end ignore nulls) over (partition by series_id order by date rows between current row and unbounded following) as pb,
       first_value(value ignore nulls) over (partition by series_id order by date rows between current row and unbounded following) as vb,
       count(value) over {UPTO} as run from n1"""}


@query("w20_interpolate", """
select series_id, date, round(case when value is not null then value when pa is null then vb when pb is null then va
  else va + (vb - va) * (p - pa) / (pb - pa) end, 4) as value from n2""", ["v_gaps"], NEIGHBOURS)
def w20(spark, sf):
    return I.interpolate(V.gaps(spark, sf)).select("series_id", "date", F.round("value", 4).alias("value"))


@query("w21_sandwich", """
select series_id, date, round(case when value is not null then value when va is not null and vb is not null then vb - (vb - va) / pow(2.0, p - pa) end, 8) as smooth,
  case when value is not null then value when va is not null then vb end as step from n2""", ["v_gaps"], NEIGHBOURS)
def w21(spark, sf):
    df = I.sandwich(V.gaps(spark, sf), out="smooth")
    df = I.sandwich(df, out="step", stepwise=F.lit(True))
    return df.select("series_id", "date", F.round("smooth", 8).alias("smooth"), "step")


@query("g28_imputation", """
select column_name, date, round(case when kind = 'never' then value else last_value(filled ignore nulls) over (partition by column_name order by date
   rows between unbounded preceding and current row) end, 8) as value
from (select *, case when value is not null or kind = 'never' then value when va is null or vb is null then null
   when kind = 'step' then vb else vb - (vb - va) / pow(2.0, p - pa) end as filled from i2) t""", ["v_gaps"], {
    "i0": """select series_id as column_name, date, value, 'smooth' as kind from v_gaps
       union all select 'f_trend_signal', date, case when f_urgent > 200000 then 1 when f_urgent is not null then -1 end, 'step' from v_wide
       union all select 'x_ref_date', date, f_low, 'never' from v_wide""",
    "i1": "select *, row_number() over (partition by column_name order by date) as p from i0",
    "i2": """select *, last_value(case when value is not null then p end ignore nulls) over u as pa, last_value(value ignore nulls) over u as va,
       first_value(value ignore nulls) over (partition by column_name order by date rows between current row and unbounded following) as vb
       from i1 window u as (partition by column_name order by date rows between unbounded preceding and current row)"""})
def g28(spark, sf):
    wide = V.wide(spark, sf).withColumns({
        "f_trend_signal": F.when(F.col("f_urgent") > 200000, 1.0).when(F.col("f_urgent").isNotNull(), -1.0),
        "x_ref_date": F.col("f_low"), "empty": F.lit(None).cast("double")})
    df = I.impute(wide, [*COLS, "f_trend_signal", "x_ref_date", "empty"])
    return df.select("column_name", "date", F.round("value", 8).alias("value"))
