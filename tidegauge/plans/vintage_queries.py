"""T1-T4, T8, J1-J8, C5 and G15, G21-G25: releases, calendar joins, macro signals."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions import scalars as C
from tidegauge.operators import joins, macro, signals as S, vintage as T
from tidegauge.operators.axis import DAILY, Axis
from tidegauge.plans import views as V
from tidegauge.plans.registry import query
from tidegauge.plans.signal_queries import any_present, rank as _rank
from tidegauge.session import persist_plan

PIT = """select series_id, reference_date, min(release_date) as release_date,
  min_by(value, release_date) filter (where value is not null) as value_pit,
  min_by(value2, release_date) filter (where value2 is not null) as value2_pit
from v_vintage group by series_id, reference_date"""


@query("t1_first_release", PIT, ["v_vintage"])
def t1(spark, sf):
    return T.first_release(V.vintage(spark, sf), ["value", "value2"], ["series_id"])


@query("t2_first_complete_release", """
select series_id, reference_date, min(release_date) as release_date, min_by(value2, release_date) as value2
from v_vintage where value2 is not null group by series_id, reference_date""", ["v_vintage"])
def t2(spark, sf):
    return T.first_complete_release(V.vintage(spark, sf), "value2", ["series_id"])


LATEST = """select series_id, release_date, max(reference_date) as reference_date, max_by(value, reference_date) as value,
  max_by(coalesce(value2, -1), reference_date) as v2 from v_vintage group by series_id, release_date"""


@query("t3_latest_reference_per_release", f"""
select series_id, release_date, reference_date, value, case when v2 >= 0 then v2 end as value2 from ({LATEST}) t""", ["v_vintage"])
def t3(spark, sf):
    return T.latest_reference(V.vintage(spark, sf), ["value", "value2"], ["series_id"])


@query("t4_keep_first_per_date", """
select date, series_id, value from (select *, row_number() over (partition by date order by value, series_id) as rn from v_series) t
where rn = 1""", ["v_series"])
def t4(spark, sf):
    return T.keep_first(V.series(spark, sf), ["date"], ["value", "series_id"])


@query("t8_month_end_last", """
select series_id, last_day(date) as date, max_by(value, date) as value from v_series group by series_id, last_day(date)""", ["v_series"])
def t8(spark, sf):
    return T.month_end_last(V.series(spark, sf), "value", ["series_id"])


@query("j1_inner_join_on_date", """
select a.series_id, a.date, a.value as a, b.value as b from v_series a join v_series b
on a.date = b.date and b.series_id = '1-URGENT' and a.series_id <> '1-URGENT'""", ["v_series"])
def j1(spark, sf):
    s = V.series(spark, sf)
    return S.on_common_dates(s.where("series_id <> '1-URGENT'"), s.where("series_id = '1-URGENT'")) \
            .select("series_id", "date", "a", "b")


@query("j2_side_by_side", "select * from v_wide", ["v_wide"])
def j2(spark, sf):
    s = V.series(spark, sf)
    return joins.side_by_side({n: s.where(F.col("series_id") == k) for n, k in V.WIDE.items()})


SPINE = {"v_spine": """select cast(d as date) as date from (select unnest(generate_series(
  (select min(date) from v_series), (select max(date) from v_series), interval 1 day)) as d) t where isodow(cast(d as date)) < 6"""}


def spine(spark, sf):
    return joins.business_days(joins.span_of(V.series(spark, sf)))


@query("g25_business_day_spine", "select date from v_spine", ["v_series"], SPINE)
def g25(spark, sf):
    return spine(spark, sf)


@query("j3_left_joins_to_spine", """
select s.date, u.value as u_value, a.open as bar_open, a.high as bar_high, a.low as bar_low, a.close as bar_close, a.volume as bar_volume
from v_spine s left join v_series u on s.date = u.date and u.series_id = '1-URGENT'
left join v_bars a on s.date = a.date and a.series_id = 'A'""", ["v_series", "v_bars"], SPINE)
def j3(spark, sf):
    return joins.on_spine(spine(spark, sf), {
        "u_": V.series(spark, sf).where("series_id = '1-URGENT'").drop("series_id"),
        "bar_": V.bars(spark, sf).where("series_id = 'A'").drop("series_id")})


BARS = ("open", "high", "low", "close", "volume")


@query("j3_left_joins_every_series", "select s.date, " + ", ".join(
    [f"{n}.value as {n}_value" for n in V.WIDE] + [f"bar_{k}.{c} as bar_{k}_{c}" for k in "anr" for c in BARS]) + " from v_spine s "
    + " ".join(f"left join v_series {n} on s.date = {n}.date and {n}.series_id = '{k}'" for n, k in V.WIDE.items()) + " "
    + " ".join(f"left join v_bars bar_{k} on s.date = bar_{k}.date and bar_{k}.series_id = '{k.upper()}'" for k in "anr"), ["v_series", "v_bars"], SPINE)
def j3_every(spark, sf):
    series, bars = V.series(spark, sf), V.bars(spark, sf)
    frames = {f"{n}_": series.where(F.col("series_id") == k).drop("series_id") for n, k in V.WIDE.items()}
    frames |= {f"bar_{k}_": bars.where(F.col("series_id") == k.upper()).drop("series_id") for k in "anr"}
    return joins.on_spine(spine(spark, sf), frames)


ASOF_SQL = """
select s.series_id, s.date, r.reference_date, r.value, case when r.v2 >= 0 then r.v2 end as value2
from (select series_id, cast(d as date) as date from (
  select series_id, unnest(generate_series(min(release_date), max(release_date), interval 1 day)) as d
  from v_vintage group by series_id) t where isodow(cast(d as date)) < 6) s
asof left join v_latest r on s.series_id = r.series_id and s.date >= r.release_date"""


def asof_parts(spark, sf):
    releases = persist_plan(V.vintage(spark, sf))               # read for both sides, and by the passes of a layout
    left = joins.business_days(joins.span_of(releases, "release_date", ["series_id"]))
    return left, T.latest_reference(releases, ["value", "value2"], ["series_id"])


def _asof(spark, sf, **how):
    left, right = asof_parts(spark, sf)
    return joins.asof(left, right, ["series_id"], "date", "release_date", ["reference_date", "value", "value2"], **how)


@query("j4_asof_backward", ASOF_SQL, ["v_vintage"], {"v_latest": LATEST})
def j4(spark, sf):
    return _asof(spark, sf)


@query("j4_asof_backward_long_series", ASOF_SQL, ["v_vintage"], {"v_latest": LATEST})
def j4_long(spark, sf):
    return _asof(spark, sf, long_series=True, target_rows=500)


@query("j4_asof_raw_rows", """
select l.series_id, l.date, count(*) as n, count(r.value) as matched, round(sum(l.price / r.value), 4) as relative_price
from (select l_returnflag as series_id, cast(l_shipdate as date) as date, l_extendedprice as price from lineitem) l
asof left join v_latest r on l.series_id = r.series_id and l.date >= r.release_date
group by l.series_id, l.date""", ["v_vintage"], {"v_latest": LATEST})
def j4_rows(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("price"))
    right = T.latest_reference(V.vintage(spark, sf), ["value"], ["series_id"])
    out = joins.asof_rows(rows, right, ["series_id"], "date", "release_date", ["value"])
    return out.groupBy("series_id", "date").agg(
        F.count("*").alias("n"), F.count("value").alias("matched"),
        F.round(F.sum(F.try_divide("price", "value")), 4).alias("relative_price"))


@query("j5_reindex_forward_fill", """
select s.date, p.close from v_spine s asof left join (select date, close from v_bars where series_id = 'R') p on s.date >= p.date""",
       ["v_series", "v_bars"], SPINE)
def j5(spark, sf):
    one = F.lit(1).alias("k")
    bars = V.bars(spark, sf).where("series_id = 'R'").select(one, F.col("date").alias("seen"), "close")
    return joins.asof(spine(spark, sf).select("date", one), bars, ["k"], "date", "seen", ["close"]).drop("k")


@query("j6_left_join_then_fill", """
select series_id, date, value, last_value(close ignore nulls) over (partition by series_id order by date
  rows between unbounded preceding and current row) as close
from (select s.series_id, s.date, s.value, b.close from v_series s left join v_bars b on s.date = b.date and b.series_id = 'N') t""",
       ["v_series", "v_bars"])
def j6(spark, sf):
    other = V.bars(spark, sf).where("series_id = 'N'").select("date", "close")
    df = V.series(spark, sf).join(other, "date", "left")
    return df.select("series_id", "date", "value", R.ffill(DAILY, "close").alias("close"))


@query("j7_members_with_prices", """
select m.date, m.ticker, p.close from v_member m left join v_panel p on m.date = p.date and m.ticker = p.ticker""", ["v_member", "v_panel"])
def j7(spark, sf):
    return joins.members_with_prices(V.members(spark, sf), V.panel(spark, sf)).select("date", "ticker", "close")


@query("c5_month_ends", """
select distinct date, last_day(date) as this_end, last_day(date + 1) as next_end,
       concat(cast(year(date) as varchar), 'Q', cast(quarter(date) as varchar)) as quarter from v_series""", ["v_series"])
def c5(spark, sf):
    return V.series(spark, sf).select("date").distinct().select(
        "date", C.month_end("date").alias("this_end"), C.month_end("date", 1).alias("next_end"),
        C.quarter_label("date").alias("quarter"))


# -- macro signals -----------------------------------------------------------

RW = "(partition by series_id order by reference_date)"


def rn(n):
    return f"(partition by series_id order by reference_date rows between {n - 1} preceding and current row)"


def roc(x, k, d=6):
    return f"round({x} / nullif(lag({x}, {k}) over {RW}, 0) - 1, {d})"


def sma(x, n, d=6):
    return f"case when count({x}) over {rn(n)} >= {n} then round(avg({x}) over {rn(n)}, {d}) end"


def z(x, n):
    return (f"case when count({x}) over {rn(n)} >= {n // 2} then round(({x} - avg({x}) over {rn(n)}) / "
            f"nullif(stddev_samp({x}) over {rn(n)}, 0), 6) end")


def rank(x, n):
    return _rank(x, n, order="reference_date")


def out(cols: dict, source, check, lead="series_id, reference_date, release_date"):
    body = ", ".join(f"{e} as {n}" for n, e in cols.items())
    return f"select * from (select {lead}, {body} from {source}) z where {any_present(check)}"


MONTH = {"value_pit": "value_pit", "yoy_change": "round(yoy, 6)", "mom_change": roc("value_pit", 1),
         "change_3m_annualized": f"round(pow(value_pit / lag(value_pit, 3) over {RW}, 12.0 / 3) - 1, 4)",
         "change_6m_annualized": f"round(pow(value_pit / lag(value_pit, 6) over {RW}, 12.0 / 6) - 1, 4)",
         "yoy_change_zscore_24m": z("yoy", 24), "yoy_change_percentile_36m": rank("yoy", 36),
         "yoy_change_vs_sma12m_diff": f"round(yoy - case when count(yoy) over {rn(12)} >= 12 then avg(yoy) over {rn(12)} end, 6)"}
BASE_M = {"pit": PIT, "g_base": f"select *, value_pit / lag(value_pit, 12) over {RW} - 1 as yoy from pit"}


def _macro(spark, sf, name):
    _, frequency, wanted = macro.MACRO_SETS[name]
    df = macro.macro_signals(V.vintage(spark, sf), frequency, wanted)
    digits = {w: 4 if "annualized" in w else 6 for w in wanted}
    return df.select("series_id", "reference_date", "release_date", "value_pit",
                     *[F.round(w, d).alias(w) for w, d in digits.items()])


@query("g21_macro_payrolls", out(MONTH, "g_base", [c for c in MONTH if c != "value_pit"]), ["v_vintage"], BASE_M)
def g21_m(spark, sf):
    return _macro(spark, sf, "non_farm_payrolls")


def _subset(name, extra=()):
    wanted = macro.MACRO_SETS[name][2]
    table = MONTH | dict(extra)
    return out({"value_pit": "value_pit"} | {w: table[w] for w in wanted}, "g_base", wanted)


for _name, _extra in {
    "cpi": {}, "retail_sales": {},
    "m2_money_supply": {"yoy_change_percentile_60m": rank("yoy", 60)},
    "housing_starts": {"change_3m_sma": sma("value_pit", 3)},
    "housing_prices": {"yoy_change_zscore_36m": z("yoy", 36), "yoy_change_percentile_60m": rank("yoy", 60)},
    "consumer_confidence": {"value_mom_diff": f"round(value_pit - lag(value_pit, 1) over {RW}, 6)",
                            "value_yoy_diff": f"round(value_pit - lag(value_pit, 12) over {RW}, 6)",
                            "value_sma_3m": sma("value_pit", 3), "value_sma_6m": sma("value_pit", 6),
                            "value_zscore_24m": z("value_pit", 24), "value_percentile_36m": rank("value_pit", 36)},
}.items():
    query(f"g21_macro_{_name}", _subset(_name, _extra), ["v_vintage"], BASE_M)(
        lambda spark, sf, name=_name: _macro(spark, sf, name))

WEEK = {"value_pit": "value_pit", "value_pit_4wk_ma": "round(ma, 4)", "change_1wk": roc("value_pit", 4), "change_4wk_ma_yoy": "round(ch, 6)",
        "change_4wk_ma_zscore_52wk": z("ch", 52), "change_4wk_ma_percentile_104wk": rank("ch", 104)}


@query("g21_macro_jobless_claims", out(WEEK, "g_base", [c for c in WEEK if c != "value_pit"]), ["v_vintage"], {
    "pit": PIT, "g_ma": f"select *, case when count(value_pit) over {rn(4)} >= 4 then avg(value_pit) over {rn(4)} end as ma from pit",
    "g_base": f"select *, ma / lag(ma, 52) over {RW} - 1 as ch from g_ma"})
def g21_w(spark, sf):
    _, frequency, wanted = macro.MACRO_SETS["initial_jobless_claims"]
    df = macro.macro_signals(V.vintage(spark, sf), frequency, wanted)
    return df.select("series_id", "reference_date", "release_date", "value_pit",
                     *[F.round(w, 4 if w == "value_pit_4wk_ma" else 6).alias(w) for w in wanted])


@query("g15_credit_spread", """
select reference_date, release_date, round(spread, 4) as spread_value from (
 select coalesce(a.reference_date, b.reference_date) as reference_date, greatest(a.release_date, b.release_date) as release_date, a.value - b.value as spread
 from (select reference_date, min(release_date) as release_date, min_by(value, release_date) as value from v_vintage where series_id = 'A' group by 1) a
 full join (select reference_date, min(release_date) as release_date, min_by(value, release_date) as value from v_vintage where series_id = 'N' group by 1) b
 on a.reference_date = b.reference_date) t where spread is not null""", ["v_vintage"])
def g15(spark, sf):
    v = V.vintage(spark, sf)
    df = T.credit_spread(v.where("series_id = 'A'"), v.where("series_id = 'N'"))
    return df.select("reference_date", "release_date", F.round("spread_value", 4).alias("spread_value"))


SURVEY = {"bullish_pct": "value", "neutral_pct": "value2", "bearish_pct": "-value", "bull_bear_spread_pct": "value + coalesce(value2, 0)",
          "bullish_8wk_ma_pct": "value2"}
G22 = {"bull_bear_spread_pct_sma_4wk": sma("bull_bear_spread_pct_pit", 4), "bull_bear_spread_pct_zscore_52wk": z("bull_bear_spread_pct_pit", 52),
       "bullish_pct_percentile_52wk": rank("bullish_pct_pit", 52), "bearish_pct_percentile_52wk": rank("bearish_pct_pit", 52)}


@query("g22_survey_sentiment", out({f"{v}_pit": f"{v}_pit" for v in SURVEY} | G22, "pit", G22), ["v_vintage"], {
    "raw": "select series_id, reference_date, release_date, " + ", ".join(f"{e} as {n}" for n, e in SURVEY.items()) + " from v_vintage",
    "pit": "select series_id, reference_date, min(release_date) as release_date, " + ", ".join(
        f"min_by({v}, release_date) filter (where {v} is not null) as {v}_pit" for v in SURVEY) + " from raw group by series_id, reference_date"})
def g22(spark, sf):
    raw = V.vintage(spark, sf).select("series_id", "reference_date", "release_date", *[F.expr(e).alias(n) for n, e in SURVEY.items()])
    df = macro.survey_signals(raw, Axis(("series_id",), ("reference_date",)))
    return df.select("series_id", "reference_date", "release_date", *[f"{v}_pit" for v in SURVEY], *[F.round(c, 6).alias(c) for c in G22])


G23 = {"debit_balances_yoy_change": "round(yoy, 6)", "debit_balances_roc_3m": roc("d", 3), "debit_balances_roc_6m": roc("d", 6),
       "normalized_margin_debt": "round(d / close, 6)", "margin_debt_vs_free_credit_ratio": "round(d / nullif(coalesce(c, 0) + coalesce(m, 0), 0), 6)",
       "debit_balances_yoy_change_zscore_24m": z("yoy", 24)}


@query("g23_margin_debt", out({"debit_balances_pit": "d", "free_credit_cash_pit": "c", "free_credit_margin_pit": "m"} | G23, "g_base", G23),
       ["v_vintage", "v_bars"], {
    "pit": """select series_id, reference_date, min(release_date) as release_date, min_by(value, release_date) as d,
       min_by(value2, release_date) filter (where value2 is not null) as c,
       min_by(value2 * 2, release_date) filter (where value2 is not null) as m from v_vintage group by series_id, reference_date""",
    "monthly": """select last_day(date) as month, max_by(close, date) as close from v_bars where series_id = 'A'
       and date between (select min(reference_date) from v_vintage) and (select max(reference_date) from v_vintage) group by 1""",
    "g_base": f"select p.*, p.d / lag(p.d, 12) over (partition by series_id order by reference_date) - 1 as yoy, x.close from pit p "
              "asof left join monthly x on p.reference_date >= x.month"})
def g23(spark, sf):
    raw = V.vintage(spark, sf).select("series_id", "reference_date", "release_date", F.col("value").alias("debit_balances"),
                                      F.col("value2").alias("free_credit_cash"), (F.col("value2") * 2).alias("free_credit_margin"))
    close = V.bars(spark, sf).where("series_id = 'A'").select("date", "close")
    df = macro.margin_signals(raw, close)
    return df.select("series_id", "reference_date", "release_date", "debit_balances_pit", "free_credit_cash_pit", "free_credit_margin_pit",
                     *[F.round(c, 6).alias(c) for c in G23])


G24 = {"spread_value_sma_21d": sma("s", 21), "spread_value_sma_63d": sma("s", 63),
       "spread_value_vs_sma63d_diff": f"round(s - case when count(s) over {rn(63)} >= 63 then avg(s) over {rn(63)} end, 6)",
       "spread_value_roc_21d": roc("s", 21), "spread_value_roc_63d": roc("s", 63), "spread_value_zscore_252d": z("s", 252),
       "spread_value_percentile_252d": rank("s", 252),
       "spread_widening_signal_5d": f"""coalesce(cast(s > case when count(s) over {rn(5)} >= 5 then avg(s) over {rn(5)} end
          and s / lag(s, 5) over {RW} - 1 > 0 as int), 0)"""}


@query("g24_bond_spread", out({"high_yield_series_id": "series_id", "investment_grade_series_id": "'IG'", "spread_value_pit": "s"} | G24, "g_base", G24,
                              lead="reference_date, release_date"), ["v_vintage"],
       {"pit": PIT, "g_base": "select series_id, reference_date, release_date, value_pit as s from pit"})
def g24(spark, sf):
    raw = V.vintage(spark, sf).select(F.col("series_id").alias("high_yield_series_id"), F.lit("IG").alias("investment_grade_series_id"),
                                      "reference_date", "release_date", F.col("value").alias("spread_value"))
    df = macro.bond_spread_signals(raw)
    return df.select("high_yield_series_id", "investment_grade_series_id", "reference_date", "release_date", "spread_value_pit",
                     *[F.col(c) if "signal" in c else F.round(c, 6).alias(c) for c in G24])
