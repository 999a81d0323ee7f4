"""Sources, sinks and scalar functions.

Text sources are checked by a round trip: a view is written out in the source's
shape to the shared folder, read back and compared with the view itself.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions import scalars as C
from tidegauge.operators import evaluate as E
from tidegauge.operators.axis import DAILY
from tidegauge.plans import views as V
from tidegauge.plans.evaluation_queries import importances, IMP
from tidegauge.plans.registry import query
from tidegauge.plans.rolling_queries import STATES, W, states
from tidegauge.session import scratch
from tidegauge.sources import readers, sinks, tables


def written_csv(df, name):
    path = scratch(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


FIVE = "day(date) % 5 = 0"


@query("s1_gamma_csv", f"select series_id, date, value as gex_value from v_series where not {FIVE}", ["v_series"])
def s1(spark, sf):
    text = F.when(F.dayofmonth("date") % 5 == 0, "n/a").otherwise(F.col("value").cast("decimal(20,2)").cast("string"))
    path = written_csv(V.series(spark, sf).select("series_id", "date", F.lit("x").alias("note"), text.alias("gex")), "gamma")
    return readers.gamma_csv(spark, path, ["series_id"])


@query("s2_freight_csv_folder", """
select date, min_by(value, series_id) as value from v_series group by date""", ["v_series"])
def s2(spark, sf):
    folder = scratch(spark, "freight")
    for i, name in enumerate(V.WIDE.values()):
        s = V.series(spark, sf).where(F.col("series_id") == name).select(F.date_format("date", "M/d/yyyy").alias("Date"), F.format_number("value", 2).alias("Price"))
        bad = s.limit(2).select(F.lit("someday").alias("Date"), "Price")
        s.unionByName(bad).write.option("header", True).csv(f"{folder}/{i}")
    return readers.freight_csvs(spark, [f"{folder}/{i}" for i in range(len(V.WIDE))])


PCR = """select series_id, date, cast(floor(open) as double) as equity_call_volume, cast(floor(close) as double) as equity_put_volume,
  cast(floor(open) + floor(close) as double) as equity_total_volume, case when day(date) % 4 <> 0 then round(close / open, 2) end as equity_pc_ratio
  from v_bars"""


def put_call_rows(spark, sf):
    bars = V.bars(spark, sf)
    call, put = F.floor("open").cast("double"), F.floor("close").cast("double")
    return bars.select("series_id", "date", call.alias("equity_call_volume"), put.alias("equity_put_volume"), (call + put).alias("equity_total_volume"),
                       F.when(F.dayofmonth("date") % 4 != 0, F.round(F.try_divide("close", "open"), 2)).alias("equity_pc_ratio"))


@query("s3_put_call_csv_with_preamble", PCR, ["v_bars"])
def s3(spark, sf):
    def number(c):
        return F.concat(F.lit('"'), F.format_number(c, 0), F.lit('"'))
    rows = put_call_rows(spark, sf).select(F.concat_ws(",", F.date_format("date", "M/d/yyyy"), number("equity_call_volume"),
        number("equity_put_volume"), number("equity_total_volume"), F.coalesce(F.col("equity_pc_ratio").cast("string"), F.lit("")), "series_id").alias("line"))
    head = spark.createDataFrame([("Volume and ratio data, subject to change",), ("PRODUCT: EQUITY,EXCHANGE: X,,,",), ("DATE,CALL,PUT,TOTAL,P/C Ratio,SERIES",)], "line string")
    path = scratch(spark, "putcall")
    head.unionByName(rows).write.text(path)
    return readers.put_call_csv(spark, path, keys=["series_id"])


@query("s4_fear_greed_json", """
select series_id, date as reference_date, date as release_date, cast(floor(value) as bigint) as value from v_series""", ["v_series"])
def s4(spark, sf):
    # one JSON array per file: rows are packed by series and year, as a provider's yearly files would be
    s = V.series(spark, sf).groupBy("series_id", F.year("date").alias("y")).agg(F.collect_list(F.struct(
        F.col("date").cast("string").alias("date"), F.floor("value").cast("string").alias("value"))).alias("a"))
    path = scratch(spark, "feargreed")
    s.select(F.to_json("a").alias("value"), "series_id", "y").write.partitionBy("series_id", "y").text(path)
    return readers.fear_greed_json(spark, path, ["series_id"])


@query("s5_confidence_json", """
select date, max(case when series_id = '1-URGENT' then value end) as smci_pct_dmci_ratio, max(case when series_id = '2-HIGH' then value end) as smci_value,
  max(case when series_id = '5-LOW' then value end) as dmci_value from v_series where series_id in ('1-URGENT', '2-HIGH', '5-LOW') group by date""", ["v_series"])
def s5(spark, sf):
    names = ("1-URGENT", "2-HIGH", "5-LOW")
    point = F.array(F.col("date").cast("string"), F.col("value").cast("decimal(20,2)").cast("string"))
    # a file per year, as a provider that cuts them would give
    one = V.series(spark, sf).where(F.col("series_id").isin(*names)).groupBy(F.year("date").alias("y")).agg(*[
        F.collect_list(F.when(F.col("series_id") == n, point)).alias(f"a{i}") for i, n in enumerate(names)])
    path = scratch(spark, "confidence")
    one.select(F.to_json(F.array("a0", "a1", "a2")).alias("value"), "y").write.partitionBy("y").text(path)
    return readers.confidence_json(spark, path)


@query("s5_confidence_json_every_series", """
select series_id, date, floor(value / 1000) as smci_pct_dmci_ratio, value as smci_value, floor(value) as dmci_value from v_series""", ["v_series"])
def s5_every(spark, sf):
    v = F.col("value")
    parts = (F.floor(v / 1000), v.cast("decimal(20,2)"), F.floor(v))
    points = [F.collect_list(F.array(F.col("date").cast("string"), x.cast("string"))) for x in parts]
    files = V.series(spark, sf).groupBy("series_id", F.year("date").alias("y")).agg(F.to_json(F.array(*points)).alias("value"))
    path = scratch(spark, "confidence")
    files.write.partitionBy("series_id", "y").text(path)
    return readers.confidence_json(spark, path, ["series_id"])


@query("s6_survey_csv", """
select date as reference_date, last_day(date + 1) as release_date, f_urgent as bullish_pct, f_high as neutral_pct, f_medium as bearish_pct,
  cast(null as double) as total_pct, f_none as bullish_8wk_ma_pct, f_low as bull_bear_spread_pct
from (select date, """ + ", ".join(f"round({c} / 10000, 1) as {c}" for c in V.WIDE) + " from v_wide) t", ["v_wide"])
def s6(spark, sf):
    def pct(c):
        return F.concat(F.round(F.col(c) / 10000, 1).cast("string"), F.lit("%"))
    heads = {"f_urgent": "Bullish", "f_high": "Neutral", "f_medium": "Bearish", "f_none": "Bullish 8 Week MA", "f_low": "Bull-Bear Spread"}
    df = V.wide(spark, sf).select(F.date_format("date", "M/d/yyyy").alias("Date"), *[pct(c).alias(h) for c, h in heads.items()])
    return readers.survey_csv(spark, written_csv(df, "survey"))


@query("s7_margin_csv", """
select series_id, last_day(date) as reference_date, last_day(last_day(date) + 1) as release_date, cast(max(floor(value)) as bigint) as debit_balances_margin_accounts,
  cast(min(floor(value)) as bigint) as free_credit_cash_accounts, count(*) as free_credit_margin_accounts
from v_series group by series_id, last_day(date)""", ["v_series"])
def s7(spark, sf):
    heads = list(readers.MARGIN)
    m = V.series(spark, sf).groupBy("series_id", F.date_format("date", "yyyy-MM").alias("Year-Month")).agg(
        F.format_number(F.max(F.floor("value")), 0).alias(heads[0]), F.format_number(F.min(F.floor("value")), 0).alias(heads[1]),
        F.format_number(F.count("*"), 0).alias(heads[2]))
    return readers.margin_csv(spark, written_csv(m, "margin"), ["series_id"])


@query("s8_normalised_bars", """
select date, open, high, low, close, case when day(date) % 2 = 0 then close else close / 2 end as adjusted_close, cast(volume as bigint) as volume, series_id as ticker
from v_bars""", ["v_bars"])
def s8(spark, sf):
    b = V.bars(spark, sf)
    raw = b.select("series_id", F.col("date").alias("Date"), F.col("open").alias("1. open"), F.col("high").alias("2. high"), F.col("low").alias("Low"),
                   F.col("close").cast("string").alias("Close"), F.when(F.dayofmonth("date") % 2 != 0, F.col("close") / 2).alias("Adj Close"),
                   F.col("volume").alias("6. volume"), F.lit("junk").alias("extra"))
    return readers.normalise_bars(raw, F.col("series_id"))


@query("s9_normalised_vintages", """
select reference_date, release_date, value, series_id from v_vintage""", ["v_vintage"])
def s9(spark, sf):
    raw = V.vintage(spark, sf).select(
        "series_id",         F.col("reference_date").cast("string").alias("date"), F.col("release_date").cast("string").alias("realtime_start"), F.col("value").cast("string").alias("value"))
    twice = raw.unionByName(raw).unionByName(raw.limit(3).withColumn("date", F.lit("not a day")))
    return readers.normalise_vintages(twice, F.col("series_id"))


S10_NAMES = {"A": "RGDPQOQFOR", "N": "T10Y2Y", "R": "CPIAUCSL"}


@query("s10_configured_ingest", """
select 'gdp_forecasts' as table_name, 'RGDPQOQFOR' as series_id, reference_date, release_date, value, cast(null as varchar) as spread_type,
  concat(cast(year(reference_date) as varchar), 'Q', cast(quarter(reference_date) as varchar)) as forecast_period from v_vintage where series_id = 'A'
union all select 'cpi', 'CPIAUCSL', reference_date, release_date, value, null, null from v_vintage where series_id = 'R'
union all select 'treasury_yield_spreads', 'T10Y2Y', reference_date, min(release_date), min_by(value, release_date), '10Y-2Y', null
  from v_vintage where series_id = 'N' group by reference_date""", ["v_vintage"])
def s10(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in S10_NAMES.items() for x in kv])
    return readers.ingest_series(V.vintage(spark, sf).withColumn("series_id", names[F.col("series_id")]))


UPSERT = {"tgt": "select series_id, date, value, 'old' as note from v_series where day(date) % 3 <> 0",
          "src": "select series_id, date, case when day(date) % 10 = 0 then null else value * 2 end as value, 'new' as note from v_series where day(date) % 2 = 0"}


def upsert_sides(spark, sf):
    s, d = V.series(spark, sf), F.dayofmonth("date")
    return (s.where(d % 3 != 0).withColumn("note", F.lit("old")),
            s.where(d % 2 == 0).withColumns({"value": F.when(d % 10 != 0, F.col("value") * 2), "note": F.lit("new")}))


@query("s14_upsert", """
select coalesce(s.series_id, t.series_id) as series_id, coalesce(s.date, t.date) as date, case when s.date is not null then s.value else t.value end as value,
  case when t.date is null then s.note else t.note end as note from tgt t full join src s on t.series_id = s.series_id and t.date = s.date""", ["v_series"], UPSERT)
def s14(spark, sf):
    return sinks.upsert(*upsert_sides(spark, sf), ["series_id", "date"], update=["value"])


@query("s14_upsert_keep_existing", """
select coalesce(s.series_id, t.series_id) as series_id, coalesce(s.date, t.date) as date, case when t.date is null then s.value else t.value end as value,
  case when t.date is null then s.note else t.note end as note from tgt t full join src s on t.series_id = s.series_id and t.date = s.date""", ["v_series"], UPSERT)
def s14_nothing(spark, sf):
    return sinks.upsert(*upsert_sides(spark, sf), ["series_id", "date"], update=[])


@query("s14_upsert_partitions", """
select coalesce(s.series_id, t.series_id) as series_id, coalesce(s.date, t.date) as date, case when s.date is not null then s.value else t.value end as value,
  case when s.date is not null then s.note else t.note end as note from tgt t full join (select * from src where series_id in ('1-URGENT', '2-HIGH')) s
  on t.series_id = s.series_id and t.date = s.date""", ["v_series"], UPSERT)
def s14_partitions(spark, sf):
    target, source = upsert_sides(spark, sf)
    path = scratch(spark, "table")
    tables.replace_table(target, path, "series_id")
    tables.upsert_table(path, source.where("series_id in ('1-URGENT', '2-HIGH')"), ["date"])
    return tables.read_table(spark, path).select("series_id", "date", "value", "note")


@query("s15_put_call_upsert", """
select coalesce(n.series_id, o.series_id) as series_id, coalesce(n.date, o.date) as date, case when n.date is not null then n.c else o.c end as equity_call_volume, case when n.date is not null then n.p else o.p end as equity_put_volume,
  round(case when n.date is not null then n.r else o.r end, 6) as equity_pc_ratio, case when n.date is not null then 'csv' else 'old' end as source
from (select series_id, date, equity_call_volume * 10 as c, equity_put_volume as p, 1.0::double as r from pcr where day(date) % 3 = 0) o
full join (select series_id, date, equity_call_volume as c, equity_put_volume as p, coalesce(equity_pc_ratio, case when equity_call_volume > 0 then equity_put_volume / equity_call_volume end) as r from pcr) n
on o.series_id = n.series_id and o.date = n.date where coalesce(n.r, o.r) is not null""", ["v_bars"], {"pcr": PCR})
def s15(spark, sf):
    rows = put_call_rows(spark, sf)
    target = rows.where(F.dayofmonth("date") % 3 == 0).select(
        "series_id", "date", (F.col("equity_call_volume") * 10).alias("equity_call_volume"), "equity_put_volume", "equity_total_volume",
        F.lit(1.0).alias("equity_pc_ratio"), F.lit("old").alias("source"))
    df = sinks.put_call_upsert(target, rows, "csv", ["series_id"])
    return df.select("series_id", "date", "equity_call_volume", "equity_put_volume", F.round("equity_pc_ratio", 6).alias("equity_pc_ratio"), "source")


@query("s16_replace_table", "select * from v_wide", ["v_wide"])
def s16(spark, sf):
    path = scratch(spark, "replaced")
    wide = V.wide(spark, sf)
    tables.replace_table(wide.where("f_low is null"), path)
    tables.replace_table(wide, path)
    return tables.read_table(spark, path)


@query("s18_report_files", "select theme as run, feature, fold, importance from v_imp", [], IMP)
def s18(spark, sf):
    folder = scratch(spark, "reports")
    sinks.save_reports(folder, importances=importances(spark, sf).withColumnRenamed("theme", "run"))
    schema = "feature string, fold int, importance double, run string"
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/importances").select("run", "feature", "fold", "importance")


@query("s18_all_report_files", """
select 'importances' as report, theme as run, feature as name, cast(fold as varchar) as fold, round(importance, 6) as value from v_imp
union all select 'fold_metrics', theme, 'best', cast(fold as varchar), round(max(importance), 6) from v_imp group by theme, fold
union all select 'summary', theme, 'count', null, count(*) from v_imp group by theme
union all select 'out_of_fold', theme, feature, null, round(sum(importance), 6) from v_imp group by theme, feature""", [], IMP)
def s18_all(spark, sf):
    folder = scratch(spark, "reports")
    rows = importances(spark, sf).withColumnRenamed("theme", "run")
    sinks.save_reports(folder, rows.groupBy("run", "fold").agg(F.round(F.max("importance"), 6).alias("best")), rows.groupBy("run").agg(F.count(F.lit(1)).alias("count")),
                       rows.groupBy("run", "feature").agg(F.round(F.sum("importance"), 6).alias("total")), rows)

    def back(name, kind, schema, of, fold, value):
        df = getattr(spark.read.schema(schema).option("header", True) if kind == "csv" else spark.read.schema(schema), kind)(f"{folder}/{name}")
        return df.select(F.lit(name).alias("report"), "run", of.alias("name"), fold.cast("string").alias("fold"), F.round(F.col(value).cast("double"), 6).alias("value"))
    none = F.lit(None)
    return back("importances", "csv", "feature string, fold int, importance double, run string", F.col("feature"), F.col("fold"), "importance") \
        .unionByName(back("fold_metrics", "csv", "fold int, best double, run string", F.lit("best"), F.col("fold"), "best")) \
        .unionByName(back("summary", "json", "count long, run string", F.lit("count"), none, "count")) \
        .unionByName(back("out_of_fold", "csv", "feature string, total double, run string", F.col("feature"), none, "total"))


@query("s18_feature_lists", "select distinct theme, feature from v_imp", [], IMP)
def s18_lists(spark, sf):
    folder = scratch(spark, "lists")
    kept = importances(spark, sf).select("theme", "feature").distinct()
    sinks.save_feature_lists(kept, folder)
    return spark.read.schema("value string, theme string").text(folder).select("theme", F.col("value").alias("feature"))


# -- scalars -----------------------------------------------------------------

@query("c1_percent_text", """
select o_orderkey, case when o_orderkey % 7 = 0 then null else round(o_totalprice / 10000, 1) end as pct from orders""")
def c1(spark, sf):
    text = F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), F.round(F.col("o_totalprice") / 10000, 1).cast("string"), F.lit("% ")))
    return V.table(spark, sf, "orders").select("o_orderkey", C.percent_text(text).alias("pct"))


@query("c2_grouped_numbers", """
select o_orderkey, o_totalprice as amount, cast(floor(o_totalprice) as bigint) as whole from orders""")
def c2(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey", C.grouped_number(F.format_number("o_totalprice", 2)).alias("amount"),
        C.grouped_number(F.format_number(F.floor("o_totalprice"), 0), "bigint").alias("whole"))


@query("c3_dashed_numbers", """
select o_orderkey, case when o_orderkey % 5 in (0, 1) then null else o_totalprice end as amount from orders""")
def c3(spark, sf):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "-").when(k == 1, "").otherwise(F.format_number("o_totalprice", 2))
    return V.table(spark, sf, "orders").select("o_orderkey", C.dashed_number(text).alias("amount"))


@query("c4_date_text", """
select o_orderkey, cast(o_orderdate as date) as iso, case when o_orderkey % 4 = 0 then null else cast(o_orderdate as date) end as us from orders""")
def c4(spark, sf):
    d = F.col("o_orderdate").cast("date")
    us = F.when(F.col("o_orderkey") % 4 == 0, "13/45/1996").otherwise(F.date_format(d, "M/d/yyyy"))
    return V.table(spark, sf, "orders").select("o_orderkey", C.date_text(d.cast("string")).alias("iso"), C.date_text(us, "M/d/yyyy").alias("us"))


@query("c6_quarter_label", """
select o_orderkey, concat(cast(year(o_orderdate) as varchar), 'Q', cast(quarter(o_orderdate) as varchar)) as quarter from orders""")
def c6(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", C.quarter_label("o_orderdate").alias("quarter"))


@query("c7_derived_ratio", """
select series_id, date, round(coalesce(equity_pc_ratio, case when equity_call_volume > 0 then equity_put_volume / equity_call_volume end), 6) as ratio from pcr""", ["v_bars"], {"pcr": PCR})
def c7(spark, sf):
    return put_call_rows(spark, sf).select("series_id", "date", F.round(C.put_call_ratio("equity_pc_ratio", "equity_put_volume", "equity_call_volume"), 6).alias("ratio"))


@query("c9_table_labels", r"""
select p_partkey, 'theme_' || trim(regexp_replace(replace(lower(p_name), 's&p 500', 'sandp500'), '[^a-z0-9]+', '_', 'g'), '_') as label from part""")
def c9(spark, sf):
    k = F.col("p_partkey")
    title = F.concat(k.cast("string"), F.lit(". "), "p_name", F.lit(" (Under the Hood)"))
    return V.table(spark, sf, "part").select("p_partkey", C.table_label(title).alias("label"))


@query("c11_sign_signals", f"""
select series_id, date, cast(sign(value - lag(value) over {W}) as int) as direction from v_gaps""", ["v_gaps"])
def c11(spark, sf):
    return V.gaps(spark, sf).select("series_id", "date", C.side("value", F.lag("value").over(DAILY.base())).alias("direction"))


@query("c12_bands", """
select series_id, date, case when value / 10000 < 20 then 0 when value / 10000 < 40 then 1 when value is not null then 2 end as band from v_gaps""", ["v_gaps"])
def c12(spark, sf):
    return V.gaps(spark, sf).select("series_id", "date", C.band(F.col("value") / 10000).alias("band"))


@query("c13_flags", "select series_id, date, coalesce(cast(value < 200000 as int), 0) as low from v_gaps", ["v_gaps"])
def c13(spark, sf):
    return V.gaps(spark, sf).select("series_id", "date", C.flag(F.col("value") < 200000).alias("low"))


@query("c15_greatest_of_present", "select date, greatest(f_urgent, f_high, f_low) as top from v_wide", ["v_wide"])
def c15(spark, sf):
    return V.wide(spark, sf).select("date", F.greatest("f_urgent", "f_high", "f_low").alias("top"))


@query("c16_finite_only", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_discount > 0 then round(l_tax / l_discount, 6) end as ratio from lineitem""")
def c16(spark, sf):
    raw = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).when(F.col("l_tax") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(C.finite(raw), 6).alias("ratio"))


@query("c17_release_lag", "select series_id, reference_date, release_date, cast(release_date - reference_date as int) as lag_days from v_vintage", ["v_vintage"])
def c17(spark, sf):
    return V.vintage(spark, sf).select("series_id", "reference_date", "release_date", C.days_between("release_date", "reference_date").alias("lag_days"))


@query("o1_sorted_by_date", "select series_id, date, value, row_number() over (partition by series_id order by date) as place from v_series", ["v_series"])
def o1(spark, sf):
    return V.series(spark, sf).withColumn("place", F.row_number().over(DAILY.base()))
