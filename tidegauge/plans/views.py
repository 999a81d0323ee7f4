"""The test tables seen as series, bars, vintages, panels and predictions.

Every view exists twice: as a DataFrame and as SQL text for the checker.
All daily views are grouped to one row per key and date, so later windows are
bounded by the calendar; the grouping itself combines map-side.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def series(spark, sf):
    return (table(spark, sf, "orders")
            .groupBy(F.col("o_orderpriority").alias("series_id"),
                     F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("value")))


def bars(spark, sf):
    tie = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_returnflag").alias("series_id"),
                     F.col("l_shipdate").cast("date").alias("date"))
            .agg(F.min_by("l_extendedprice", tie).alias("open"),
                 F.max("l_extendedprice").alias("high"),
                 F.min("l_extendedprice").alias("low"),
                 F.max_by("l_extendedprice", tie).alias("close"),
                 F.sum("l_quantity").alias("volume")))


def vintage(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .where("l_shipdate >= o_orderdate")
            .groupBy(F.col("l_returnflag").alias("series_id"),
                     F.col("o_orderdate").cast("date").alias("reference_date"),
                     F.col("l_shipdate").cast("date").alias("release_date"))
            .agg(F.max("l_extendedprice").alias("value"),
                 F.max(F.when(F.col("l_quantity") >= 25, F.col("l_quantity"))).alias("value2")))


def panel(spark, sf):
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").alias("ticker"),
                     F.col("l_shipdate").cast("date").alias("date"))
            .agg(F.max("l_extendedprice").alias("close")))


def members(spark, sf):
    return (table(spark, sf, "lineitem")
            .where("l_returnflag = 'A' and l_linestatus = 'O' and l_quantity >= 40")
            .select(F.date_trunc("month", "l_shipdate").cast("date").alias("date"),
                    F.col("l_suppkey").alias("ticker"))
            .distinct())


def hourly(spark, sf):
    return (table(spark, sf, "events")
            .groupBy(F.col("event_type").alias("series_id"),
                     F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts_hour"))
            .agg(F.round(F.avg("value"), 4).alias("value"), F.count("*").alias("n")))


WIDE = {"f_urgent": "1-URGENT", "f_high": "2-HIGH", "f_medium": "3-MEDIUM",
        "f_none": "4-NOT SPECIFIED", "f_low": "5-LOW"}


def wide(spark, sf):
    return series(spark, sf).groupBy("date").agg(*[
        F.max(F.when(F.col("series_id") == p, F.col("value"))).alias(c) for c, p in WIDE.items()])


def gaps(spark, sf):
    """The wide table in long form: five series on common dates, about 28 % NULL."""
    return wide(spark, sf).unpivot(["date"], list(WIDE), "series_id", "value")


RUNS = {"a": 4, "b": 5, "c": 7}


def predictions(spark, sf):
    """Three runs of three-class predictions with probabilities, one row per run and date."""
    base = table(spark, sf, "embeddings").select(
        "vec_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("vec_id").cast("int")).alias("date"),
        (F.col("label") % 3).alias("true_label"))
    runs = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(m).alias("every"))
                               for r, m in RUNS.items()])).alias("r")
    df = base.select("*", runs).select(
        "vec_id", "date", "true_label", F.col("r.run").alias("run"),
        F.when(F.col("vec_id") % F.col("r.every") == 0, (F.col("true_label") + 1) % 3)
         .otherwise(F.col("true_label")).alias("predicted_label"))
    weight = [1 + F.when(F.col("predicted_label") == c, 3).otherwise(0)
              + (F.col("vec_id") * (c + 1)) % 5 for c in range(3)]
    total = weight[0] + weight[1] + weight[2]
    return df.select("run", "date", "true_label", "predicted_label",
                     *[(w / total).alias(f"p{c}") for c, w in enumerate(weight)])


SQL = {
    "v_series": """
select o_orderpriority as series_id, cast(o_orderdate as date) as date,
       round(sum(o_totalprice), 2) as value
from orders group by o_orderpriority, cast(o_orderdate as date)""",
    "v_bars": """
select series_id, date, max(case when i = 1 then p end) as open, max(p) as high,
       min(p) as low, max(case when i = n then p end) as close, sum(q) as volume
from (
  select l_returnflag as series_id, cast(l_shipdate as date) as date,
         l_extendedprice as p, l_quantity as q,
         row_number() over (partition by l_returnflag, cast(l_shipdate as date)
           order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i,
         count(*) over (partition by l_returnflag, cast(l_shipdate as date)) as n
  from lineitem) r
group by series_id, date""",
    "v_vintage": """
select l_returnflag as series_id, cast(o_orderdate as date) as reference_date,
       cast(l_shipdate as date) as release_date, max(l_extendedprice) as value,
       max(case when l_quantity >= 25 then l_quantity end) as value2
from lineitem join orders on l_orderkey = o_orderkey
where l_shipdate >= o_orderdate
group by l_returnflag, cast(o_orderdate as date), cast(l_shipdate as date)""",
    "v_panel": """
select l_suppkey as ticker, cast(l_shipdate as date) as date, max(l_extendedprice) as close
from lineitem group by l_suppkey, cast(l_shipdate as date)""",
    "v_member": """
select distinct cast(date_trunc('month', l_shipdate) as date) as date, l_suppkey as ticker
from lineitem where l_returnflag = 'A' and l_linestatus = 'O' and l_quantity >= 40""",
    "v_hourly": """
select event_type as series_id, date_trunc('hour', ts) as ts_hour,
       round(avg(value), 4) as value, count(*) as n
from events group by event_type, date_trunc('hour', ts)""",
    "v_wide": """
select date, max(case when series_id = '1-URGENT' then value end) as f_urgent,
       max(case when series_id = '2-HIGH' then value end) as f_high,
       max(case when series_id = '3-MEDIUM' then value end) as f_medium,
       max(case when series_id = '4-NOT SPECIFIED' then value end) as f_none,
       max(case when series_id = '5-LOW' then value end) as f_low
from v_series group by date""",
    "v_gaps": """
select series_id, date, value from (
select 'f_urgent' as series_id, date, f_urgent as value from v_wide union all
select 'f_high', date, f_high from v_wide union all
select 'f_medium', date, f_medium from v_wide union all
select 'f_none', date, f_none from v_wide union all
select 'f_low', date, f_low from v_wide) g""",
    "v_pred": """
select run, date, true_label, predicted_label, w0 / (w0 + w1 + w2) as p0,
       w1 / (w0 + w1 + w2) as p1, w2 / (w0 + w1 + w2) as p2
from (
  select *, 1.0::double + (case when predicted_label = 0 then 3 else 0 end) + (vec_id * 1) % 5 as w0,
            1.0::double + (case when predicted_label = 1 then 3 else 0 end) + (vec_id * 2) % 5 as w1,
            1.0::double + (case when predicted_label = 2 then 3 else 0 end) + (vec_id * 3) % 5 as w2
  from (
    select vec_id, date '2020-01-01' + cast(vec_id as int) as date, label % 3 as true_label, run,
           case when vec_id % every = 0 then (label % 3 + 1) % 3 else label % 3 end as predicted_label
    from embeddings, (values ('a', 4), ('b', 5), ('c', 7)) r(run, every)) x) y""",
}
NEEDS = {"v_wide": ["v_series"], "v_gaps": ["v_series", "v_wide"]}


def with_views(*names, extra=None):
    """``WITH v AS (...), ...`` for the named views and ``extra`` named steps."""
    wanted = []
    for n in names:
        for d in [*NEEDS.get(n, []), n]:
            if d not in wanted:
                wanted.append(d)
    steps = [f"{n} as ({SQL[n]})" for n in wanted]
    steps += [f"{n} as ({body})" for n, body in (extra or {}).items()]
    return "with " + ",\n".join(steps) + "\n"
