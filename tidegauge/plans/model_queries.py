"""Regime labels, feature selection, training and stacking."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import rolling as R
from tidegauge.operators import evaluate as E, profile as Q, regimes as G, selection as S, splits as P, training as T
from tidegauge.operators.axis import DAILY, Axis
from tidegauge.plans import views as V
from tidegauge.plans.registry import query
from tidegauge.plans.rolling_queries import STATES, W, states
from tidegauge.plans.table_queries import COLS, LONG
from tidegauge.session import persist_plan, scratch

# -- regimes -----------------------------------------------------------------

PAIR = ("ret_21", "vol_21")
FULL = {"max_iter": 1000, "tolerance": 1e-3}                  # iterations of a fit at most, and what ends it


def market_features(spark, sf):
    """Monthly return and volatility of the bar series, the inputs of the labelling."""
    df = V.bars(spark, sf).withColumns({"r1": R.change(DAILY, "high", 1), "ret_21": R.change(DAILY, "high", 21)})
    return df.withColumn("vol_21", R.volatility(DAILY, "r1", 21, 10)).select("series_id", "date", "high", *PAIR)


@query("m21_hidden_markov_labels")
def m21(spark, sf):
    fits = G.fit_hidden_markov(market_features(spark, sf), PAIR, **FULL)
    return G.decoded(fits, smoothing=200)


@query("m21_state_summary")
def m21_summary(spark, sf):
    fits = G.fit_hidden_markov(market_features(spark, sf), PAIR, **FULL)
    return G.state_summary(fits, PAIR)


@query("m22_label_stability")
def m22(spark, sf):
    return G.label_stability(market_features(spark, sf), PAIR, drop_last=range(200, 1800, 200), **FULL)


# three labelings of the same days: the states, a rotation with flips, a swap with flips
RUNS = STATES | {
    "v_runs": """select series_id, date, value, 'r0' as run, state from v_state join v_series using (series_id, date)
       union all select series_id, date, value, 'r1', case when day(date) % 7 = 0 then state else (state + 1) % 3 end from v_state join v_series using (series_id, date)
       union all select series_id, date, value, 'r2', case when day(date) % 5 = 0 then state else (state * 2) % 3 end from v_state join v_series using (series_id, date)""",
    "v_means": "select series_id, run, " + ", ".join(f"avg(case when state = {c} then ln(value) end) as m{c}, avg(case when state = {c} then day(date) end) as d{c}" for c in range(3)) + " from v_runs group by 1, 2",
    "v_perm": "select * from (values (0,1,2),(0,2,1),(1,0,2),(1,2,0),(2,0,1),(2,1,0)) p(a, b, c)",
    "v_cost": "select m.series_id, m.run, a, b, c, " + " + ".join(
        f"sqrt(pow(r.m{i} - [m.m0, m.m1, m.m2][{x} + 1], 2) + pow(r.d{i} - [m.d0, m.d1, m.d2][{x} + 1], 2))" for i, x in enumerate("abc")) +
       " as cost from v_means m join v_means r on m.series_id = r.series_id and r.run = 'r0', v_perm",
    "v_map": "select * from (select *, row_number() over (partition by series_id, run order by cost, a, b, c) as k from v_cost) t where k = 1",
    "v_remap": "select s.series_id, s.run, s.date, case s.state when m.a then 0 when m.b then 1 else 2 end as state from v_runs s join v_map m using (series_id, run)"}


def labelings(spark, sf):
    df = V.series(spark, sf).join(states(spark, sf), ["series_id", "date"])
    s, d = F.col("state"), F.dayofmonth("date")
    runs = F.explode(F.array(
        F.struct(F.lit("r0").alias("run"), s.alias("state")),
        F.struct(F.lit("r1").alias("run"), F.when(d % 7 == 0, s).otherwise((s + 1) % 3).alias("state")),
        F.struct(F.lit("r2").alias("run"), F.when(d % 5 == 0, s).otherwise((s * 2) % 3).alias("state")))).alias("x")
    return df.select("series_id", "date", "value", runs).select("series_id", "date", "value", "x.*")


def _mapped(spark, sf):
    rows = labelings(spark, sf)
    means = rows.groupBy("series_id", "run").agg(F.array(*[
        F.array(*[F.avg(F.when(F.col("state") == c, x)) for x in (F.ln("value"), F.dayofmonth("date").cast("double"))])
        for c in range(3)]).alias("means"))
    return rows, G.state_mapping(means, "r0")


@query("m22_state_mapping", "select series_id, run, a, b, c, round(cost, 6) as cost from v_map", ["v_series"], RUNS)
def m22_mapping(spark, sf):
    _, m = _mapped(spark, sf)
    return m.select("series_id", "run", *[F.get("order", F.lit(i)).alias(n) for i, n in enumerate("abc")], F.round("cost", 6).alias("cost"))


@query("m22_agreement", """
select x.series_id, x.run, round(avg(cast(x.state = r.state as int)), 6) as agreement from v_remap x join v_remap r
on x.series_id = r.series_id and x.date = r.date and r.run = 'r0' and x.run <> 'r0' group by 1, 2""", ["v_series"], RUNS)
def m22_agreement(spark, sf):
    rows, m = _mapped(spark, sf)
    return G.agreement_with(G.remapped(rows, m), "r0").select("series_id", "run", F.round("agreement", 6).alias("agreement"))


@query("m22_label_distribution", """
select series_id, date, state, n, round(n / sum(n) over (partition by series_id, date), 6) as share
from (select series_id, date, state, count(*) as n from v_remap group by 1, 2, 3) t""", ["v_series"], RUNS)
def m22_distribution(spark, sf):
    rows, m = _mapped(spark, sf)
    df = G.label_distribution(G.remapped(rows, m))
    return df.select("series_id", "date", "state", "n", F.round("share", 6).alias("share"))


@query("m23_kmeans_sizes")
def m23(spark, sf):
    return G.kmeans_sizes(market_features(spark, sf), PAIR)


@query("m23_kmeans_summary")
def m23_summary(spark, sf):
    return G.cluster_summary(G.kmeans_states(market_features(spark, sf), PAIR), PAIR)


@query("m24_markov_state_numbers")
def m24(spark, sf):
    fits = G.fit_hidden_markov(market_features(spark, sf), PAIR, states=(2, 3, 4, 5), **FULL)
    return G.information_criteria(fits, len(PAIR))


@query("m24_mixture_sizes")
def m24_mixture(spark, sf):
    return G.mixture_sizes(market_features(spark, sf), PAIR)


# -- feature selection -------------------------------------------------------

@query("m16_stationarity")
def m16(spark, sf):
    return S.stationarity(Q.to_long(V.wide(spark, sf).withColumn("flat", F.lit(2.0)), [*COLS, "flat"]))


@query("m16_screening", """
select column_name, count(value) as n, case when count(value) < 20 then 'Insufficient data points' when min(value) = max(value) then 'Constant series' end as error
from (select * from v_long union all select 'flat', date, 2.0 from v_wide union all select 'few', date, case when day(date) = 31 and month(date) = 1 then 1.0 * year(date) end from v_wide) t
group by column_name""", ["v_gaps"], LONG)
def m16_screening(spark, sf):
    few = F.when((F.dayofmonth("date") == 31) & (F.month("date") == 1), F.year("date").cast("double"))
    wide = V.wide(spark, sf).withColumns({"flat": F.lit(2.0), "few": few})
    return S.screened(Q.to_long(wide, [*COLS, "flat", "few"]))


@query("m16_verdicts", """
select p_partkey, case when p_size % 10 = 0 then 'Error in tests' when a and k then 'Stationary' when not a and not k then 'Non-Stationary'
  when a then 'Difference Stationary (ADF Stationary, KPSS Non-Stationary)' else 'Trend Stationary (ADF Non-Stationary, KPSS Stationary)' end as verdict
from (select p_partkey, p_size, p_size < 15 as a, case when p_partkey % 11 = 0 then p_partkey % 9 / 100.0 - 0.001 when p_partkey % 13 = 0 then p_partkey % 9 / 100.0 + 0.001
  else p_partkey % 9 / 100.0 end >= 0.05 as k from part) t""")
def m16_verdicts(spark, sf):
    df = V.table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") % 10 != 0, F.when(F.col("p_size") < 15, 0.01).otherwise(0.5)).alias("a"),
        (F.col("p_partkey") % 9 / 100).alias("k"), (F.col("p_partkey") % 11 == 0).alias("below"), (F.col("p_partkey") % 13 == 0).alias("above"))
    return df.select("p_partkey", S.verdict("a", "k", "above", "below").alias("verdict"))


SLICE = LONG | {
    "begins": "select column_name, min(date) as first from v_long where value is not null group by column_name",
    "l0": "select l.*, row_number() over (partition by column_name order by date) as p from v_long l where date > (select max(first) from begins)",
    "l1": """select *, last_value(case when value is not null then p end ignore nulls) over u as pa, last_value(value ignore nulls) over u as va,
       first_value(case when value is not null then p end ignore nulls) over d as pb, first_value(value ignore nulls) over d as vb from l0
       window u as (partition by column_name order by date rows between unbounded preceding and current row),
              d as (partition by column_name order by date rows between current row and unbounded following)""",
    "sliced": """select column_name, date, case when value is not null then value when pa is null then vb when pb is null then va
       else va + (vb - va) * ((p - pa) / (pb - pa)) end as value from l1"""}


def sliced(spark, sf):
    return S.statistics_slice(Q.to_long(V.wide(spark, sf), COLS))


@query("m20_statistics_slice", "select column_name, date, round(value, 4) as value from sliced", ["v_gaps"], SLICE)
def m20(spark, sf):
    return sliced(spark, sf).select("column_name", "date", F.round("value", 4).alias("value"))


@query("m17_mutual_information", """
select column_name, round(sum(n / t * ln(n * t / (x * y))), 6) as mutual_information from (
 select *, sum(n) over (partition by column_name, bin) as x, sum(n) over (partition by column_name, label) as y, sum(n) over (partition by column_name) as t from (
  select v.column_name, (""" + " + ".join(f"case when value > q{i} then 1 else 0 end" for i in range(1, 10)) + """) as bin, state as label, count(*)::double as n
  from v_lab v join cuts using (column_name) group by 1, 2, 3) a) b group by column_name""", ["v_gaps"], LONG | STATES | {
    "v_lab": "select v.column_name, v.value, s.state from v_long v join v_state s on s.date = v.date and s.series_id = '1-URGENT' where v.value is not null",
    "cuts": "select column_name, " + ", ".join(f"quantile_cont(value, 0.{i}) as q{i}" for i in range(1, 10)) + " from v_lab group by column_name"})
def m17(spark, sf):
    labels = states(spark, sf).where("series_id = '1-URGENT'").select("date", F.col("state").alias("label"))
    df = S.mutual_information(Q.to_long(V.wide(spark, sf), COLS), labels)
    return df.select("column_name", F.round("mutual_information", 6).alias("mutual_information"))


def _psi(x):
    return (f"(ln({x} + 8.0) - 1 / (2 * ({x} + 8.0)) - 1 / (12 * ({x} + 8.0) ** 2) + 1 / (120 * ({x} + 8.0) ** 4) - 1 / (252 * ({x} + 8.0) ** 6) + 1 / (240 * ({x} + 8.0) ** 8) - "
            + " - ".join(f"1 / ({x} + {i}.0)" for i in range(8)) + ")")


LABELLED = "select v.column_name, v.date, v.value, s.state from v_long v join v_state s on s.date = v.date and s.series_id = '1-URGENT' where v.value is not null"


@query("m17_neighbour_information", f"""
select column_name, round(greatest({_psi("count(*)")} + avg({_psi("k")}) - avg({_psi("n")}) - avg({_psi("m")}), 0), 6) as mutual_information from reach group by column_name""",
       ["v_gaps"], LONG | STATES | {
    "v_lab": LABELLED,
    "sized": "select * from (select *, count(*) over (partition by column_name, state) as n from v_lab) t where n > 1",
    "far": """select a.column_name, a.date, a.state, any_value(a.value) as value, any_value(a.n) as n, any_value(least(3, a.n - 1)) as k,
      list_sort(list(abs(b.value - a.value)))[least(3, any_value(a.n) - 1)] as d, list(b.value) as others
      from sized a join sized b on a.column_name = b.column_name and a.state = b.state and a.date <> b.date group by 1, 2, 3""",
    "ends": """select *, coalesce(list_max(list_filter(others, lambda x: x < value and value - x = d)), value - d) as low,
      coalesce(list_min(list_filter(others, lambda x: x > value and x - value = d)), value + d) as high from far""",
    "reach": """select e.column_name, e.date, any_value(e.n) as n, any_value(e.k) as k, count(*) as m from ends e join sized b
      on e.column_name = b.column_name and ((e.d = 0 and b.value = e.value) or (e.d > 0 and b.value > low and b.value < high)) group by 1, 2"""})
def m17_neighbours(spark, sf):
    labels = states(spark, sf).where("series_id = '1-URGENT'").select("date", F.col("state").alias("label"))
    df = S.neighbour_information(Q.to_long(V.wide(spark, sf), COLS), labels)
    return df.select("column_name", F.round("mutual_information", 6).alias("mutual_information"))


@query("m18_spearman_pairs", "select a, b, round(r, 6) as correlation from (" + " union all ".join(
    f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from ranked" for i, a in enumerate(COLS) for b in COLS[i:]) + ") t", ["v_gaps"], SLICE | {
    "rk": """select column_name, date, (2 * rank() over (partition by column_name order by value) + count(*) over (partition by column_name, value) - 1) / 2.0 as r from sliced""",
    "ranked": "select date, " + ", ".join(f"max(case when column_name = '{c}' then r end) as {c}" for c in COLS) + " from rk group by date"})
def m18(spark, sf):
    return S.spearman(sliced(spark, sf), COLS, target_rows=500).select("a", "b", F.round("correlation", 6).alias("correlation"))


@query("m19_feature_reduction")
def m19(spark, sf):
    wide = V.wide(spark, sf).withColumns({"f_twin": F.col("f_high") * 2 + 1, "f_sum": F.col("f_high") + F.col("f_low") + F.col("f_none")})
    labels = states(spark, sf).where("series_id = '1-URGENT'").select("date", F.col("state").alias("label"))
    cols = [*COLS, "f_twin", "f_sum"]
    return S.reduce_features(Q.to_long(wide, cols), labels, cols)


# -- training ----------------------------------------------------------------

FEATURES = [f"e{i}" for i in range(64)]
N = 3


def learning_rows(spark, sf):
    """All entries of every embedding as features, the class folded to three as label."""
    t = V.table(spark, sf, "embeddings")
    return t.select(F.lit(1).alias("series_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("vec_id").cast("int")).alias("date"),
                    (F.col("label") % N).alias("true_label"),
                    *[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(FEATURES)])


def folds(spark, sf, k=5):
    return persist_plan(P.expanding_folds(learning_rows(spark, sf), k=k))


@query("m6_logistic_importance")
def m6(spark, sf):
    m = T.fit(T.vectors(learning_rows(spark, sf), FEATURES), "logistic", {"C": 1.0})
    return spark.createDataFrame(list(T.importances(m, FEATURES).items()), "feature string, importance double")


@query("m7_tree_models")
def m7(spark, sf):
    rows = T.vectors(learning_rows(spark, sf), FEATURES)
    found = []
    for name, params in (("forest", {"numTrees": 50}), ("boosted", {"maxIter": 10})):
        found += [(name, f, v) for f, v in T.importances(T.fit(rows, name, params), FEATURES).items()]
    return spark.createDataFrame(found, "model string, feature string, importance double")


@query("m8_cross_validation")
def m8(spark, sf):
    oof, _ = T.cross_validate(folds(spark, sf), FEATURES, N, "logistic")
    return E.fold_summary(T.fold_scores(oof, N), ["accuracy", "f1_macro", "mcc", "log_loss", "auc_roc_ovr_macro"], ("run",))


@query("m8_out_of_fold_rows")
def m8_oof(spark, sf):
    return T.cross_validate(folds(spark, sf), FEATURES, N, "forest", {"numTrees": 50})[0]


@query("m9_final_fit")
def m9(spark, sf):
    path = scratch(spark, "model")
    rows = learning_rows(spark, sf)
    T.fit_and_save(rows, FEATURES, path)
    return T.score(T.PipelineModel.load(path), T.vectors(rows, FEATURES), N).drop("features", "series_id")


@query("m10_permutation_importance")
def m10(spark, sf):
    _, fitted = T.cross_validate(folds(spark, sf), FEATURES, N, "logistic")
    return T.cv_importance(fitted, FEATURES, N, repeats=5)


@query("m25_random_search")
def m25(spark, sf):
    space = {"C": {"type": "float", "low": 0.001, "high": 10.0, "log": True}, "penalty": {"type": "categorical", "choices": ["l1", "l2"]},
             "max_iter": {"type": "int", "low": 10, "high": 50, "step": 10}}
    return T.random_search(folds(spark, sf), FEATURES, N, space, trials=50).withColumn("params", F.to_json("params"))


@query("m26_incremental_themes")
def m26(spark, sf):
    themes = {"one": FEATURES[:16], "two": FEATURES[16:40], "three": FEATURES[40:]}
    return T.incremental_themes(folds(spark, sf), list(themes), themes, N)


CONTEXT_SQL = "select date, case when date_diff('day', date '2020-01-01', date) % 4 <> 0 then true_label * 1.5::double end as pillar, case when date_diff('day', date '2020-01-01', date) > 3 then true_label end as target from v_pred where run = 'a'"


@query("g29_stacking_features", "select * from (select x.date, " + ", ".join(
    f"round(max(case when run = '{r}' then ln(p{c} / (1 - p{c})) end), 6) as logit_proba_{r}_regime_{c}" for r in "abc" for c in range(3)) + ", "
    + ", ".join(f"round(stddev_samp(p{c}), 6) as disagreement_{c}" for c in range(3)) +
    """, max(k.pillar) as pillar, max(k.target) as target from v_pred x join (select date, target, last_value(pillar ignore nulls) over (order by date
   rows between unbounded preceding and current row) as pillar from ctx) k on x.date = k.date group by x.date) t where pillar is not null and target is not null""",
       ["v_pred"], {"ctx": CONTEXT_SQL})
def g29(spark, sf):
    p = V.predictions(spark, sf)
    day = F.datediff("date", F.lit("2020-01-01").cast("date"))
    context = p.where("run = 'a'").select("date", F.when(day % 4 != 0, F.col("true_label") * 1.5).alias("pillar"),
                                          F.when(day > 3, F.col("true_label")).alias("target"))
    df = T.stacking_features(p, list(V.RUNS), range(3), context, ["pillar"], "target")
    return df.select("date", "pillar", "target", *[F.round(c, 6).alias(c) for c in df.columns if c not in ("date", "pillar", "target")])


@query("g29_out_of_fold_stacking")
def g29_oof(spark, sf):
    f = folds(spark, sf)
    oof = [T.cross_validate(f, FEATURES, N, m, p, run=m)[0] for m, p in (("logistic", None), ("forest", {"numTrees": 50}))]
    context = learning_rows(spark, sf).select("date", F.col("e0").alias("pillar"), F.col("true_label").alias("target"))
    return T.stacking_features(oof[0].unionByName(oof[1]), ["logistic", "forest"], range(N), context, ["pillar"], "target", with_disagreement=False)
