"""Folds, scores, spells and events over stored predictions."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import scalars as C
from tidegauge.operators import evaluate as E, matching as X, splits as P
from tidegauge.operators.axis import DAILY, Axis
from tidegauge.plans import views as V
from tidegauge.plans.registry import query
from tidegauge.plans.rolling_queries import LONG, STATES, UPTO, W, states

K = (0, 1, 2)
PV = ["v_pred"]


def rounded(df, keys, digits=6, exact=()):
    return df.select(*keys, *exact, *[F.round(c, digits).alias(c) for c in df.columns if c not in (*keys, *exact)])


# -- folds -------------------------------------------------------------------

def fold_sql(k, purge, embargo=None):
    parts = []
    for f in range(k):
        a = f"{f} * (n // {k}) + least({f}, n % {k})"
        b = f"{f + 1} * (n // {k}) + least({f + 1}, n % {k})"
        late = f" or i >= {b} + {embargo}" if embargo is not None else ""
        parts.append(f"select series_id, date, {f + 1} as fold, case when i >= {a} and i < {b} then 'test' "
                     f"when i < {a} - {purge}{late} then 'train' end as role from ix")
    return "select * from (" + " union all ".join(parts) + ") t where role is not null"


IX = {"ix": f"select series_id, date, row_number() over {W} - 1 as i, count(*) over (partition by series_id) as n from v_series"}


def _keys(spark, sf):
    return V.series(spark, sf).select("series_id", "date")


@query("m1_purged_folds", fold_sql(5, 21), ["v_series"], IX)
def m1(spark, sf):
    return P.purged_folds(_keys(spark, sf), k=5, purge=21)


@query("m1_purged_folds_embargo_long_series", fold_sql(4, 10, 15), ["v_series"], IX)
def m1_long(spark, sf):
    return P.purged_folds(_keys(spark, sf), k=4, purge=10, embargo=15, long_series=True, target_rows=LONG)


@query("m2_expanding_folds", "select * from (" + " union all ".join(
    f"select series_id, date, {f + 1} as fold, case when i < n - {5 - f} * (n // 6) then 'train' when i < n - {5 - f} * (n // 6) + n // 6 then 'test' end as role from ix"
    for f in range(5)) + ") t where role is not null", ["v_series"], IX)
def m2(spark, sf):
    return P.expanding_folds(_keys(spark, sf))


@query("m27_holdout", "select series_id, date, case when i >= n - ceil(n * 0.2) then 'test' else 'train' end as role from ix", ["v_series"], IX)
def m27(spark, sf):
    return P.holdout(_keys(spark, sf))


@query("m3_class_weights", """
select label, round(sum(c) over () / (count(*) over () * c), 6) as weight from (select label, count(*) * 1.0::double as c from embeddings group by label) t""")
def m3(spark, sf):
    return P.class_weights(V.table(spark, sf, "embeddings"), "label").select("label", F.round("weight", 6).alias("weight"))


@query("j11_weights_and_unseen_rows", """
select vec_id, e.label, round(w.weight, 6) as weight from embeddings e join (
  select label, sum(c) over () / (count(*) over () * c) as weight from (select label, count(*) * 1.0::double as c from embeddings group by label) t) w on e.label = w.label
where vec_id not in (select vec_id from embeddings where vec_id % 5 = 0)""")
def j11(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", "label")
    left = e.join(e.where("vec_id % 5 = 0").select("vec_id"), "vec_id", "left_anti")
    weights = P.class_weights(e, "label")
    return left.join(F.broadcast(weights), "label").select("vec_id", "label", F.round("weight", 6).alias("weight"))


@query("m4_label_codes", "select label, cast(dense_rank() over (order by label) - 1 as int) as code from (select distinct label from embeddings) t")
def m4(spark, sf):
    return P.label_codes(V.table(spark, sf, "embeddings"), "label")


INPUTS = [c for c in V.WIDE if c != "f_high"]


@query("m5_training_matrix", f"""
select * from (select date, f_high as y, {", ".join(f"last_value({c} ignore nulls) over u as {c}" for c in INPUTS)}
 from v_wide where f_high is not null window u as (order by date rows between unbounded preceding and current row)) t
where {" and ".join(f"{c} is not null" for c in INPUTS)}""", ["v_wide"])
def m5(spark, sf):
    return P.training_matrix(V.wide(spark, sf).select("date", F.col("f_high").alias("y"), *INPUTS), INPUTS, "y", Axis(()))


@query("m5_training_matrix_zero_fill", f"""
select date, f_high as y, {", ".join(f"coalesce({c}, 0) as {c}" for c in INPUTS)} from v_wide where f_high is not null""", ["v_wide"])
def m5_zero(spark, sf):
    df = V.wide(spark, sf).select("date", F.col("f_high").alias("y"), *INPUTS, F.lit(None).cast("double").alias("f_empty"))
    return P.training_matrix(df, [*INPUTS, "f_empty"], "y", zero_fill=True)


# -- label scores ------------------------------------------------------------

CLASS = {
    "cm": "select run, true_label as t, predicted_label as p, count(*) as n from v_pred group by 1, 2, 3",
    "cls": """select r.run, r.label, coalesce(sum(case when t = p and t = r.label then n end), 0) as tp,
       coalesce(sum(case when t = r.label then n end), 0) as sup, coalesce(sum(case when p = r.label then n end), 0) as prd
       from (select distinct run, label from (select run, t as label from cm union all select run, p from cm) u) r join cm on cm.run = r.run group by r.run, r.label""",
    "cs": """select *, coalesce(tp * 1.0::double / nullif(prd, 0), 0) as precision, coalesce(tp * 1.0::double / nullif(sup, 0), 0) as recall,
       coalesce(2.0::double * tp / nullif(sup + prd, 0), 0) as f1 from cls"""}


@query("m11_class_scores", """
select run, label, cast(tp as bigint) as tp, cast(sup as bigint) as support, cast(prd as bigint) as predicted,
  round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from cs""", PV, CLASS)
def m11_class(spark, sf):
    return rounded(E.class_scores(V.predictions(spark, sf)), ["run", "label"], exact=["tp", "support", "predicted"])


@query("m11_label_scores", """
select run, round(sum(tp) / sum(sup), 6) as accuracy, round(avg(precision), 6) as precision_macro, round(avg(recall), 6) as recall_macro,
  round(avg(f1), 6) as f1_macro, round(sum(precision * w) / sum(w), 6) as precision_custom_weighted, round(sum(recall * w) / sum(w), 6) as recall_custom_weighted,
  round(sum(f1 * w) / sum(w), 6) as f1_custom_weighted,
  round((sum(tp) * sum(sup) - sum(sup * prd)) / sqrt(cast((sum(sup) * sum(sup) - sum(prd * prd)) as double) * cast((sum(sup) * sum(sup) - sum(sup * sup)) as double)), 6) as mcc
from (select *, case label when 0 then 3.0 when 2 then 0.5 else 1.0 end as w from cs) t group by run""", PV, CLASS)
def m11(spark, sf):
    return rounded(E.label_scores(V.predictions(spark, sf), weights={0: 3.0, 2: 0.5}), ["run"])


@query("m11_binary_scores", """
select run, round(2.0 * tp / (2 * tp + fp + fn), 6) as binary_r0_f1, round(tp * 1.0 / (tp + fp), 6) as binary_r0_precision,
  round(tp * 1.0 / (tp + fn), 6) as binary_r0_recall, round((tp + tn) * 1.0 / (tp + tn + fp + fn), 6) as binary_r0_accuracy
from (select run, sum(case when t = 0 and p = 0 then n else 0 end)::double as tp, sum(case when t <> 0 and p = 0 then n else 0 end)::double as fp,
  sum(case when t = 0 and p <> 0 then n else 0 end)::double as fn, sum(case when t <> 0 and p <> 0 then n else 0 end)::double as tn from cm group by run) c""", PV, CLASS)
def m11_binary(spark, sf):
    return rounded(E.binary_scores(V.predictions(spark, sf)), ["run"])


@query("m11_quality_threshold", """
select 'chars' as run, round(avg(cast(q = p as int)), 6) as accuracy, round(sum(case when q = 1 and p = 1 then 1.0::double else 0 end) / nullif(sum(p), 0), 6) as precision_1,
  round(sum(case when q = 1 and p = 1 then 1.0::double else 0 end) / nullif(sum(q), 0), 6) as recall_1
from (select l.quality as q, cast(d.n_chars > 500 as int) as p from labels l join documents d using (doc_id)) t""")
def m11_quality(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("predicted_label"))
    df = V.table(spark, sf, "labels").join(docs, "doc_id").select(F.lit("chars").alias("run"), F.col("quality").alias("true_label"), "predicted_label")
    s = E.binary_scores(df, positive=1)
    return s.select("run", F.round("binary_r1_accuracy", 6).alias("accuracy"), F.round("binary_r1_precision", 6).alias("precision_1"),
                    F.round("binary_r1_recall", 6).alias("recall_1"))


@query("m13_confusion", "select run, t as true_label, p as predicted_label, n, round(n / sum(n) over (partition by run, t), 6) as share from cm", PV, CLASS)
def m13(spark, sf):
    return rounded(E.normalised_confusion(V.predictions(spark, sf)), ["run", "true_label", "predicted_label"], exact=["n"])


@query("m13_confusion_table", "select run, t as true_label, " + ", ".join(
    f"cast(coalesce(sum(case when p = {c} then n end), 0) as bigint) as predicted_{c}" for c in K) + " from cm group by run, t", PV, CLASS)
def m13_table(spark, sf):
    return E.confusion_table(V.predictions(spark, sf), K)


@query("m13_classification_report", """
select run, cast(label as varchar) as row, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(sup as bigint) as support from cs
union all select run, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(sup) as bigint) from cs group by run
union all select run, 'weighted avg', round(sum(precision * sup) / sum(sup), 6), round(sum(recall * sup) / sum(sup), 6), round(sum(f1 * sup) / sum(sup), 6), cast(sum(sup) as bigint) from cs group by run
union all select run, 'accuracy', round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6), cast(sum(sup) as bigint) from cs group by run""", PV, CLASS)
def m13_report(spark, sf):
    return rounded(E.classification_report(V.predictions(spark, sf)), ["run", "row"], exact=["support"])


# -- probability scores ------------------------------------------------------

@query("m12_log_loss", """
select run, round(avg(-ln(case true_label when 0 then p0 when 1 then p1 else p2 end)), 6) as log_loss from v_pred group by run""", PV)
def m12(spark, sf):
    return rounded(E.log_loss(V.predictions(spark, sf), K), ["run"])


SCORES = {"sc": " union all ".join(f"select run, {c} as label, p{c} as score, cast(true_label = {c} as int) as hit from v_pred" for c in K),
          "rk": """select *, (rank() over (partition by run, label order by score) + rank() over (partition by run, label order by score)
            + count(*) over (partition by run, label, score) - 1) / 2.0 as r from sc"""}
AUC = """select run, label, (sum(case when hit = 1 then r end) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * (count(*) - sum(hit))) as auc
 from rk group by run, label"""


@query("m12_auc_per_class", f"select run, label, round(auc, 6) as auc from ({AUC}) t", PV, SCORES)
def m12_auc(spark, sf):
    return rounded(E.auc(V.predictions(spark, sf), K, target_rows=20), ["run", "label"])


@query("m12_auc_macro", f"select run, round(avg(auc), 6) as auc_roc_ovr_macro from ({AUC}) t group by run", PV, SCORES)
def m12_macro(spark, sf):
    return rounded(E.macro_auc(E.auc(V.predictions(spark, sf), K)), ["run"])


@query("m12_roc_points", """
select run, label, round(score, 6) as threshold, round(sum(neg) over w * 1.0 / sum(neg) over g, 6) as fpr, round(sum(pos) over w * 1.0 / sum(pos) over g, 6) as tpr
from (select run, label, score, sum(hit) as pos, count(*) - sum(hit) as neg from sc group by run, label, score) t
window w as (partition by run, label order by score desc rows between unbounded preceding and current row), g as (partition by run, label)""", PV, SCORES)
def m12_roc(spark, sf):
    return rounded(E.roc_points(V.predictions(spark, sf), K), ["run", "label"])


@query("t23_confidence", """
select run, round(avg(c), 6) as avg_confidence, round(stddev_samp(c), 6) as std_confidence, round(avg(case when ok then c end), 6) as avg_conf_when_correct,
  round(avg(case when not ok then c end), 6) as avg_conf_when_incorrect, round(avg(case when ok then c end) - avg(case when not ok then c end), 6) as confidence_lift
from (select run, case predicted_label when 0 then p0 when 1 then p1 else p2 end as c, true_label = predicted_label as ok from v_pred) t group by run""", PV)
def t23(spark, sf):
    return rounded(E.confidence(V.predictions(spark, sf), K), ["run"])


@query("t21_disagreement", "select date, " + ", ".join(f"round(stddev_samp(p{c}), 6) as disagreement_{c}" for c in K) + " from v_pred group by date", PV)
def t21(spark, sf):
    return rounded(E.disagreement(V.predictions(spark, sf), K), ["date"])


@query("c14_logits", "select run, date, " + ", ".join(f"round(ln(p{c} / (1 - p{c})), 6) as logit_{c}" for c in K) +
       ", round(p0, 6) as back from v_pred", PV)
def c14(spark, sf):
    df = V.predictions(spark, sf).withColumns({f"logit_{c}": C.logit(f"p{c}") for c in K})
    return df.select("run", "date", *[F.round(f"logit_{c}", 6).alias(f"logit_{c}") for c in K], F.round(C.inverse_logit("logit_0"), 6).alias("back"))


# -- many runs ---------------------------------------------------------------
# run c skips every third date here, so votes have gaps to fill

GAPPY = {"v_g": "select run, date, predicted_label from v_pred where not (run = 'c' and date_diff('day', date '2020-01-01', date) % 3 = 0)"}


def gappy(spark, sf):
    skip = (F.col("run") == "c") & (F.datediff("date", F.lit("2020-01-01").cast("date")) % 3 == 0)
    return V.predictions(spark, sf).where(~skip)


AGREE = """select a.run as run_a, b.run as run_b, count(*) as n_common, sum(cast(a.predicted_label = b.predicted_label as int)) as n_agree
 from v_g a join v_g b on a.date = b.date and a.run < b.run group by 1, 2"""


@query("t22_pair_agreement", f"select run_a, run_b, round(n_agree / n_common, 6) as agreement from ({AGREE}) t", PV, GAPPY)
def t22(spark, sf):
    return E.pair_agreement(gappy(spark, sf), list(V.RUNS)).select("run_a", "run_b", F.round("agreement", 6).alias("agreement"))


@query("j8_pairs_of_runs", f"select run_a, run_b, n_common, cast(n_agree as bigint) as n_agree from ({AGREE}) t", PV, GAPPY)
def j8(spark, sf):
    return E.pair_agreement(gappy(spark, sf), list(V.RUNS)).drop("agreement")


@query("t20_majority_vote", """
select date, min(label) filter (where n = top) as majority, round(max(n) / sum(n), 6) as agreement
from (select *, max(n) over (partition by date) as top from (
  select date, label, count(*) as n from (select date, unnest([a, b, c]) as label from f3) u where label is not null group by 1, 2) x) y group by date""",
       PV, GAPPY | {
    "f1": "select date, " + ", ".join(f"max(case when run = '{r}' then predicted_label end) as {r}" for r in "abc") + " from v_g group by date",
    "f2": "select date, " + ", ".join(f"last_value({r} ignore nulls) over (order by date rows between unbounded preceding and current row) as {r}" for r in "abc") + " from f1",
    "f3": "select date, " + ", ".join(f"first_value({r} ignore nulls) over (order by date rows between current row and unbounded following) as {r}" for r in "abc") + " from f2"})
def t20(spark, sf):
    return rounded(E.majority_vote(gappy(spark, sf), list(V.RUNS)), ["date"], exact=["majority"])


@query("o5_common_dates", """
select distinct date from v_g where run = 'a' and date in (select date from v_g where run = 'b') and date in (select date from v_g where run = 'c')""", PV, GAPPY)
def o5(spark, sf):
    g = gappy(spark, sf)
    return E.common_dates([g.where(F.col("run") == r) for r in V.RUNS])


# -- spells and events -------------------------------------------------------

SPELL = {"sp0": f"select series_id, date, state, case when lag(state) over {W} is distinct from state or row_number() over {W} = 1 then 1 else 0 end as new from v_state",
         "sp": f"""select series_id, state as label, min(date) as start, max(date) as "end", count(*) as n_rows, max(date) - min(date) + 1 as days
       from (select *, sum(new) over {UPTO} as block from sp0) t group by series_id, state, block"""}


@query("w17_spells", 'select series_id, label, start, "end", n_rows, cast(days as int) as days from sp where days >= 5', ["v_series"], STATES | SPELL)
def w17(spark, sf):
    return E.spells(states(spark, sf), "state", DAILY, min_days=5)


@query("w17_spells_long_series", 'select series_id, label, start, "end", n_rows, cast(days as int) as days from sp', ["v_series"], STATES | SPELL)
def w17_long(spark, sf):
    return E.spells(states(spark, sf), "state", DAILY, long_series=True, target_rows=LONG)


@query("w18_entries", "select series_id, date, state as label from sp0 where new = 1", ["v_series"], STATES | SPELL)
def w18(spark, sf):
    return E.entries(states(spark, sf), "state", DAILY)


@query("w19_stability", """
select series_id, round(count(*) / sum(n_rows), 6) as flip_rate, round(avg(n_rows), 6) as avg_spell_rows, round(stddev_samp(n_rows), 6) as std_spell_rows,
  min(n_rows) as min_spell_rows, max(n_rows) as max_spell_rows from sp group by series_id""", ["v_series"], STATES | SPELL)
def w19(spark, sf):
    df = E.stability(states(spark, sf), "state", DAILY)
    return rounded(df, ["series_id"], exact=["min_spell_rows", "max_spell_rows"])


# predictions for the event matchers: the true state against the state smoothed over 5 days
SMOOTH = STATES | {
    "v_pair": """select series_id as run, date, state as true_label, case when c0 >= c1 and c0 >= c2 then 0 when c1 >= c2 then 1 else 2 end as predicted_label
       from (select *, """ + ", ".join(f"sum(case when state = {c} then 1 else 0 end) over (partition by series_id order by date rows between 2 preceding and 2 following) as c{c}" for c in K)
              + " from v_state) t",
    **{f"e_{n}": f"""select run, date, {c} as label from (select *, lag({c}) over (partition by run order by date) as before from v_pair) t
       where before is distinct from {c}""" for n, c in (("true", "true_label"), ("pred", "predicted_label"))},
    **{f"s_{n}": f"""select run, label, min(date) as start, max(date) as stop from (select *, sum(new) over (partition by run order by date rows between unbounded preceding and current row) as block
       from (select run, date, {c} as label, case when lag({c}) over (partition by run order by date) is distinct from {c} then 1 else 0 end as new from v_pair) t) u
       group by run, label, block having max(date) - min(date) + 1 >= 5""" for n, c in (("true", "true_label"), ("pred", "predicted_label"))}}


def smoothed(spark, sf):
    mode = F.mode("state", True).over(DAILY.base().rowsBetween(-2, 2))
    return states(spark, sf).select(F.col("series_id").alias("run"), "date", F.col("state").alias("true_label"), mode.alias("predicted_label"))


@query("j9_entry_candidates", """
select t.run, t.label, t.date as true_date, p.date as pred_date, cast(p.date - t.date as int) as lag_days from e_true t join e_pred p
on t.run = p.run and t.label = p.label and p.date between t.date - 5 and t.date + 10""", ["v_series"], SMOOTH)
def j9(spark, sf):
    return X.entry_candidates(smoothed(spark, sf))


def _greedy(true, near, events):
    """Each event of ``true`` in order takes the first of its ``near`` list that is free."""
    return f"""with recursive c as (select *, row_number() over (partition by run, label order by {events}) as k, {near} as near from {true} t),
    r as (select distinct run, label, 0::bigint as k, []::date[] as taken, null::date as event, null::date as pick from c
      union all select run, label, k, case when pick is null then taken else list_append(taken, pick) end, event, pick from (
        select c.run, c.label, c.k, c.{events} as event, taken, list_filter(near, lambda x: not list_contains(taken, x))[1] as pick
        from r join c on r.run = c.run and r.label = c.label and c.k = r.k + 1) s)
    select run, label, event, pick from r where pick is not null"""


GREEDY = SMOOTH | {
    "m_entries": _greedy("e_true", """(select list(p.date order by abs(p.date - t.date), p.date) from e_pred p
      where p.run = t.run and p.label = t.label and p.date between t.date - 5 and t.date + 10)""", "date"),
    "m_starts": _greedy("s_true", """(select list(p.start order by greatest(t.start, p.start) - least(t.stop, p.stop), p.start) from s_pred p
      where p.run = t.run and p.label = t.label and t.start <= p.stop and p.start <= t.stop)""", "start"),
    "m_spells": """select m.run, m.label, m.event as true_start, t.stop as true_end, cast(t.stop - t.start + 1 as int) as true_days,
      p.start as pred_start, p.stop as pred_end, cast(p.stop - p.start + 1 as int) as pred_days
      from m_starts m join s_true t on m.run = t.run and m.label = t.label and m.event = t.start join s_pred p on m.run = p.run and m.label = p.label and m.pick = p.start""",
    "m_classes": "select distinct run, unnest([0, 1, 2]) as label from v_pair"}


def _scored(events, hits, means):
    """Counts, precision, recall and f1 per run and class, and means over the hits."""
    return f"""
select run, label, n_true, n_pred, n_hit, """ + ", ".join(f"round(coalesce({m}, 0), 6) as {m}" for m in means) + f""", round(p, 6) as precision, round(r, 6) as recall,
  round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from (
  select *, coalesce(n_hit / nullif(n_pred, 0), 0) as p, coalesce(n_hit / nullif(n_true, 0), 0) as r from (
    select k.*, (select count(*) from {events}_true e where e.run = k.run and e.label = k.label) as n_true,
      (select count(*) from {events}_pred e where e.run = k.run and e.label = k.label) as n_pred, coalesce(n_hit, 0) as n_hit, """ + ", ".join(means) + f"""
    from m_classes k left join (select run, label, count(*) as n_hit, """ + ", ".join(f"{x} as {m}" for m, x in means.items()) + f" from {hits} group by 1, 2) h using (run, label)) a) b"


@query("j9_matched_entries", """
select run, label, event as true_date, pick as pred_date, cast(pick - event as int) as lag_days from m_entries""", ["v_series"], GREEDY)
def j9_matched(spark, sf):
    return X.match_entries(smoothed(spark, sf))


@query("j10_overlapping_spells", """
select t.run, t.label, t.start as true_start, t.stop as true_end, cast(t.stop - t.start + 1 as int) as true_days, p.start as pred_start, p.stop as pred_end,
  cast(p.stop - p.start + 1 as int) as pred_days, cast(least(t.stop, p.stop) - greatest(t.start, p.start) + 1 as int) as overlap_days
from s_true t join s_pred p on t.run = p.run and t.label = p.label and t.start <= p.stop and p.start <= t.stop""", ["v_series"], SMOOTH)
def j10(spark, sf):
    return X.overlapping_spells(smoothed(spark, sf))


@query("j10_matched_spells", "select * from m_spells", ["v_series"], GREEDY)
def j10_matched(spark, sf):
    return X.match_spells(smoothed(spark, sf))


@query("m14_entry_scores", _scored("e", "m_entries", {"mean_lag_days": "avg(pick - event)"}), ["v_series"], GREEDY)
def m14(spark, sf):
    return rounded(X.entry_scores(smoothed(spark, sf), K), ["run", "label"], exact=["n_true", "n_pred", "n_hit"])


@query("m15_spell_scores", _scored("s", "m_spells", {
    "avg_start_diff": "avg(pred_start - true_start)", "avg_end_diff": "avg(pred_end - true_end)", "avg_duration_ratio": "avg(pred_days / true_days)",
    "starts_within_tolerance": "avg(cast(pred_start - true_start between -10 and 0 as int))",
    "ends_within_tolerance": "avg(cast(pred_end - true_end between 0 and 10 as int))"}), ["v_series"], GREEDY)
def m15(spark, sf):
    return rounded(X.spell_scores(smoothed(spark, sf), K), ["run", "label"], exact=["n_true", "n_pred", "n_hit"])


# -- result tables -----------------------------------------------------------
# orders stand in for importance scores: theme = priority, feature = status and month, fold = quarter

IMP = {"v_imp": """select o_orderpriority as theme, o_orderstatus || cast(month(o_orderdate) as varchar) as feature, quarter(o_orderdate + interval 1 month) + 4 * (year(o_orderdate) % 2) as fold,
  round(avg(o_totalprice) / 100000 - 1.5, 6) as importance from orders group by 1, 2, 3"""}


def importances(spark, sf):
    d = F.col("o_orderdate")
    later = F.add_months(d.cast("date"), 1)
    return V.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("theme"), F.concat("o_orderstatus", F.month(d).cast("string")).alias("feature"),
        (F.quarter(later) + 4 * (F.year(d) % 2)).alias("fold")) \
        .agg(F.round(F.avg("o_totalprice") / 100000 - 1.5, 6).alias("importance"))


@query("t17_prune_features", """
select theme, feature, round(avg(importance), 9) as mean_importance, round(avg(cast(importance > 0 as int)), 6) as positive_share from v_imp
group by theme, feature having avg(importance) > 0 and avg(cast(importance > 0 as int)) >= 0.6""", [], IMP)
def t17(spark, sf):
    df = E.prune_features(importances(spark, sf))
    return df.select("theme", "feature", F.round("mean_importance", 9).alias("mean_importance"), F.round("positive_share", 6).alias("positive_share"))


@query("t18_theme_importance", """
select theme, round(sum(importance), 9) as importance, round(100 * sum(importance) / sum(sum(importance)) over (), 9) as pct from v_imp group by theme""", [], IMP)
def t18(spark, sf):
    return rounded(E.theme_importance(importances(spark, sf)), ["theme"], 9)


@query("t19_fold_summary", """
select theme, feature as model, round(avg(importance), 9) as importance_mean, round(stddev_samp(importance), 9) as importance_std from v_imp group by 1, 2""", [], IMP)
def t19(spark, sf):
    df = E.fold_summary(importances(spark, sf).withColumnRenamed("feature", "model"), ["importance"])
    return rounded(df, ["theme", "model"], 9)


@query("t19_theme_ranking", """
select theme, round(score, 9) as score, cast(row_number() over (order by score desc, theme) as int) as place from (
 select theme, avg(m) as score from (select theme, feature, avg(importance) as m from v_imp group by 1, 2) t group by theme) u""", [], IMP)
def t19_rank(spark, sf):
    s = E.fold_summary(importances(spark, sf).withColumnRenamed("feature", "model"), ["importance"])
    return rounded(E.ranked(s, "importance_mean"), ["theme"], 9, exact=["place"])


TOP = """(select theme, feature, row_number() over (partition by theme order by avg(importance) desc, feature) as k from v_imp group by 1, 2)"""


@query("o2_top_features", f"select v.theme, v.feature, v.fold, v.importance from v_imp v join {TOP} t on v.theme = t.theme and v.feature = t.feature where k <= 5", [], IMP)
def o2(spark, sf):
    return E.top_features(importances(spark, sf), 5)


@query("o3_top_themes", """
select theme, round(score, 9) as score, cast(place as int) as place from (select *, row_number() over (order by score desc, theme) as place from (
 select theme, avg(m) as score from (select theme, feature, avg(importance) as m from v_imp group by 1, 2) t group by theme) u) w where place <= 3""", [], IMP)
def o3(spark, sf):
    s = E.fold_summary(importances(spark, sf).withColumnRenamed("feature", "model"), ["importance"])
    return rounded(E.ranked(s, "importance_mean").where("place <= 3"), ["theme"], 9, exact=["place"])


@query("o4_union_of_frames", """
select 'orders' as source, cast(o_orderdate as date) as date, o_totalprice as value from orders
union all select 'lines', cast(l_shipdate as date), l_extendedprice from lineitem""")
def o4(spark, sf):
    a = V.table(spark, sf, "orders").select(F.lit("orders").alias("source"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("value"))
    b = V.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("value"), F.lit("lines").alias("source"), F.col("l_shipdate").cast("date").alias("date"))
    return a.unionByName(b)


@query("t6_performance_by_state", """
select state, count(*) as n, round(avg(r), 6) as mean_daily, round(stddev_samp(r), 6) as std_daily, round(avg(r) * 252, 4) as mean_annual,
  round(stddev_samp(r) * sqrt(252), 4) as std_annual from (select state, value / lag(value) over (partition by series_id order by date) - 1 as r
  from v_series join v_state using (series_id, date)) t where r is not null group by state""", ["v_series"], STATES)
def t6(spark, sf):
    from tidegauge.operators.regimes import performance
    df = V.series(spark, sf).join(states(spark, sf), ["series_id", "date"])
    out = performance(df, "state", "value")
    return out.select("state", "n", *[F.round(c, 6 if "daily" in c else 4).alias(c) for c in ("mean_daily", "std_daily", "mean_annual", "std_annual")])
