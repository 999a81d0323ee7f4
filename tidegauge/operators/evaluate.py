"""Scores of classifiers from stored predictions, for many runs at once.

Predictions are long: ``run, date, true_label, predicted_label, p0 .. pk``. Label
scores are arithmetic on the confusion counts (runs * classes^2 rows), probability
scores on counts per distinct score.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions.scalars import clip
from tidegauge.operators.axis import Axis
from tidegauge.operators.chunks import TARGET_ROWS, by_chunk, cumulative_by, filled, lay_out, running_sum
from tidegauge.operators.profile import block_sums

TRUE, PRED = "true_label", "predicted_label"
RUNS = Axis(("run",))
FLOAT_EPSILON = 2.220446049250313e-16


def confusion(df: DataFrame, by=("run",)):
    return df.dropna(subset=[TRUE, PRED]).groupBy(*by, TRUE, PRED).agg(F.count(F.lit(1)).alias("n"))


def normalised_confusion(df: DataFrame, by=("run",)):
    """Share of each true class predicted as each class."""
    row = Axis((*by, TRUE)).whole()
    return confusion(df, by).withColumn("share", F.col("n") / F.sum("n").over(row))


def confusion_table(df: DataFrame, classes, by=("run",)):
    """Confusion counts with one column per predicted class."""
    cols = [F.coalesce(F.sum(F.when(F.col(PRED) == c, F.col("n"))), F.lit(0)).alias(f"predicted_{c}") for c in classes]
    return confusion(df, by).groupBy(*by, TRUE).agg(*cols)


def _zero(x):
    return F.coalesce(x, F.lit(0.0))


def class_scores(df: DataFrame, classes=None, by=("run",)):
    """precision, recall, f1 and support per run and class; 0 where undefined.

    Classes default to all labels a run has or predicts.
    """
    c = confusion(df, by)
    hit = F.when(F.col(TRUE) == F.col(PRED), F.col("n")).otherwise(0)
    rows = c.select(*by, F.col(TRUE).alias("label"), hit.alias("tp"), F.col("n").alias("is_true"), F.lit(0).alias("is_pred")) \
            .unionAll(c.select(*by, F.col(PRED), F.lit(0), F.lit(0), F.col("n")))
    if classes is not None:
        runs = c.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(k) for k in classes])).alias("label"))
        rows = rows.unionAll(runs.select(*by, "label", F.lit(0), F.lit(0), F.lit(0)))
    g = rows.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("is_true").alias("support"), F.sum("is_pred").alias("predicted"))
    g = g.withColumns({"precision": _zero(F.try_divide("tp", "predicted")), "recall": _zero(F.try_divide("tp", "support"))})
    return g.withColumn("f1", _zero(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def label_scores(df: DataFrame, classes=None, weights: dict | None = None, by=("run",)):
    """accuracy, macro precision/recall/f1, MCC per run; weighted averages if weights are given."""
    by = list(by)
    s = class_scores(df, classes, by)
    aggs = [F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")]
    if weights:
        w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("label")], F.lit(1.0))
        aggs += [F.try_divide(F.sum(F.col(m) * w), F.sum(w)).alias(f"{m}_custom_weighted") for m in ("precision", "recall", "f1")]
    right, total = F.sum("tp"), F.sum("support")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("support", "predicted")}        # squares of counts pass a long's range
    tt, pp, tp = (F.sum(wide[a] * wide[b]) for a, b in (("support", "support"), ("predicted", "predicted"), ("support", "predicted")))
    hits, rows = right.cast("decimal(19,0)"), total.cast("decimal(19,0)")
    spread = (rows * rows - pp).cast("double") * (rows * rows - tt).cast("double")
    mcc = _zero(F.try_divide((hits * rows - tp).cast("double"), F.sqrt(spread)))
    return s.groupBy(*by).agg(F.try_divide(right, total).alias("accuracy"), *aggs, mcc.alias("mcc"))


def binary_scores(df: DataFrame, positive=0, by=("run",)):
    """One class against the rest."""
    one = df.withColumns({TRUE: (F.col(TRUE) == positive).cast("int"), PRED: (F.col(PRED) == positive).cast("int")})
    s = class_scores(one, [0, 1], by)
    p = f"binary_r{positive}_"
    return s.groupBy(*by).agg(
        *[F.max(F.when(F.col("label") == 1, F.col(m))).alias(p + m) for m in ("f1", "precision", "recall")],
        F.try_divide(F.sum("tp"), F.sum("support")).alias(p + "accuracy"))


def classification_report(df: DataFrame, by=("run",)):
    """Per class, then macro and weighted averages and accuracy, as rows."""
    by = list(by)
    s = class_scores(df, None, by)
    cols = ["precision", "recall", "f1", "support"]
    each = s.select(*by, F.col("label").cast("string").alias("row"), *cols)
    macro = s.groupBy(*by).agg(F.lit("macro avg").alias("row"), *[F.avg(c).alias(c) for c in cols[:3]], F.sum("support").alias("support"))
    weighted = s.groupBy(*by).agg(F.lit("weighted avg").alias("row"), *[
        F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols[:3]], F.sum("support").alias("support"))
    acc = F.try_divide(F.sum("tp"), F.sum("support"))
    accuracy = s.groupBy(*by).agg(F.lit("accuracy").alias("row"), *[acc.alias(c) for c in cols[:3]], F.sum("support").alias("support"))
    return reduce(DataFrame.unionByName, [each, macro, weighted, accuracy])


# -- probabilities -----------------------------------------------------------

def probability_of(label, classes):
    """The probability column of the class a row's ``label`` names."""
    return F.coalesce(*[F.when(F.col(label) == c, F.col(f"p{c}")) for c in classes])


def log_loss(df: DataFrame, classes, by=("run",)):
    total = sum((F.col(f"p{c}") for c in classes), F.lit(0.0))
    p = clip(F.try_divide(probability_of(TRUE, classes), total), FLOAT_EPSILON, 1 - FLOAT_EPSILON)
    return df.groupBy(*by).agg(F.avg(-F.ln(p)).alias("log_loss"))


def score_counts(df: DataFrame, classes, by=("run",)):
    """Positives and negatives per run, class and distinct score."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"p{c}").alias("score"),
                                        (F.col(TRUE) == c).alias("hit")) for c in classes])).alias("s")
    return df.select(*by, each).groupBy(*by, "s.label", "s.score").agg(
        F.count_if("s.hit").alias("pos"), F.count_if(~F.col("s.hit")).alias("neg"))


def auc(df: DataFrame, classes, by=("run",), target_rows=TARGET_ROWS):
    """One-vs-rest ROC AUC per run and class, by rank sum with average ranks.

    Scores are counted first and accumulated in chunks, so a run of any length is
    ranked by many tasks.
    """
    keys = [*by, "label"]
    s = score_counts(df, classes, by)
    s = cumulative_by(s, keys, ["score"], {"upto": F.col("neg")}, target_rows)
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") + F.col("neg") / 2))
    return s.groupBy(*keys).agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def macro_auc(per_class: DataFrame, by=("run",)):
    return per_class.groupBy(*by).agg(F.avg("auc").alias("auc_roc_ovr_macro"))


def roc_points(df: DataFrame, classes, by=("run",), target_rows=TARGET_ROWS):
    """False and true positive rate at every distinct score, from the highest down."""
    keys = [*by, "label"]
    s = score_counts(df, classes, by).withColumn("down", -F.col("score"))
    s = cumulative_by(s, keys, ["down"], {"tp": F.col("pos"), "fp": F.col("neg")}, target_rows)
    totals = s.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return s.join(F.broadcast(totals), keys).select(          # one row per run and class
        *keys, F.col("score").alias("threshold"), F.try_divide("fp", "_n").alias("fpr"), F.try_divide("tp", "_p").alias("tpr"))


# -- many runs ---------------------------------------------------------------

def confidence(df: DataFrame, classes, by=("run",)):
    df = df.dropna(subset=[TRUE, PRED]).withColumns({
        "_c": probability_of(PRED, classes), "_ok": F.col(TRUE) == F.col(PRED)})
    right, wrong = F.avg(F.when(F.col("_ok"), F.col("_c"))), F.avg(F.when(~F.col("_ok"), F.col("_c")))
    return df.groupBy(*by).agg(
        F.avg("_c").alias("avg_confidence"), F.stddev_samp("_c").alias("std_confidence"),
        right.alias("avg_conf_when_correct"), wrong.alias("avg_conf_when_incorrect"), (right - wrong).alias("confidence_lift"))


def on_dates(df: DataFrame, runs, date="date", value=PRED):
    """One row per date, one column per run."""
    return df.groupBy(date).agg(*[F.max(F.when(F.col("run") == r, F.col(value))).alias(r) for r in runs])


def pair_agreement(df: DataFrame, runs, date="date"):
    """Share of common dates on which two runs predict the same, for every pair of runs.

    The labels of a date stand side by side, and blocks of runs are compared by the products
    of their one-hot planes, summed over the dates: the plan does not grow with the runs, and
    no pair rows are formed before the sums. Without any date there are no rows.
    """
    spark, names = df.sparkSession, np.array(list(runs), dtype=object)
    places = spark.createDataFrame([(r, i) for i, r in enumerate(runs)], "run string, _i int")
    codes = df.where(F.col(PRED).isNotNull()).join(F.broadcast(places), "run")      # the given runs
    codes = codes.groupBy(date, "_i").agg(F.max(PRED).cast("string").alias("_l"))
    rows = codes.groupBy(date).agg(F.collect_list("_i").alias("_i"), F.collect_list("_l").alias("_l")).select("_i", "_l")      # a label per run

    def sums(x, left, right):
        a, b = x[:, left], x[:, right]
        planes = [((a == c).astype("float64"), (b == c).astype("float64")) for c in range(int(x.max(initial=-1)) + 1)]
        return (a >= 0).astype("float64").T @ (b >= 0).astype("float64"), sum((p.T @ q for p, q in planes), np.zeros((a.shape[1], b.shape[1])))

    def partial(batches):
        for pdf in batches:
            size = pdf["_i"].map(len).to_numpy()
            x = np.full((len(pdf), len(names)), -1)
            if size.sum():
                _, label = np.unique(np.concatenate(pdf["_l"].to_numpy()).astype(str), return_inverse=True)
                x[np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["_i"].to_numpy())] = label
            yield from block_sums(x, names, sums, diagonal=False)
    found = rows.mapInPandas(partial, "a string, b string, s0 double, s1 double").groupBy("a", "b").agg(F.sum("s0").alias("n"), F.sum("s1").alias("s"))
    return found.select(F.col("a").alias("run_a"), F.col("b").alias("run_b"), F.col("n").cast("long").alias("n_common"), F.col("s").cast("long").alias("n_agree"),
                        F.try_divide("s", "n").alias("agreement"))


def majority_vote(df: DataFrame, runs, date="date"):
    """Most frequent label per date (smallest on ties) and its share of the runs.

    A run's label is filled forward, then backward, over dates it lacks. The dates are
    filled year by year; what is left before a run's first label takes that label.
    """
    wide = on_dates(df, runs, date)
    first = wide.agg(F.struct(*[F.min_by(F.col(f"`{r}`"), F.when(F.col(f"`{r}`").isNotNull(), F.col(date))).alias(r) for r in runs])).scalar()      # one row
    wide = filled(wide, Axis((), (date,)), runs).withColumn("_first", first)
    wide = wide.withColumns({r: F.coalesce(F.col(f"`{r}`"), F.col("_first")[r]) for r in runs})
    long = wide.select(date, F.explode(F.array(*[F.col(f"`{r}`") for r in runs])).alias("label")).where("label is not null")
    counts = long.groupBy(date, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(date).agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority"),
        F.try_divide(F.max("n"), F.sum("n")).alias("agreement"))


def disagreement(df: DataFrame, classes, by=("date",)):
    """Sample deviation of each class probability across runs."""
    return df.groupBy(*by).agg(*[F.stddev_samp(f"p{c}").alias(f"disagreement_{c}") for c in classes])


# -- spells and events -------------------------------------------------------

def spells(df: DataFrame, label, ax: Axis = RUNS, min_days=1, long_series=False, target_rows=TARGET_ROWS):
    """Maximal runs of equal labels: start, end, rows and calendar days (both ends count)."""
    date = ax.order[0]
    df = df.select(*ax.by, *ax.order, F.col(label).alias("label"))
    target_rows = target_rows if long_series else None

    # a label change is known from the previous row, carried across chunk borders
    def mark(d, a):
        return d.select(*a.keys, "label", R.changed(a, "label").alias("_new"))
    df = by_chunk(df, ax, mark, before=1, target_rows=target_rows)
    lay = lay_out(df, ax, target_rows)
    df = lay.done(running_sum(lay, {"block": F.col("_new")}))
    g = df.groupBy(*ax.by, "block", "label").agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("n_rows"))
    g = g.withColumn("days", F.datediff("end", "start") + 1)
    return g.where((F.col("days") >= min_days) & F.col("label").isNotNull()).drop("block")


def entries(df: DataFrame, label, ax: Axis = RUNS):
    """Rows where a label begins; the first row of a series counts."""
    df = df.select(*ax.by, *ax.order, F.col(label).alias("label"), R.changed(ax, label).alias("_new"))
    return df.where("_new = 1 and label is not null").drop("_new")


def stability(df: DataFrame, label=PRED, ax: Axis = RUNS):
    """Flip rate (the first row counts as a flip) and run lengths in rows."""
    df = df.dropna(subset=[label])
    s = spells(df, label, ax)
    return s.groupBy(*ax.by).agg(
        (F.count(F.lit(1)) / F.sum("n_rows")).alias("flip_rate"), F.avg("n_rows").alias("avg_spell_rows"),
        F.stddev_samp("n_rows").alias("std_spell_rows"), F.min("n_rows").alias("min_spell_rows"),
        F.max("n_rows").alias("max_spell_rows"))


# -- result tables -----------------------------------------------------------

def prune_features(importances: DataFrame, by=("theme",), least_mean=0.0, least_share=0.6):
    """Features whose mean importance and share of positive folds are high enough."""
    g = importances.groupBy(*by, "feature").agg(
        F.avg("importance").alias("mean_importance"),
        F.avg((F.col("importance") > 0).cast("double")).alias("positive_share"))
    return g.where((F.col("mean_importance") > least_mean) & (F.col("positive_share") >= least_share))


def theme_importance(importances: DataFrame):
    g = importances.groupBy("theme").agg(F.sum("importance").alias("importance"))
    return g.withColumn("pct", 100 * F.try_divide(F.col("importance"), F.sum("importance").over(Axis((F.lit(1),)).whole())))


def fold_summary(folds: DataFrame, metrics, by=("theme", "model")):
    """Mean and deviation of fold metrics per run."""
    return folds.groupBy(*by).agg(*[a for m in metrics for a in (
        F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


def ranked(summary: DataFrame, metric, by="theme"):
    """Groups by their mean score, best first; there is one row per group to rank."""
    g = summary.groupBy(by).agg(F.avg(metric).alias("score"))
    return g.withColumn("place", F.row_number().over(Axis((F.lit(1),), (F.desc("score"), by)).base()))


def top_features(importances: DataFrame, n, by=("theme",)):
    """Rows of the n features with the highest mean importance per group."""
    by = list(by)
    means = importances.groupBy(*by, "feature").agg(F.avg("importance").alias("_m"))
    place = F.row_number().over(Axis(tuple(by), (F.desc("_m"), "feature")).base())
    best = means.withColumn("_p", place).where(F.col("_p") <= n).select(*by, "feature")
    return importances.join(best, [*by, "feature"], "left_semi")


def common_dates(frames, date="date"):
    """Dates every frame has."""
    out = frames[0].select(date).distinct()
    for f in frames[1:]:
        out = out.join(f.select(date), date, "left_semi")
    return out
