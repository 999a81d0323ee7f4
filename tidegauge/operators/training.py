"""Classifiers under time-ordered folds, importances, search and stacking.

Every fit is a distributed Spark ML job; the driver only loops over folds, trials
and themes, of which there are few.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.functions.scalars import clip, logit
from tidegauge.operators import evaluate as E
from tidegauge.operators.axis import Axis
from tidegauge.operators.chunks import filled
from tidegauge.operators.many_models import mean_losses, search_logistic
from tidegauge.operators.splits import class_weights

FEATURES, WEIGHT = "features", "weight"
ROWS_A_TASK = 20_000             # training rows of a linear model in one task, about


# -- models ------------------------------------------------------------------

def logistic(params=None, rows=None):
    """Standardised logistic regression. ``C`` follows the usual inverse strength."""
    p = dict(params or {})
    strength = p.pop("C", 1.0)
    penalty = p.pop("penalty", "l2")
    est = LogisticRegression(featuresCol="scaled", labelCol=E.TRUE, weightCol=WEIGHT, family="multinomial",
                             elasticNetParam=1.0 if penalty == "l1" else 0.0,
                             regParam=1.0 / (strength * max(rows or 1, 1)), maxIter=p.pop("max_iter", 100), **p)
    return [StandardScaler(inputCol=FEATURES, outputCol="scaled", withMean=True), est]


def forest(params=None, rows=None):
    p = {"numTrees": 50, "maxDepth": 5, "seed": 42, **(params or {})}
    return [RandomForestClassifier(featuresCol=FEATURES, labelCol=E.TRUE, weightCol=WEIGHT, **p)]


def boosted(params=None, rows=None):
    """Boosted trees, one against the rest."""
    p = {"maxIter": 20, "maxDepth": 3, "seed": 42, **(params or {})}
    inner = GBTClassifier(featuresCol=FEATURES, labelCol=E.TRUE, **p)
    return [OneVsRest(classifier=inner, featuresCol=FEATURES, labelCol=E.TRUE, weightCol=WEIGHT)]


MODELS = {"logistic": logistic, "forest": forest, "boosted": boosted}


def vectors(df: DataFrame, features):
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES).transform(df)


def with_weights(df: DataFrame, balanced=True):
    if not balanced:
        return df.withColumn(WEIGHT, F.lit(1.0))
    return df.join(F.broadcast(class_weights(df, E.TRUE)), E.TRUE)      # one row per class


def fit(train: DataFrame, model="logistic", params=None, balanced=True) -> PipelineModel:
    """``train`` has ``features`` and ``true_label`` coded 0..k-1.

    A long series comes in one partition. Linear models get it dealt out; forests draw their
    rows by partition, so theirs stay.
    """
    train = rows = with_weights(train, balanced).persist()   # read once per iteration
    try:
        n = train.count()
        if model == "logistic" and n > ROWS_A_TASK:
            rows = train.repartition(math.ceil(n / ROWS_A_TASK)).persist()
        return Pipeline(stages=MODELS[model](params, n)).fit(rows)
    finally:
        rows.unpersist()
        train.unpersist()


def score(model: PipelineModel, df: DataFrame, n_classes):
    """Predicted label and ``p0..pk``; a class the model never saw gets 0."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:                                                # one-vs-rest gives margins only
        raw = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
        p = F.transform(raw, lambda v: F.try_divide(v, total))
    out = out.withColumn("_p", p)
    cols = {f"p{c}": F.coalesce(F.get("_p", F.lit(c)), F.lit(0.0)) for c in range(n_classes)}
    return out.withColumn(E.PRED, F.col("prediction").cast("int")).withColumns(cols) \
              .drop("_p", "prediction", "probability", "rawPrediction", "scaled")


def importances(model: PipelineModel, features):
    """Per feature: tree importances, or the norm of a linear model's coefficients."""
    m = model.stages[-1]
    if hasattr(m, "coefficientMatrix"):
        w = np.abs(m.coefficientMatrix.toArray())
        values = np.sqrt((w ** 2).sum(0))
    elif hasattr(m, "featureImportances"):
        values = m.featureImportances.toArray()
    else:
        values = np.mean([c.featureImportances.toArray() for c in m.models], axis=0)
    return dict(zip(features, map(float, values)))


def fit_and_save(df: DataFrame, features, path, model="logistic", params=None):
    fitted = fit(vectors(df, features), model, params)
    fitted.write().overwrite().save(path)
    return fitted


# -- cross-validation --------------------------------------------------------

def cross_validate(folds: DataFrame, features, n_classes, model="logistic", params=None, run=None, keys=("date",), balanced=True):
    """Out-of-fold predictions, and per fold the fitted model and its test rows.

    ``folds``: keys, features, ``true_label``, ``fold``, ``role``. Folds without
    training rows are skipped.
    """
    data = vectors(folds, features)
    parts, fitted = [], []
    for f in sorted(r[0] for r in folds.where("role = 'train'").select("fold").distinct().collect()):
        mine = data.where(F.col("fold") == f)
        m = fit(mine.where("role = 'train'"), model, params, balanced)
        test = mine.where("role = 'test'")
        out = score(m, test, n_classes)
        parts.append(out.select(F.lit(run or model).alias("run"), *keys, "fold", E.TRUE, E.PRED, *[f"p{c}" for c in range(n_classes)]))
        fitted.append((f, m, test))
    return reduce(DataFrame.unionByName, parts), fitted


def fold_scores(oof: DataFrame, n_classes, by=("run", "fold")):
    """Label and probability scores per run and fold."""
    classes = list(range(n_classes))
    out = E.label_scores(oof, classes, by=by).join(E.log_loss(oof, classes, by), list(by))
    return out.join(E.macro_auc(E.auc(oof, classes, by), by), list(by))


# -- permutation importance --------------------------------------------------

def donors(df: DataFrame, keys, seed, rows_per_bucket=5000, n=None):
    """Give every row another row's features: a seeded permutation of the rows.

    Rows are hashed into buckets of some thousand; within a bucket, in hash order,
    each takes the row before it and the first takes the last. No task sorts the whole.
    """
    n = df.count() if n is None else n
    h = F.xxhash64(*keys, F.lit(seed))
    df = df.withColumn("_h", h).withColumn("_b", F.pmod(F.xxhash64("_h", F.lit("bucket")), F.lit(max(1, n // rows_per_bucket))))
    ax = Axis(("_b",), ("_h", *keys))
    around = F.last(FEATURES).over(ax.base().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("_donor", F.coalesce(F.lag(FEATURES).over(ax.base()), around)).drop("_h", "_b")


def permutation_importance(model: PipelineModel, test: DataFrame, features, n_classes, keys=("date",), repeats=5, seed=42):
    """Mean rise of the log-loss when one feature is permuted, averaged over repeats.

    All features and repeats are scored in one plan: every test row appears once per
    feature, with that entry of its vector taken from its donor.
    """
    classes = list(range(n_classes))
    base = E.log_loss(score(model, test, n_classes).withColumn("run", F.lit("base")), classes).select("log_loss")
    parts, n = [], test.count()
    for r in range(repeats):
        d = donors(test, keys, seed + r, n=n)
        own, other = vector_to_array(FEATURES), vector_to_array("_donor")
        rows = d.withColumns({"_o": own, "_d": other}).select(
            *keys, E.TRUE, "_o", "_d", F.posexplode(F.array(*[F.lit(f) for f in features])).alias("_i", "feature"))
        swapped = F.transform("_o", lambda v, i: F.when(i == F.col("_i"), F.element_at("_d", i + 1)).otherwise(v))
        parts.append(rows.select("feature", E.TRUE, array_to_vector(swapped).alias(FEATURES), F.lit(r).alias("repeat")))
    scored = score(model, reduce(DataFrame.unionByName, parts), n_classes)
    loss = E.log_loss(scored, classes, ("feature", "repeat")).groupBy("feature").agg(F.avg("log_loss").alias("_l"))
    return loss.select("feature", (F.col("_l") - base.scalar()).alias("importance"))


def cv_importance(fitted, features, n_classes, keys=("date",), repeats=5, seed=42):
    parts = [permutation_importance(m, test, features, n_classes, keys, repeats, seed).withColumn("fold", F.lit(f))
             for f, m, test in fitted]
    return reduce(DataFrame.unionByName, parts)


# -- search ------------------------------------------------------------------

def draw(space: dict, trials, seed=42):
    """Parameter sets from ``name -> {type, low, high, log, step | choices}``."""
    rng = np.random.default_rng(seed)

    def one(s):
        if s["type"] == "categorical":
            return s["choices"][int(rng.integers(len(s["choices"])))]
        if s["type"] == "int":
            step = s.get("step", 1)
            return int(s["low"] + step * rng.integers((s["high"] - s["low"]) // step + 1))
        if s.get("log"):
            return float(math.exp(rng.uniform(math.log(s["low"]), math.log(s["high"]))))
        return float(rng.uniform(s["low"], s["high"]))
    return [{n: one(s) for n, s in space.items()} for _ in range(trials)]


def random_search(folds: DataFrame, features, n_classes, space, trials=50, model="logistic", seed=42, keys=("date",)):
    """Trials ranked by mean log-loss over folds; one with refused parameters scores infinity.

    Logistic trials of all folds are fitted in the same passes (see ``many_models``); trees of
    one trial and fold after the other.
    """
    rows, sets = [], draw(space, trials, seed)
    if model == "logistic":
        losses = mean_losses(search_logistic(folds, features, n_classes, sets), trials)
        return _ranked(folds.sparkSession, [(i, p, loss) for i, (p, loss) in enumerate(zip(sets, losses))])
    folds = folds.persist()                                 # read by every trial
    for i, params in enumerate(sets):
        try:
            oof, _ = cross_validate(folds, features, n_classes, model, params, keys=keys)
            loss = E.log_loss(oof, range(n_classes), ("fold",)).agg(F.avg("log_loss")).first()[0]
        except IllegalArgumentException:                    # parameters that Spark refuses
            loss = None
        rows.append((i, params, math.inf if loss is None else loss))
    folds.unpersist()
    return _ranked(folds.sparkSession, rows)


def _ranked(spark, rows):
    rows = [(p + 1, i, {k: str(v) for k, v in params.items()}, loss) for p, (i, params, loss) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))]
    return spark.createDataFrame(rows, "place int, trial int, params map<string,string>, mean_log_loss double")


def incremental_themes(folds: DataFrame, ranked_themes, theme_features: dict, n_classes, current=None, model="logistic", params=None, keys=("date",)):
    """Scores with the features of the best n themes, n = 2, 3, ...; optionally with the current label."""
    parts = []
    for n in range(2, len(ranked_themes) + 1):
        cols = [f for t in ranked_themes[:n] for f in theme_features[t]] + ([current] if current else [])
        oof, _ = cross_validate(folds, cols, n_classes, model, params, f"top{n}", keys)
        parts.append(E.label_scores(oof, list(range(n_classes))).join(E.log_loss(oof, range(n_classes)), "run").withColumn("n_themes", F.lit(n)))
    return reduce(DataFrame.unionByName, parts)


# -- stacking ----------------------------------------------------------------

def stacking_features(predictions: DataFrame, runs, classes, context: DataFrame, fill, target, with_disagreement=True, date="date"):
    """Logits of every run and class by date, disagreement, context columns, target.

    ``context``: one row per date. Its ``fill`` columns are filled forward over the
    dates with predictions; incomplete rows are dropped.
    """
    wide = predictions.groupBy(date).agg(*[
        F.max(F.when(F.col("run") == r, logit(f"p{c}"))).alias(f"logit_proba_{r}_regime_{c}") for r in runs for c in classes])
    if with_disagreement:
        clipped = predictions.select(date, *[clip(f"p{c}").alias(f"p{c}") for c in classes])
        wide = wide.join(E.disagreement(clipped, classes, (date,)), date)
    df = filled(wide.join(context, date, "left"), Axis((), (date,)), fill)       # one row per date
    return df.dropna(subset=[c for c in df.columns if c != date] + [target])
