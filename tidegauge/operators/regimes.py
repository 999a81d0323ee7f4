"""Market regimes: hidden Markov labels, their stability, clustering alternatives."""
from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import rolling as R
from tidegauge.operators.axis import DAILY, Axis
from tidegauge.session import persist_plan


def performance(df: DataFrame, state, price, ax: Axis = DAILY, by=()):
    """Return statistics by state, also annualised over 252 days."""
    df = df.withColumn("_r", R.change(ax, price, 1)).where("_r is not null")
    m, s = F.avg("_r"), F.stddev_samp("_r")
    return df.groupBy(*by, state).agg(
        F.count("_r").alias("n"), m.alias("mean_daily"), s.alias("std_daily"),
        (m * R.TRADING_DAYS).alias("mean_annual"), (s * R.TRADING_DAYS ** 0.5).alias("std_annual"))


# -- hidden Markov labels ----------------------------------------------------
# One task fits one (series, seed, number of states): expectation-maximisation needs
# the series in order, many times over. A daily series has 366 rows a year, and the
# many series, seeds and sizes run side by side.

FIT_SCHEMA = """dates array<date>, states array<int>, means array<array<double>>,
 variances array<array<double>>, transitions array<array<double>>, start array<double>, centre array<double>,
 scale array<double>, log_likelihood double, n_iter int"""


def fit_hidden_markov(df: DataFrame, features, ax: Axis = DAILY, states=(3,), seeds=(42,), drop_last=(0,),
                      max_iter=100, tolerance=1e-2, plans=None):
    """One row per series, number of states, seed and number of last rows left out.

    ``plans`` lists (states, seed, rows left out) to fit instead of all combinations.

    Features are standardised per series; means and variances are in those units,
    ``centre`` and ``scale`` lead back. ``states[i]`` is the decoded state of ``dates[i]``.
    """
    features, date = list(features), ax.order[0]
    plans = plans or [(k, s, d) for k in states for s in seeds for d in drop_last]
    runs = F.explode(F.array(*[F.struct(F.lit(k).alias("n_states"), F.lit(s).alias("seed"), F.lit(d).alias("drop_last"))
                               for k, s, d in plans])).alias("_run")
    rows = df.dropna(subset=features).select(*ax.by, date, *features, runs).select(*ax.by, date, *features, "_run.*")
    group = [*ax.by, "n_states", "seed", "drop_last"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in group) + ", " + FIT_SCHEMA

    def fit(key, pdf):
        k, seed, out = (int(v) for v in key[-3:])
        pdf = pdf.sort_values(date)
        pdf = pdf.iloc[:max(len(pdf) - out, 0)]
        x = pdf[features].to_numpy("float64")
        columns = [*group, "dates", "states", "means", "variances", "transitions", "start", "centre", "scale",
                   "log_likelihood", "n_iter"]
        if len(x) <= k:                                         # no rows to fit to: the series comes back without states
            return pd.DataFrame([[*key, list(pdf[date]), [None] * len(x), None, None, None, None, None, None, None, 0]], columns=columns)
        centre, scale = x.mean(0), x.std(0)
        scale[scale == 0] = 1.0
        z = (x - centre) / scale
        start, trans, means, var, ll, n = _expectation_maximisation(z, k, seed, max_iter, tolerance)
        path = _most_likely_path(_densities(z, means, var), start, trans)
        row = [*key, list(pdf[date]), path.tolist(), means.tolist(), var.tolist(), trans.tolist(), start.tolist(),
               centre.tolist(), scale.tolist(), float(ll), n]
        return pd.DataFrame([row], columns=columns)

    return rows.groupBy(*group).applyInPandas(fit, schema)


def _densities(x, means, var):
    """Log density of every row under every state's diagonal normal."""
    d = x[:, None, :] - means[None]
    return -0.5 * (np.log(2 * np.pi * var)[None] + d * d / var[None]).sum(2)


def _seed_means(x, k, rng, rounds=10):
    """A few rounds of k-means from random rows."""
    means = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([x[near == j].mean(0) if (near == j).any() else means[j] for j in range(k)])
    return means


def _expectation_maximisation(x, k, seed, max_iter, tolerance, floor=1e-3):
    rng = np.random.default_rng(seed)
    means, var = _seed_means(x, k, rng), np.tile(x.var(0) + floor, (k, 1))
    start, trans = np.full(k, 1 / k), np.full((k, k), 1 / k)
    before = -np.inf
    for n in range(1, max_iter + 1):
        log_b = _densities(x, means, var)
        peak = log_b.max(1)
        b = np.exp(log_b - peak[:, None])
        a = _messages(start * b[0], trans[None] * b[:, None, :])         # forward, each row scaled to sum 1
        c = np.concatenate([[(start * b[0]).sum()], ((a[:-1] @ trans) * b[1:]).sum(1)])
        back = _messages(np.ones(k), (trans[None] * b[:, None, :]).transpose(0, 2, 1)[:0:-1], first=False)
        beta = np.concatenate([back[::-1], np.full((1, k), 1 / k)])
        post = a * beta
        post /= post.sum(1, keepdims=True)
        ahead = b[1:] * beta[1:]
        moves = trans * ((a[:-1] / ((a[:-1] @ trans) * ahead).sum(1)[:, None]).T @ ahead)
        start = post[0] / post[0].sum()
        trans = np.where(moves.sum(1, keepdims=True) > 0, moves / np.maximum(moves.sum(1, keepdims=True), 1e-300), trans)
        weight = post.sum(0)[:, None] + 1e-300
        means = post.T @ x / weight
        var = np.maximum(post.T @ (x * x) / weight - means ** 2, 0) + floor
        ll = (np.log(c) + peak).sum()
        if ll - before < tolerance:
            break
        before = ll
    return start, trans, means, var, ll, n


def _messages(v, steps, first=True):
    """Row vectors ``v``, v @ steps[1], v @ steps[1] @ steps[2], ..., each scaled to sum 1.

    With ``first=False`` the first one out is v @ steps[0]. Steps are multiplied up in all
    blocks of about the root of their number side by side; then only the vectors between
    blocks follow one another.
    """
    if first:
        steps = steps[1:]
    n, k = len(steps), len(v)
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(k), (blocks * size - n, k, k))]).reshape(blocks, size, k, k)
    upto = np.empty_like(padded)
    now = np.broadcast_to(np.eye(k), (blocks, k, k))
    for j in range(size):
        now = now @ padded[:, j]
        now = now / now.max(axis=(1, 2), keepdims=True)
        upto[:, j] = now
    starts = np.empty((blocks, k))
    at = v / v.sum()
    for i in range(blocks):
        starts[i] = at
        at = at @ upto[i, -1]
        at = at / at.sum()
    out = np.einsum("bi,bsij->bsj", starts, upto).reshape(blocks * size, k)[:n]
    out /= out.sum(1, keepdims=True)
    return np.concatenate([[v / v.sum()], out]) if first else out


def _most_likely_path(log_b, start, trans):
    log_t = np.log(trans + 1e-300)
    score = np.log(start + 1e-300) + log_b[0]
    back = np.zeros(log_b.shape, dtype=int)
    for t in range(1, len(log_b)):
        options = score[:, None] + log_t
        back[t] = options.argmax(0)
        score = options.max(0) + log_b[t]
    path = np.empty(len(log_b), dtype=int)
    path[-1] = score.argmax()
    for t in range(len(log_b) - 2, -1, -1):
        path[t] = back[t + 1, path[t + 1]]
    return path


RUN = ("n_states", "seed", "drop_last")


def decoded(fits: DataFrame, ax: Axis = DAILY, smoothing=None):
    """One row per run and date; ``state_smoothed`` is a centred rolling mode."""
    keys = [*ax.by, *RUN]
    rows = fits.select(*keys, F.explode(F.arrays_zip("dates", "states")).alias("_r")) \
               .select(*keys, F.col("_r.dates").alias(ax.order[0]), F.col("_r.states").alias("state_raw"))
    if smoothing is None:
        return rows
    return rows.withColumn("state_smoothed", R.smoothed_state(Axis(tuple(keys), ax.order), "state_raw", smoothing))


def state_summary(fits: DataFrame, features, ax: Axis = DAILY):
    """Mean and deviation per state and feature in original units, and transition rows."""
    keys = [*ax.by, *RUN]
    each = F.explode(F.sequence(F.lit(0), F.col("n_states") - 1)).alias("state")
    df = fits.select(*keys, "means", "variances", "centre", "scale", "transitions", each)

    def at(col, j=None):
        row = F.get(col, F.col("state"))
        return row if j is None else F.get(row, F.lit(j))
    cols = []
    for j, f in enumerate(features):
        c, s = F.get("centre", F.lit(j)), F.get("scale", F.lit(j))
        cols += [(at("means", j) * s + c).alias(f"{f}_mean"), (F.sqrt(at("variances", j)) * s).alias(f"{f}_std")]
    return df.select(*keys, "state", *cols, at("transitions").alias("transition_row"))


def information_criteria(fits: DataFrame, n_features, ax: Axis = DAILY):
    """AIC and BIC of each number of states."""
    k = F.col("n_states")
    params = k * (k - 1) + (k - 1) + 2 * k * n_features
    return fits.select(*ax.by, *RUN, "log_likelihood", (2 * params - 2 * F.col("log_likelihood")).alias("aic"),
                       (params * F.ln(F.size("dates")) - 2 * F.col("log_likelihood")).alias("bic"))


# -- stability ---------------------------------------------------------------

def state_mapping(means: DataFrame, reference, run="run", by=("series_id",), k=3):
    """Which state of each run is which state of the reference run.

    ``means``: by, run, ``means`` (one array of feature means per state). The mapping
    is the assignment with the least total distance; the k! assignments are a constant.
    """
    by = list(by)
    ref = means.where(F.col(run) == reference).select(*by, F.col("means").alias("_ref"))
    df = means.join(ref, by)
    orders = F.array(*[F.array(*[F.lit(i) for i in p]) for p in permutations(range(k))])

    def distance(i, p):
        a, b = F.get("_ref", i), F.get("means", F.get(p, i))
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))

    def cost(p):
        return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, i: s + distance(i, p))
    best = F.array_min(F.transform(orders, lambda p: F.struct(cost(p).alias("cost"), p.alias("order"))))
    return df.select(*by, run, best["order"].alias("order"), best["cost"].alias("cost"))


def remapped(states: DataFrame, mapping: DataFrame, run="run", by=("series_id",), state="state"):
    """States renumbered as in the reference run. ``mapping`` has one row per run."""
    df = states.join(mapping.select(*by, run, "order"), [*by, run])
    return df.withColumn(state, (F.array_position("order", F.col(state)) - 1).cast("int")).drop("order")


def agreement_with(states: DataFrame, reference, run="run", by=("series_id",), state="state", date="date"):
    """Share of dates on which each run agrees with the reference run."""
    ref = states.where(F.col(run) == reference).select(*by, date, F.col(state).alias("_ref"))
    df = states.where(F.col(run) != reference).join(ref, [*by, date])
    return df.groupBy(*by, run).agg(F.avg((F.col(state) == F.col("_ref")).cast("double")).alias("agreement"))


def label_distribution(states: DataFrame, by=("series_id",), state="state", date="date"):
    """Share of the runs in each state, by date."""
    n = states.groupBy(*by, date, state).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Axis((*by, date)).whole()))


def label_stability(df: DataFrame, features, ax: Axis = DAILY, states=3, seeds=range(0, 420, 42), seed=42, drop_last=(), smoothing=50, **fit):
    """Agreement of labelings in two experiments: by, experiment, seed, drop_last, agreement.

    ``seeds``: fits to all rows, each compared with the first. ``truncation``: fits with
    ``seed`` to all but so many last rows, each compared with the fit to all of them. A run
    both experiments need is fitted once, and the fits are written before they are read.
    A series without a fit to either side has no row.
    """
    runs = {"seeds": [(states, s, 0) for s in seeds], "truncation": [(states, seed, d) for d in (0, *drop_last)]}
    fits = persist_plan(fit_hidden_markov(df, features, ax=ax, plans=list(dict.fromkeys(sum(runs.values(), []))), **fit))
    by, out = list(ax.by), []
    for name, plans in runs.items():
        run = F.concat_ws("_", "seed", "drop_last").alias("run")
        reference = f"{plans[0][1]}_{plans[0][2]}"
        own = fits.join(F.broadcast(fits.sparkSession.createDataFrame(plans, "n_states int, seed int, drop_last int")),      # the runs of one experiment
                        ["n_states", "seed", "drop_last"]).withColumn("run", run)
        mapping = state_mapping(own.where("means is not null").select(*by, "run", "means"), reference, by=by, k=states)
        rows = decoded(own, ax, smoothing).select(*by, run, ax.order[0], F.col("state_smoothed").alias("state"))
        found = agreement_with(remapped(rows, mapping, by=by), reference, by=by, date=ax.order[0])
        place = F.split("run", "_")
        out.append(found.select(*by, F.lit(name).alias("experiment"), place[0].cast("int").alias("seed"), place[1].cast("int").alias("drop_last"), "agreement"))
    return out[0].unionByName(out[1])


# -- clustering --------------------------------------------------------------

def _scaled(df, features):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    rows = df.dropna(subset=list(features))
    return Pipeline(stages=stages).fit(rows).transform(rows).drop("_raw")


def kmeans_sizes(df: DataFrame, features, sizes=range(2, 8), seed=42):
    """Inertia and silhouette for each number of clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    x, out = _scaled(df, features).persist(), []            # read once per iteration
    for k in sizes:
        model = KMeans(k=k, seed=seed).fit(x)
        out.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(x)))))
    x.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double")


def kmeans_states(df: DataFrame, features, k=3, seed=42):
    from pyspark.ml.clustering import KMeans
    x = _scaled(df, features)
    return KMeans(k=k, seed=seed, predictionCol="state").fit(x).transform(x).drop("features")


def cluster_summary(labelled: DataFrame, features, state="state"):
    return labelled.groupBy(state).agg(F.count(F.lit(1)).alias("n"), *[
        a for f in features for a in (F.avg(f).alias(f"{f}_mean"), F.stddev_samp(f).alias(f"{f}_std"))])


def mixture_sizes(df: DataFrame, features, sizes=range(2, 6), seed=42):
    """AIC and BIC of Gaussian mixtures: regimes without memory, fitted on all rows at once."""
    from pyspark.ml.clustering import GaussianMixture
    x, d, out = _scaled(df, features).persist(), len(list(features)), []
    n = x.count()
    for k in sizes:
        ll = float(GaussianMixture(k=k, seed=seed).fit(x).summary.logLikelihood)
        params = (k - 1) + k * d + k * d * (d + 1) // 2
        out.append((k, ll, 2 * params - 2 * ll, params * float(np.log(n)) - 2 * ll))
    x.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, log_likelihood double, aic double, bic double")
