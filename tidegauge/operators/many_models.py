"""Many logistic models in the same passes over the rows.

A search fits one model for every trial and fold. They share their rows, so a step of all of
them is one pass: every task multiplies its blocks of rows by the weights of all trials of their
fold and sums the gradients; the sums of the tasks are added in two rounds. The driver holds
the weights, which depend on trials, folds, classes and features only, never on rows.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.operators.evaluate import FLOAT_EPSILON, TRUE
from tidegauge.session import scratch

BLOCK_ROWS = 4096
CACHE_ROWS = 256                 # rows whose scores under all trials stay in a core's cache
ROWS_A_TASK = 20_000             # about; fewer rows in all stay as they come
FAN_IN = 64                      # sums of tasks that one task adds


def _pack(n_features):
    def run(batches):
        for batch in batches:
            fold, role = batch.column("fold").to_numpy(), np.array(batch.column("role").to_pylist(), dtype=object)
            label = batch.column(TRUE).to_numpy().astype(np.int64)
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(len(label), n_features)
            for f in np.unique(fold):
                for r in ("train", "test"):
                    rows = np.flatnonzero((fold == f) & (role == r))
                    for a in range(0, len(rows), BLOCK_ROWS):
                        part = rows[a:a + BLOCK_ROWS]
                        yield pa.RecordBatch.from_arrays([pa.array([int(f)]), pa.array([r]), pa.array([len(part)]), pa.array([x[part].tobytes()], pa.binary()),
                                                          pa.array([label[part].tobytes()], pa.binary())], ["fold", "role", "n", "x", "label"])
    return run


def _blocks(batches, n_features):
    for batch in batches:
        for f, n, x, label in zip(*(batch.column(c).to_pylist() for c in ("fold", "n", "x", "label"))):
            yield f, np.frombuffer(x, np.float64).reshape(n, n_features), np.frombuffer(label, np.int64)


def _summed(blocks: DataFrame, one, n_features):
    """Sum over all blocks of the arrays that ``one`` (fold, rows, labels) gives, by fold."""
    def partial(batches):
        total = {}
        for f, x, label in _blocks(batches, n_features):
            got = one(f, x, label)
            total[f] = total[f] + got if f in total else got
        for f, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(f)]), pa.array([t.ravel().tobytes()], pa.binary())], ["fold", "sums"])

    def add(key, table):
        total = sum(np.frombuffer(s, np.float64) for s in table.column("sums").to_pylist())
        return pa.table({"fold": [key[0].as_py()], "sums": pa.array([total.tobytes()], pa.binary())})
    sums = blocks.mapInArrow(partial, "fold long, sums binary")
    near = sums.withColumn("_g", F.floor(F.spark_partition_id() / FAN_IN)).groupBy("fold", "_g").applyInArrow(add, "fold long, sums binary")
    return {r.fold: np.frombuffer(bytes(r.sums), np.float64) for r in near.groupBy("fold").applyInArrow(add, "fold long, sums binary").collect()}


def _softmax(z):
    z = np.exp(z - z.max(axis=2, keepdims=True))
    return z / z.sum(axis=2, keepdims=True)


def _scores(x, centre, scale, w):
    """Probabilities of rows (rows, trials, classes) under weights (trials, features + 1, classes)."""
    z = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], axis=1)
    trials, size, classes = w.shape
    return z, _softmax((z @ w.transpose(1, 0, 2).reshape(size, trials * classes)).reshape(len(x), trials, classes))


def _slope(x, label, centre, scale, w, weight):
    """Gradient of the weighted log-loss for every trial: (features + 1, trials, classes).

    Scores become probabilities some rows at a time, class by class; the products are those of
    whole blocks, so sums do not depend on how many rows that is.
    """
    z = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], axis=1)
    trials, size, classes = w.shape
    flat = w.transpose(1, 0, 2).reshape(size, trials * classes)
    p = (z @ flat).reshape(len(x), trials, classes)
    for a in range(0, len(x), CACHE_ROWS):
        now = label[a:a + CACHE_ROWS]
        by_class = np.ascontiguousarray(p[a:a + CACHE_ROWS].transpose(2, 0, 1))
        by_class -= by_class.max(axis=0)
        np.exp(by_class, out=by_class)
        by_class /= by_class.sum(axis=0)
        by_class[now, np.arange(len(now))] -= 1
        by_class *= weight[now][:, None]
        p[a:a + CACHE_ROWS] = by_class.transpose(1, 2, 0)
    return (z.T @ p.reshape(len(x), -1)).reshape(size, trials, classes)


def search_logistic(folds: DataFrame, features, n_classes, trials, balanced=True):
    """Held-out log-loss of every trial and fold: (trial, fold, log_loss, rows).

    ``folds``: features, ``true_label`` coded 0..k-1, ``fold``, ``role``. ``trials``: dicts with
    ``C``, ``penalty`` (l1 or l2) and ``max_iter``; a trial that is out of range is left out.
    Rows with a null feature or label take no part. Features are standardised by the training
    rows of their fold; classes weigh the same with ``balanced``. Steps are those of
    accelerated proximal gradients, of the length that the fold's Gram matrix allows; the
    intercept is not penalised. A fold without training rows is skipped.
    """
    d = len(features)
    spark = folds.sparkSession
    good = [t for t, p in enumerate(trials) if p.get("C", 1.0) > 0 and p.get("max_iter", 100) >= 0 and p.get("penalty", "l2") in ("l1", "l2")]
    path = scratch(spark, "blocks")
    rows = folds.dropna(subset=[*features, TRUE]).select(F.col("fold").cast("long").alias("fold"), "role", F.col(TRUE).cast("long").alias(TRUE),
                                                         F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    parts = math.ceil(rows.count() / ROWS_A_TASK)
    if parts > 1:                                               # a long series comes in one partition
        rows = rows.repartition(parts)
    rows.mapInArrow(_pack(d), "fold long, role string, n long, x binary, label binary").write.parquet(path)
    blocks = spark.read.parquet(path)
    train, test = blocks.where("role = 'train'"), blocks.where("role = 'test'")

    def shape(f, x, label):
        count = np.bincount(label, minlength=n_classes).astype(float)
        return np.concatenate([[len(x)], count, x.sum(axis=0), (x * x).sum(axis=0)])
    facts = _summed(train, shape, d)
    centre, scale, weight, size = {}, {}, {}, {}
    for f, s in facts.items():
        n, count = s[0], s[1:1 + n_classes]
        mean = s[1 + n_classes:1 + n_classes + d] / n
        spread = np.sqrt(np.maximum((s[1 + n_classes + d:] - n * mean ** 2) / max(n - 1, 1), 0))
        centre[f], scale[f], size[f] = mean, np.where(spread > 0, spread, 1.0), n
        weight[f] = np.where(count > 0, n / (max((count > 0).sum(), 1) * np.maximum(count, 1)), 0) / n if balanced else np.full(n_classes, 1 / n)

    def gram(f, x, label):
        z = np.concatenate([(x - centre[f]) / scale[f], np.ones((len(x), 1))], axis=1) * np.sqrt(weight[f][label])[:, None]
        return z.T @ z
    steps = {f: np.linalg.eigvalsh(g.reshape(d + 1, d + 1))[-1] / 2 for f, g in _summed(train, gram, d).items()}
    ridge = np.array([0.0 if trials[t].get("penalty", "l2") == "l1" else 1.0 / trials[t].get("C", 1.0) for t in good])
    lasso = np.array([1.0 / trials[t].get("C", 1.0) if trials[t].get("penalty", "l2") == "l1" else 0.0 for t in good])
    last = np.array([trials[t].get("max_iter", 100) for t in good])
    w = {f: np.zeros((len(good), d + 1, n_classes)) for f in facts}
    ahead = {f: x.copy() for f, x in w.items()}
    for k in range(int(last.max(initial=0)) if facts else 0):
        live = np.flatnonzero(last > k)

        def slope(f, x, label, now={f: a[live] for f, a in ahead.items()}):
            return _slope(x, label, centre[f], scale[f], now[f], weight[f])
        for f, s in _summed(train, slope, d).items():
            g = s.reshape(d + 1, len(live), n_classes).transpose(1, 0, 2).copy()
            g[:, :d] += (ridge[live] / size[f])[:, None, None] * ahead[f][live][:, :d]
            pace = 1 / (steps[f] + ridge[live] / size[f])[:, None, None]
            new = ahead[f][live] - pace * g
            cut = pace * (lasso[live] / size[f])[:, None, None]
            new[:, :d] = np.sign(new[:, :d]) * np.maximum(np.abs(new[:, :d]) - cut, 0)
            ahead[f][live] = new + k / (k + 3) * (new - w[f][live])
            w[f][live] = new

    def loss(f, x, label):
        if f not in w:
            return np.zeros(len(good) + 1)
        p = _scores(x, centre[f], scale[f], w[f])[1][np.arange(len(x)), :, label]
        return np.concatenate([-np.log(np.clip(p, FLOAT_EPSILON, 1 - FLOAT_EPSILON)).sum(axis=0), [len(x)]])
    found = []
    for f, s in sorted(_summed(test, loss, d).items()):
        if s[-1] and f in w:
            found += [(t, f, float(s[i] / s[-1]), int(s[-1])) for i, t in enumerate(good)]
    return found


def mean_losses(found, trials):
    """Mean of the folds' log-losses for every trial; infinity for one without any."""
    losses = {}
    for t, _, loss, _ in found:
        losses.setdefault(t, []).append(loss)
    return [math.fsum(losses[t]) / len(losses[t]) if t in losses else math.inf for t in range(trials)]
