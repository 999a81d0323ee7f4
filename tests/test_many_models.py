"""Many logistic models in shared passes against independent fits."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import many_models, training as T
from tidegauge.operators.many_models import mean_losses, search_logistic


@pytest.fixture(scope="module")
def folds(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 4)) * [1, 5, 0.1, 1] + [0, 3, 0, 0]
    y = np.argmax(np.stack([x[:, 0], 0.3 * (x[:, 1] - 3), 8 * x[:, 2]], axis=1) + rng.gumbel(size=(240, 3)) * 0.7, axis=1)
    rows = [(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))] + [(900, None, 1.0, 1.0, 1.0, 1), (901, 1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, true_label int")
    each = [df.withColumn("fold", F.lit(f)).withColumn("role", F.when((F.col("i") >= 60 * f) & (F.col("i") < 60 * f + 60), "test").otherwise("train")) for f in (1, 2, 3)]
    return each[0].unionByName(each[1]).unionByName(each[2]).coalesce(2).persist()


NAMES = ["a", "b", "c", "d"]


def slow(folds, f, trial, steps=3000):
    """One model by plain proximal gradient steps of a fixed small length."""
    rows = [r for r in folds.where(F.col("fold") == f).collect() if r.a is not None and r.true_label is not None]
    part = lambda role: (np.array([[r[c] for c in NAMES] for r in rows if r.role == role]), np.array([r.true_label for r in rows if r.role == role]))      # noqa: E731
    (x, y), (xt, yt) = part("train"), part("test")
    mean, std = x.mean(axis=0), x.std(axis=0, ddof=1)
    z, zt = (np.concatenate([(v - mean) / std, np.ones((len(v), 1))], axis=1) for v in (x, xt))
    count = np.bincount(y, minlength=3)
    weight = (len(y) / (3 * count))[y] / len(y)
    w, strength = np.zeros((5, 3)), 1 / trial["C"] / len(y)
    softmax = lambda s: np.exp(s - s.max(1, keepdims=True)) / np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True)       # noqa: E731
    for _ in range(steps):
        g = z.T @ ((softmax(z @ w) - np.eye(3)[y]) * weight[:, None])
        if trial["penalty"] == "l2":
            g[:4] += strength * w[:4]
        w = w - 0.2 * g
        if trial["penalty"] == "l1":
            w[:4] = np.sign(w[:4]) * np.maximum(np.abs(w[:4]) - 0.2 * strength, 0)
    return -np.log(softmax(zt @ w)[np.arange(len(yt)), yt]).mean()


TRIALS = [{"C": 1.0, "penalty": "l2", "max_iter": 50}, {"C": 0.05, "penalty": "l2", "max_iter": 50}, {"C": 0.1, "penalty": "l1", "max_iter": 50}, {"C": 1.0, "penalty": "l2", "max_iter": 0},
          {"C": -1.0, "penalty": "l2", "max_iter": 5}]


def test_losses_of_independent_fits(folds):
    got = {(t, f): (loss, n) for t, f, loss, n in search_logistic(folds, NAMES, 3, TRIALS)}
    assert set(got) == {(t, f) for t in range(4) for f in (1, 2, 3)} and all(n == 60 for _, n in got.values())
    for t, f in ((0, 1), (0, 3), (1, 2), (2, 1), (2, 2)):
        assert got[t, f][0] == pytest.approx(slow(folds, f, TRIALS[t]), abs=3e-3)
    assert got[3, 1][0] == pytest.approx(math.log(3))
    means = mean_losses([(t, f, *v) for (t, f), v in got.items()], 5)
    assert means[4] == math.inf and means[0] < means[3]


def test_blocks_do_not_matter(folds, monkeypatch):
    few = [{**t, "max_iter": 4} for t in TRIALS[:2]]
    want = search_logistic(folds, NAMES, 3, few)
    monkeypatch.setattr(many_models, "BLOCK_ROWS", 7)
    monkeypatch.setattr(many_models, "FAN_IN", 2)
    for a, b in zip(want, search_logistic(folds.repartition(11), NAMES, 3, few)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)


def test_close_to_the_library(folds):
    clean = folds.dropna()
    from tidegauge.operators import evaluate as E
    oof, _ = T.cross_validate(clean, NAMES, 3, "logistic", {"C": 1.0}, keys=("i",))
    want = E.log_loss(oof, range(3), ("fold",)).agg(F.avg("log_loss")).first()[0]
    assert mean_losses(search_logistic(clean, NAMES, 3, [{**TRIALS[0], "max_iter": 25}]), 1)[0] == pytest.approx(want, abs=0.02)


def test_no_rows(folds):
    assert search_logistic(folds.limit(0), NAMES, 3, TRIALS) == []


def test_gradients_class_by_class_are_those_of_whole_blocks():
    import numpy as np
    from tidegauge.operators import many_models as M
    rng = np.random.default_rng(4)
    x, label, w, weight = rng.normal(size=(601, 7)), rng.integers(0, 3, 601), rng.normal(size=(5, 8, 3)), np.array([.2, .5, .3])
    z, p = M._scores(x, 0.1, 1.5, w)
    p[np.arange(601), :, label] -= 1
    p *= weight[label][:, None, None]
    want = (z.T @ p.reshape(601, -1)).reshape(8, 5, 3)
    assert np.array_equal(M._slope(x, label, 0.1, 1.5, w, weight), want)


def test_rows_of_one_partition_are_dealt_out(spark, monkeypatch):
    """A long series comes in one partition: its blocks go to several files, with the same losses."""
    from pyspark.sql import functions as F
    from tidegauge.operators import many_models as M
    rows = spark.range(0, 900, 1, 1).select((F.col("id") % 3).alias("true_label"), F.lit(1).alias("fold"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("role"),
                                            ((F.col("id") % 3) + (F.col("id") * 7919 % 101) / 40).alias("a"), ((F.col("id") * 31 % 17) / 9).alias("b"))
    trials = [{"C": 1.0, "max_iter": 5}, {"C": 0.1, "penalty": "l1", "max_iter": 3}]
    one, paths = M.search_logistic(rows, ["a", "b"], 3, trials), []
    scratch = M.scratch
    monkeypatch.setattr(M, "scratch", lambda *a: paths.append(scratch(*a)) or paths[-1])
    monkeypatch.setattr(M, "ROWS_A_TASK", 200)
    many = M.search_logistic(rows, ["a", "b"], 3, trials)
    assert len(spark.read.parquet(paths[0]).inputFiles()) == 5
    assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in many]
    assert max(abs(a[2] - b[2]) for a, b in zip(one, many)) < 1e-9
