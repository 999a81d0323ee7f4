"""Greedy matching against brute force; statistics and models on data with known answers."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import evaluate as E, matching as X, profile as Q, regimes as G, selection as S, splits as P, training as T
from tidegauge.operators.axis import DAILY

DAY0 = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(3)
    rows = []
    for run, sticky in (("x", 0.6), ("y", 0.9)):
        t = p = 0
        for i in range(400):
            t = t if rng.random() < sticky else rng.randrange(3)
            p = t if rng.random() < 0.7 else p
            rows.append((run, DAY0 + dt.timedelta(days=i), t, p))
    return spark.createDataFrame(rows, "run string, date date, true_label int, predicted_label int").persist()


def labels(predictions, run):
    rows = [r for r in predictions.orderBy("date").collect() if r.run == run]
    return [r.date for r in rows], [r.true_label for r in rows], [r.predicted_label for r in rows]


def starts(dates, y, c):
    return [d for i, d in enumerate(dates) if y[i] == c and (i == 0 or y[i - 1] != c)]


def runs_of(dates, y, c, least):
    out, i = [], 0
    while i < len(y):
        j = i
        while j + 1 < len(y) and y[j + 1] == y[i]:
            j += 1
        if y[i] == c and (dates[j] - dates[i]).days + 1 >= least:
            out.append((dates[i], dates[j]))
        i = j + 1
    return out


@pytest.fixture(scope="module")
def dense(spark):
    """Labels that change nearly every day for years, so that what is taken is handed on all the way."""
    rng = random.Random(9)
    rows = []
    for run in ("x", "y", None):
        t, p, day = 0, 0, DAY0 - dt.timedelta(days=40)
        for i in range(900):
            t = int(t == 0) if rng.random() < 0.95 else rng.randrange(3)
            p = (int(p == 0) if rng.random() < 0.7 else p) if i % 300 > 30 else t
            rows.append((run, day, t, p))
            day += dt.timedelta(days=1 if rng.random() < 0.97 else rng.randint(2, 90))
    return spark.createDataFrame(rows, "run string, date date, true_label int, predicted_label int").persist()


@pytest.mark.parametrize("frame", ["predictions", "dense"])
def test_entries_match_as_by_hand(frame, request):
    predictions = request.getfixturevalue(frame)
    got = {(r.run, r.label, r.true_date): r.pred_date for r in X.match_entries(predictions).collect()}
    want = {}
    for run in ("x", "y") if frame == "predictions" else ("x", "y", None):
        dates, t, p = labels(predictions, run)
        for c in range(3):
            free = starts(dates, p, c)
            for a in starts(dates, t, c):
                near = [b for b in free if -5 <= (b - a).days <= 10]
                if near:
                    b = min(near, key=lambda b: (abs((b - a).days), b))
                    free.remove(b)
                    want[(run, c, a)] = b
    assert got == want


def test_wide_windows_are_refused(predictions):
    with pytest.raises(ValueError):
        X.match_entries(predictions, early=20, late=20)


@pytest.mark.parametrize("frame, least, rows", [("predictions", 2, None), ("predictions", 1, 20), ("dense", 1, None), ("dense", 1, 30)])
def test_spells_match_as_by_hand(frame, least, rows, request):
    predictions = request.getfixturevalue(frame).where("run is not null")
    got = {(r.run, r.label, r.true_start): (r.pred_start, r.pred_end) for r in X.match_spells(predictions, min_days=least, target_rows=rows).collect()}
    want = {}
    for run in ("x", "y"):
        dates, t, p = labels(predictions, run)
        for c in range(3):
            free = runs_of(dates, p, c, least)
            for a in runs_of(dates, t, c, least):
                best, pick = 0, None
                for b in free:
                    shared = (min(a[1], b[1]) - max(a[0], b[0])).days + 1
                    if shared > best:
                        best, pick = shared, b
                if pick:
                    free.remove(pick)
                    want[(run, c, a[0])] = pick
    assert got == want


def test_scores_of_a_class_without_events(predictions):
    r = X.entry_scores(predictions, [0, 1, 2, 9]).where("label = 9").first()
    assert (r.n_true, r.n_pred, r.n_hit, r.precision, r.recall, r.f1, r.mean_lag_days) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    assert X.spell_scores(predictions, [0, 9]).where("label = 9").first().n_hit == 0


def test_auc_by_pairs(spark):
    rng = random.Random(1)
    rows = [("r", rng.randrange(2), round(rng.random(), 1)) for _ in range(120)]
    df = spark.createDataFrame([(r, t, 1 - p, p) for r, t, p in rows], "run string, true_label int, p0 double, p1 double")
    pos, neg = [p for _, t, p in rows if t], [p for _, t, p in rows if not t]
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])
    for size in (3, 1000):
        got = {r.label: r.auc for r in E.auc(df, (0, 1), target_rows=size).collect()}
        assert got[1] == pytest.approx(want) and got[0] == pytest.approx(want)


def test_purge_and_embargo(spark):
    df = spark.createDataFrame([("s", DAY0 + dt.timedelta(days=i)) for i in range(11)], "series_id string, date date")
    def of(rows, fold, role):
        return sorted((r.date - DAY0).days for r in rows if r.fold == fold and r.role == role)
    rows = P.purged_folds(df, k=3, purge=2).collect()
    assert of(rows, 1, "test") == [0, 1, 2, 3] and of(rows, 2, "test") == [4, 5, 6, 7] and of(rows, 3, "test") == [8, 9, 10]
    assert of(rows, 1, "train") == [] and of(rows, 2, "train") == [0, 1] and of(rows, 3, "train") == list(range(6))
    assert of(P.purged_folds(df, k=3, purge=2, embargo=1).collect(), 1, "train") == list(range(5, 11))


def test_moments_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 3, (300, 3))
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double")
    for r in Q.moments(df, ["a", "b", "c"]).collect():
        i, j = "abc".index(r.a), "abc".index(r.b)
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r.n == ok.sum()
        assert r.correlation == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-9)


def test_unit_root_tests_tell_walk_from_noise():
    rng = np.random.default_rng(5)
    noise, walk = rng.normal(size=500), rng.normal(size=500).cumsum()
    assert S.adf_test(noise)[1] < 0.01 and S.adf_test(walk)[1] > 0.05
    assert not S.kpss_test(noise)[4] and S.kpss_test(noise)[1] >= 0.05 and S.kpss_test(walk)[1] < 0.05


def test_adf_p_value_at_its_critical_values():
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert S._adf_p(stat) == pytest.approx(p, abs=0.002)


def test_hidden_markov_finds_planted_regimes(spark):
    rng = np.random.default_rng(2)
    truth = np.repeat([0, 1, 2, 0, 2], 60)
    x = np.array([-3.0, 0.0, 3.0])[truth] + rng.normal(0, 0.5, len(truth))
    df = spark.createDataFrame([("s", DAY0 + dt.timedelta(days=i), float(v), float(v * v)) for i, v in enumerate(x)],
                               "series_id string, date date, f double, g double")
    fits = G.fit_hidden_markov(df, ["f", "g"], seeds=(1, 2), max_iter=50)
    run = F.col("seed").cast("string").alias("run")
    mapping = G.state_mapping(fits.select("series_id", run, "means"), "1")
    rows = G.remapped(G.decoded(fits).select("series_id", run, "date", F.col("state_raw").alias("state")), mapping)
    assert G.agreement_with(rows, "1").first().agreement > 0.98
    first = [r.state for r in rows.where("run = '1'").orderBy("date").collect()]
    assert all(len(set(np.array(first)[truth == k])) == 1 or np.bincount(np.array(first)[truth == k]).max() > 55 for k in range(3))


def test_donors_permute(spark):
    rows = [(i, i % 3, [float(i), float(-i)]) for i in range(500)]
    from pyspark.ml.functions import array_to_vector, vector_to_array
    df = spark.createDataFrame(rows, "k int, true_label int, a array<double>").select("k", "true_label", array_to_vector("a").alias("features"))
    for size in (40, 5000):
        got = T.donors(df, ["k"], 1, size).select("k", vector_to_array("_donor")[0].alias("d")).collect()
        assert sorted(r.d for r in got) == [float(i) for i in range(500)]
        assert sum(r.k == r.d for r in got) <= 2


def test_pruning(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 400))
    df = spark.createDataFrame([(float(x), float(2 * x + 0.01 * z), float(y), float(x + y)) for x, y, z in zip(a, b, rng.normal(size=400))],
                               "a double, twin double, b double, both double")
    pairs = Q.moments(df, df.columns)
    assert S.prune_correlated(pairs, {"a": 1.0, "twin": 2.0, "b": 0.5, "both": 0.1}, df.columns) == ["twin", "b", "both"]
    assert len(S.prune_inflated(pairs, ["a", "b", "both"])) == 2
    assert S.inflation_factors(pairs, ["a", "b"])["a"] == pytest.approx(1.0, abs=0.05)


def test_unseen_class_scores_zero(spark):
    rows = [(DAY0 + dt.timedelta(days=i), i % 2, float(i % 2) + 0.01 * i) for i in range(60)]
    df = T.vectors(spark.createDataFrame(rows, "date date, true_label int, f double"), ["f"])
    out = T.score(T.fit(df, "forest", {"numTrees": 3}), df, 3)
    assert out.agg(F.max("p2")).first()[0] == 0.0


def test_search_space():
    space = {"n": {"type": "int", "low": 10, "high": 30, "step": 10}, "x": {"type": "float", "low": 0.01, "high": 1.0, "log": True},
             "c": {"type": "categorical", "choices": ["a", "b"]}}
    drawn = T.draw(space, 50, 1)
    assert drawn == T.draw(space, 50, 1)
    assert {d["n"] for d in drawn} == {10, 20, 30} and all(0.01 <= d["x"] <= 1 for d in drawn) and {d["c"] for d in drawn} == {"a", "b"}


def test_search_ranks_refused_parameters_last(spark):
    i = F.col("id")
    folds = spark.range(60).select(
        i.alias("date"), (i % 3).cast("double").alias("x"), (i % 2).cast("int").alias("true_label"), F.lit(1).alias("fold"),
        F.when(i < 40, "train").otherwise("test").alias("role"))
    rows = T.random_search(folds, ["x"], 2, {"max_iter": {"type": "categorical", "choices": [-1, 5]}}, trials=6).collect()
    good = [r.mean_log_loss < float("inf") for r in rows]
    assert {r.params["max_iter"]: r.mean_log_loss < float("inf") for r in rows} == {"5": True, "-1": False}
    assert good == sorted(good, reverse=True)


def test_messages_follow_the_chain():
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 50, 333):
        v, steps = rng.random(3), rng.random((n, 3, 3))
        rows = [v / v.sum()]
        for m in steps[1:]:
            rows.append(rows[-1] @ m / (rows[-1] @ m).sum())
        assert np.allclose(G._messages(v, steps), rows, rtol=1e-12)


def test_label_stability_compares_each_experiment_with_its_own_reference(spark):
    rng = np.random.default_rng(4)
    rows = [("s", DAY0 + dt.timedelta(days=i), float(rng.normal((i // 60) % 3 * 4, 0.5)), float(rng.normal((i // 60) % 3, 0.5))) for i in range(360)]
    df = spark.createDataFrame(rows, "series_id string, date date, a double, b double")
    got = {(r.experiment, r.seed, r.drop_last): r.agreement for r in G.label_stability(df, ["a", "b"], seeds=(0, 42, 84), drop_last=(60, 355), smoothing=5).collect()}
    assert set(got) == {("seeds", 42, 0), ("seeds", 84, 0), ("truncation", 42, 60), ("truncation", 42, 355)}
    assert got["truncation", 42, 60] > 0.9


def test_label_queries_fit_to_the_end(monkeypatch):
    """Registered fits may take as many iterations, seeds and truncations as the whole job has."""
    from tidegauge.plans import model_queries as M
    asked = []

    class Stop(Exception):
        pass

    def fit(df, features, **kw):
        asked.append(kw)
        raise Stop

    monkeypatch.setattr(M.G, "fit_hidden_markov", fit)
    monkeypatch.setattr(M, "market_features", lambda spark, sf: None)
    for run in (M.m21, M.m21_summary, M.m22, M.m24):
        with pytest.raises(Stop):
            run(None, None)
    assert all(k["max_iter"] == 1000 and k["tolerance"] == 1e-3 for k in asked)
    plans = asked[2]["plans"]
    assert len({s for _, s, d in plans if not d}) == 10 and len([p for p in plans if p[2]]) == 8 and len(plans) == 18


def test_agreement_of_a_thousand_runs(spark):
    rng = np.random.default_rng(6)
    label = rng.integers(0, 4, (1000, 12))
    rows = [(f"r{i}", DAY0 + dt.timedelta(days=d), None if (i + d) % 7 == 0 else int(label[i, d])) for i in range(1000) for d in range(12)]
    got = E.pair_agreement(spark.createDataFrame(rows, "run string, date date, predicted_label int"), [f"r{i}" for i in range(1000)]).collect()
    assert len(got) == 1000 * 999 // 2
    known = np.array([[(i + d) % 7 != 0 for d in range(12)] for i in range(1000)])
    for r in got[::997]:
        a, b = int(r.run_a[1:]), int(r.run_b[1:])
        both = known[a] & known[b]
        assert a < b and (r.n_common, r.n_agree) == (both.sum(), (both & (label[a] == label[b])).sum())


def test_moments_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 150))
    x[rng.random(x.shape) < 0.1] = np.nan
    cols = [f"c{i:03d}" for i in range(150)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols))
    got = {(r.a, r.b): r for r in Q.moments(df, cols).collect()}
    assert len(got) == 150 * 151 // 2
    for i, j in ((0, 0), (3, 70), (64, 149), (149, 149), (63, 64)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[cols[i], cols[j]].n == both.sum()
        assert got[cols[i], cols[j]].covariance == pytest.approx(np.cov(x[both, i], x[both, j])[0, 1])


def test_label_scores_of_billions_of_rows(spark, monkeypatch):
    """Products of four counts pass a long's range; the scores depend on the shares alone."""
    monkeypatch.setattr(E, "confusion", lambda df, by: df)

    def scores(times):
        rows = [("x", t, p, n * times) for t, p, n in ((0, 0, 3), (0, 1, 1), (1, 1, 5), (1, 0, 2), (2, 2, 4), (2, 1, 1))]
        counts = spark.createDataFrame(rows, "run string, true_label int, predicted_label int, n long")
        return E.label_scores(counts, weights={0: 3.0}).first().asDict()
    small = scores(1)
    assert small["mcc"] == pytest.approx((12 * 16 - (4 * 5 + 7 * 7 + 5 * 4)) / ((16 ** 2 - 25 - 49 - 16) * (16 ** 2 - 16 - 49 - 25)) ** 0.5)
    large = scores(500_000_000)
    assert {k: round(v, 9) for k, v in large.items() if k != "run"} == {k: round(v, 9) for k, v in small.items() if k != "run"}


def test_linear_models_get_a_long_series_dealt_out(spark, monkeypatch):
    """Rows of one partition reach a linear fit in several, a forest's as they are."""
    rows = spark.range(0, 300, 1, 1).select((F.col("id") % 3).cast("int").alias("true_label"), ((F.col("id") % 3) + (F.col("id") * 7919 % 101) / 40).alias("a"))
    got = []

    class Seen:
        def __init__(self, stages):
            pass

        def fit(self, df):
            got.append(df.rdd.getNumPartitions())
    monkeypatch.setattr(T, "Pipeline", Seen)
    monkeypatch.setattr(T, "ROWS_A_TASK", 100)
    for model in ("logistic", "forest"):
        T.fit(T.vectors(rows, ["a"]), model)
    assert got[0] == 3 and got[1] == 1
