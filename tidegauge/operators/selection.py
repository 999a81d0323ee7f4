"""Choosing features: stationarity, mutual information, correlation, inflation."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.functions.scalars import digamma
from tidegauge.operators.axis import Axis
from tidegauge.operators.chunks import TARGET_ROWS, by_chunk, cumulative_by, percentiles
from tidegauge.operators.impute import interpolate
from tidegauge.operators.profile import COLUMNS, moments
from tidegauge.session import persist_plan

# fixed values: MacKinnon (1994) p-value polynomials and (2010) critical values, constant only
ADF_BOUNDS = (-18.83, -1.61, 2.74)
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433),
                "5%": (-2.86154, -2.8903, -4.234, -40.040),
                "10%": (-2.56677, -1.5384, -2.809, 0.0)}
# fixed values: KPSS (1992) table, level stationarity
KPSS_LEVELS = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def adf_test(x, max_lag=None):
    """Augmented Dickey-Fuller with a constant; lags chosen by AIC on a common sample."""
    n = len(x)
    if max_lag is None:
        max_lag = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    dx = np.diff(x)

    def design(lags, first):
        y = dx[first:]
        cols = [x[first:-1], np.ones(len(y))] + [dx[first - j:len(dx) - j] for j in range(1, lags + 1)]
        return y, np.column_stack(cols)

    y, full = design(max_lag, max_lag)
    gram, cross, m = full.T @ full, full.T @ y, len(y)

    def aic(lags):
        k = lags + 2
        b = np.linalg.lstsq(gram[:k, :k], cross[:k], rcond=None)[0]
        rss = max(y @ y - b @ cross[:k], 1e-300)
        return m * (math.log(2 * math.pi * rss / m) + 1) + 2 * k
    lags = min(range(max_lag + 1), key=aic)
    y, z = design(lags, lags)
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    r = y - z @ b
    cov = np.linalg.pinv(z.T @ z) * (r @ r) / (len(y) - z.shape[1])
    stat = b[0] / math.sqrt(cov[0, 0])
    return float(stat), _adf_p(stat), lags, {c: sum(v / len(y) ** i for i, v in enumerate(k)) for c, k in ADF_CRITICAL.items()}


def _adf_p(stat):
    low, turn, high = ADF_BOUNDS
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    poly = ADF_SMALL_P if stat <= turn else ADF_LARGE_P
    z = sum(c * stat ** i for i, c in enumerate(poly))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def kpss_test(x):
    """KPSS around a level; bandwidth by Hobijn, Franses and Ooms (1998)."""
    n = len(x)
    r = x - x.mean()

    def auto(i):
        return r[i:] @ r[:n - i] / n
    first = int(n ** (2 / 9))
    s0 = auto(0) + 2 * sum(auto(i) for i in range(1, first + 1))
    s1 = 2 * sum(i * auto(i) for i in range(1, first + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    spread = auto(0) + 2 * sum((1 - i / (lags + 1)) * auto(i) for i in range(1, lags + 1))
    stat = float((np.cumsum(r) ** 2).sum() / n ** 2 / spread)
    return stat, float(np.interp(stat, KPSS_LEVELS, KPSS_P)), lags, stat < KPSS_LEVELS[0], stat > KPSS_LEVELS[-1]


def verdict(adf_p, kpss_p, above, below):
    """Combined reading of both tests; a p-value off the table's end is nudged outwards."""
    adf_p, kpss_p = F.col(adf_p), F.col(kpss_p)
    # fixed values: the five verdict texts
    real = F.when(F.col(below), kpss_p - 0.001).when(F.col(above), kpss_p + 0.001).otherwise(kpss_p)
    a, k = adf_p < 0.05, real >= 0.05
    return (F.when(adf_p.isNull() | kpss_p.isNull(), "Error in tests")
            .when(a & k, "Stationary").when(~a & ~k, "Non-Stationary")
            .when(a & ~k, "Difference Stationary (ADF Stationary, KPSS Non-Stationary)")
            .otherwise("Trend Stationary (ADF Non-Stationary, KPSS Stationary)"))


def screened(long: DataFrame, least=20):
    """Columns with too few rows or no variation, and why; one row per column."""
    g = long.groupBy("column_name").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    error = F.when(F.col("n") < least, "Insufficient data points").when(F.col("lo") == F.col("hi"), "Constant series")
    return g.select("column_name", "n", error.alias("error"))


def stationarity(long: DataFrame, date="date"):
    """Both tests for every column of ``column_name, date, value``.

    A column is tested by one task: it holds one value per date.
    """
    checks = screened(long)
    schema = """column_name string, adf_statistic double, adf_p_value double, adf_n_lags int, `adf_critical_1%` double,
     `adf_critical_5%` double, `adf_critical_10%` double, kpss_statistic double, kpss_p_value double, kpss_n_lags int,
     kpss_p_above boolean, kpss_p_below boolean"""

    def test(key, pdf):
        x = pdf.sort_values(date)["value"].to_numpy("float64")
        stat, p, lags, crit = adf_test(x)
        row = [key[0], stat, p, lags, crit["1%"], crit["5%"], crit["10%"], *kpss_test(x)]
        return pd.DataFrame([row], columns=["column_name", "adf_statistic", "adf_p_value", "adf_n_lags", "adf_critical_1%",
                                            "adf_critical_5%", "adf_critical_10%", "kpss_statistic", "kpss_p_value",
                                            "kpss_n_lags", "kpss_p_above", "kpss_p_below"])

    fit = long.where("value is not null").join(checks.where("error is null").select("column_name"), "column_name", "left_semi")
    tested = fit.groupBy("column_name").applyInPandas(test, schema)
    df = checks.join(tested, "column_name", "left")
    v = verdict("adf_p_value", "kpss_p_value", "kpss_p_above", "kpss_p_below")
    return df.withColumn("overall_stationarity", F.when(F.col("error").isNull(), v))


# -- statistics slice --------------------------------------------------------

def statistics_slice(long: DataFrame, ax: Axis = COLUMNS):
    """Rows after every column has begun, gaps interpolated by row position.

    Columns without any value do not take part.
    """
    date = ax.order[0]
    begins = long.where("value is not null").groupBy("column_name").agg(F.min(date).alias("first"))
    cut = begins.agg(F.max("first")).scalar()                          # one value
    df = long.where(F.col(date) > cut).join(begins.select("column_name"), "column_name", "left_semi")
    return interpolate(df, ax).where("value is not null")


# -- mutual information ------------------------------------------------------

def mutual_information(long: DataFrame, labels: DataFrame, bins=10, date="date", label="label", target_rows=TARGET_ROWS):
    """Plug-in mutual information of each column, in quantile bins, with the label.

    ``labels``: date, label. Cut points are exact quantiles, one row per column; the
    rest is counting, so every column is scored in the same two aggregations.
    """
    rows = long.where("value is not null").join(labels.dropna(subset=[label]), date)
    cuts = percentiles(rows, ["column_name"], "value", {f"q{i}": i / bins for i in range(1, bins)}, target_rows)
    rows = rows.join(F.broadcast(cuts), "column_name")
    bin_ = sum((F.when(F.col("value") > F.col(f"q{i}"), 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    joint = rows.groupBy("column_name", bin_.alias("bin"), label).agg(F.count(F.lit(1)).alias("n"))

    def over(*by):
        return F.sum("n").over(Axis(("column_name", *by)).whole())
    joint = joint.withColumns({"_x": over("bin"), "_y": over(label), "_t": over()})
    term = F.col("n") / F.col("_t") * F.ln(F.col("n") * F.col("_t") / (F.col("_x") * F.col("_y")))
    return joint.groupBy("column_name").agg(F.sum(term).alias("mutual_information"))


def neighbour_information(long: DataFrame, labels: DataFrame, neighbours=3, date="date", label="label", target_rows=TARGET_ROWS):
    """Mutual information of each column with the label, by distances to nearest neighbours.

    Around each value an open interval reaches to its k-th nearest value of the same label; m
    is the number of values of any label in it (for a distance of 0, of equal ones). The
    estimate is psi(n) + <psi(k)> - <psi(n of the label)> - <psi(m)>, and 0 at least; k is
    ``neighbours``, or one less than the label has values. Labels with one value do not take
    part. ``labels``: date, label.

    Equal values of a label are one row with their number. Neighbours lie at most k rows away
    in the label's order, and the numbers in the intervals are differences of one running
    sum over all values and interval ends, so no task needs a whole column.
    """
    rows = long.where("value is not null").join(labels.dropna(subset=[label]).select(date, F.col(label).alias("_label")), date)
    points = rows.groupBy("column_name", "_label", "value").agg(F.count(F.lit(1)).alias("_w"))
    sizes = points.groupBy("column_name", "_label").agg(F.sum("_w").alias("_of_label")).where("_of_label > 1")
    points = persist_plan(points.join(sizes, ["column_name", "_label"]).withColumn("_k", F.least(F.lit(neighbours), F.col("_of_label") - 1)))
    v, none = F.col("value"), F.array().cast("array<double>")

    def reach(d, a):
        def away(i):
            return (F.lag if i < 0 else F.lead)(F.struct("value", "_w"), abs(i)).over(a.base())
        steps = [i for i in range(-neighbours, neighbours + 1) if i]
        d = d.withColumns({f"_p{i}": away(i) for i in steps})
        far = {i: F.abs(F.col(f"`_p{i}`.value") - v) for i in steps}
        times = [F.array_repeat(F.lit(0.0), F.least(F.col("_w") - 1, F.lit(neighbours)).cast("int"))]
        times += [F.coalesce(F.array_repeat(far[i], F.least(F.col(f"`_p{i}`._w"), F.lit(neighbours)).cast("int")), none) for i in steps]
        d = d.withColumn("_d", F.element_at(F.array_sort(F.flatten(F.array(*times))), F.col("_k").cast("int")))

        def end(side):
            met = [F.when(far[i] == F.col("_d"), F.col(f"`_p{i}`.value")) for i in steps if i * side > 0]
            return F.coalesce(*met, v + side * F.col("_d"))
        return d.select(*a.keys, "_w", "_of_label", "_k", "_d", end(-1).alias("_low"), end(1).alias("_high"))

    ends = by_chunk(points, Axis(("column_name", "_label"), ("value",)), reach, neighbours, neighbours, target_rows=target_rows)
    # an end comes before the values equal to it (0) or after them (2)
    zero = F.col("_d") == 0
    both = F.array(F.struct(F.when(zero, v).otherwise(F.col("_low")).alias("at"), F.when(zero, 0).otherwise(2).alias("side"), F.lit(-1).alias("sign")),
                   F.struct(F.when(zero, v).otherwise(F.col("_high")).alias("at"), F.when(zero, 2).otherwise(0).alias("side"), F.lit(1).alias("sign")))
    asked = ends.select("column_name", "_label", "value", "_w", "_of_label", "_k", F.explode(both).alias("_e")).select("*", "_e.at", "_e.side", "_e.sign", F.lit(0).cast("long").alias("_add")).drop("_e")
    marks = points.groupBy("column_name", "value").agg(F.sum("_w").alias("_add")).select("column_name", F.col("value").alias("at"), F.lit(1).alias("side"), "_add")
    placed = cumulative_by(asked.unionByName(marks, allowMissingColumns=True), ["column_name"], ["at", "side"], {"_upto": F.col("_add")}, target_rows)
    inside = placed.where("side <> 1").groupBy("column_name", "_label", "value").agg(
        F.first("_w").alias("_w"), F.first("_of_label").alias("_of_label"), F.first("_k").alias("_k"), F.sum(F.col("sign") * F.col("_upto")).alias("_m"))

    def mean(c):
        return F.sum(F.col("_w") * digamma(F.col(c).cast("double"))) / F.sum("_w")
    estimate = digamma(F.sum("_w").cast("double")) + mean("_k") - mean("_of_label") - mean("_m")
    return inside.groupBy("column_name").agg(F.greatest(estimate, F.lit(0.0)).alias("mutual_information"))


# -- redundancy --------------------------------------------------------------

def average_ranks(long: DataFrame, target_rows=TARGET_ROWS):
    """Each value's rank in its column, ties averaged; ranked by counts per value."""
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_w"))
    placed = cumulative_by(counts, ["column_name"], ["value"], {"_upto": F.col("_w")}, target_rows)
    ranks = placed.select("column_name", "value", (F.col("_upto") - (F.col("_w") - 1) / 2).alias("rank"))
    return long.join(ranks, ["column_name", "value"])


def spearman(long: DataFrame, columns, date="date", target_rows=TARGET_ROWS):
    """Rank correlations of all column pairs (upper triangle) on a slice without gaps."""
    ranked = average_ranks(long, target_rows)
    wide = ranked.groupBy(date).agg(*[F.max(F.when(F.col("column_name") == c, F.col("rank"))).alias(c) for c in columns])
    return moments(wide, columns).select("a", "b", "correlation")


def _matrix(pairs, columns):
    """Square matrix from pair rows; the table's columns bound its size."""
    at = {c: i for i, c in enumerate(columns)}
    m = np.full((len(columns), len(columns)), np.nan)
    wanted = F.col("a").isin(list(columns)) & F.col("b").isin(list(columns))
    for a, b, r in pairs.where(wanted).select("a", "b", "correlation").collect():
        m[at[a], at[b]] = m[at[b], at[a]] = np.nan if r is None else r
    return m


def prune_correlated(pairs: DataFrame, scores: dict, columns, threshold=0.9):
    """By falling score, keep a feature and drop what correlates with it beyond the threshold."""
    columns = sorted(columns, key=lambda c: (-scores.get(c, -1.0), c))
    near = {c: [] for c in columns}
    close = pairs.where("a <> b").where(F.abs("correlation") > threshold).where(~F.isnan("correlation"))
    for a, b in close.select("a", "b").toLocalIterator():               # only pairs beyond the threshold come here
        if a in near and b in near:
            near[a].append(b)
            near[b].append(a)
    kept, gone = [], set()
    for c in columns:
        if c not in gone:
            kept.append(c)
            gone.update(near[c])
    return kept


def _inflation(m):
    """Diagonal of the inverse; the ridge only keeps exact copies finite (and huge).

    A column that does not vary has no correlation with itself and counts as infinite.
    """
    flat = np.isnan(np.diag(m))
    live = np.nan_to_num(m) + np.diag(np.where(flat, 1.0, 1e-12))
    return np.where(flat, np.inf, np.diag(np.linalg.inv(live)))


def inflation_factors(pairs: DataFrame, columns):
    """Variance inflation per column."""
    return dict(zip(columns, _inflation(_matrix(pairs, columns))))


def prune_inflated(pairs: DataFrame, columns, threshold=7.5):
    """Drop the most inflated column until all are within the threshold."""
    columns, m = list(columns), _matrix(pairs, columns)
    while len(columns) > 1:
        vif = _inflation(m)
        worst = int(vif.argmax())
        if vif[worst] <= threshold:
            break
        columns.pop(worst)
        m = np.delete(np.delete(m, worst, 0), worst, 1)
    return columns


def reduce_features(long: DataFrame, labels: DataFrame, columns, correlation=0.9, inflation=7.5, neighbours=3):
    """Statistics slice, mutual information, rank-correlation and inflation pruning."""
    part = statistics_slice(long).persist()                            # read four times below
    scores = {r[0]: r[1] for r in neighbour_information(part, labels, neighbours).collect()}     # one row per column
    live = [c for c in columns if c in scores]
    kept = prune_correlated(spearman(part, live), scores, live, correlation)
    wide = part.groupBy("date").agg(*[F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(c) for c in kept])
    final = set(prune_inflated(moments(wide, kept), kept, inflation))
    part.unpersist()
    rows = [(c, scores.get(c), c in kept, c in final) for c in columns]
    return long.sparkSession.createDataFrame(rows, "column_name string, mutual_information double, kept_by_correlation boolean, selected boolean")
