"""Time-ordered folds, holdouts, class weights and label codes."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions.scalars import finite
from tidegauge.operators.axis import DAILY, Axis
from tidegauge.operators.chunks import TARGET_ROWS, filled, join_keys, lay_out, positions


def indexed(df: DataFrame, ax: Axis = DAILY, long_series=False, target_rows=TARGET_ROWS):
    """Add ``_i`` (0-based row number) and ``_n`` (rows of the series)."""
    lay = lay_out(df, ax, target_rows if long_series else None)
    df = lay.done(positions(lay, "_i"))
    n = df.groupBy(*ax.by).agg(F.count(F.lit(1)).alias("_n"))
    return join_keys(df.withColumn("_i", F.col("_i") - 1), n, list(ax.by))


def _roles(df, folds):
    """Explode the non-NULL (fold, role) pairs of every row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("fold"), role.alias("role")) for f, role in folds])
    df = df.withColumn("_f", F.explode(F.filter(pairs, lambda p: p["role"].isNotNull())))
    return df.withColumns({"fold": F.col("_f.fold"), "role": F.col("_f.role")}).drop("_f", "_i", "_n")


def purged_folds(df: DataFrame, ax: Axis = DAILY, k=5, purge=0, embargo=None, **how):
    """Each row once per fold it plays in: ``fold`` 1..k and ``role`` test or train.

    Test blocks are contiguous, the first ``n % k`` one row longer. Training rows end
    ``purge`` rows before the block. Rows after the block never train, unless an
    ``embargo`` is given: then those more than that many rows after it do.
    """
    df = indexed(df, ax, **how)
    i, size, extra = F.col("_i"), F.floor(F.col("_n") / k), F.col("_n") % k

    def start(f):
        return f * size + F.least(F.lit(f), extra)
    folds = []
    for f in range(k):
        a, b = start(f), start(f + 1)
        train = i < a - purge
        if embargo is not None:
            train = train | (i >= b + embargo)
        folds.append((f + 1, F.when((i >= a) & (i < b), "test").when(train, "train")))
    return _roles(df, folds)


def expanding_folds(df: DataFrame, ax: Axis = DAILY, k=5, **how):
    """Growing training window, then a test block of n // (k + 1) rows, k times."""
    df = indexed(df, ax, **how)
    i, size = F.col("_i"), F.floor(F.col("_n") / (k + 1))
    folds = []
    for f in range(k):
        a = F.col("_n") - (k - f) * size
        folds.append((f + 1, F.when(i < a, "train").when(i < a + size, "test")))
    return _roles(df, folds)


def holdout(df: DataFrame, ax: Axis = DAILY, share=0.2, **how):
    """The last ``share`` of each series (rounded up) as test, in time order."""
    df = indexed(df, ax, **how)
    test = F.ceil(F.col("_n") * F.lit(share))
    return df.withColumn("role", F.when(F.col("_i") >= F.col("_n") - test, "test").otherwise("train")).drop("_i", "_n")


def class_weights(df: DataFrame, label, by=()):
    """Balanced weights n / (classes * n_class), one row per class.

    Classes are few, so the result is small and may be broadcast.
    """
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    whole = Axis(tuple(by) or (F.lit(1),)).whole()
    return counts.select(*by, label, (F.sum("_c").over(whole) / (F.count("_c").over(whole) * F.col("_c"))).alias("weight"))


def label_codes(df: DataFrame, label):
    """Codes 0..k-1 in sorted label order; only the distinct labels are ordered."""
    distinct = df.where(F.col(label).isNotNull()).select(label).distinct()
    order = Axis((F.lit(1),), (label,)).base()
    return distinct.withColumn("code", F.row_number().over(order) - 1)


def training_matrix(df: DataFrame, features, target, ax: Axis = DAILY, zero_fill=False):
    """Features ready to fit: infinities to NULL, then one of two treatments.

    Default: filled forward, rows still missing anything dropped. ``zero_fill``: empty
    columns dropped and gaps set to 0. Rows without a target are dropped either way.
    """
    df = df.dropna(subset=[target]).withColumns({f: finite(f) for f in features})
    if zero_fill:
        seen = df.agg(*[F.count(f).alias(f) for f in features]).first()
        kept = [f for f in features if seen[f]]
        return df.drop(*[f for f in features if f not in kept]).na.fill(0.0, subset=kept)
    return filled(df, ax, features).dropna(subset=list(features))
