"""Keyed merges and report files; see ``tables`` for where they are kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions.scalars import dashed_number, put_call_ratio


def upsert(target: DataFrame, source: DataFrame, keys, update=None):
    """Rows of ``target`` with those of ``source`` merged in by key.

    On a common key the ``update`` columns (default: all source columns but the keys)
    take the source's value, NULL included; other columns keep theirs. An empty
    ``update`` changes nothing. ``source`` has one row per key.
    """
    keys = list(keys)
    update = [c for c in source.columns if c not in keys] if update is None else list(update)
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    joined = t.join(s, keys, "full_outer")
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c not in source.columns:
            cols.append(F.col(f"t.{c}"))
        else:
            takes = F.col("_s").isNotNull() & (F.col("_t").isNull() | F.lit(c in update))
            cols.append(F.when(takes, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return joined.select(*cols)


def put_call_upsert(target: DataFrame, source: DataFrame, label, keys=()):
    """Merge put/call rows by date (and ``keys``), deriving a missing ratio; rows without one are skipped."""
    call, put, total, ratio = (dashed_number(F.col(c).cast("string")) for c in (
        "equity_call_volume", "equity_put_volume", "equity_total_volume", "equity_pc_ratio"))
    clean = source.select(*keys, "date", call.alias("equity_call_volume"), put.alias("equity_put_volume"), total.alias("equity_total_volume"),
                          put_call_ratio(ratio, put, call).alias("equity_pc_ratio"), F.lit(label).alias("source"))
    return upsert(target, clean.dropna(subset=["date", "equity_pc_ratio"]), [*keys, "date"])


def save_reports(folder, folds: DataFrame = None, summary: DataFrame = None, oof: DataFrame = None, importances: DataFrame = None):
    """Fold metrics, summary, out-of-fold rows and importances, split by run where they have one."""
    for name, df, kind in (("fold_metrics", folds, "csv"), ("summary", summary, "json"),
                           ("out_of_fold", oof, "csv"), ("importances", importances, "csv")):
        if df is None:
            continue
        w = df.write.mode("overwrite").option("header", True)
        w = w.partitionBy("run") if "run" in df.columns and len(df.columns) > 1 else w
        getattr(w, kind)(f"{folder}/{name}")


def save_feature_lists(kept: DataFrame, folder):
    """One folder per theme with its features, one per line."""
    kept.select("theme", "feature").repartition("theme").sortWithinPartitions("theme", "feature") \
        .write.mode("overwrite").partitionBy("theme").text(folder)
