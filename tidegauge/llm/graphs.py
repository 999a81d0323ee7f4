"""Connected components as joins, and inside one task."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidegauge.session import persist_plan


def components(edges):
    """Smallest id reachable from each end of ``edges`` (``a``, ``b``): ``id``, ``component``.

    Each round every vertex points to its smallest neighbour, pointers are doubled, and the
    edges are contracted to what their ends point to. Vertices shrink by half a round at
    least, so the rounds are logarithmic; each is cut with a checkpoint. A hub's edges are
    pre-aggregated before its shuffle, and the joins are plain equi-joins that AQE can split.
    Null ends and loops are ignored.
    """
    edges = persist_plan(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    labels = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = persist_plan(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        for _ in range(2):
            hop = points.select(F.col("a").alias("to"), F.col("to").alias("next"))
            points = persist_plan(points.join(hop, "to").select("a", F.col("next").alias("to")))
        if labels is None:
            labels = points.select(F.col("a").alias("id"), F.col("to").alias("component"))
        else:
            step = points.select(F.col("a").alias("component"), "to")
            labels = persist_plan(labels.join(step, "component", "left").select(
                "id", F.coalesce("to", "component").alias("component")))
        left = points.select("a", F.col("to").alias("x"))
        right = points.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = persist_plan(edges.join(left, "a").join(right, "b").where("x <> y")
                             .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


def local_components(n, a, b):
    """Component number (smallest member) of ``n`` vertices linked by arrays ``a`` and ``b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        label = new[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label
