"""Near-duplicate vectors by tiled comparison in the order of principal components.

Vectors of length one are rotated to their principal axes. A tile of two groups is compared on
the leading axes first; the rest of a cosine is at most the product of the lengths of the two
remainders, so pairs that cannot reach the threshold stop there. Groups are ranges of the first
axis, and tiles whose ranges are too far apart are never made. Equal vectors are compared once.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidegauge.llm.graphs import components, local_components
from tidegauge.session import persist_plan

LEAST = 0.9
SLACK = 1e-9
STAGES = (8, 16, 32)             # axes after which the bound is tried
TILE = 512                       # rows of a comparison in memory
GROUP = 16384                    # vectors of a group, about


def units(lists, width):
    """Rows of length one; which rows are whole, finite and not zero."""
    out, ok = np.zeros((len(lists), width)), np.zeros(len(lists), bool)
    for i, x in enumerate(lists):
        if x is not None and None not in x:
            row = np.asarray(x, np.float64)
            top = np.abs(row).max() if len(row) else 0.0
            if np.isfinite(row).all() and top > 0:
                row = row / top                                 # no overflow of squares
                out[i, :len(row)] = row / np.sqrt(row @ row)
                ok[i] = True
    return out, ok


def _reader(width):
    def run(batches):
        for batch in batches:
            rows, ok = units(batch.column("embedding").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() if k else None for r, k in zip(rows, ok)], pa.binary())],
                                             ["vec_id", "vector"])
    return run


def stacked(column, width):
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), width)


def _moments(width):
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = stacked(batch.column("vector"), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])
    return run


def _rotate(axes):
    def run(batches):
        for batch in batches:
            x = stacked(batch.column("vector"), len(axes)) @ axes
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), pa.array(x[:, 0] if x.shape[1] else np.zeros(len(x))),
                                              pa.array([r.tobytes() for r in x], pa.binary())], ["rep", "copies", "lead", "vector"])
    return run


def linked(a, b):
    """Pairs of rows of two rotated blocks with cosine of at least the threshold."""
    i = j = None
    total = np.zeros((len(a), len(b)))
    done = 0
    for stop in (*STAGES, a.shape[1]):
        stop = min(stop, a.shape[1])
        if stop <= done and stop < a.shape[1]:
            continue
        if i is None:
            total += a[:, done:stop] @ b[:, done:stop].T
        else:
            sums = sums + np.einsum("ij,ij->i", a[i, done:stop], b[j, done:stop])
        rest_a, rest_b = (np.sqrt((x[:, stop:] ** 2).sum(axis=1)) for x in (a, b))
        if i is None:
            near = total + np.outer(rest_a, rest_b) >= LEAST - SLACK
            if np.count_nonzero(near) * 8 < near.size or stop == a.shape[1]:
                i, j = np.nonzero(near)
                sums = total[i, j]
        else:
            keep = sums + rest_a[i] * rest_b[j] >= LEAST - SLACK
            i, j, sums = i[keep], j[keep], sums[keep]
        done = stop
    edge = np.flatnonzero(np.abs(sums - LEAST) < SLACK)         # as near to it as rounding: the sum in one order
    sums[edge] = (a[i[edge]] * b[j[edge]]).sum(axis=1)
    keep = sums >= LEAST
    return i[keep], j[keep]


def _compare(width):
    def run(table):
        ids, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        copies, x = table.column("copies").to_numpy(), stacked(table.column("vector"), width)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
        own = not len(right) and not (side == 0).any()          # a group with itself
        if own:
            right = left
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for s in range(0, len(left), TILE):
            for t in range(s if own else 0, len(right), TILE):
                p, q = left[s:s + TILE], right[t:t + TILE]
                i, j = linked(x[p], x[q])
                if own and s == t:
                    i, j = i[i < j], j[i < j]
                i, j = p[i], q[j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                fresh = label[i] != label[j]
                if fresh.any():
                    merged = local_components(len(ids), label[i[fresh]], label[j[fresh]])
                    label = merged[label]
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, label, ids)
        return pa.table({"rep": ids, "links": links, "root": root[label]})
    return run


def near_vectors(vectors, groups=None):
    """Links and classes of ``vectors`` (``vec_id``, ``embedding``): vec_id, n_links, component_id, kept.

    Vectors link if their cosine in double precision is at least 0.9. Null and zero vectors and
    such with null or non-finite numbers link with nothing; shorter ones count as padded with
    zeros. Rows that repeat a vec_id with the same vector are one; null ids take no part. Other
    columns are ignored. An empty table gives an empty result.
    """
    given = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width = given.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(width, 1)
    read = given.mapInArrow(_reader(width), "vec_id long, vector binary").groupBy("vec_id").agg(F.max("vector").alias("vector"))
    read = persist_plan(read)
    some = read.where("vector is not null")
    distinct = persist_plan(some.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    total = np.zeros((width, width))
    for row in distinct.select("vector").mapInArrow(_moments(width), "sums binary").toLocalIterator():
        total += np.frombuffer(row.sums).reshape(width, width)
    axes = np.linalg.eigh(total)[1][:, ::-1].copy()
    turned = persist_plan(distinct.mapInArrow(_rotate(axes), "rep long, copies long, lead double, vector binary"))
    n = turned.count()
    if not n:
        return read.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = groups or max(-(-n // GROUP), min(int(np.sqrt(2 * parts)), -(-n // TILE)))
    cuts = turned.approxQuantile("lead", [k / groups for k in range(1, groups)], 0.1 / groups) if groups > 1 else []
    number = F.lit(0)
    for c in sorted(set(cuts)):
        number = number + (F.col("lead") > F.lit(c)).cast("int")
    grouped = persist_plan(turned.withColumn("group", number))
    ends = sorted((r.group, r.low, r.high) for r in grouped.groupBy("group").agg(F.min("lead").alias("low"), F.max("lead").alias("high")).collect())
    reach = np.sqrt(2 - 2 * LEAST) + SLACK                      # vectors further apart on an axis cannot link
    tiles = []
    for x, (g, _, high) in enumerate(ends):
        tiles.append((g, len(tiles), 2))
        for h, low, _ in ends[x + 1:]:
            if low - high <= reach:
                tiles += [(g, len(tiles), 0), (h, len(tiles), 1)]
    places = spark.createDataFrame(_numbered(tiles), "group int, tile int, side int")
    met = grouped.join(places, "group").groupBy("tile").applyInArrow(_compare(width), "rep long, links long, root long")
    met = persist_plan(met)
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(met.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = distinct.join(counts, "rep").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    known = persist_plan(known.select("vector", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = read.join(known, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _numbered(tiles):
    """Both sides of a tile under one number."""
    out, number = [], 0
    for g, _, side in tiles:
        if side != 1:
            number += 1
        out.append((int(g), number, side))
    return out
