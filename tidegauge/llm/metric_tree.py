"""Exact top-k inner products with paged metric trees.

A further coordinate gives every vector the same length, so the greatest inner product is the
least Euclidean distance. Vectors go to the page of their nearest router, with their distance to
it; a page keeps its covering radius. A query visits pages best bound first and, within a page,
only entries that the stored distances cannot exclude by the triangle inequality.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from tidegauge.llm.hard_negatives import best as first_rows, products
from tidegauge.llm.words import pack, unpack
from tidegauge.session import persist_plan

SCALE = 256
ROUTERS = 256                    # vectors that centre pages, in hashed order
PAGE = 2048                      # vectors of a page; a router with more has several pages
QUERIES = 1024                   # queries of a block
SLACK = 1e-6                     # of a squared distance, for rounding
CANCEL = 1e-12                   # of the squared length, for differences of great numbers


def integers(lists, width):
    """Rows floor(256 x) of lists of numbers as doubles; which rows are whole and finite."""
    out, ok = np.zeros((len(lists), width)), np.zeros(len(lists), bool)
    for i, x in enumerate(lists):
        if x is not None and None not in x:
            row = np.asarray(x, np.float64)
            if np.isfinite(row).all():
                out[i, :len(row)] = np.floor(row * SCALE)
                ok[i] = True
    return out, ok


def lift(vectors, reach):
    """The further coordinate, with which all vectors have squared length ``reach``."""
    return np.sqrt(np.maximum(reach - (vectors ** 2).sum(axis=1), 0))


def distances(a, a_more, b, b_more):
    square = (a ** 2).sum(axis=1)[:, None] + a_more[:, None] ** 2 + (b ** 2).sum(axis=1) + b_more ** 2
    return np.sqrt(np.maximum(square - 2 * (a @ b.T + np.outer(a_more, b_more)), 0))


def _reader(width):
    def run(batches):
        for batch in batches:
            vectors, ok = integers(batch.column("embedding").to_pylist(), width)
            lengths = (vectors ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(ok)), pa.array([v.tobytes() for v in vectors[ok]], pa.binary()), pa.array(lengths[ok])],
                ["vec_id", "vector", "square"])
    return run


def _assigner(routers, reach, salts):
    more = lift(routers, reach)

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
            d = distances(vectors, lift(vectors, reach), routers, more)
            near = d.argmin(axis=1)
            page = near * salts + (ids % salts)
            yield pa.RecordBatch.from_arrays([pa.array(page), batch.column("vec_id"), batch.column("vector"), pa.array(d[np.arange(len(ids)), near])],
                                             ["page", "vec_id", "vector", "far"])
    return run


def _page(salts):
    def run(key, table):
        far = table.column("far").to_numpy()
        order = np.lexsort((table.column("vec_id").to_numpy(), far))
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(far), -1)[order]
        wide = bool(np.abs(vectors).max(initial=0) > 2 ** 24)    # whole numbers up to there are exact in 32 bits
        blob = pack(table.column("vec_id").to_numpy()[order], (vectors if wide else vectors.astype(np.float32)).ravel(), far[order])
        page = key[0].as_py()
        return pa.table({"page": [page], "router": [page // salts], "radius": [float(far.max())], "wide": [wide], "blob": pa.array([blob], pa.binary())})
    return run


def search_pages(pages, queries, k, routers, reach):
    """The best ``k`` of each query in some pages: query, id and score.

    ``pages``: (router, radius, ids, vectors, distances). ``queries``: ids and vectors.
    """
    ids, vectors = queries
    router_ids, centres = routers
    seen = vectors @ centres.T
    lengths = (vectors ** 2).sum(axis=1)
    to_router = np.sqrt(np.maximum(lengths[:, None] + reach - 2 * seen, 0))
    start = np.where(router_ids == ids[:, None], -np.inf, seen)
    floor = np.sort(start, axis=1)[:, -k] if start.shape[1] >= k else np.full(len(ids), -np.inf)
    floor = floor - CANCEL * reach                              # these are rounded, what they are held against is exact
    apart = np.sqrt(CANCEL * reach) + 1e-6
    which = np.array([p[0] for p in pages])
    radius = np.array([p[1] for p in pages])
    gap = np.maximum(to_router[:, which] - radius - apart, 0)
    bound = (lengths[:, None] + reach - gap ** 2) / 2 + SLACK * (1 + np.sqrt(lengths * reach))[:, None]
    norms = np.sqrt(lengths)
    out = []
    for q in range(len(ids)):
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = floor[q]                                        # no score under it can be among the best
        for p in np.argsort(-bound[q], kind="stable"):
            if bound[q, p] < least:
                break
            _, _, entry_ids, entries, far = pages[p]
            room = np.sqrt(max(lengths[q] + reach - 2 * least, 0) * (1 + SLACK) + SLACK) if np.isfinite(least) else np.inf
            d = to_router[q, which[p]]
            a, b = np.searchsorted(far, d - room - apart), np.searchsorted(far, d + room + apart, "right")
            if a >= b:
                continue
            score = products(vectors[q], norms[q], entries[a:b], np.array([np.sqrt(reach)]))
            fits = (score >= least) & (entry_ids[a:b] != ids[q])
            best_ids, best = first_rows(np.concatenate([best_ids, entry_ids[a:b][fits]]), np.concatenate([best, score[fits]]), k)
            if len(best) == k:
                least = max(least, float(best[-1]))
        out.append((np.full(len(best), ids[q]), best_ids, best))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _searcher(k, routers, reach, width):
    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        pages = []
        for router, radius, wide, blob in zip(*(left.column(c).to_pylist() for c in ("router", "radius", "wide", "blob"))):
            ids, flat, far = unpack(blob, np.int64, np.float64 if wide else np.float32, np.float64)
            pages.append((router, radius, ids, flat.reshape(len(ids), width).astype(np.float64), far))
        ids = right.column("vec_id").to_numpy()
        vectors = np.frombuffer(b"".join(right.column("vector").to_pylist()), np.float64).reshape(len(ids), width)
        q, v, s = search_pages(pages, (ids, vectors), k, routers, reach)
        return pa.table({"query_id": q.astype(np.int64), "vec_id": v.astype(np.int64), "score": s.astype(np.int64)})
    return run


def top_inner_products(vectors, every=50, k=5, groups=None):
    """The ``k`` best other vectors of each query: query_id, rank, vec_id, score.

    ``vectors``: ``vec_id``, ``embedding``; other columns are ignored. Queries are rows whose id
    is divisible by ``every``. Scores are inner products of floor(256 x), exact, and end at the
    range of a long; ties go to the smaller id. Null vectors, such with null or non-finite numbers and null ids take no part; shorter
    vectors count as padded with zeros. Of rows that repeat an id one stays.
    """
    spark = vectors.sparkSession
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width = given.agg(F.max(F.size("embedding"))).first()[0] or 0
    read = given.mapInArrow(_reader(width), "vec_id long, vector binary, square double")
    read = persist_plan(read.groupBy("vec_id").agg(F.max("vector").alias("vector"), F.max("square").alias("square")))
    n, reach = read.agg(F.count("*"), F.max("square")).first()
    chosen = read.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ROUTERS).select("vec_id", "vector").collect()
    router_ids = np.array([r.vec_id for r in chosen], np.int64)
    centres = np.frombuffer(b"".join(bytes(r.vector) for r in chosen), np.float64).reshape(len(chosen), width) if n else np.zeros((0, width))
    reach = float(reach or 0)
    salts = max(1, -(-n // (ROUTERS * PAGE // 4)))
    paged = read.mapInArrow(_assigner(centres, reach, salts), "page long, vec_id long, vector binary, far double")
    pages = paged.groupBy("page").applyInArrow(_page(salts), "page long, router long, radius double, wide boolean, blob binary")
    queries = read.where(F.col("vec_id") % every == 0).select("vec_id", "vector")
    blocks = max(1, -(-queries.count() // QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = queries.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "vec_id", "vector")
    parts = pages.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.hash("page"), F.lit(groups)).alias("part"),
                         "router", "radius", "wide", "blob")
    found = parts.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(
        _searcher(k, (router_ids, centres), reach, width), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
