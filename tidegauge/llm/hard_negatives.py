"""Hard negatives by angular triangle filtering.

Every row keeps its angles to a few reference directions. For an anchor and a row the angle
between them is at least the difference of their angles to a direction and at most the sum, so
each direction gives an interval of their cosine. The intersection of the intervals, times both
norms and widened for rounding, bounds the inner product. Only rows whose bounds reach what is
still asked for are scored, in integers: first the best rows of the anchor's own label, then the
rows of other labels within the windows that those scores set. Pages of rows close in angle have
bounds of their own, which pass over whole pages.

Anchors come in blocks of bounded size, each sent to all tasks; the pages stay where they are.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from tidegauge.llm.words import pack, unpack
from tidegauge.session import persist_plan, scratch

SCALE = 256
DIRECTIONS = 8
SAMPLE = 4096                    # rows that the directions are fitted to, in hashed order
PAGE = 2048                      # rows of a page
BLOCK_BYTES = 1 << 25            # of the anchors of a block
SLACK = 1e-6                     # of a cosine: angles are stored in 32 bits
EXACT = 2.0 ** 53                # products of norms under it have exact sums in doubles
LEAST, MOST = -2 ** 63, 2 ** 63 - 1


def whole_numbers(lists, width):
    """Rows floor(256 x) of an Arrow column of lists, padded with zeros; which rows are whole and finite."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fine = np.isfinite(flat)
    out = np.zeros((len(sizes), width))
    out[row, place] = np.floor(np.where(fine, flat, 0) * SCALE) + 0.0
    return out, np.bincount(row[~fine], minlength=len(sizes)) == 0


def lengths(vectors):
    """Euclidean norms, without overflow."""
    top = np.maximum(np.abs(vectors).max(axis=1, initial=0), 1e-300)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1))


def angles(vectors, norms, directions):
    """Angle of every row to every direction; 0 for a row of zeros."""
    unit = vectors / np.maximum(norms, 1e-300)[:, None]
    out = np.zeros((len(vectors), len(directions)))
    for k, d in enumerate(directions):
        out[:, k] = 2 * np.arctan2(np.sqrt(((unit - d) ** 2).sum(axis=1)), np.sqrt(((unit + d) ** 2).sum(axis=1)))
    return np.where(norms[:, None] > 0, out, 0)


def fit_directions(vectors, n=DIRECTIONS, rounds=8):
    """Unit vectors along the groups of a sample, by spherical k-means from far-apart rows."""
    norms = lengths(vectors)
    unit = vectors[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return unit
    chosen = unit[:1]
    while len(chosen) < min(n, len(unit)):
        chosen = np.concatenate([chosen, unit[(unit @ chosen.T).max(axis=1).argmin()][None]])
    for _ in range(rounds):
        near = (unit @ chosen.T).argmax(axis=1)
        sums = np.stack([unit[near == k].sum(axis=0) for k in range(len(chosen))])
        size = lengths(sums)
        chosen = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-300)[:, None], chosen)
    return chosen


def products(anchor, norm, vectors, norms):
    """Inner products of rows of whole numbers as integers, ending at the range of a long."""
    if norm * norms.max(initial=0) * (1 + 1e-9) < EXACT:
        return (vectors @ anchor).astype(np.int64)
    whole = lambda x: np.frompyfunc(int, 1, 1)(x).astype(object)                   # noqa: E731
    return np.array([min(max(int(s), LEAST), MOST) for s in whole(vectors) @ whole(anchor)], np.int64)


def stretched(cosines, norm, norms, up):
    """Bounds of products from bounds of cosines, rounded outwards."""
    size = norm * norms
    return np.minimum(cosines + SLACK, 1) * size + (1 + 1e-9 * size) if up else np.maximum(cosines - SLACK, -1) * size - (1 + 1e-9 * size)


def row_bounds(angle, norm, cosines, sines, norms):
    """Least and greatest product that each row can have with an anchor, by its angles to the directions."""
    c, s = cosines * np.cos(angle), sines * np.sin(angle)
    return (stretched((c - s).max(axis=1, initial=-1), norm, norms, False), stretched((c + s).min(axis=1, initial=1), norm, norms, True))


def page_bounds(angle, norm, nearest, furthest, least, most):
    """The same of all rows of a page for every anchor, from the page's least and greatest angles and norms."""
    close = np.maximum(np.maximum(nearest - angle, angle - furthest), 0)
    low, high = angle + nearest, angle + furthest               # sums; beyond pi they come back
    wide = np.where((low <= np.pi) & (high >= np.pi), np.pi, np.where(high < np.pi, high, 2 * np.pi - low))
    top, bottom = np.cos(close).min(axis=1, initial=1), np.cos(wide).max(axis=1, initial=-1)
    return (np.minimum(stretched(bottom, norm, least, False), stretched(bottom, norm, most, False)),
            np.maximum(stretched(top, norm, least, True), stretched(top, norm, most, True)))


def kth(values, k):
    """The k-th greatest value; without so many, minus infinity."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best(ids, scores, k):
    """The first ``k`` of some rows, by score from the greatest, then id."""
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == LEAST else -scores))[:k]
    return ids[order], scores[order]


def _reader(width):
    def run(batches):
        for batch in batches:
            vectors, ok = whole_numbers(batch.column("embedding"), width)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(keep), batch.column("label").filter(keep),
                                              pa.array([v.tobytes() for v in vectors[ok]], pa.binary())], ["vec_id", "label", "vector"])
    return run


def matrix(column, width):
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), width)


def _placer(directions, width):
    """Nearest direction of every row and the angle to it."""
    def run(batches):
        for batch in batches:
            vectors = matrix(batch.column("vector"), width)
            angle = angles(vectors, lengths(vectors), directions)
            near = angle.argmin(axis=1) if angle.size else np.zeros(len(vectors), np.int64)
            least = angle.min(axis=1) if angle.size else np.zeros(len(vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(least)], ["vec_id", "label", "vector", "near", "angle"])
    return run


ROWS = "vec_id long, label long, vector binary"
PAGES = "label long, n long, wide boolean, blob binary"


def _pager(directions, width, rows):
    """Pages of up to ``rows`` rows of one label, from sorted rows; of equal rows one stays."""
    def page(ids, label, vectors):
        norms = lengths(vectors)
        wide = bool(np.abs(vectors).max(initial=0) > 2 ** 24)
        blob = pack(ids, (vectors if wide else vectors.astype(np.float32)).ravel(), norms, angles(vectors, norms, directions).astype(np.float32).ravel())
        return pa.RecordBatch.from_arrays([pa.array([label], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([wide]), pa.array([blob], pa.binary())],
                                          ["label", "n", "wide", "blob"])

    def run(batches):
        held, last = [], None                                   # rows of the page that is not full yet
        for batch in batches:
            for row in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("vector").to_pylist()):
                if row == last:
                    continue
                if held and (row[1] != last[1] or len(held) == rows):
                    yield page(np.array([r[0] for r in held]), last[1], np.frombuffer(b"".join(r[2] for r in held)).reshape(len(held), width))
                    held = []
                held.append(row)
                last = row
        if held:
            yield page(np.array([r[0] for r in held]), last[1], np.frombuffer(b"".join(r[2] for r in held)).reshape(len(held), width))
    return run


def read_page(n, wide, blob, width):
    ids, flat, norms, angle = unpack(blob, np.int64, np.float64 if wide else np.float32, np.float64, np.float32)
    return ids, flat.reshape(n, width).astype(np.float64), norms, angle.reshape(n, len(angle) // max(n, 1)).astype(np.float64)


def _pages(batches, width):
    """Label, rows and bounds of every page."""
    for batch in batches:
        for label, n, wide, blob in zip(*(batch.column(c).to_pylist() for c in ("label", "n", "wide", "blob"))):
            page = read_page(n, wide, blob, width)
            angle, norms = page[3], page[2]
            yield label, page, (angle.min(axis=0), angle.max(axis=0), norms.min(), norms.max())


def _positives(block, k, width):
    """The best ``k`` rows of its own label for each anchor, among the pages of a task."""
    labels, ids, vectors, norms, angle = block

    def run(batches):
        found = {}
        bar = np.full(len(ids), -np.inf)                        # no score under it can be among the best
        for label, (row_ids, rows, row_norms, row_angles), edges in _pages(batches, width):
            own = np.flatnonzero(labels == label)
            own = own[page_bounds(angle[own], norms[own], *edges)[1] >= bar[own]]
            cosines, sines = np.cos(row_angles), np.sin(row_angles)
            for a in own.tolist():
                low, high = row_bounds(angle[a], norms[a], cosines, sines, row_norms)
                other = row_ids != ids[a]
                asked = np.flatnonzero(other & (high >= max(bar[a], kth(low[other], k))))
                if not len(asked):
                    continue
                had = found.get(a, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                scores = products(vectors[a], norms[a], rows[asked], row_norms[asked])
                found[a] = best(np.concatenate([had[0], row_ids[asked]]), np.concatenate([had[1], scores]), k)
                if len(found[a][1]) == k:
                    bar[a] = max(bar[a], float(found[a][1][-1]))
        for a, (which, scores) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), a)), pa.array(which), pa.array(scores)], ["anchor", "id", "score"])
    return run


def _negatives(block, windows, k, width):
    """The best ``k`` rows of other labels in each window of an anchor, among the pages of a task.

    ``windows``: per anchor the least and greatest scores of its windows, as integers.
    """
    labels, ids, vectors, norms, angle = block

    def run(batches):
        found = {}
        bar = [np.array([float(w[0]) for w in at]) for at in windows]
        lows = np.array([b.min(initial=np.inf) for b in bar])
        highs = np.array([max((float(w[1]) for w in at), default=-np.inf) for at in windows])
        for label, (row_ids, rows, row_norms, row_angles), edges in _pages(batches, width):
            bottom, top = page_bounds(angle, norms, *edges)
            cosines, sines = np.cos(row_angles), np.sin(row_angles)
            for a in np.flatnonzero((labels != label) & (top >= lows) & (bottom <= highs)).tolist():
                low, high = row_bounds(angle[a], norms[a], cosines, sines, row_norms)
                other = row_ids != ids[a]
                asked = np.zeros(len(row_ids), bool)
                for w, (least, most) in enumerate(windows[a]):
                    inside = other & (low >= least) & (high <= most)
                    asked |= (high >= max(bar[a][w], kth(low[inside], k))) & (low <= most)
                asked = np.flatnonzero(asked & other)
                if not len(asked):
                    continue
                scores = products(vectors[a], norms[a], rows[asked], row_norms[asked])
                for w, (least, most) in enumerate(windows[a]):
                    fits = np.flatnonzero((scores >= least) & (scores <= most) & (scores >= bar[a][w]))
                    if len(fits):
                        had = found.get((a, w), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        found[a, w] = best(np.concatenate([had[0], row_ids[asked][fits]]), np.concatenate([had[1], scores[fits]]), k)
                        if len(found[a, w][1]) == k:
                            bar[a][w] = max(bar[a][w], float(found[a, w][1][-1]))
                lows[a] = bar[a].min(initial=np.inf)
        for (a, w), (which, scores) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), a)), pa.array(np.full(len(which), w)), pa.array(which), pa.array(scores)],
                                             ["anchor", "window", "id", "score"])
    return run


def _first(rows, k, *keys):
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(anchors, limit):
    """Pages of anchors in groups of ``limit`` rows at most (one page at least)."""
    group, size = [], 0
    for r in anchors.select("part", "n").orderBy("label", "part").toLocalIterator():
        if group and size + r.n > limit:
            yield group
            group, size = [], 0
        group.append(r.part)
        size += r.n
    if group:
        yield group


def _load(anchors, parts, width):
    """Labels, ids, vectors, norms and angles of a block of anchors."""
    pages = [(r.label, read_page(r.n, r.wide, bytes(r.blob), width)) for r in anchors.where(F.col("part").isin(parts)).orderBy("label", "part").collect()]
    labels = np.concatenate([np.full(len(p[0]), label) for label, p in pages])
    return labels, *(np.concatenate([p[i] for _, p in pages]) for i in range(4))


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_negatives(vectors, every=100, positives=5, negatives=10, least=30, most=90, page=PAGE, block_bytes=BLOCK_BYTES):
    """Hard negatives of anchors: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: ``vec_id``, ``embedding``, ``label``; other columns are ignored. Anchors are
    rows whose id is divisible by ``every``. Scores are inner products of floor(256 x), higher
    ones first, ties by the smaller id; beyond the range of a long they end at its ends. For
    each of the first ``positives`` rows of the anchor's label come the first ``negatives`` rows
    of other labels whose score lies between ``least`` and ``most`` percent of the positive's.
    Null ids, labels and vectors and vectors with null or non-finite numbers take no part;
    shorter vectors count as padded with zeros. Equal rows count once; different rows with one
    id all take part, each such anchor by itself, but never partner a row with its own id.
    Without anchors or partners there are no rows. Directions are fitted to SAMPLE rows; they
    change the work, never the result.
    """
    spark = vectors.sparkSession
    given = vectors.where("vec_id is not null and embedding is not null and label is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    width = given.agg(F.max(F.size("embedding"))).first()[0] or 0
    read = persist_plan(given.mapInArrow(_reader(width), ROWS))
    sample = read.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).select("vector").toArrow().column("vector")
    directions = fit_directions(matrix(sample, width)) if len(sample) else np.zeros((0, width))
    placed = read.mapInArrow(_placer(directions, width), ROWS + ", near long, angle double")
    order = ["label", "near", "angle", "vec_id", "vector"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), read.count() // (64 * page))
    as_pages = lambda rows, n: rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_pager(directions, width, page), PAGES)
    path, anchor_path = scratch(spark, "pages"), scratch(spark, "anchors")
    as_pages(placed, parts).write.parquet(path)
    as_pages(placed.where(F.col("vec_id") % every == 0), 1 + parts // every).withColumn("part", F.monotonically_increasing_id()).write.parquet(anchor_path)
    pages, anchors = spark.read.parquet(path), spark.read.parquet(anchor_path)
    out = []
    for parts in _blocks(anchors, max(page, block_bytes // (8 * (width + 3 * DIRECTIONS)))):
        block = _load(anchors, parts, width)
        own = pages.where((F.col("label") >= int(block[0].min())) & (F.col("label") <= int(block[0].max())))
        near = _first(own.mapInArrow(_positives(block, positives, width), "anchor long, id long, score long"), positives, "anchor").toArrow()
        windows, rows = [[] for _ in block[0]], []
        for a, which, score in zip(*(near.column(c).to_pylist() for c in ("anchor", "id", "score"))):     # some anchors of one block
            window = (-(-least * score // 100), most * score // 100)
            if window[0] <= window[1]:
                if window not in windows[a]:
                    windows[a].append(window)
                rows.append((a, windows[a].index(window), int(block[1][a]), which, score))
        if not rows:
            continue
        asked = spark.createDataFrame(pa.table(dict(zip(("anchor", "window", "anchor_id", "positive_id", "positive_score"), zip(*rows)))))
        found = _first(pages.mapInArrow(_negatives(block, windows, negatives, width), "anchor long, window long, id long, score long"), negatives, "anchor", "window")
        path = scratch(spark, "negatives")
        found.join(asked, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                                                       F.col("score").alias("negative_score")).write.parquet(path)
        out.append(path)
    return reduce(lambda a, b: a.unionByName(b), [spark.read.schema(OUT).parquet(p) for p in out]) if out else spark.createDataFrame([], OUT)
