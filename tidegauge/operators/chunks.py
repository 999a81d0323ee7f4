"""Splitting long series so that no window runs in one task.

A window is sorted and scanned by one task per partition. Daily series are short
(366 rows a year), but a tick series, or a pile of scores ranked per class, may hold
a third of all rows in one group. Here such *hot* groups are cut into chunks of
consecutive rows. Windows then run per chunk:

* bounded frames read their first rows from copies of the preceding chunk's tail
  (``with_halo``);
* unbounded frames run inside the chunk and add what the earlier chunks hand over
  (``running_sum``, ``positions``, ``fill_forward``, ...), which is one row per chunk.

Cut points come from a mergeable quantile sketch. Any cut points give exact
results; good ones only balance the tasks. They are fetched to the driver once (at
most ``2 * MAX_CUTS`` values in all, whatever the data size) and put back into the
plan as constants, so that re-run tasks after an executor loss see the same chunks.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidegauge.operators.axis import Axis
from tidegauge.session import persist_plan

TARGET_ROWS = 1_000_000
MAX_CUTS = 4096
CHUNK = "_chunk"


@dataclass(frozen=True)
class Layout:
    """Rows with their chunk number. ``cuts`` is None when no group is hot.

    ``every``: all groups are cut, at the same places.
    """

    df: DataFrame
    ax: Axis
    cuts: DataFrame | None = None
    every: bool = False

    @property
    def hot(self):
        return self.cuts is not None or self.every

    @property
    def local(self) -> Axis:
        return self.ax.within(CHUNK)

    def done(self, df):
        return df.drop(CHUNK)


def lay_out(df: DataFrame, ax: Axis, target_rows=TARGET_ROWS) -> Layout:
    """Cut every group of more than ``target_rows`` rows on its first order column.

    Rows that share that column's value stay together; make them one row first.
    ``target_rows=None`` takes groups ordered by a date as they are, without a pass that
    sizes them: the calendar bounds them, whatever the data; others are cut as usual.
    """
    if target_rows is None:
        if isinstance(df.schema[ax.order[0]].dataType, T.DateType):
            return Layout(df.withColumn(CHUNK, F.lit(0)), ax)
        target_rows = TARGET_ROWS
    by = list(ax.by)

    def sized(rows):
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    total, most = sized(df).agg(F.sum("_n"), F.max("_n")).first()
    limit = max(target_rows, math.ceil((total or 0) / MAX_CUTS))
    if most is None or most <= limit:
        return Layout(df.withColumn(CHUNK, F.lit(0)), ax)

    # the rows are read several times from here on: write them once, so that a costly
    # plan is not repeated and every pass sees the same rows
    df = persist_plan(df)
    hot = sized(df).where(F.col("_n") > limit)
    first = F.col(ax.order[0])
    pieces = math.ceil(most / limit)
    grid = [i / pieces for i in range(1, pieces)]
    wanted = F.ceil(F.col("_n") / limit).cast("int")
    thinned = F.transform(
        F.sequence(F.lit(1), wanted - 1),
        lambda i: F.element_at(
            "_grid", F.greatest(F.lit(1), (i * pieces / wanted).cast("int"))))
    rows = (df.join(F.broadcast(hot), by)                  # < MAX_CUTS groups are hot
              .groupBy(*by, "_n")
              .agg(F.percentile_approx(first, grid, 2000).alias("_grid"))
              .select(*by, F.array_distinct(thinned).alias("_cuts")))
    cuts = df.sparkSession.createDataFrame(rows.collect(), rows.schema)
    # the number of cuts at or before the row, found by halving: a step is a column of its own
    marked = df.join(F.broadcast(cuts), by, "left").withColumn(CHUNK, F.lit(0))
    for step in (1 << i for i in reversed(range(pieces.bit_length()))):
        beyond = F.get("_cuts", F.col(CHUNK) + (step - 1)) <= first
        marked = marked.withColumn(CHUNK, F.col(CHUNK) + F.when(beyond, step).otherwise(0))
    return Layout(marked.drop("_cuts"), ax, cuts)


def by_years(df: DataFrame, ax: Axis) -> Layout:
    """Every series cut at the turns of the years of its date.

    The cut of a time axis that no column splits further: its years are scanned side by
    side, and what a year hands over is one row of a table with one row a year.
    """
    return Layout(df.withColumn(CHUNK, F.coalesce(F.year(ax.order[0]), F.lit(-9999))), ax, every=True)


def filled(df: DataFrame, ax: Axis, columns) -> DataFrame:
    """``columns`` filled forward along the axis; one without a key is scanned by years."""
    if ax.by:
        return df.withColumns({c: F.last(c, True).over(ax.past()) for c in columns})
    lay = by_years(df, ax)
    return lay.done(fill_forward(lay, {c: F.col(f"`{c}`") for c in columns}))


def hot_rows(lay: Layout) -> DataFrame:
    """The rows of the groups that were cut."""
    if lay.every:
        return lay.df
    return lay.df.join(F.broadcast(lay.cuts.select(*lay.ax.by)), list(lay.ax.by), "left_semi")


def _handed_over(lay: Layout, summary: DataFrame, carried: dict) -> DataFrame:
    """Attach to each row what earlier chunks of its group pass on.

    ``summary`` has one row per chunk of a hot group (at most 2 * MAX_CUTS rows plus
    one per group), so it fits in a broadcast.
    """
    by = list(lay.ax.by)
    before = (Window.partitionBy(*by or [F.lit(0)]).orderBy(CHUNK)
              .rowsBetween(Window.unboundedPreceding, -1))
    small = summary.select(*by, CHUNK, *[fn(before).alias(n) for n, fn in carried.items()])
    return lay.df.join(F.broadcast(small), [*by, CHUNK], "left")


def _sorted_key(ax):
    return F.struct(*ax.order)


def running_sum(lay: Layout, sums: dict) -> DataFrame:
    """``out -> column``: cumulative sums along the axis."""
    local = {o: F.sum(x).over(lay.local.past()) for o, x in sums.items()}
    if not lay.hot:
        return lay.df.withColumns(local)
    part = (hot_rows(lay).groupBy(*lay.ax.by, CHUNK)
            .agg(*[F.sum(x).alias(o) for o, x in sums.items()]))
    df = _handed_over(lay, part, {
        f"_in_{o}": (lambda w, o=o: F.sum(o).over(w)) for o in sums})
    df = df.withColumns(local)
    # no value seen yet stays NULL; otherwise a missing side counts as 0
    add = {o: F.when(F.col(o).isNotNull() | F.col(f"_in_{o}").isNotNull(),
                     F.coalesce(F.col(o), F.lit(0)) + F.coalesce(F.col(f"_in_{o}"), F.lit(0)))
           for o in sums}
    return df.withColumns(add).drop(*[f"_in_{o}" for o in sums])


def positions(lay: Layout, out="_pos") -> DataFrame:
    """1-based row number along the axis."""
    df = running_sum(lay, {out: F.lit(1)})
    return df.withColumn(out, F.col(out).cast("long"))


def running_min(lay: Layout, out, x) -> DataFrame:
    local = F.min(x).over(lay.local.past())
    if not lay.hot:
        return lay.df.withColumn(out, local)
    part = hot_rows(lay).groupBy(*lay.ax.by, CHUNK).agg(F.min(x).alias("_m"))
    df = _handed_over(lay, part, {"_in": lambda w: F.min("_m").over(w)})
    df = df.withColumn(out, local)
    return df.withColumn(out, F.least(out, "_in")).drop("_in")


def fill_forward(lay: Layout, outs: dict) -> DataFrame:
    """``out -> column``: the latest non-NULL value up to and including each row."""
    local = {o: F.last(x, True).over(lay.local.past()) for o, x in outs.items()}
    if not lay.hot:
        return lay.df.withColumns(local)
    key = _sorted_key(lay.ax)
    part = (hot_rows(lay).groupBy(*lay.ax.by, CHUNK)
            .agg(*[F.max_by(x, F.when(_c(x).isNotNull(), key)).alias(o) for o, x in outs.items()]))
    df = _handed_over(lay, part, {
        f"_in_{o}": (lambda w, o=o: F.last(o, True).over(w)) for o in outs})
    df = df.withColumns(local)
    return (df.withColumns({o: F.coalesce(F.col(o), F.col(f"_in_{o}")) for o in outs})
              .drop(*[f"_in_{o}" for o in outs]))


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def with_halo(lay: Layout, before: int, after: int = 0) -> DataFrame:
    """Every chunk plus copies of its ``before`` previous and ``after`` next rows.

    Copies carry ``_halo = true``. Which chunks need a row is decided by its exact
    position, so a frame may even span several short chunks.
    """
    if not lay.hot:
        return lay.df.withColumn("_halo", F.lit(False))
    by = list(lay.ax.by)
    df = positions(lay, "_pos")
    ends = (hot_rows(lay).groupBy(*by, CHUNK).agg(F.count(F.lit(1)).alias("_n")))
    upto = Window.partitionBy(*by or [F.lit(0)]).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    spans = (ends.withColumn("_to", F.sum("_n").over(upto))
             .groupBy(*by)
             .agg(F.collect_list(F.struct(
                 F.col(CHUNK).alias("c"), (F.col("_to") - F.col("_n") + 1).alias("lo"),
                 F.col("_to").alias("hi"))).alias("_spans")))    # one entry per chunk
    df = df.join(F.broadcast(spans), by, "left") if by else df.withColumn("_spans", spans.scalar())
    pos = F.col("_pos")
    wanted = F.filter("_spans", lambda s: (s["lo"] - before <= pos) & (pos <= s["hi"] + after))
    homes = F.when(F.col("_spans").isNotNull(), F.transform(wanted, lambda s: s["c"])) \
             .otherwise(F.array(F.col(CHUNK)))
    return (df.withColumn("_home", F.explode(homes))
              .withColumn("_halo", F.col("_home") != F.col(CHUNK))
              .withColumn(CHUNK, F.col("_home"))
              .drop("_home", "_pos", "_spans"))


def by_chunk(df: DataFrame, ax: Axis, build, before: int, after: int = 0, fill=(),
             target_rows=TARGET_ROWS) -> DataFrame:
    """Run ``build(df, axis)`` over long series; an axis without a key is cut by years.

    ``before`` and ``after`` are the rows its frames (all steps together) look at.
    ``build`` must pass ``axis.keys`` through. Columns it fills forward are named in
    ``fill``: they are filled here, across chunks, as ``_f_<column>``.
    """
    lay = lay_out(df, ax, target_rows) if ax.by else by_years(df, ax)
    if not lay.hot:
        return build(df, ax)
    if fill:
        lay = replace(lay, df=fill_forward(lay, {f"_f_{c}": F.col(c) for c in fill}))
    out = build(with_halo(lay, before, after), lay.local.carrying("_halo"))
    return out.where(~F.col("_halo")).drop("_halo", CHUNK)


def cumulative_by(df: DataFrame, by, order, weights: dict, target_rows=TARGET_ROWS) -> DataFrame:
    """Cumulative sums over a frame already reduced to one row per ``by + order``.

    ``target_rows=None`` says that groups are known to be short (one row per date, say)
    and saves the pass that sizes them.
    """
    ax = Axis(tuple(by), tuple(order))
    if target_rows is None:
        return df.withColumns({o: F.sum(x).over(ax.past()) for o, x in weights.items()})
    lay = lay_out(df, ax, target_rows)
    return lay.done(running_sum(lay, weights))


def join_keys(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Inner join on ``by`` in which NULL keys meet; the keys stay once."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in by})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by]
    return left.join(right, on).drop(*[f"_r_{k}" for k in by]) if by else left.crossJoin(right)


def percentiles(df: DataFrame, by, value, at: dict, target_rows=TARGET_ROWS) -> DataFrame:
    """Exact percentiles with linear interpolation: ``out -> fraction``.

    Values are counted first, then placed by their cumulative count; no task ever
    holds a whole group, unlike the built-in exact ``percentile``.
    """
    by = list(by)
    counts = (df.where(F.col(value).isNotNull())
                .groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_w")))
    ax = Axis(tuple(by), ("_v",))
    lay = lay_out(counts, ax, target_rows) if target_rows is not None else Layout(counts.withColumn(CHUNK, F.lit(0)), ax)
    totals = lay.df.groupBy(*by).agg(F.sum("_w").alias("_total"))
    placed = join_keys(lay.done(running_sum(lay, {"_upto": F.col("_w")})), totals, by)
    aggs = []
    for out, q in at.items():
        spot = (F.col("_total") - 1) * F.lit(float(q))          # 0-based rank
        low, high = F.floor(spot) + 1, F.ceil(spot) + 1

        def at_rank(rank):
            inside = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_w") < rank)
            return F.max(F.when(inside, F.col("_v")))
        share = F.max(spot - F.floor(spot))
        aggs.append((at_rank(low) * (1 - share) + at_rank(high) * share).alias(out))
    return placed.groupBy(*by).agg(*aggs)
