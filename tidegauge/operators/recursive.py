"""Exponential smoothing, the one window family that is recursive.

``y = (d * y_before + a * x) / (d + a)`` with ``d = (1 - a) ** rows since the last
observation``; the first observation seeds it. A row without an observation keeps the last y.

Windows cannot recur, so a series is cut into parts of a year (or some hundred rows), each an
array. One fold over the parts finds the state each begins with, and every part is replayed from
its state, all in built-in expressions and step by step as the formula is written. A series that
is too long for one task is cut into chunks first: a chunk maps the y it gets to
``slope * y + level``, those maps are composed, one entry per chunk, and the chunks are then
folded side by side.
"""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F, types as T

from tidegauge.operators.axis import Axis
from tidegauge.operators.chunks import CHUNK, TARGET_ROWS, by_years, hot_rows, lay_out

PART_ROWS = 366                  # of a part on other axes than days


def span(n):
    return 2.0 / (n + 1)


def wilder(n):
    return 1.0 / n


def smooth(df: DataFrame, ax: Axis, specs: dict, long_series=False, target_rows=None) -> DataFrame:
    """Add ``out`` columns; ``specs`` maps out -> (column, alpha, least observations).

    Series ordered by a date are bounded by the calendar and folded whole; others, and all
    with ``long_series=True``, are sized, and those of more than ``target_rows`` rows are cut.
    A time axis without a key is cut by years.
    """
    lay = lay_out(df, ax, target_rows or (TARGET_ROWS if long_series else None)) if ax.by else by_years(df, ax)
    names = {o: f"_{i}" for i, o in enumerate(specs)}
    series = _folded(lay)
    begin = {n: NOTHING for n in names.values()}
    if lay.hot:
        series = series.join(F.broadcast(_starts(lay, specs, names)), [*ax.by, CHUNK], "left")
        begin = {n: f"coalesce({n}_in, {NOTHING})" for n in begin}
    begin = _struct(begin)
    after = _struct({n: _after(f"s.{n}", *specs[o][:2]) for o, n in names.items()})
    states = f"""aggregate(_parts, named_struct('now', {begin}, 'all', filter(array({begin}), x -> false)),
      (acc, p) -> named_struct('now', aggregate(p.rows, acc.now, (s, r) -> {after}), 'all', concat(acc.all, array(acc.now))), acc -> acc.all)"""
    parts = series.select(*ax.by, F.expr(f"explode(arrays_zip(_parts, {states})) as _z")).select(*ax.by, "_z._parts.rows", F.col("_z.1").alias("_begin"))

    values = _struct({n: f"if(t.{n}.n >= {specs[o][2]}, t.{n}.y, null)" for o, n in names.items()})
    none = _struct({n: "cast(null as double)" for n in names.values()})
    replayed = f"""aggregate(rows, named_struct('now', _begin, 'all', filter(array({none}), x -> false)),
      (acc, r) -> transform(array(transform(array(acc.now), s -> {after})[0]), t -> named_struct('now', t, 'all', concat(acc.all, array({values}))))[0], acc -> acc.all)"""
    rows = parts.select(*ax.by, F.expr(f"explode(arrays_zip(rows, {replayed})) as _z"))
    kept = {c: F.col(f"`{c}`") if c in ax.by else F.col(f"_z.rows.`{c}`") for c in df.columns if c not in specs}
    return rows.select(*[v.alias(c) for c, v in kept.items()], *[F.col(f"_z.1.{n}").alias(o) for o, n in names.items()])


# Expressions are SQL texts here: nested lambdas are many calls each when built as columns.

#: State before the first observation: y, decay since the last observation, number of observations.
NOTHING = "named_struct('y', cast(null as double), 'd', 1D, 'n', 0L)"


def _struct(fields):
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _observed(col):
    return f"nullif(cast(r.`{col}` as double), double('NaN'))"


def _after(s, col, alpha):
    """State ``s`` after row ``r``."""
    x, d, a = _observed(col), f"{s}.d * {1 - alpha!r}D", f"{float(alpha)!r}D"
    seen = _struct({"y": f"if({s}.y is null or {s}.y = {x}, {x}, ({d} * {s}.y + {a} * {x}) / ({d} + {a}))", "d": "1D", "n": f"{s}.n + 1L"})
    return f"if({x} is null, " + _struct({"y": f"{s}.y", "d": f"if({s}.y is null, 1D, {d})", "n": f"{s}.n"}) + f", {seen})"


def _folded(lay):
    """The rows of a series (or chunk) in order, as an array of parts that are arrays of rows."""
    df, ax = lay.df, lay.ax
    if isinstance(df.schema[ax.order[0]].dataType, T.DateType):
        df = df.withColumn("_part", F.year(ax.order[0]))
    else:
        df = df.withColumn("_part", F.floor((F.row_number().over(lay.local.base()) - 1) / PART_ROWS))
    group = [*ax.by, CHUNK]
    payload = [*ax.order, *[c for c in df.columns if c not in (*group, *ax.order, "_part")]]
    parts = df.groupBy(*group, "_part").agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in payload]))).alias("rows"))
    return parts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_part", "rows"))).alias("_parts"))


# -- cut series --------------------------------------------------------------

def _starts(lay, specs, names):
    """State at the start of every chunk of a cut series; there are 2 * MAX_CUTS chunks at most."""
    by = list(lay.ax.by)
    chunks = _folded(replace(lay, df=hot_rows(lay)))
    lines = chunks.withColumn("_rows", F.expr("flatten(transform(_parts, p -> p.rows))")).select(
        *by, CHUNK, *[F.expr(_line(*specs[o][:2])).alias(n) for o, n in names.items()])
    series = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(CHUNK, *names.values()))).alias("_lines"))
    begins = ", ".join(_begins(specs[o][1], n) for o, n in names.items())
    rows = series.select(*by, F.expr(f"explode(arrays_zip(_lines, {begins})) as _z"))
    return rows.select(*by, F.col(f"_z._lines.{CHUNK}").alias(CHUNK), *[F.col(f"_z.{i}").alias(f"{n}_in") for i, n in enumerate(names.values(), 1)])


def _line(col, alpha):
    """What a chunk does: decay up to its first observation, that one, slope and level from there on, decay after the last, observations."""
    x, d, a = _observed(col), f"s.d * {1 - alpha!r}D", f"{float(alpha)!r}D"
    as_was = {c: f"s.{c}" for c in ("lead", "seed", "slope", "level", "d", "n")}
    seeded = _struct({"lead": d, "seed": x, "slope": "1D", "level": "0D", "d": "1D", "n": "s.n + 1L"})
    moved = _struct(as_was | {"slope": f"{d} * s.slope / ({d} + {a})", "level": f"({d} * s.level + {a} * {x}) / ({d} + {a})", "d": "1D", "n": "s.n + 1L"})
    zero = _struct({"lead": "1D", "seed": "cast(null as double)", "slope": "1D", "level": "0D", "d": "1D", "n": "0L"})
    return f"aggregate(_rows, {zero}, (s, r) -> if({x} is null, {_struct(as_was | {'d': d})}, if(s.seed is null, {seeded}, {moved})))"


def _begins(alpha, n):
    """The states that the chunks of a series begin with."""
    s, c, a = "acc.now", f"p.{n}", f"{float(alpha)!r}D"
    d = f"{s}.d * {c}.lead"
    first = f"if({s}.y is null, {c}.seed, ({d} * {s}.y + {a} * {c}.seed) / ({d} + {a}))"
    after = f"if({c}.seed is null, " + _struct({"y": f"{s}.y", "d": f"if({s}.y is null, 1D, {s}.d * {c}.d)", "n": f"{s}.n"}) + ", " + \
        _struct({"y": f"{c}.slope * {first} + {c}.level", "d": f"{c}.d", "n": f"{s}.n + {c}.n"}) + ")"
    return f"""aggregate(_lines, named_struct('now', {NOTHING}, 'all', filter(array({NOTHING}), x -> false)),
      (acc, p) -> named_struct('now', {after}, 'all', concat(acc.all, array(acc.now))), acc -> acc.all)"""
