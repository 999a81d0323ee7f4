"""The wide point-in-time feature table and its theme tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import rolling as R
from tidegauge.operators.axis import Axis
from tidegauge.operators.chunks import by_chunk, filled
from tidegauge.operators.joins import business_days
from tidegauge.operators.vintage import REF, REL, keep_first, latest_reference

# fixed values: columns that are keys or raw inputs, never features
NOT_FEATURES = (
    "id", "created_at", "date", "reference_date", "release_date", "date_orig", "reference_date_orig",
    "year_month_orig", "symbol", "series_id", "comparison_pair", "index_a_ticker", "index_b_ticker",
    "ratio_name", "numerator_ticker", "denominator_ticker", "high_yield_series_id",
    "investment_grade_series_id", "em_yield_series_id", "tbill_yield_series_id", "oil_symbol_for_ratio",
    "forecast_period", "source", "spread_type", "sp500_open", "sp500_high", "sp500_low", "sp500_close",
    "sp500_adjusted_close", "sp500_volume", "equity_call_volume", "equity_put_volume", "equity_total_volume")

HORIZON = 126
MOST_KEYS = 2000                 # that a pivot looks up


def feature_columns(df: DataFrame, also=()):
    return [c for c in df.columns if c not in NOT_FEATURES and c not in also]


def scan(df: DataFrame, filters: dict | None):
    """``WHERE k = v AND ...``; filters on absent columns are skipped."""
    for k, v in (filters or {}).items():
        if k in df.columns:
            df = df.where(F.col(k) == F.lit(v))
    return df


def labels_ahead(labels: DataFrame, state="regime_t", horizon=HORIZON, by=()):
    """Labels with the label ``horizon`` rows later; the last rows have none."""
    def ahead(d, a):
        return d.withColumn("regime_t_plus_6m", R.lead(a, state, horizon))
    return by_chunk(labels, Axis(tuple(by)), ahead, before=0, after=horizon, target_rows=None)


def pivot_named(df: DataFrame, key, values, name, date="date", keys=None):
    """Long to wide, mean on duplicates; ``name(value, key)`` names each column.

    Keys become columns, so more than MOST_KEYS of them are an error; pass ``keys`` where
    they are known to save the pass that looks them up.
    """
    if keys is None:
        keys = [r[0] for r in df.select(key).distinct().orderBy(key).limit(MOST_KEYS + 1).collect()]
        if len(keys) > MOST_KEYS:
            raise ValueError(f"{key} has more than {MOST_KEYS} values, too many to become columns")
    return df.groupBy(date).agg(*[
        F.avg(F.when(F.col(key) == k, F.col(v))).alias(name(v, k)) for k in keys for v in values])


def ratio_name(value, key):
    return f"{key.lower().replace(' ', '_')}_{value}"


def treasury_name(value, key):
    return f"tsy_spread_{key.lower().replace('-', '')}_{value}"


def stack_by_date(frames: dict, date="date"):
    """Daily frames (one row per date each) side by side, columns prefixed.

    They are stacked and grouped once: one shuffle for any number of tables.
    """
    parts = []
    for prefix, df in frames.items():
        parts.append(df.select(date, *[F.col(c).alias(prefix + c) for c in feature_columns(df, (date,))]))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.groupBy(date).agg(*[F.max(c).alias(c) for c in both.columns if c != date])


def latest_known(spine: DataFrame, vintages: dict, date="date"):
    """As-of join of many release tables to the spine in one pass.

    ``vintages``: prefix -> frame with reference_date, release_date and features. Each
    is first reduced to one row per release date; the stacked releases (at most one
    per table and day) are carried forward together.
    """
    parts, structs = [spine.select(F.col(date).alias("_t"), F.lit(1).alias("_side"))], {}
    for prefix, df in vintages.items():
        cols = feature_columns(df)
        row = F.struct(F.col(REF).alias(f"{prefix}ref_date"), *[F.col(c).alias(prefix + c) for c in cols])
        structs[prefix] = [f"{prefix}ref_date", *[prefix + c for c in cols]]
        parts.append(latest_reference(df, cols).select(
            F.col(REL).alias("_t"), F.lit(0).alias("_side"), row.alias(f"_r_{prefix}")))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    both = filled(both, Axis((), ("_t", "_side")), [f"_r_{p}" for p in vintages])
    cols = [F.col(f"_r_{p}")[c].alias(c) for p, cs in structs.items() for c in cs]
    return both.where("_side = 1").select(F.col("_t").alias(date), *cols)


def master_table(labels: DataFrame, daily: dict, vintages: dict, pivots, start=None, end=None,
                 filters: dict | None = None, keep_unlabelled=False):
    """Business-day spine <- labels <- daily tables <- as-of releases <- pivots.

    ``labels``: date, regime_t. ``daily`` and ``vintages``: prefix -> frame (filters by
    prefix); ``pivots``: frames already wide by date. Values dated on weekends reach
    the table through the as-of joins only. One row per business day of history.
    """
    filters = filters or {}
    labelled = labels_ahead(labels.select("date", "regime_t"))
    first = F.min("date") if start is None else F.greatest(F.min("date"), F.to_date(F.lit(start)))
    last = F.max("date") if end is None else F.to_date(F.lit(end))
    spine = business_days(labels.agg(first.alias("start"), last.alias("end")))
    tables = {}
    for prefix, df in daily.items():
        df = scan(df, filters.get(prefix))
        cols = feature_columns(df)
        tables[prefix] = keep_first(df.select("date", *cols), ["date"], cols)
    out = spine.join(labelled, "date", "left").join(stack_by_date(tables), "date", "left")
    releases = {p: scan(df, filters.get(p)) for p, df in vintages.items()}
    if releases:
        out = out.join(latest_known(spine, releases), "date", "left")
    for wide in pivots:
        out = out.join(wide, "date", "left")
    return out if keep_unlabelled else out.where("regime_t is not null")


def theme_table(master: DataFrame, columns, essential=("date", "regime_t", "regime_t_plus_6m")):
    """Essential columns, then the theme's columns that exist, in sorted order."""
    lead = [c for c in essential if c in master.columns]
    return master.select(*lead, *sorted(c for c in set(columns) if c in master.columns and c not in lead))


def complete_columns(df: DataFrame, expected: dict):
    """Exactly the expected columns (name -> type), absent ones as NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in expected.items()])


def informative_columns(df: DataFrame, threshold=1e-9):
    """Numeric columns that are not all NULL and vary; found in one pass."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in
               ("double", "float", "integer", "long", "short", "byte") or f.dataType.typeName().startswith("decimal")]
    row = df.agg(*[F.var_pop(c).alias(c) for c in numeric]).first()
    return [c for c in numeric if row[c] is not None and row[c] > threshold]


def drop_non_stationary(df: DataFrame, summary: DataFrame, verdict="overall_stationarity"):
    """Drop the columns a stationarity summary (one row per column) calls Non-Stationary."""
    bad = {r[0] for r in summary.where(F.col(verdict) == "Non-Stationary").select("column_name").collect()}
    return df.drop(*[c for c in df.columns if c in bad])
