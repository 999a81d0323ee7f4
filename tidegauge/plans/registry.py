"""Registry of named queries and their SQL twins."""
from __future__ import annotations

from tidegauge.plans.views import with_views

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, sql=None, views=(), extra=None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its DuckDB twin."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = (with_views(*views, extra=extra) if views or extra else "") + sql
        return fn
    return register
