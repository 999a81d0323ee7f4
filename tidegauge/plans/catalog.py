"""All registered queries. Importing a query module registers its queries."""
from __future__ import annotations

import importlib

from tidegauge.plans.registry import ORACLE, QUERIES

MODULES = ["rolling_queries", "signal_queries", "vintage_queries", "table_queries", "evaluation_queries",
           "model_queries", "source_queries"]


def _load():
    for name in MODULES:
        importlib.import_module(f"tidegauge.plans.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
