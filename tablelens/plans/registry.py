"""Query registry shared by ``__spark_entry__``, ``bench.py`` and the tests."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MODULES = [
    "tablelens.plans.profile_queries",
    "tablelens.plans.agg_queries",
    "tablelens.plans.clean_queries",
    "tablelens.plans.sample_queries",
    "tablelens.plans.feature_queries",
    "tablelens.plans.stats_queries",
    "tablelens.plans.eval_queries",
    "tablelens.plans.text_queries",
    "tablelens.plans.similar_queries",
    "tablelens.plans.series_queries",
    "tablelens.plans.survival_queries",
    "tablelens.plans.recipe_queries",
    "tablelens.plans.chart_queries",
    "tablelens.plans.model_queries",
    "tablelens.plans.edge_queries",
]


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def _shipping(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tablelens.session import ensure_shipped
        ensure_shipped(spark)  # workers import tablelens for the pandas UDFs
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _shipping(fn) for name, fn in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
