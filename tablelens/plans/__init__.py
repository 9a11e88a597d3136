"""Registered queries: each is ``fn(spark, sf_dir) -> DataFrame`` over the
driver's tables, paired (where the answer is SQL-expressible) with the DuckDB
oracle text that must return the same rows."""

from tablelens.plans.registry import ORACLES, QUERIES, all_queries, all_oracles  # noqa: F401
