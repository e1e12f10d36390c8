"""Registry of named queries: Spark plan + optional DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, operator: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``operator`` is the inventory id(s) it covers; ``oracle`` the DuckDB SQL
    over the driver's tables (None for rows-only checks).
    """

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPERATORS[name] = operator
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    from postlens.plans import (  # noqa: F401
        q_alerts,
        q_clean,
        q_demand,
        q_extract,
        q_match,
        q_nlp,
        q_reports,
        q_salary,
        q_search,
        q_trends,
    )
