"""Registry of named queries: a Spark plan and (when deterministic) its SQL oracle.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the driver
tables of that folder.  The oracle string is DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lucerna.plans.fixtures import Views


@dataclass
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None
    ids: str  # SURVEY operator ids covered


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def deco(fn: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn
    return deco


def _load_all() -> None:
    # importing the modules fills REGISTRY
    from lucerna.plans import (queries_consensus, queries_explain,  # noqa: F401
                               queries_metrics, queries_models, queries_prep,
                               queries_results, queries_sample)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def bind(q: Query):
        return lambda spark, sf_dir: q.build(Views(spark, sf_dir))
    return {n: bind(q) for n, q in sorted(REGISTRY.items())}


def oracle_queries() -> dict[str, str]:
    _load_all()
    return {n: q.sql for n, q in sorted(REGISTRY.items()) if q.sql}
