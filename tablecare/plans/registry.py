"""Registry of named queries: a Spark callable ``(spark, sf_dir) → DataFrame``
plus, where the semantics are SQL-expressible, the DuckDB SQL text that
computes the same result over the same parquet tables (the oracle).

Every query reads whole driver tables (or views Spark derives from them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, operators: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with its SURVEY operator ids and the
    oracle SQL (None → rows-only check)."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPERATORS[name] = operators
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def load_all() -> None:
    """Import the query modules (each registers on import)."""
    from . import q_clean, q_explore, q_model, q_names, q_profile, q_sources, q_targets  # noqa: F401
