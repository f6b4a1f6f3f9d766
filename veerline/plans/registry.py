"""Registry of named queries (Spark) and their DuckDB oracle SQL.

Each query takes (spark, sf_dir) and returns a lazy DataFrame over the fixture tables. The oracle
SQL, when given, runs in DuckDB over the same tables registered as views and must return the
same columns (names and values)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query under ``name``; ``sql`` is its DuckDB oracle (None = rows-only check)."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


def load_all() -> None:
    """Import every plan module so that its queries are registered."""
    from veerline.plans import (  # noqa: F401
        boost_queries,
        docs_queries,
        eval_queries,
        flow_queries,
        io_queries,
        model_queries,
        neighbour_queries,
        sampling_queries,
        subword_queries,
        text_queries,
        timeline_queries,
        vector_queries,
    )
