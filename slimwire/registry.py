"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per operator,
with the equivalent DuckDB SQL where one exists.

Every query reads the given parquet tables (or views Spark derives from them) in
full; limits appear only where they are the feature (ring buffer, recent-N).
Column names and types are aligned with the oracle: integers BIGINT, reals DOUBLE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from slimwire.plans import (queries_context, queries_core, queries_ingest,  # noqa: F401
                                queries_stages, queries_state, queries_stream, queries_upkeep)
