"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

Every query reads whole tables (or what Spark derives from them); limits
appear only where they are the feature (top-k, sampling).  Scores are
rounded to 6 places on both sides and every order has an id tie-break.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}


def _load_all():
    # the query modules register themselves on import
    from . import q_retrieval, q_evaluate, q_text, q_mixture, q_composite, q_rules, q_stored  # noqa: F401
