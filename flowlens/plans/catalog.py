"""Query catalogue: one Spark builder and (where SQL can say it) one oracle SQL per key.

Every query reads the given tables (through ``plans.fixtures``) and runs over
all of their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from flowlens.plans import (q_curves, q_encode, q_feedback, q_io, q_models,  # noqa: F401
                                q_profile, q_rows, q_scorers, q_split, q_text)
