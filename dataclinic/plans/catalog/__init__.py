"""Registry of the queries exposed through ``__spark_entry__``.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` plus, where the
operator is SQL-expressible, the DuckDB oracle text over the same tables.
"""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    from . import profiling, injection, quality, advice, repairs, trajectories, runlogs, examples, models, streams  # noqa: F401
    return QUERIES, ORACLE
