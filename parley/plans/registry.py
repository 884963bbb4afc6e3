"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(views)`` under its name, with the SQL that gives the same rows if there is one."""

    def add(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return fn

    return add


from parley.plans import record_queries, scalar_queries, sequence_queries, voice_queries, workflow_queries  # noqa: E402, F401
