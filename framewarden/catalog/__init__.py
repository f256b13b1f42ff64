"""Registered queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import check_sql, load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register ``fn(*inputs)`` under ``name``; inputs are the named views.

    ``sql`` is the check, written over the same view names.
    """

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[load(spark, sf_dir, v) for v in views])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = check_sql(sql, *views)
        return fn

    return keep


def load_all() -> None:
    from . import aggregates, composites, joins, ordering, rules, scalars, scans, windows  # noqa: F401
