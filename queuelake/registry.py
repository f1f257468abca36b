"""Named queries over the driver's tables, each with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function (spark, sf_dir) -> DataFrame."""

    def put(run):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, run, sql)
        return run

    return put
