"""Named queries over the given tables, each with its comparison SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Dates between which the given tables lie (orders from 1995-01-01 to 2001-08-01).
AS_OF = "2001-06-01 00:00:00"
MIDDLE = "1998-06-01 00:00:00"


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
