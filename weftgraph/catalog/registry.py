"""Queries by name, each with the DuckDB SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.graph_views import SQL as VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = False):
    """Registers a function (spark, sf_dir) under its name; ``views``: the SQL uses the views nodes and edges."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip().replace("{VIEWS}", VIEWS)
            ORACLES[f.__name__] = (f"with {VIEWS}, {body[5:]}" if body.startswith("with ") else f"with {VIEWS} {body}") if views else body
        return f

    return add
