"""All registered queries, each with its SQL for the check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "venue_radius"


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query by its function's name. views: common table expressions that the SQL refers to."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(views)} {sql}" if views else sql).strip()
        return f

    return register

