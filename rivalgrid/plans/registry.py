"""Registered queries: a Spark callable, an output spec and, where SQL can say it, the same SQL.

The spec ("season:i pts:d ...") fixes the output columns on both sides: i bigint, d double
(rounded at the edge), n an integer or flag that may be NULL (as double), s string, b boolean. The rounding nudge keeps exact halves from falling
differently in two engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalgrid.plans.sql_views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_DIGITS = 6
_NUDGE = 3.137e-8  # off the grid of values rounded to nine digits, so those never become halves


def _spec(text: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in text.split()]


def finish(df: DataFrame, spec: str) -> DataFrame:
    def edge(name: str, kind: str):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "d":
            c = F.round(c.cast("double") + F.lit(_NUDGE), _DIGITS)
        elif kind == "n":
            c = c.cast("double")
        elif kind == "s":
            c = c.cast("string")
        elif kind == "b":
            c = c.cast("boolean")
        return c.alias(name)

    return df.select(*[edge(n, k) for n, k in _spec(spec)])


def finish_sql(sql: str, spec: str) -> str:
    def edge(name: str, kind: str) -> str:
        if kind == "i":
            return f"CAST({name} AS BIGINT) AS {name}"
        if kind == "d":
            return f"ROUND(CAST({name} AS DOUBLE) + {_NUDGE!r}, {_DIGITS}) AS {name}"
        if kind == "n":
            return f"CAST({name} AS DOUBLE) AS {name}"
        if kind == "s":
            return f"CAST({name} AS VARCHAR) AS {name}"
        return f"CAST({name} AS BOOLEAN) AS {name}"

    columns = ", ".join(edge(n, k) for n, k in _spec(spec))
    return f"SELECT {columns} FROM (\n{sql.strip()}\n) AS answer"


def query(name: str, spec: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir), spec)
        if sql is not None:
            SQL[name] = finish_sql(sql, spec)
        return fn

    return register


def sql_texts() -> dict[str, str]:
    """Every query's SQL with the views it needs; called once all blocks are loaded."""
    return {name: with_views(sql) for name, sql in SQL.items()}
