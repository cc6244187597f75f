"""Registration of queries with their SQL, and access to the input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated query under its own name, with its DuckDB SQL if it has one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view_sql(name: str, columns: dict[str, str], source: str) -> str:
    """A named subquery whose expressions both dialects have; ``ARRAY_OF(...)`` makes a list."""
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})".replace("ARRAY_OF(", "list_value(")


def view(spark: SparkSession, sf_dir: str, columns: dict[str, str], source: str) -> DataFrame:
    """The same rows as ``view_sql`` gives, as a DataFrame."""
    return table(spark, sf_dir, source).selectExpr(*(f"{e} AS {c}".replace("ARRAY_OF(", "array(") for c, e in columns.items()))
