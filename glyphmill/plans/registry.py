"""A query is a function of (spark, sf_dir) and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def inline(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """Rows as a table that takes no Python on the executors; its SQL twin is `VALUES` with values(rows)."""
    return spark.sql(f"SELECT * FROM VALUES {values(rows)} AS t({names})")


def values(rows: list[tuple]) -> str:
    """Rows as a VALUES list that both dialects read."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
