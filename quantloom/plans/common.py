"""Registration of queries and the rounding that makes doubles of two engines compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with its DuckDB twin."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """``df`` with columns rounded, and no negative zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def r(expr: str, name: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"
