"""Registry of named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, if given, SQL with the same result."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(value: Column, digits: int = 6) -> Column:
    """Comparable double: rounded, without negative zero."""
    return F.when(F.abs(value) < 0.5 * 10**-digits, F.lit(0.0)).otherwise(F.round(value, digits))


def rounded_sql(value: str, digits: int = 6) -> str:
    return f"(CASE WHEN abs({value}) < {0.5 * 10**-digits!r} THEN 0.0 ELSE round({value}, {digits}) END)"


def clock(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def clock_sql(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"
