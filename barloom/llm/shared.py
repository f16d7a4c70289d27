"""Intermediate tables in the folder that all executors share; ``barloom.session.release`` removes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.session import fresh_copy, materialize


def place(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    return fresh_copy(spark, name)


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    return materialize(df, name, *partitions)
