"""Helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
