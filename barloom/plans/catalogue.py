"""All registered queries."""

from barloom.plans import queries_bars, queries_documents, queries_features, queries_ledger, queries_rows, queries_streaming, queries_study  # noqa: F401
from barloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
