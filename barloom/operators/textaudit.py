"""Audits of written text: boundary vocabulary and cited evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.text import boundary_term


def boundary_audit(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows with the first forbidden term they contain (NULL when none)."""
    return docs.withColumn("boundary_term", boundary_term(F.col(text)))


def ungrounded(citations: DataFrame, evidence: DataFrame, ids: str = "evidence_ids") -> DataFrame:
    """Cited ids that the evidence does not contain."""
    flat = citations.select(*[c for c in citations.columns if c != ids], F.explode(ids).alias("evidence_id"))
    return flat.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti")
