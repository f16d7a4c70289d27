"""Content digests as columns (stable within this library)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.schemas import BAR_FIELDS


def digest(*parts: Column) -> Column:
    """SHA-256 of a JSON rendering; NULL parts are kept apart from empty ones."""
    named = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def instant_text(ts: Column) -> Column:
    return F.unix_micros(ts).cast("string")


def exact_double(value: Column) -> Column:
    """Shortest text that reads back as the same double; -0.0 as 0.0."""
    return (value + F.lit(0.0)).cast("string")


def bar_fingerprint() -> Column:
    """What a bar is; its source is provenance and not part of it."""
    return digest(
        F.lit("bar"), F.col("symbol"), F.col("interval"), instant_text(F.col("timestamp")),
        *[exact_double(F.col(f)) for f in BAR_FIELDS],
    )


def observation_key() -> Column:
    """One claim of one hypothesis about one bar; the state is not identity."""
    return digest(
        F.lit("observation"), F.col("symbol"), F.col("interval"), F.col("basis"), instant_text(F.col("timestamp")),
        F.col("hypothesis_id"), F.col("hypothesis_version").cast("string"), F.col("hypothesis_fingerprint"),
    )


def assessment_key() -> Column:
    return digest(
        F.lit("assessment"), F.col("symbol"), F.col("interval"), F.col("basis"), instant_text(F.col("timestamp")),
        F.col("policy_fingerprint"),
    )


def artifact_key() -> Column:
    return F.when(F.col("kind") == "assessment", assessment_key()).otherwise(observation_key())


def outcome_key() -> Column:
    return digest(
        F.lit("outcome"), F.col("artifact_key"), F.col("spec_fingerprint"), F.col("evaluation_version").cast("string")
    )


def short_hash(*parts: Column, length: int = 32) -> Column:
    return F.substring(digest(*parts), 1, length)
