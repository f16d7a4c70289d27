"""Ensemble assessments: several hypotheses' observations at one market point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.definitions import Policy
from barloom.schemas import BEARISH, BULLISH, CONFLICTED, INSUFFICIENT, NEUTRAL, SERIES_KEY

POINT = (*SERIES_KEY, "timestamp")

# --- fixed values: reason codes in reporting order --------------------------
REASON_ORDER = (
    "unanimous_bullish", "unanimous_bearish", "unanimous_neutral", "directional_bullish_with_neutral",
    "directional_bearish_with_neutral", "conflicting_directional_evidence", "insufficient_evidence",
    "insufficient_inputs_excluded",
)


def ensemble_state(bullish: Column, bearish: Column, neutral: Column, minimum: int) -> Column:
    """Direction wins over neutral; two directions conflict; too few is insufficient."""
    return (
        F.when(bullish + bearish + neutral < minimum, INSUFFICIENT)
        .when((bullish > 0) & (bearish > 0), CONFLICTED)
        .when(bullish > 0, BULLISH)
        .when(bearish > 0, BEARISH)
        .otherwise(NEUTRAL)
    )


def ensemble_reasons(state: Column, neutral: Column, insufficient: Column) -> Column:
    main = F.lit(None).cast("string")
    main = F.when(state == INSUFFICIENT, "insufficient_evidence")
    main = main.when(state == CONFLICTED, "conflicting_directional_evidence")
    for s in (BULLISH, BEARISH):
        main = main.when((state == s) & (neutral == 0), f"unanimous_{s}").when(state == s, f"directional_{s}_with_neutral")
    main = main.otherwise("unanimous_neutral")
    return F.array_compact(F.array(main, F.when(insufficient > 0, "insufficient_inputs_excluded")))


def ordered_codes(codes: Column, order: tuple[str, ...] = REASON_ORDER) -> Column:
    """The given codes in canonical order."""
    return F.filter(F.array(*[F.lit(c) for c in order]), lambda c: F.array_contains(codes, c))


def ensemble_issues(observations: DataFrame, policy: Policy) -> DataFrame:
    """Missing, unexpected, re-parameterised and duplicate members per point."""
    spark = observations.sparkSession
    members = spark.createDataFrame(list(policy.members), "hypothesis_id string, version int, fingerprint string")
    pinned = F.broadcast(members.withColumnRenamed("fingerprint", "pinned"))
    identity = ["hypothesis_id", "version", "fingerprint"]
    cols = [*POINT, *identity]
    named = observations.select(*cols).join(pinned, ["hypothesis_id", "version"], "left")
    wrong = (
        F.when(F.col("pinned").isNull(), "unexpected_hypothesis")
        .when(F.col("pinned") != F.col("fingerprint"), "fingerprint_mismatch")
    )
    bad = named.withColumn("issue", wrong).filter("issue IS NOT NULL").select(*cols, "issue")
    twice = (
        observations.groupBy(*cols).count().filter("count > 1").select(*cols, F.lit("duplicate_hypothesis").alias("issue"))
    )
    expected = observations.select(*POINT).distinct().crossJoin(F.broadcast(members))
    missing = expected.join(observations.select(*cols), cols, "left_anti").select(
        *cols, F.lit("missing_hypothesis").alias("issue")
    )
    return bad.unionByName(twice).unionByName(missing)


def assess(observations: DataFrame, policy: Policy) -> DataFrame:
    """One assessment per market point (members are bounded by the policy)."""
    state = F.col("state")
    grouped = observations.groupBy(*POINT).agg(
        *[F.count_if(state == s).alias(n) for s, n in
          ((BULLISH, "bullish_count"), (BEARISH, "bearish_count"), (NEUTRAL, "neutral_count"), (INSUFFICIENT, "insufficient_count"))],
        F.max("evaluable_from").alias("assessment_as_of"),
        F.sort_array(F.collect_list(F.struct("hypothesis_id", "version", "fingerprint", "state"))).alias("inputs"),
    )
    b, r, n, i = (F.col(f"{s}_count") for s in ("bullish", "bearish", "neutral", "insufficient"))
    out = grouped.withColumn("state", ensemble_state(b, r, n, policy.minimum_sufficient))
    return out.withColumns(
        {
            "reason_codes": ensemble_reasons(F.col("state"), n, i),
            "policy_fingerprint": F.lit(policy.fingerprint),
        }
    )
