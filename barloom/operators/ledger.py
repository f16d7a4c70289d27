"""Append-only claims and their outcomes: registration, maturation, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.definitions import OutcomeSpec
from barloom.functions.identity import artifact_key, bar_fingerprint, digest, outcome_key
from barloom.functions.times import new_york_date
from barloom.operators.layout import AUTO, Layout, arrange, placed
from barloom.operators.outcomes import forward_columns, outcome_structs, rows_ahead
from barloom.operators.quality import finite
from barloom.operators.stats import describe, fraction, null_safe
from barloom.schemas import EVALUATED, INSUFFICIENT, SERIES_KEY

EVALUATION_VERSION = 1
SAMPLE_FLOOR = 20
POINT = ("symbol", "interval", "basis", "timestamp")
PRODUCER = ("kind", "hypothesis_id", "hypothesis_version", "hypothesis_fingerprint", "policy_fingerprint")
# content that must agree when a key is seen again; the recording clock is the ledger's
CLAIM_CONTENT = (
    *POINT, *PRODUCER, "state", "reason_codes", "source", "data_cutoff", "observation_bar_fingerprint", "origin",
)


def claim_digest() -> Column:
    return digest(*[F.col(c).cast("string") if c not in ("reason_codes",) else F.array_join(c, ",") for c in CLAIM_CONTENT])


def claims_from_observations(
    observations: DataFrame, bars: DataFrame, recorded_at: Column, origin: str = "prospective"
) -> DataFrame:
    """Hypothesis claims about observed bars, with keys and bar fingerprints."""
    key = [*SERIES_KEY, "timestamp"]
    printed = bars.select(*key, bar_fingerprint().alias("observation_bar_fingerprint"))
    rows = observations.join(printed, key).select(
        F.lit("observation").alias("kind"), "symbol", "interval", "basis", "timestamp", "state", "reason_codes", "source",
        F.col("timestamp").alias("data_cutoff"), recorded_at.alias("recorded_at"), "observation_bar_fingerprint",
        F.lit(origin).alias("origin"), "hypothesis_id", F.col("version").alias("hypothesis_version"),
        F.col("fingerprint").alias("hypothesis_fingerprint"), F.lit(None).cast("string").alias("policy_fingerprint"),
    )
    return rows.withColumn("artifact_key", artifact_key())


def claims_from_assessments(
    assessments: DataFrame, bars: DataFrame, recorded_at: Column, origin: str = "prospective"
) -> DataFrame:
    key = [*SERIES_KEY, "timestamp"]
    printed = bars.select(*key, bar_fingerprint().alias("observation_bar_fingerprint"))
    rows = assessments.join(printed, key).select(
        F.lit("assessment").alias("kind"), "symbol", "interval", "basis", "timestamp", "state", "reason_codes", "source",
        F.col("timestamp").alias("data_cutoff"), recorded_at.alias("recorded_at"), "observation_bar_fingerprint",
        F.lit(origin).alias("origin"), F.lit(None).cast("string").alias("hypothesis_id"),
        F.lit(None).cast("int").alias("hypothesis_version"), F.lit(None).cast("string").alias("hypothesis_fingerprint"),
        "policy_fingerprint",
    )
    return rows.withColumn("artifact_key", artifact_key())


def register(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Status of each incoming key: written, duplicate or conflict.

    One row per key. Copies of a key inside the batch must agree; a held key is
    compared by content, never by its recording clock.
    """
    content = claim_digest()
    batch = incoming.withColumn("_digest", content).groupBy("artifact_key").agg(
        F.min("_digest").alias("_low"), F.max("_digest").alias("_high"), F.count(F.lit(1)).alias("sightings"),
        F.min_by(F.struct(*[c for c in incoming.columns if c != "artifact_key"]), "recorded_at").alias("_row"),
    )
    stored = held.select("artifact_key", content.alias("_held"))
    joined = batch.join(stored, "artifact_key", "left")
    status = (
        F.when(F.col("_low") != F.col("_high"), "conflict")
        .when(F.col("_held").isNull(), "written")
        .when(F.col("_held") == F.col("_low"), "duplicate")
        .otherwise("conflict")
    )
    return joined.select("artifact_key", "_row.*", "sightings", status.alias("status"))


def printed_bars(bars: DataFrame, specs: Sequence[OutcomeSpec], layout: Layout = AUTO) -> DataFrame:
    """Bars with forward columns and, per spec, the digest of the bars it consumes.

    The consumed bars are the next ``horizon_bars`` bars in order, so the frame
    is bounded by the horizon.
    """
    arranged = arrange(bars, after=rows_ahead(specs), layout=layout)
    arranged = arranged.with_columns({"_print": bar_fingerprint(), **forward_columns(arranged, specs)})
    consumed = {
        f"f_used_{s.fingerprint}": F.sha2(
            F.array_join(F.collect_list("_print").over(arranged.window.rowsBetween(1, s.horizon_bars)), ","), 256
        )
        for s in specs
    }
    rows = arranged.with_columns(consumed).result()
    keep = [c for c in rows.columns if c.startswith("f_")]
    return rows.select(*POINT, F.col("source").alias("bar_source"), F.col("_print").alias("bar_print"), *keep)


def track(
    claims: DataFrame, bars: DataFrame, specs: Sequence[OutcomeSpec], present: DataFrame | None, now: Column,
    layout: Layout = AUTO,
) -> DataFrame:
    """What can be said now about every claim under every spec.

    A claim is held against the bar of its own source; where only another
    source has the bar, the claim is refused.

    present / out_of_window / ineligible / refused (with reason) / pending /
    evaluated, the last with the finished outcome record. A revised bar outranks
    a pending future.
    """
    ahead = printed_bars(bars, specs, layout)
    first = bars.groupBy("symbol", "interval", "basis").agg(F.min("timestamp").alias("_first_bar"))
    ahead = ahead.withColumn("source", F.col("bar_source")).drop("bar_source")
    elsewhere = bars.groupBy(*POINT).agg(F.lit(True).alias("_elsewhere"))
    rows = (
        claims.join(ahead, [*POINT, "source"], "left").join(elsewhere, list(POINT), "left")
        .join(first, ["symbol", "interval", "basis"], "left")
    )
    evaluable = F.col("state") != INSUFFICIENT
    measured = rows.withColumn("_o", F.explode(outcome_structs(specs, evaluable)))
    used = F.lit(None).cast("string")
    for s in specs:
        used = F.when(F.col("spec_fingerprint") == s.fingerprint, F.col(f"f_used_{s.fingerprint}")).otherwise(used)
    flat = measured.select(
        *claims.columns, "_elsewhere", "bar_print", "_first_bar", "_o.spec_fingerprint", "_o.horizon_bars",
        F.col("_o.status").alias("_measured"), "_o.reference_timestamp", "_o.reference_price", "_o.future_timestamp",
        "_o.future_price", F.col("_o.outcome_value").alias("forward_return"),
        *[c for c in rows.columns if c.startswith("f_used_")],
    ).withColumns({"evaluation_version": F.lit(EVALUATION_VERSION), "evaluated_at": now, "consumed_bars_fingerprint": used})
    flat = flat.drop(*[c for c in flat.columns if c.startswith("f_used_")]).withColumn("outcome_key", outcome_key())
    if present is None:
        flat = flat.withColumn("_present", F.lit(None).cast("boolean"))
    else:
        flat = flat.join(present.select("outcome_key", F.lit(True).alias("_present")), "outcome_key", "left")
    out_of_window = F.col("_first_bar").isNull() | (F.col("timestamp") < F.col("_first_bar"))
    refusal = (
        F.when(F.col("bar_print").isNull(), F.when(F.col("_elsewhere"), "source_mismatch").otherwise("no_matching_bar"))
        .when(F.col("bar_print") != F.col("observation_bar_fingerprint"), "source_bar_revised")
    )
    status = (
        F.when(F.col("_present"), "present")
        .when(~evaluable, "ineligible")
        .when(out_of_window, "out_of_window")
        .when(refusal.isNotNull(), "refused")
        .when(F.col("_measured") == EVALUATED, "evaluated")
        .otherwise("pending")
    )
    out = flat.withColumn("status", status).withColumn("refusal", F.when(F.col("status") == "refused", refusal))
    return out.drop("_measured", "_present", "_first_bar", "_elsewhere", "bar_print")


OUTCOME_COLUMNS = (
    "outcome_key", "artifact_key", "symbol", "spec_fingerprint", "horizon_bars", "evaluation_version", "evaluated_at",
    "consumed_bars_fingerprint", "reference_timestamp", "reference_price", "future_timestamp", "future_price", "forward_return",
)


def new_outcomes(tracked: DataFrame) -> DataFrame:
    """Records to append, each with the digest of the claim it measured."""
    return tracked.filter(F.col("status") == "evaluated").select(*OUTCOME_COLUMNS, claim_digest().alias("artifact_digest"))


def refresh_counts(tracked: DataFrame) -> DataFrame:
    return tracked.groupBy("symbol", "horizon_bars", "status").agg(F.count(F.lit(1)).alias("items"))


def claim_issues(claims: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Keys that do not match their content, repeats and foreign partitions."""
    wrong = claims.filter(F.col("artifact_key") != artifact_key()).select("artifact_key", F.lit("key_mismatch").alias("issue"))
    twice = claims.groupBy("artifact_key").count().filter("count > 1").select("artifact_key", F.lit("duplicate_key").alias("issue"))
    out = wrong.unionByName(twice)
    if universe is not None:
        foreign = claims.join(universe, "symbol", "left_anti").select("artifact_key", F.lit("foreign_partition").alias("issue"))
        out = out.unionByName(foreign)
    return out


def outcome_issues(outcomes: DataFrame, claims: DataFrame) -> DataFrame:
    """Outcome records that contradict themselves, their claim or the ledger."""
    held = claims.select(
        "artifact_key", F.col("timestamp").alias("_ts"), F.col("recorded_at").alias("_rec"),
        F.col("data_cutoff").alias("_cut"), F.col("state").alias("_state"), claim_digest().alias("_digest"),
    )
    rows = outcomes.join(held, "artifact_key", "left")
    one_bar = F.col("future_timestamp") == F.col("reference_timestamp")
    ret = F.col("forward_return")
    prices = finite(F.col("reference_price")) & finite(F.col("future_price")) & (F.col("reference_price") > 0) & (F.col("future_price") > 0)
    issues = F.array_compact(
        F.array(
            F.when(F.col("_ts").isNull(), "orphan_outcome"),
            F.when(F.col("_digest") != F.col("artifact_digest"), "artifact_content_differs"),
            F.when(F.col("_state") == INSUFFICIENT, "ineligible_artifact"),
            F.when(F.col("outcome_key") != outcome_key(), "key_mismatch"),
            F.when(F.col("evaluated_at") < F.col("_rec"), "evaluated_before_recorded"),
            F.when(F.col("reference_timestamp") <= F.col("_ts"), "reference_not_after_claim"),
            F.when(F.col("future_timestamp") < F.col("reference_timestamp"), "future_before_reference"),
            F.when((F.col("horizon_bars") == 1) != one_bar, "horizon_shape"),
            F.when(F.col("evaluated_at") <= F.col("future_timestamp"), "evaluated_before_future"),
            F.when(F.col("future_timestamp") <= F.col("_cut"), "future_not_after_cutoff"),
            F.when(~prices, "unusable_price"),
            F.when(~finite(ret) | (ret != F.col("future_price") / F.col("reference_price") - 1.0), "return_disagrees"),
        )
    )
    bad = rows.withColumn("issues", issues).filter(F.size("issues") > 0).select("outcome_key", F.explode("issues").alias("issue"))
    twice = outcomes.groupBy("outcome_key").count().filter("count > 1").select("outcome_key", F.lit("duplicate_key").alias("issue"))
    return bad.unionByName(twice)


COVERAGE_KEY = ("spec_fingerprint", "horizon_bars", *PRODUCER, "state", "source")


def spec_table(df: DataFrame, specs: Sequence[OutcomeSpec]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(s.fingerprint, s.horizon_bars, i) for i, s in enumerate(specs)],
        "spec_fingerprint string, horizon_bars int, spec_order int",
    )


def ledger_coverage(claims: DataFrame, outcomes: DataFrame, specs: Sequence[OutcomeSpec]) -> DataFrame:
    """Registered, evaluable and completed claims per spec, producer, state and source."""
    wanted = F.broadcast(spec_table(claims, specs))
    registered = claims.crossJoin(wanted)
    done = outcomes.select("artifact_key", "spec_fingerprint").distinct().withColumn("_done", F.lit(True))
    rows = registered.join(done, ["artifact_key", "spec_fingerprint"], "left")
    evaluable = F.col("state") != INSUFFICIENT
    out = rows.groupBy("spec_order", *COVERAGE_KEY).agg(
        F.count(F.lit(1)).alias("artifacts_registered"),
        F.count_if(evaluable).alias("artifacts_evaluable"),
        F.count_if("_done").alias("artifacts_completed"),
        F.min("timestamp").alias("first_artifact_timestamp"),
        F.max("timestamp").alias("last_artifact_timestamp"),
    )
    return out.withColumns(
        {
            "raw_coverage_fraction": fraction(F.col("artifacts_completed"), F.col("artifacts_registered")),
            "evaluable_coverage_fraction": fraction(F.col("artifacts_completed"), F.col("artifacts_evaluable")),
        }
    )


def ledger_metrics(claims: DataFrame, outcomes: DataFrame, specs: Sequence[OutcomeSpec]) -> DataFrame:
    """Return statistics per coverage group and evaluation version, with its own coverage."""
    wanted = F.broadcast(spec_table(claims, specs))
    known = claims.select("artifact_key", *PRODUCER, "state", "source", "timestamp")
    group = [*COVERAGE_KEY, "evaluation_version"]
    rows = outcomes.select("artifact_key", "spec_fingerprint", "evaluation_version", "forward_return").join(wanted, "spec_fingerprint")
    rows = rows.join(known, "artifact_key").select(*group, "forward_return", "timestamp")
    spans = [F.min("timestamp").alias("first_artifact_timestamp"), F.max("timestamp").alias("last_artifact_timestamp")]
    stats = describe(rows, group, "forward_return", extra=spans)
    base = ledger_coverage(claims, outcomes, specs).select(
        "spec_order", *COVERAGE_KEY, "artifacts_registered", "artifacts_evaluable"
    )
    out = null_safe(stats, base, COVERAGE_KEY)
    return out.withColumns(
        {
            "raw_coverage_fraction": fraction(F.col("sample_count"), F.col("artifacts_registered")),
            "evaluable_coverage_fraction": fraction(F.col("sample_count"), F.col("artifacts_evaluable")),
            "sample_floor_met": F.col("sample_count") >= SAMPLE_FLOOR,
        }
    )


def summary_places(df: DataFrame) -> DataFrame:
    """Adds ``place``: requested spec order, then producer, state and source; numbered over range partitions."""
    return placed(df, (), ["spec_order", *[F.col(c).asc_nulls_first() for c in PRODUCER], "state", "source"], "place")


def missed_tails(bars: DataFrame, claims: DataFrame, activated_at: Column) -> DataFrame:
    """Settled bars after activation, before the tail and after the last claim, never claimed."""
    from barloom.functions.times import is_pre_activation

    tails = bars.groupBy("symbol").agg(F.max("timestamp").alias("_tail"))
    floors = claims.groupBy("symbol").agg(F.max("timestamp").alias("_floor"))
    rows = bars.select("symbol", "timestamp").join(tails, "symbol").join(floors, "symbol", "left")
    open_rows = rows.filter(
        (F.col("timestamp") < F.col("_tail"))
        & (F.col("_floor").isNull() | (F.col("timestamp") > F.col("_floor")))
        & ~is_pre_activation(F.col("timestamp"), activated_at)
    )
    return open_rows.join(claims.select("symbol", "timestamp").distinct(), ["symbol", "timestamp"], "left_anti").select(
        "symbol", "timestamp"
    )


def run_missed(runs: DataFrame) -> DataFrame:
    """Distinct missed sessions per symbol over all run records."""
    return (
        runs.select(F.explode("symbols").alias("s"))
        .select(F.col("s.symbol").alias("symbol"), F.explode("s.missed_tails").alias("timestamp"))
        .distinct()
    )


def ledger_health(
    claims: DataFrame, outcomes: DataFrame, runs: DataFrame, universe: DataFrame, specs: Sequence[OutcomeSpec]
) -> DataFrame:
    """Claims, maturity, pending work and missed dates per universe symbol."""
    evaluable = F.col("state") != INSUFFICIENT
    held = claims.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("claims_total"),
        F.countDistinct("timestamp").alias("tails_registered"),
        F.count_if(evaluable).alias("claims_evaluable"),
        F.count_if(~evaluable).alias("claims_insufficient"),
        F.max("timestamp").alias("last_tail"),
    )
    known = outcomes.filter(
        F.col("spec_fingerprint").isin(*[s.fingerprint for s in specs]) & (F.col("evaluation_version") == EVALUATION_VERSION)
    )
    matured = known.groupBy("symbol").agg(
        *[F.count_if(F.col("horizon_bars") == s.horizon_bars).alias(f"matured_h{s.horizon_bars}") for s in specs]
    )
    missed = (
        run_missed(runs).join(claims.select("symbol", "timestamp").distinct(), ["symbol", "timestamp"], "left_anti")
        .groupBy("symbol").agg(F.countDistinct(new_york_date(F.col("timestamp"))).alias("missed_dates"))
    )
    out = universe.join(held, "symbol", "left").join(matured, "symbol", "left").join(missed, "symbol", "left").fillna(0)
    total = sum((F.col(f"matured_h{s.horizon_bars}") for s in specs), F.lit(0))
    return out.withColumn("pending", F.col("claims_evaluable") * len(specs) - total)


def status_histogram(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode("symbols.status").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("symbol_runs"))
