"""Audit of a claims ledger against the log of the runs that wrote it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.times import (
    in_collection_window, is_current_tail, is_new_york_midnight, is_pre_activation, new_york_date, plus_seconds,
)
from barloom.operators.layout import AUTO, Layout, arrange
from barloom.session import materialize

# --- fixed values: reasons, statuses and tolerances -------------------------
INVALID_REASONS = (
    "unmatched_claim", "unmatched_outcome", "claim_outside_window", "outcome_outside_window", "pre_activation_claim",
    "late_claim", "claim_timestamp_convention", "unexpected_partition", "unexpected_source", "unexpected_origin",
    "unexpected_producer", "unexpected_outcome_spec", "artifact_count_mismatch", "outcome_count_mismatch",
    "missing_claimed_artifacts", "missing_claimed_outcomes", "run_record_inconsistent", "collector_commit_mismatch",
)
DEGRADED_REASONS = ("interrupted_run",)
EXACT_STATUSES = ("ok", "duplicate_already_exists", "insufficient_history")
REFRESHED_STATUSES = EXACT_STATUSES + ("refresh_failure", "corrupt_ledger")
BACKWARD_SECONDS = 5
MAX_SPAN_SECONDS = 3600
#: width of the time bins in which loose rows meet interrupted runs
BIN_SECONDS = 60
LEDGER_FILES = ("artifacts.jsonl", "outcomes.jsonl")
IGNORED_NAMES = (".DS_Store",)

RUN_LOG = (
    "position BIGINT, record_type STRING, run_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, run_status STRING, "
    "collection_fingerprint STRING, policy_fingerprint STRING, activated_at TIMESTAMP, collector_commit STRING, "
    "universe ARRAY<STRING>, symbols ARRAY<STRUCT<symbol: STRING, status: STRING, built_at: TIMESTAMP, tail: TIMESTAMP, "
    "artifacts_new: INT, outcomes_new: INT, missed_tails: ARRAY<TIMESTAMP>>>"
)


@dataclass(frozen=True)
class ProvenancePolicy:
    """What a legitimate ledger looks like."""

    universe: tuple[str, ...]
    activated_at: str
    collection_fingerprint: str
    policy_fingerprint: str
    collector_commit: str
    producers: tuple[tuple[str, ...], ...]
    spec_horizons: tuple[tuple[str, int], ...]
    interval: str = "1d"
    basis: str = "raw"
    provider: str = "yfinance"
    origin: str = "prospective"
    claims_per_tail: int = 4
    evaluation_version: int = 1

    @property
    def activated(self) -> Column:
        return F.lit(self.activated_at).cast("timestamp")


def finding(df: DataFrame, reason: Column | str, component: Column | str, symbol: Column | str | None = None, line: Column | str | None = None) -> DataFrame:
    as_col = lambda x, t: F.lit(None).cast(t) if x is None else (F.lit(x) if isinstance(x, str) else x).cast(t)
    return df.select(
        as_col(reason, "string").alias("reason"), as_col(component, "string").alias("component"),
        as_col(symbol, "string").alias("symbol"), as_col(line, "long").alias("line"),
    )


def audit_log(log: DataFrame, policy: ProvenancePolicy, layout: Layout = AUTO) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings of the run log alone, its accepted completed records, and its interrupted starts.

    A run id holds a start and its completion, so windows over it are tiny; the
    next entry's start time needs one row of the log's order.
    """
    by_run = Window.partitionBy("run_id").orderBy("position")
    before = by_run.rowsBetween(Window.unboundedPreceding, -1)
    is_start = F.col("record_type") == "start"
    completed = (F.col("record_type") == "record") & (F.col("run_status") == "completed")
    claims_id = is_start | ((F.col("record_type") == "record") & ~completed)
    rows = log.withColumns(
        {
            "_seen": F.coalesce(F.max(claims_id.cast("int")).over(before), F.lit(0)) > 0,
            "_is_start": is_start,
            "_completed": completed,
        }
    )
    # the start that counts for a run id is its first identity-bearing entry
    begun = F.when(F.col("_is_start") & ~F.col("_seen"), F.struct(F.lit(True).alias("ok"), F.col("started_at").alias("at")))
    rows = rows.withColumn("_begun", F.first(begun, ignorenulls=True).over(before))
    universe = F.array(*[F.lit(s) for s in policy.universe])
    commit = F.col("collector_commit") != policy.collector_commit
    start_wrong = (
        (F.col("collection_fingerprint") != policy.collection_fingerprint)
        | (F.col("policy_fingerprint") != policy.policy_fingerprint)
        | (F.col("activated_at") != policy.activated)
        | (F.col("universe") != universe)
        | ~in_collection_window(F.col("started_at"))
        | (F.col("started_at") <= policy.activated)
    )
    paired = (
        F.col("_begun").isNotNull()
        & F.col("_begun.at").eqNullSafe(F.col("started_at"))
        & (F.col("collection_fingerprint") == policy.collection_fingerprint)
        & (F.col("universe") == universe)
        & (F.col("symbols.symbol") == universe)
    )
    rows = rows.withColumn("_paired", F.col("_completed") & F.coalesce(paired, F.lit(False)))
    rows = rows.withColumn(
        "_accepted", F.col("_paired") & (F.coalesce(F.max(F.col("_paired").cast("int")).over(before), F.lit(0)) == 0)
    )
    refusal = ~F.col("_is_start") & ~F.col("_completed")
    has_symbols = F.coalesce(F.size("symbols"), F.lit(0)) > 0
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_is_start") & F.col("_seen"), "run_record_inconsistent"),
            F.when(F.col("_is_start") & ~F.col("_seen") & start_wrong, "run_record_inconsistent"),
            F.when(commit & ~(F.col("_is_start") & F.col("_seen")), "collector_commit_mismatch"),
            F.when(~F.col("_is_start") & (F.col("activated_at") != policy.activated), "run_record_inconsistent"),
            F.when(refusal & (has_symbols | F.col("_seen")), "run_record_inconsistent"),
            F.when(F.col("_completed") & ~F.col("_accepted"), "run_record_inconsistent"),
        )
    )
    flagged = rows.select("position", F.explode(reasons).alias("reason"))
    findings = finding(flagged, F.col("reason"), "run_log", None, F.col("position"))
    accepted = rows.filter("_accepted").select(*log.columns)
    arranged = arrange(
        log.select("position", "record_type", "run_id", "started_at"), (), ("position",), after=1, layout=layout,
    )
    ends = arranged.with_columns({"window_end": F.lead("started_at").over(arranged.window)}).result()
    interrupted = (
        ends.filter("record_type = 'start'")
        .join(accepted.select("run_id"), "run_id", "left_anti")
        .select("run_id", "position", "started_at", "window_end", new_york_date(F.col("started_at")).alias("run_day"))
    )
    return findings, accepted, interrupted


def symbol_runs(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Refreshed (symbol, clock) pairs of completed runs, and findings for repeats."""
    flat = accepted.select("position", "run_id", F.posexplode("symbols").alias("ord", "s")).select(
        "position", "run_id", "ord", "s.*"
    )
    reached = flat.filter(
        F.col("status").isin(*REFRESHED_STATUSES) & F.col("built_at").isNotNull() & F.col("tail").isNotNull()
    )
    pairs = reached.groupBy("symbol", "built_at").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct("tail", "status", "artifacts_new", "outcomes_new"), F.struct("position", "ord")).alias("_r"),
    )
    repeats = pairs.filter("_n > 1").select("symbol", F.explode(F.sequence(F.lit(2), F.col("_n"))).alias("_i"))
    return pairs.select("symbol", "built_at", "_r.*"), finding(repeats, "run_record_inconsistent", "run_log", F.col("symbol"))


def interrupted_for(rows: DataFrame, clock: str, key: str, interrupted: DataFrame) -> DataFrame:
    """The latest interrupted run that can explain each row's clock.

    An interval join on equal New York dates: a run's window, an hour at most,
    is spread over the time bins that it meets, a row lies in one bin, and only
    rows and runs of one bin are compared, so a day of many rows and many runs
    costs the pairs that overlap and its bins are spread over tasks.
    """
    def binned(micros: Column) -> Column:
        return F.floor(micros / (BIN_SECONDS * 1_000_000)).cast("long")

    begin = F.unix_micros("started_at") - BACKWARD_SECONDS * 1_000_000
    end = F.least(F.unix_micros("started_at") + MAX_SPAN_SECONDS * 1_000_000, F.unix_micros("window_end"))
    runs = interrupted.filter(end >= begin).select(
        "run_id", "position", "started_at", "window_end", "run_day", F.explode(F.sequence(binned(begin), binned(end))).alias("_bin"))
    candidates = rows.select(
        key, F.col(clock).alias("_t"), new_york_date(F.col(clock)).alias("run_day"), binned(F.unix_micros(clock)).alias("_bin")
    ).join(runs, ["_bin", "run_day"])
    fits = (
        (plus_seconds(F.col("started_at"), -BACKWARD_SECONDS) <= F.col("_t"))
        & (F.col("window_end").isNull() | (F.col("_t") < F.col("window_end")))
        & (F.unix_micros("_t") - F.unix_micros("started_at") <= MAX_SPAN_SECONDS * 1_000_000)
    )
    return candidates.filter(fits).groupBy(key).agg(F.max_by("run_id", "position").alias("orphan_run"))


def path_findings(paths: DataFrame, policy: ProvenancePolicy) -> DataFrame:
    """Ledger paths outside universe / interval / basis / files."""
    allowed = []
    for s in policy.universe:
        base = f"{s}/{policy.interval}/{policy.basis}"
        allowed += [s, f"{s}/{policy.interval}", base, *[f"{base}/{f}" for f in LEDGER_FILES]]
    known = paths.sparkSession.createDataFrame([(p,) for p in allowed], "path string")
    name = F.element_at(F.split("path", "/"), -1)
    odd = paths.filter(~name.isin(*IGNORED_NAMES)).join(F.broadcast(known), "path", "left_anti")
    return finding(odd, "unexpected_partition", F.concat(F.lit("ledger:"), F.col("path")))


def reconcile(
    claims: DataFrame, outcomes: DataFrame, log: DataFrame, policy: ProvenancePolicy, paths: DataFrame | None = None,
    layout: Layout = AUTO,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, excluded artifact keys and excluded outcome keys.

    ``claims`` and ``outcomes`` carry ``partition_symbol`` (where the record was
    found) and ``line``.
    """
    log_findings, accepted, interrupted = audit_log(log, policy, layout)
    refreshed, repeat_findings = symbol_runs(accepted)
    spark = claims.sparkSession
    part = F.col("partition_symbol")
    comp = F.concat(F.lit("ledger:"), part, F.lit(":artifacts"))
    producers = spark.createDataFrame([(p,) for p in ("|".join(x) for x in policy.producers)], "producer string")
    producer = F.when(
        F.col("kind") == "assessment", F.concat_ws("|", F.lit("assessment"), F.col("policy_fingerprint"))
    ).otherwise(
        F.concat_ws("|", F.lit("observation"), "hypothesis_id", F.col("hypothesis_version").cast("string"), "hypothesis_fingerprint")
    )
    c = claims.withColumn("producer", producer).join(
        F.broadcast(producers.withColumn("_known", F.lit(True))), "producer", "left"
    )
    problems = F.array_compact(
        F.array(
            F.when((F.col("symbol") != part) | (F.col("interval") != policy.interval) | (F.col("basis") != policy.basis), "unexpected_partition"),
            F.when(F.col("source") != policy.provider, "unexpected_source"),
            F.when(F.col("origin") != policy.origin, "unexpected_origin"),
            F.when(F.col("_known").isNull(), "unexpected_producer"),
            F.when((F.col("data_cutoff") != F.col("timestamp")) | ~is_new_york_midnight(F.col("timestamp")), "claim_timestamp_convention"),
            F.when(~in_collection_window(F.col("recorded_at")), "claim_outside_window"),
            F.when(is_pre_activation(F.col("timestamp"), policy.activated) | (F.col("recorded_at") <= policy.activated), "pre_activation_claim"),
            F.when(~is_current_tail(F.col("timestamp"), F.col("recorded_at")), "late_claim"),
        )
    )
    run = refreshed.select(
        F.col("symbol").alias("partition_symbol"), F.col("built_at").alias("recorded_at"), F.col("tail").alias("run_tail"),
        F.lit(True).alias("_run"),
    )
    c = c.withColumn("problems", problems).join(run, ["partition_symbol", "recorded_at"], "left")
    c = c.withColumn("matched", F.col("_run").isNotNull() & F.coalesce(F.col("run_tail") == F.col("timestamp"), F.lit(False)))
    loose = c.filter(~F.col("matched") & F.col("_run").isNull() & (F.size("problems") == 0))
    c = c.join(interrupted_for(loose, "recorded_at", "artifact_key", interrupted), "artifact_key", "left")
    # one snapshot per interrupted run and symbol
    groups = c.filter("orphan_run IS NOT NULL").groupBy("partition_symbol", "orphan_run").agg(
        F.min("recorded_at").alias("_c0"), F.max("recorded_at").alias("_c1"), F.min("timestamp").alias("_t0"),
        F.max("timestamp").alias("_t1"), F.count(F.lit(1)).alias("_size"),
    )
    whole = (F.col("_c0") == F.col("_c1")) & (F.col("_t0") == F.col("_t1")) & (F.col("_size") <= policy.claims_per_tail)
    groups = groups.select("partition_symbol", "orphan_run", "_c0", whole.alias("_whole"))
    c = c.join(groups, ["partition_symbol", "orphan_run"], "left")
    excluded = F.coalesce(F.col("_whole"), F.lit(False))
    c = c.withColumn(
        "verdict", F.when(F.col("matched"), "matched").when(excluded, "interrupted_run").otherwise("unmatched_claim")
    )
    # read by six later passes
    c = materialize(c, "claims-audited")
    claim_findings = finding(
        c.select("partition_symbol", "line", F.explode("problems").alias("reason")),
        F.col("reason"), comp, part, F.col("line"),
    ).unionByName(
        finding(c.filter("verdict <> 'matched'"), F.col("verdict"), comp, part, F.col("line"))
    )
    crowded = c.groupBy("partition_symbol", "timestamp").count().filter(F.col("count") > policy.claims_per_tail)
    claim_findings = claim_findings.unionByName(finding(crowded, "artifact_count_mismatch", comp, part))
    excluded_claims = c.filter("verdict = 'interrupted_run'").select("artifact_key").distinct()

    ocomp = F.concat(F.lit("ledger:"), part, F.lit(":outcomes"))
    horizon = F.lit(None).cast("int")
    for fp, h in policy.spec_horizons:
        horizon = F.when(F.col("spec_fingerprint") == fp, h).otherwise(horizon)
    oproblems = F.array_compact(
        F.array(
            F.when(F.col("symbol") != part, "unexpected_partition"),
            F.when(
                ~horizon.eqNullSafe(F.col("horizon_bars")) | (F.col("evaluation_version") != policy.evaluation_version),
                "unexpected_outcome_spec",
            ),
            F.when(~in_collection_window(F.col("evaluated_at")), "outcome_outside_window"),
        )
    )
    held = c.groupBy("partition_symbol", "artifact_key").agg(
        F.max_by(F.struct("recorded_at", "verdict"), "line").alias("_claim")
    )
    orun = refreshed.select(
        F.col("symbol").alias("partition_symbol"), F.col("built_at").alias("evaluated_at"), F.lit(True).alias("_run")
    )
    o = (
        outcomes.withColumn("problems", oproblems)
        .join(held, ["partition_symbol", "artifact_key"], "left")
        .join(orun, ["partition_symbol", "evaluated_at"], "left")
    )
    broken = F.col("_claim").isNull() | (F.col("evaluated_at") <= F.col("_claim.recorded_at"))
    o = o.withColumns({"_broken": broken, "matched": ~broken & F.col("_run").isNotNull()})
    loose = o.filter(~F.col("_broken") & ~F.col("matched") & (F.size("problems") == 0))
    o = o.join(interrupted_for(loose, "evaluated_at", "outcome_key", interrupted), "outcome_key", "left")
    ogroups = o.filter("orphan_run IS NOT NULL").groupBy("partition_symbol", "orphan_run").agg(
        F.min("evaluated_at").alias("_e0"), F.max("evaluated_at").alias("_e1")
    )
    clocks = groups.filter("_whole").select("partition_symbol", "orphan_run", F.col("_c0").alias("_clock"))
    ogroups = ogroups.join(clocks, ["partition_symbol", "orphan_run"], "left")
    same = (F.col("_e0") == F.col("_e1")) & (F.col("_clock").isNull() | (F.col("_clock") == F.col("_e0")))
    o = o.join(ogroups.select("partition_symbol", "orphan_run", same.alias("_whole")), ["partition_symbol", "orphan_run"], "left")
    o = o.withColumn(
        "verdict",
        F.when(F.col("matched"), "matched")
        .when(F.coalesce(F.col("_whole"), F.lit(False)), "interrupted_run")
        .otherwise("unmatched_outcome"),
    )
    o = materialize(o, "outcomes-audited")
    outcome_findings = finding(
        o.select("partition_symbol", "line", F.explode("problems").alias("reason")), F.col("reason"), ocomp, part, F.col("line")
    ).unionByName(finding(o.filter("verdict <> 'matched'"), F.col("verdict"), ocomp, part, F.col("line")))
    of_excluded = ~F.col("_broken") & (F.col("_claim.verdict") == "interrupted_run")
    excluded_outcomes = o.filter(of_excluded | (F.col("verdict") == "interrupted_run")).select("outcome_key").distinct()

    counted_claims = c.filter("matched").groupBy(
        F.col("partition_symbol").alias("symbol"), F.col("recorded_at").alias("built_at")
    ).agg(F.count(F.lit(1)).alias("_claims"))
    counted_outcomes = o.filter("matched").groupBy(
        F.col("partition_symbol").alias("symbol"), F.col("evaluated_at").alias("built_at")
    ).agg(F.count(F.lit(1)).alias("_outcomes"))
    runs = refreshed.join(counted_claims, ["symbol", "built_at"], "left").join(counted_outcomes, ["symbol", "built_at"], "left")
    runs = runs.fillna(0, ["_claims", "_outcomes", "artifacts_new", "outcomes_new"])
    exact = F.col("status").isin(*EXACT_STATUSES)
    mismatch = F.array_compact(
        F.array(
            F.when(exact & (F.col("_claims") < F.col("artifacts_new")), "missing_claimed_artifacts")
            .when(exact & (F.col("_claims") > F.col("artifacts_new")), "artifact_count_mismatch")
            .when(~exact & (F.col("_claims") > policy.claims_per_tail), "artifact_count_mismatch"),
            F.when(exact & (F.col("_outcomes") < F.col("outcomes_new")), "missing_claimed_outcomes")
            .when(exact & (F.col("_outcomes") > F.col("outcomes_new")), "outcome_count_mismatch"),
        )
    )
    kind = F.when(F.col("reason").isin("missing_claimed_artifacts", "artifact_count_mismatch"), "artifacts").otherwise("outcomes")
    count_findings = finding(
        runs.select("symbol", F.explode(mismatch).alias("reason")),
        F.col("reason"), F.concat(F.lit("ledger:"), F.col("symbol"), F.lit(":"), kind), F.col("symbol"),
    )
    findings = log_findings.unionByName(repeat_findings).unionByName(claim_findings)
    findings = findings.unionByName(outcome_findings).unionByName(count_findings)
    if paths is not None:
        findings = findings.unionByName(path_findings(paths, policy))
    return findings, excluded_claims, excluded_outcomes


def reason_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("reason").agg(F.count(F.lit(1)).alias("findings"))


def verdict(findings: DataFrame) -> DataFrame:
    """invalid over degraded over ok."""
    bad = F.count_if(F.col("reason").isin(*INVALID_REASONS))
    weak = F.count_if(F.col("reason").isin(*DEGRADED_REASONS))
    return findings.agg(
        F.when(bad > 0, "invalid").when(weak > 0, "degraded").otherwise("ok").alias("status"),
        bad.alias("invalid_findings"), weak.alias("degraded_findings"),
    )
