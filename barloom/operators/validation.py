"""Validation of a matured ledger: stop rule, primary cells, secondary views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.times import add_months, is_pre_activation, settles_at
from barloom.operators.layout import AUTO, Layout, arrange
from barloom.operators.runs import run_starts
from barloom.operators.stats import deltas, describe, fill_counts
from barloom.schemas import INSUFFICIENT


@dataclass(frozen=True)
class ValidationDefinition:
    """Frozen parameters of one validation."""

    activated_at: str
    primary_hypothesis: tuple[str, int, str]
    primary_state: str
    primary_horizon: int
    primary_symbols: tuple[str, ...]
    secondary_symbols: tuple[str, ...]
    specs: tuple[tuple[int, str], ...]
    # (symbol, mean_delta, median_delta) of the retrospective study
    references: tuple[tuple[str, float, float], ...]
    minimum_months: int = 48
    minimum_matured: int = 750
    forced_months: int = 72
    minimum_episodes: int = 8
    evaluation_version: int = 1

    def __post_init__(self) -> None:
        if tuple(r[0] for r in self.references) != self.primary_symbols:
            raise ValueError("one reference per primary symbol, in order")
        if self.primary_horizon not in dict(self.specs):
            raise ValueError("the primary horizon needs a spec")
        if self.forced_months < self.minimum_months:
            raise ValueError("a forced unlock cannot precede the stop rule")
        if any(r[1] == 0 or r[2] == 0 for r in self.references):
            raise ValueError("a reference delta is zero")

    @property
    def activated(self) -> Column:
        return F.lit(self.activated_at).cast("timestamp")

    @property
    def symbols(self) -> tuple[str, ...]:
        return self.primary_symbols + self.secondary_symbols


def missed_sessions(run_log: DataFrame) -> DataFrame:
    """Sessions that any run of the log reports as missed, each once per symbol."""
    entries = run_log.select(F.inline("symbols"))
    return entries.select("symbol", F.explode("missed_tails").alias("timestamp")).distinct()


def evidence(claims: DataFrame, outcomes: DataFrame, run_log: DataFrame, excluded_claims: DataFrame, excluded_outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a validation rests on: claims with ``excluded``, measurements of known claims with ``excluded``, and missed sessions."""
    out = excluded_claims.select("artifact_key", F.lit(True).alias("excluded")).distinct()
    stamped = claims.join(out, "artifact_key", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    gone = excluded_outcomes.select("outcome_key", F.lit(True).alias("excluded")).distinct()
    known = claims.select("artifact_key", F.col("timestamp").alias("claim_timestamp"), "state")
    measurements = (
        outcomes.join(known, "artifact_key").join(gone, "outcome_key", "left")
        .withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    )
    return stamped, measurements, missed_sessions(run_log)


def reserved(d: ValidationDefinition) -> Column:
    """The bar had settled at or before activation."""
    return is_pre_activation(F.col("timestamp"), d.activated)


def of_hypothesis(claims: DataFrame, identity: tuple[str, int, str]) -> DataFrame:
    h, v, f = identity
    return claims.filter(
        (F.col("hypothesis_id") == h) & (F.col("hypothesis_version") == v) & (F.col("hypothesis_fingerprint") == f)
    )


def population(claims: DataFrame, excluded: DataFrame, d: ValidationDefinition, identity: tuple[str, int, str] | None = None) -> DataFrame:
    """Claims of one hypothesis that are neither excluded nor reserved."""
    rows = of_hypothesis(claims, identity or d.primary_hypothesis)
    return rows.join(excluded.select("artifact_key"), "artifact_key", "left_anti").filter(~reserved(d))


def population_issues(rows: DataFrame) -> DataFrame:
    """Two claims of one hypothesis for one bar."""
    return rows.groupBy("symbol", "hypothesis_id", "timestamp").count().filter("count > 1")


def measured(outcomes: DataFrame, excluded: DataFrame, d: ValidationDefinition) -> DataFrame:
    """Outcomes under the frozen specs that are not excluded."""
    pairs = F.lit(False)
    for h, fp in d.specs:
        pairs = pairs | ((F.col("horizon_bars") == h) & (F.col("spec_fingerprint") == fp))
    kept = outcomes.filter(pairs & (F.col("evaluation_version") == d.evaluation_version))
    return kept.join(excluded.select("outcome_key"), "outcome_key", "left_anti")


def evidence_through(claims: DataFrame, excluded: DataFrame, d: ValidationDefinition) -> DataFrame:
    """When the latest legitimate claim bar settled."""
    kept = claims.join(excluded.select("artifact_key"), "artifact_key", "left_anti").filter(~reserved(d))
    return kept.agg(F.max(settles_at(F.col("timestamp"))).alias("evidence_through"))


def matured(claims: DataFrame, outcomes: DataFrame, excluded_claims: DataFrame, excluded_outcomes: DataFrame, d: ValidationDefinition) -> DataFrame:
    """Matured primary claims and cutoff per symbol, zero rows included."""
    done = measured(outcomes, excluded_outcomes, d).filter(F.col("horizon_bars") == d.primary_horizon)
    rows = population(claims, excluded_claims, d).join(done.select("artifact_key"), "artifact_key", "left_semi")
    counted = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("matured"), F.max("timestamp").alias("cutoff"))
    every = claims.sparkSession.createDataFrame([(s,) for s in d.symbols], "symbol string")
    return F.broadcast(every).join(counted, "symbol", "left").fillna(0, ["matured"])


def stop_rule(claims: DataFrame, outcomes: DataFrame, excluded_claims: DataFrame, excluded_outcomes: DataFrame, d: ValidationDefinition) -> DataFrame:
    """(months and matured counts) or forced months, on the evidence clock."""
    counts = matured(claims, outcomes, excluded_claims, excluded_outcomes, d)
    enough = counts.filter(F.col("symbol").isin(*d.primary_symbols)).agg(
        F.bool_and(F.col("matured") >= d.minimum_matured).alias("e2_met"), F.min("matured").alias("least_matured")
    )
    row = evidence_through(claims, excluded_claims, d).crossJoin(enough)
    clock = F.col("evidence_through")
    met = lambda due: F.coalesce(clock >= F.col(due), F.lit(False))
    row = row.withColumns(
        {"e1_due": add_months(d.activated, d.minimum_months), "forced_due": add_months(d.activated, d.forced_months)}
    ).withColumns({"e1_met": met("e1_due"), "f_met": met("forced_due")})
    both = F.col("e1_met") & F.col("e2_met")
    return row.withColumns(
        {
            "unlockable": both | F.col("f_met"),
            "unlock_basis": F.when(both, "E1_and_E2").when(F.col("f_met"), "F_forced_unlock"),
        }
    )


def session_spine(claims: DataFrame, missed: DataFrame, cutoffs: DataFrame, d: ValidationDefinition) -> DataFrame:
    """Registered and missed sessions up to each symbol's cutoff."""
    both = claims.select("symbol", "timestamp").unionByName(missed.select("symbol", "timestamp")).distinct()
    limited = both.join(cutoffs.select("symbol", "cutoff"), "symbol").filter(F.col("timestamp") <= F.col("cutoff"))
    return limited.filter(~reserved(d)).drop("cutoff")


def positions(
    claims: DataFrame, outcomes: DataFrame, missed: DataFrame, excluded_claims: DataFrame, excluded_outcomes: DataFrame,
    d: ValidationDefinition, identity: tuple[str, int, str] | None = None, horizons: Sequence[int] | None = None,
) -> DataFrame:
    """State and value at every session; a session without claim has neither."""
    identity = identity or d.primary_hypothesis
    horizons = list(horizons or [d.primary_horizon])
    cut = matured(claims, outcomes, excluded_claims, excluded_outcomes, d)
    spine = session_spine(claims, missed, cut, d)
    grid = spine.crossJoin(F.broadcast(claims.sparkSession.createDataFrame([(h,) for h in horizons], "horizon_bars int")))
    held = population(claims, excluded_claims, d, identity).select("symbol", "timestamp", "artifact_key", "state")
    values = measured(outcomes, excluded_outcomes, d).select(
        "artifact_key", "horizon_bars", "outcome_key", F.col("forward_return").alias("value"), "reference_timestamp", "future_timestamp"
    )
    return (
        grid.join(held, ["symbol", "timestamp"], "left")
        .join(values, ["artifact_key", "horizon_bars"], "left")
        .withColumn("hypothesis_id", F.lit(identity[0]))
    )


def integrity_issues(rows: DataFrame) -> DataFrame:
    """Values whose bars do not follow the claim, and non-finite values."""
    order = (F.col("timestamp") < F.col("reference_timestamp")) & (F.col("reference_timestamp") <= F.col("future_timestamp"))
    value = F.col("value")
    issue = F.when(~order, "lookahead").when(F.isnan(value) | (F.abs(value) == float("inf")), "non_finite")
    return rows.filter(value.isNotNull()).withColumn("issue", issue).filter("issue IS NOT NULL").select(
        "symbol", "artifact_key", "outcome_key", "issue"
    )


def cells(rows: DataFrame, states: Sequence[str], keys: Sequence[str] = ("symbol", "hypothesis_id", "horizon_bars"), layout: Layout = AUTO) -> DataFrame:
    """State groups beside their matched group over the session sequence.

    Runs restart within ``keys``: with a year among them, every January opens
    new runs; a session without claim breaks a run.
    """
    keys = list(keys)
    arranged = arrange(rows, keys, before=1, layout=layout)
    has = F.col("value").isNotNull()
    members = {"in_all": has, **{f"in_{s}": has & F.coalesce(F.col("state") == s, F.lit(False)) for s in states}}
    flagged = run_starts(arranged, members).own().df
    runs = flagged.groupBy(*keys).agg(*[F.count_if(n).alias(n) for n in members])
    names = F.array(*[F.struct(F.lit(n.removeprefix("in_")).alias("group_state"), F.col(n).alias("episode_count")) for n in members])
    grid = runs.select(*keys, F.inline(names))
    tagged = rows.filter(has).select(*keys, "value", F.explode(F.array(F.lit("all"), F.col("state"))).alias("group_state"))
    stats = describe(tagged.filter(F.col("group_state").isin("all", *states)), [*keys, "group_state"], "value")
    full = fill_counts(grid.join(stats, [*keys, "group_state"], "left"))
    matched_rows = full.filter(F.col("group_state") == "all")
    out = deltas(full, matched_rows, keys, "mean_delta", "median_delta")
    extra = matched_rows.select(
        *keys, F.col("episode_count").alias("matched_episode_count"), F.col("sample_count").alias("matched_count")
    )
    return out.filter(F.col("group_state") != "all").join(extra, keys)


def episode_start_values(rows: DataFrame, states: Sequence[str], layout: Layout = AUTO) -> DataFrame:
    """Value at the first member of every run."""
    keys = ["symbol", "hypothesis_id", "horizon_bars"]
    arranged = arrange(rows, keys, before=1, layout=layout)
    members = {
        f"in_{s}": F.col("value").isNotNull() & F.coalesce(F.col("state") == s, F.lit(False)) for s in states
    }
    flagged = run_starts(arranged, members).own().df
    any_start = F.lit(False)
    for n in members:
        any_start = any_start | F.col(n)
    return flagged.filter(any_start).select(*keys, "state", "timestamp", "value")


def episode_start_stats(rows: DataFrame, states: Sequence[str], layout: Layout = AUTO) -> DataFrame:
    starts = episode_start_values(rows, states, layout)
    return describe(starts, ["symbol", "hypothesis_id", "horizon_bars", "state"], "value")


def sign_relation(value: Column, reference: Column) -> Column:
    return (
        F.when(value.isNull() | (value == 0), "zero_or_undefined")
        .when((value > 0) == (reference > 0), "same_sign")
        .otherwise("opposite_sign")
    )


def category(valid: Column, adequate: Column, mean: Column, median: Column) -> Column:
    """Per-symbol category from validity, adequacy and the two sign relations."""
    both = lambda r: (mean == r) & (median == r)
    return (
        F.when(~valid, "invalid")
        .when(~adequate, "inconclusive_insufficient_sample")
        .when(both("same_sign"), "directionally_consistent")
        .when(both("opposite_sign"), "directionally_reversed")
        .otherwise("mixed")
    )


def primary_results(rows: DataFrame, d: ValidationDefinition, layout: Layout = AUTO) -> DataFrame:
    """Primary cell, adequacy, category and magnitude ratios per primary symbol."""
    spark = rows.sparkSession
    refs = spark.createDataFrame(list(d.references), "symbol string, ref_mean double, ref_median double")
    cell = cells(rows, [d.primary_state], layout=layout)
    broken = integrity_issues(rows).groupBy("symbol").agg(F.count(F.lit(1)).alias("integrity_findings"))
    out = F.broadcast(refs).join(cell, "symbol", "left").join(broken, "symbol", "left")
    out = fill_counts(out, ["episode_count", "integrity_findings"])
    mean, median = F.col("mean_delta"), F.col("median_delta")
    adequate = F.col("episode_count") >= d.minimum_episodes
    valid = F.col("integrity_findings") == 0
    return out.withColumns(
        {
            "adequate": adequate,
            "valid": valid,
            "category": category(
                valid, adequate, sign_relation(mean, F.col("ref_mean")), sign_relation(median, F.col("ref_median"))
            ),
            "abs_mean_delta_ratio": F.abs(mean) / F.abs(F.col("ref_mean")),
            "abs_median_delta_ratio": F.abs(median) / F.abs(F.col("ref_median")),
        }
    )


def by_year(rows: DataFrame) -> DataFrame:
    return rows.withColumn("year", F.year("timestamp"))


def coverage_accounting(
    claims: DataFrame, outcomes: DataFrame, missed: DataFrame, excluded_claims: DataFrame, excluded_outcomes: DataFrame,
    d: ValidationDefinition,
) -> DataFrame:
    """Reserved, excluded, in-population, matured and missed counts up to the cutoff."""
    cut = matured(claims, outcomes, excluded_claims, excluded_outcomes, d).select("symbol", "cutoff")
    out_keys = excluded_claims.select("artifact_key").distinct().withColumn("_excluded", F.lit(True))
    done = (
        measured(outcomes, excluded_outcomes, d).filter(F.col("horizon_bars") == d.primary_horizon)
        .select("artifact_key").distinct().withColumn("_matured", F.lit(True))
    )
    rows = (
        of_hypothesis(claims, d.primary_hypothesis).join(out_keys, "artifact_key", "left")
        .join(done, "artifact_key", "left").join(cut, "symbol", "left")
    )
    early = F.coalesce(F.col("timestamp") <= F.col("cutoff"), F.lit(False))
    is_reserved, is_out = reserved(d), F.coalesce(F.col("_excluded"), F.lit(False))
    inside = ~is_reserved & ~is_out & early
    is_matured = inside & F.coalesce(F.col("_matured"), F.lit(False))
    thin = inside & (F.col("state") == INSUFFICIENT)
    counted = rows.groupBy("symbol").agg(
        F.count_if(is_reserved).alias("claims_reserved"),
        F.count_if(is_out & ~is_reserved & early).alias("claims_excluded"),
        F.count_if(inside).alias("claims_in_population"),
        F.count_if(thin).alias("claims_insufficient_history"),
        F.count_if(is_matured).alias("claims_matured"),
    )
    open_missed = (
        missed.select("symbol", "timestamp").distinct()
        .join(claims.select("symbol", "timestamp").distinct(), ["symbol", "timestamp"], "left_anti")
        .join(cut, "symbol").filter((F.col("timestamp") <= F.col("cutoff")) & ~reserved(d))
        .groupBy("symbol").agg(F.count(F.lit(1)).alias("missed_sessions"))
    )
    every = claims.sparkSession.createDataFrame([(s,) for s in d.symbols], "symbol string")
    out = F.broadcast(every).join(counted, "symbol", "left").join(open_missed, "symbol", "left").fillna(0)
    return out.withColumn(
        "claims_unmatured",
        F.col("claims_in_population") - F.col("claims_matured") - F.col("claims_insufficient_history"),
    )


def collection_status(
    per_symbol: DataFrame, d_provider: str, basis: str, interval: str, activated_at: Column, claims_per_tail: int = 4, warmup: int = 51
) -> DataFrame:
    """Operational status of one collection attempt per symbol, first rule wins.

    ``per_symbol``: symbol, provider, basis, interval, bars, built_at, tail,
    off_convention (bars not stamped at local midnight), tail_claims, new_claims.
    """
    from barloom.functions.times import in_collection_window, is_current_tail

    stale = (F.col("tail_claims") < claims_per_tail) & ~is_current_tail(F.col("tail"), F.col("built_at"))
    status = (
        F.when(~in_collection_window(F.col("built_at")), "outside_collection_window")
        .when((F.col("provider") != d_provider) | (F.col("basis") != basis) | (F.col("interval") != interval), "config_mismatch")
        .when(F.col("bars") == 0, "no_settled_bar")
        .when(F.col("off_convention") > 0, "timestamp_convention")
        .when(is_pre_activation(F.col("tail"), activated_at), "pre_activation")
        .when(stale, "stale_tail")
        .when(F.col("bars") < warmup, "insufficient_history")
        .when(F.col("new_claims") == 0, "duplicate_already_exists")
        .otherwise("ok")
    )
    return per_symbol.withColumn("status", status)
