"""Forward outcomes at fixed horizons and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.definitions import OutcomeSpec
from barloom.operators.layout import AUTO, Arranged, Layout, arrange, interval_seconds
from barloom.operators.stats import describe, null_safe
from barloom.schemas import (
    BEARISH, BULLISH, EVALUATED, INELIGIBLE, INSUFFICIENT, INTRADAY, NEUTRAL, NO_FUTURE, NO_REFERENCE, SERIES_KEY,
)

HORIZONS = (1, 5, 20)
SPECS = tuple(OutcomeSpec(h) for h in HORIZONS)


def rows_ahead(specs: Sequence[OutcomeSpec]) -> int:
    return max(max(s.horizon_bars for s in specs), 1)


def forward_columns(arranged: Arranged, specs: Sequence[OutcomeSpec]) -> dict[str, Column]:
    """``lead`` columns: next bar's time and open, and each horizon's future bar."""
    w = arranged.window
    out = {"f_ref_ts": F.lead("timestamp", 1).over(w), "f_ref_price": F.lead("open", 1).over(w)}
    for s in specs:
        out[f"f_ts_{s.fingerprint}"] = F.lead("timestamp", s.horizon_bars).over(w)
        out[f"f_px_{s.fingerprint}"] = F.lead(s.future_field, s.horizon_bars).over(w)
    return out


def outcome_structs(specs: Sequence[OutcomeSpec], eligible: Column) -> Column:
    """Array with one outcome per spec of the row's basis; an ineligible row is never measured.

    A row whose basis is that of no spec ends the job: it must not be measured
    under another one.
    """
    items = []
    refused = F.raise_error(F.concat(F.lit("no outcome spec has the basis "), F.coalesce("basis", F.lit("NULL"))))
    for s in specs:
        future_ts, future = F.col(f"f_ts_{s.fingerprint}"), F.col(f"f_px_{s.fingerprint}")
        status = (
            F.when(~eligible, INELIGIBLE)
            .when(F.col("f_ref_ts").isNull(), NO_REFERENCE)
            .when(future_ts.isNull(), NO_FUTURE)
            .otherwise(EVALUATED)
        )
        measured = status == EVALUATED
        has_reference = status.isin(EVALUATED, NO_FUTURE)
        items.append(
            F.struct(
                F.lit(s.fingerprint).alias("spec_fingerprint"),
                F.lit(s.horizon_bars).alias("horizon_bars"),
                status.alias("status"),
                F.when(has_reference, F.col("f_ref_ts")).alias("reference_timestamp"),
                F.when(measured, future_ts).alias("future_timestamp"),
                F.when(has_reference, F.col("f_ref_price")).alias("reference_price"),
                F.when(measured, future).alias("future_price"),
                F.when(measured, future / F.col("f_ref_price") - 1.0).alias("outcome_value"),
            )
        )
    # the specs of a basis are known here; choosing them per row would build every outcome twice, without compilation
    out = refused.cast("void")
    for basis in dict.fromkeys(s.basis for s in specs):
        own = F.array(*[item for s, item in zip(specs, items) if s.basis == basis])
        out = F.when(F.col("basis") == basis, own).otherwise(out)
    return out


def forward_bars(bars: DataFrame, specs: Sequence[OutcomeSpec], layout: Layout = AUTO) -> DataFrame:
    """Bar keys with the forward columns of every spec."""
    read = dict.fromkeys(["open", *[s.future_field for s in specs]])
    arranged = arrange(bars.select(*SERIES_KEY, "timestamp", *read), after=rows_ahead(specs), layout=layout)
    arranged = arranged.with_columns(forward_columns(arranged, specs))
    return arranged.result().select(*SERIES_KEY, "timestamp", *forward_columns(arranged, specs))


def evaluate(
    observations: DataFrame, bars: DataFrame, specs: Sequence[OutcomeSpec] = SPECS, layout: Layout = AUTO
) -> DataFrame:
    """One row per observation and spec, matched on the exact bar."""
    ahead = forward_bars(bars, specs, layout)
    joined = at_their_bars(observations, ahead)
    kept = [c for c in joined.columns if not c.startswith("f_")]
    return joined.select(*kept, F.inline(outcome_structs(specs, F.col("state") != INSUFFICIENT)))


def at_their_bars(points: DataFrame, ahead: DataFrame) -> DataFrame:
    """Points with their bar's forward columns; a point without its exact bar ends the job (``match_issues`` lists them)."""
    # time first: rows are sorted by it, and those of one long series would all begin with the same name
    joined = points.join(ahead.withColumn("f_held", F.lit(True)), ["timestamp", *SERIES_KEY], "left")
    joined = joined.select(*SERIES_KEY, *[c for c in joined.columns if c not in SERIES_KEY])
    named = F.concat_ws(" ", F.lit("no_matching_bar"), *[F.col(k).cast("string") for k in (*SERIES_KEY, "timestamp")])
    return joined.withColumn("f_held", F.when(F.col("f_held"), True).otherwise(F.raise_error(named).cast("boolean"))).filter("f_held")


def measure_forward(
    points: DataFrame, bars: DataFrame, specs: Sequence[OutcomeSpec] = SPECS, layout: Layout = AUTO
) -> DataFrame:
    """Forward outcomes of market points that have no producer."""
    ahead = forward_bars(bars, specs, layout)
    joined = at_their_bars(points, ahead)
    kept = [c for c in joined.columns if not c.startswith("f_")]
    return joined.select(*kept, F.inline(outcome_structs(specs, F.lit(True))))


def match_issues(observations: DataFrame, bars: DataFrame, identity: Sequence[str] = ("hypothesis_id", "version")) -> DataFrame:
    """Observations without their exact bar, or repeated at one timestamp."""
    key = [*SERIES_KEY, "timestamp"]
    unmatched = observations.join(bars.select(*key), key, "left_anti").select(
        *key, *identity, F.lit("no_matching_bar").alias("issue")
    )
    repeated = (
        observations.groupBy(*key, *identity).count().filter("count > 1")
        .select(*key, *identity, F.lit("duplicate_observation").alias("issue"))
    )
    return unmatched.unionByName(repeated)


def spacing_issues(bars: DataFrame, layout: Layout = AUTO) -> DataFrame:
    """Intraday bars whose next bar starts before they end."""
    arranged = arrange(bars, after=1, layout=layout)
    arranged = arranged.with_columns({"next_timestamp": F.lead("timestamp").over(arranged.window)})
    gap = F.unix_timestamp("next_timestamp") - F.unix_timestamp("timestamp")
    intraday = F.col("interval").isin(*INTRADAY)
    return (
        arranged.result()
        .filter(intraday & (gap < interval_seconds(F.col("interval"))))
        .select(*SERIES_KEY, "timestamp", "next_timestamp", gap.alias("spacing_seconds"))
    )


def status_issues(outcomes: DataFrame) -> DataFrame:
    """Outcome rows whose fields disagree with their status."""
    s, value = F.col("status"), F.col("outcome_value")
    future = F.col("future_timestamp").isNotNull() | F.col("future_price").isNotNull()
    both_future = F.col("future_timestamp").isNotNull() & F.col("future_price").isNotNull()
    ref = F.col("reference_timestamp").isNotNull() | F.col("reference_price").isNotNull()
    both_ref = F.col("reference_timestamp").isNotNull() & F.col("reference_price").isNotNull()
    issue = (
        F.when((s == EVALUATED) & ~(both_ref & both_future & value.isNotNull()), "evaluated_without_fields")
        .when((s != EVALUATED) & (value.isNotNull() | future), "value_without_evaluation")
        .when((s == NO_FUTURE) & ~both_ref, "reference_missing")
        .when(s.isin(NO_REFERENCE, INELIGIBLE) & ref, "reference_not_allowed")
        .when((s == INELIGIBLE) != (F.col("state") == INSUFFICIENT), "eligibility_mismatch")
    )
    return outcomes.withColumn("issue", issue).filter("issue IS NOT NULL")


def state_metrics(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, median, positive rate and directional hit rate per group and state."""
    done = outcomes.filter(F.col("status") == EVALUATED)
    out = describe(done, [*keys, "state"], "outcome_value")
    n = F.col("sample_count")
    hit = F.when(F.col("state") == BULLISH, F.col("positive_count") / n).when(
        F.col("state") == BEARISH, F.col("negative_count") / n
    )
    return out.select(
        *keys, "state", F.col("sample_count").alias("count"), "mean_forward_return", "median_forward_return",
        (F.col("positive_count") / n).alias("positive_return_rate"), hit.alias("directional_hit_rate"),
    )


SUMMARY_KEYS = ("symbol", "interval", "basis", "hypothesis_id", "version", "spec_fingerprint", "horizon_bars")


def summarize(outcomes: DataFrame, keys: Sequence[str] = SUMMARY_KEYS) -> DataFrame:
    """Accounting and metrics per evaluation; statuses partition the observations."""
    keys = list(keys)
    status, state = F.col("status"), F.col("state")
    accounting = outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_observations"),
        F.count_if(status == INELIGIBLE).alias("ineligible_observations"),
        F.count_if(status != INELIGIBLE).alias("eligible_observations"),
        F.count_if(status == EVALUATED).alias("evaluated_observations"),
        F.count_if(status == NO_FUTURE).alias("insufficient_future_data"),
        F.count_if(status == NO_REFERENCE).alias("no_reference_bar"),
        *[F.count_if(state == s).alias(f"{s}_observations") for s in (BULLISH, BEARISH, NEUTRAL, INSUFFICIENT)],
    )
    done = outcomes.filter(status == EVALUATED)
    grouped = done.select(*keys, "outcome_value", F.explode(F.array(F.lit("all"), state)).alias("group"))
    stats = describe(grouped, [*keys, "group"], "outcome_value")
    n = F.col("sample_count")
    hit = F.when(F.col("group") == BULLISH, F.col("positive_count") / n).when(
        F.col("group") == BEARISH, F.col("negative_count") / n
    )
    pick = lambda g, c: F.max(F.when(F.col("group") == g, c))
    wide = stats.withColumns({"positive_rate": F.col("positive_count") / n, "hit_rate": hit}).groupBy(*keys).agg(
        *[
            pick(g, F.col(c)).alias(f"{g}_{short}")
            for g in ("all", BULLISH, BEARISH, NEUTRAL)
            for c, short in (
                ("sample_count", "count"), ("mean_forward_return", "mean"), ("median_forward_return", "median"),
                ("positive_rate", "positive_rate"), ("hit_rate", "hit_rate"),
            )
            if not (g in ("all", NEUTRAL) and short == "hit_rate")
        ]
    )
    out = null_safe(accounting, wide, keys, "left")
    counts = [f"{g}_count" for g in ("all", BULLISH, BEARISH, NEUTRAL)]
    return out.fillna(0, counts).withColumn("unconditional_mean_forward_return", F.col("all_mean"))
