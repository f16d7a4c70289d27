"""Batch research study: classify, measure, group and compare."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.definitions import Hypothesis, OutcomeSpec
from barloom.operators.hypotheses import HYPOTHESES, classify, lookback_rows
from barloom.operators.layout import AUTO, Layout, arrange
from barloom.operators.outcomes import SPECS, forward_columns, outcome_structs, rows_ahead
from barloom.operators.runs import run_starts
from barloom.operators.stats import deltas, describe, fill_counts
from barloom.schemas import (
    EVALUATED, INELIGIBLE, INSUFFICIENT, NEUTRAL, NO_FUTURE, NO_REFERENCE, OBSERVATION_STATES,
    REPORTED_STATES, SERIES_KEY,
)


@dataclass(frozen=True)
class StudyDefinition:
    """Fetch, observation and outcome windows (half-open, UTC) of one study."""

    symbols: tuple[str, ...]
    fetch_start: str
    observation_start: str
    observation_end: str
    outcome_data_end: str
    interval: str = "1d"
    basis: str = "raw"
    minimum_warmup_bars: int = 51
    hypotheses: tuple[Hypothesis, ...] = HYPOTHESES
    specs: tuple[OutcomeSpec, ...] = SPECS

    def __post_init__(self) -> None:
        if not self.fetch_start < self.observation_start < self.observation_end <= self.outcome_data_end:
            raise ValueError("study windows must be ordered")
        if not self.symbols or len(set(self.symbols)) != len(self.symbols):
            raise ValueError("symbols must be unique and present")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def window_label(d: StudyDefinition) -> Column:
    ts = F.col("timestamp")
    return (
        F.when((ts < moment(d.fetch_start)) | (ts >= moment(d.outcome_data_end)), "outside")
        .when(ts < moment(d.observation_start), "warmup")
        .when(ts < moment(d.observation_end), "observation")
        .otherwise("buffer")
    )


def partition_window(bars: DataFrame, d: StudyDefinition) -> DataFrame:
    """Bars with their window label."""
    return bars.withColumn("window", window_label(d))


def window_counts(bars: DataFrame, d: StudyDefinition) -> DataFrame:
    w = F.col("window")
    return partition_window(bars, d).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars_fetched"),
        *[F.count_if(w == n).alias(f"{n}_bars") for n in ("warmup", "observation", "buffer", "outside")],
    )


def study_issues(bars: DataFrame, d: StudyDefinition) -> DataFrame:
    """Why the supplied bars do not describe the study (empty when they do)."""
    spark = bars.sparkSession
    expected = F.broadcast(spark.createDataFrame([(s,) for s in d.symbols], "symbol string"))
    counts = window_counts(bars, d)
    issue = (
        F.when(F.col("outside_bars") > 0, "outside_fetch_window")
        .when(F.col("warmup_bars") < d.minimum_warmup_bars, "insufficient_warmup")
        .when(F.col("observation_bars") == 0, "no_observation_bar")
    )
    windows = counts.withColumn("issue", issue).filter("issue IS NOT NULL").select("symbol", "issue")
    have = counts.select("symbol")
    missing = expected.join(have, "symbol", "left_anti").withColumn("issue", F.lit("missing_symbol"))
    extra = have.join(expected, "symbol", "left_anti").withColumn("issue", F.lit("unexpected_symbol"))
    wrong = (
        bars.filter((F.col("interval") != d.interval) | (F.col("basis") != d.basis))
        .select("symbol", F.lit("wrong_interval_or_basis").alias("issue")).distinct()
    )
    return windows.unionByName(missing).unionByName(extra).unionByName(wrong)


def observation_rows(bars: DataFrame, d: StudyDefinition, layout: Layout = AUTO) -> DataFrame:
    """One row per observed bar, hypothesis and horizon, from one pass over the series.

    Features and ``lead`` see warm-up and buffer bars; only then is the
    observation window cut out.
    """
    arranged = arrange(bars, before=lookback_rows(d.hypotheses), after=rows_ahead(d.specs), layout=layout)
    arranged = classify(arranged, d.hypotheses, forward_columns(arranged, d.specs))
    rows = arranged.df.filter(window_label(d) == "observation")
    pairs = []
    for h in d.hypotheses:
        verdict = F.col(f"h_{h.hypothesis_id}")
        outcomes = outcome_structs(d.specs, verdict["state"] != INSUFFICIENT)
        pairs.append(
            F.struct(
                F.lit(h.hypothesis_id).alias("hypothesis_id"),
                F.lit(h.version).alias("version"),
                F.lit(h.fingerprint).alias("fingerprint"),
                verdict["state"].alias("state"),
                F.array_join(verdict["reason_codes"], ",").alias("reason_signature"),
                outcomes.alias("outcomes"),
            )
        )
    per_bar = rows.select(*SERIES_KEY, "timestamp", F.col("_rn").alias("position"), F.inline(F.array(*pairs)))
    kept = [c for c in per_bar.columns if c != "outcomes"]
    return per_bar.select(*kept, F.inline("outcomes"))


CELL = ("hypothesis_id", "symbol", "horizon_bars")


def grouping_rows(rows: DataFrame) -> DataFrame:
    """Evaluated rows once per result group they belong to."""
    tag = lambda kind, state, sig: F.struct(
        F.lit(kind).alias("row_type"), state.alias("group_state"), sig.alias("group_signature")
    )
    none = F.lit("")
    tags = F.array_compact(
        F.array(
            tag("matched_unconditional", F.lit("all"), none),
            tag("state", F.col("state"), none),
            F.when(F.col("state") == NEUTRAL, tag("neutral_reason", F.col("state"), F.col("reason_signature"))),
        )
    )
    return rows.filter(F.col("status") == EVALUATED).select(
        *CELL, "timestamp", "position", "outcome_value", F.inline(tags)
    )


GROUP = (*CELL, "row_type", "group_state", "group_signature")


def group_runs(rows: DataFrame, layout: Layout = AUTO) -> DataFrame:
    """Runs of every result group, counted over all observation positions.

    A member row starts a run unless the previous position of the same symbol,
    hypothesis and horizon is a member of the same group.
    """
    arranged = arrange(rows, CELL, before=1, layout=layout)
    done = F.col("status") == EVALUATED
    members = {"in_all": done}
    members.update({f"in_{s}": done & (F.col("state") == s) for s in REPORTED_STATES})
    flagged = run_starts(arranged, members)
    w = flagged.window
    same_reason = F.lag("reason_signature").over(w).eqNullSafe(F.col("reason_signature")) & F.coalesce(
        F.lag((F.col("state") == NEUTRAL) & done).over(w), F.lit(False)
    )
    flagged = flagged.with_columns({"in_reason": done & (F.col("state") == NEUTRAL) & ~same_reason}).own()
    tag = lambda on, kind, state, sig: F.when(
        F.col(on),
        F.struct(F.lit(kind).alias("row_type"), F.lit(state).alias("group_state"), sig.alias("group_signature")),
    )
    none = F.lit("")
    tags = F.array_compact(
        F.array(
            tag("in_all", "matched_unconditional", "all", none),
            *[tag(f"in_{s}", "state", s, none) for s in REPORTED_STATES],
            tag("in_reason", "neutral_reason", NEUTRAL, F.col("reason_signature")),
        )
    )
    return flagged.df.select(*CELL, F.inline(tags)).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("episode_count"))


def result_groups(rows: DataFrame, d: StudyDefinition, layout: Layout = AUTO) -> DataFrame:
    """Matched, state and neutral-reason groups with differences to the matched row."""
    spans = [F.min("timestamp").alias("first_evaluated_timestamp"), F.max("timestamp").alias("last_evaluated_timestamp")]
    stats = describe(grouping_rows(rows), GROUP, "outcome_value", extra=spans)
    spark = rows.sparkSession
    grid = F.broadcast(
        spark.createDataFrame(
            [
                (h.hypothesis_id, s, spec.horizon_bars, kind, state, "")
                for h in d.hypotheses for s in d.symbols for spec in d.specs
                for kind, state in [("matched_unconditional", "all"), *[("state", x) for x in REPORTED_STATES]]
            ],
            "hypothesis_id string, symbol string, horizon_bars int, row_type string, group_state string, group_signature string",
        )
    )
    cells = grid.unionByName(stats.filter(F.col("row_type") == "neutral_reason").select(*GROUP))
    full = cells.join(stats, list(GROUP), "left").join(group_runs(rows, layout), list(GROUP), "left")
    full = fill_counts(full, ["episode_count"])
    matched = full.filter(F.col("row_type") == "matched_unconditional")
    compared = deltas(
        full, matched, CELL, "mean_delta_vs_matched_unconditional", "median_delta_vs_matched_unconditional"
    )
    own_reference = F.col("row_type") == "matched_unconditional"
    return compared.withColumns(
        {
            c: F.when(~own_reference, F.col(c))
            for c in ("mean_delta_vs_matched_unconditional", "median_delta_vs_matched_unconditional")
        }
    )


def coverage(rows: DataFrame) -> DataFrame:
    """State and status counts per hypothesis, symbol and horizon."""
    state, status = F.col("state"), F.col("status")
    return rows.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("total_observations"),
        *[F.count_if(state == s).alias(f"{s}_count") for s in OBSERVATION_STATES],
        F.count_if(status == EVALUATED).alias("evaluated"),
        F.count_if(status == NO_FUTURE).alias("insufficient_future_data"),
        F.count_if(status == NO_REFERENCE).alias("no_reference_bar"),
        F.count_if(status == INELIGIBLE).alias("ineligible"),
        F.min("timestamp").alias("first_observation_timestamp"),
        F.max("timestamp").alias("last_observation_timestamp"),
    )


def coverage_issues(counted: DataFrame) -> DataFrame:
    """Cells whose states or statuses do not partition the observations."""
    states = sum((F.col(f"{s}_count") for s in OBSERVATION_STATES), F.lit(0))
    statuses = F.col("evaluated") + F.col("insufficient_future_data") + F.col("no_reference_bar") + F.col("ineligible")
    return counted.filter((states != F.col("total_observations")) | (statuses != F.col("total_observations")))


def symbol_coverage(bars: DataFrame, d: StudyDefinition, layout: Layout = AUTO) -> DataFrame:
    """Bars per window, spans and the largest close-to-close change."""
    arranged = arrange(bars, before=1, layout=layout)
    change = F.abs(F.col("close") / F.lag("close").over(arranged.window) - 1.0)
    rows = arranged.with_columns({"_change": change}).result().withColumn("window", window_label(d))
    w, ts = F.col("window"), F.col("timestamp")
    observed = F.when(w == "observation", ts)
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars_fetched"),
        F.count_if(w == "warmup").alias("warmup_bars"),
        F.count_if(w == "observation").alias("observation_bars"),
        F.count_if(w == "buffer").alias("outcome_buffer_bars"),
        F.min(ts).alias("first_timestamp"),
        F.max(ts).alias("last_timestamp"),
        F.min(observed).alias("first_observation_timestamp"),
        F.max(observed).alias("last_observation_timestamp"),
        F.max("_change").alias("max_abs_single_bar_close_return"),
    )


def wide_observations(rows: DataFrame, specs: Sequence[OutcomeSpec] = SPECS) -> DataFrame:
    """The study's observation table: one row per bar and hypothesis, horizons side by side."""
    key = [*SERIES_KEY, "timestamp", "hypothesis_id", "version", "fingerprint", "state", "reason_signature"]
    pick = lambda h, c: F.max(F.when(F.col("horizon_bars") == h, F.col(c)))
    return rows.groupBy(*key).agg(
        *[
            pick(s.horizon_bars, c).alias(f"h{s.horizon_bars}_{c}")
            for s in specs for c in ("status", "outcome_value", "reference_timestamp", "future_timestamp")
        ]
    )


def compare_summary(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows missing on either side or differing in any of the eleven metrics."""
    metrics = [
        "sample_count", "mean_forward_return", "median_forward_return", "min_forward_return", "max_forward_return",
        "positive_count", "negative_count", "zero_count", "episode_count",
        "mean_delta_vs_matched_unconditional", "median_delta_vs_matched_unconditional",
    ]
    left = stored.select(*GROUP, F.struct(*metrics).alias("stored"))
    right = recomputed.select(*GROUP, F.struct(*metrics).alias("recomputed"))
    joined = left.join(right, list(GROUP), "full")
    issue = (
        F.when(F.col("stored").isNull(), "unexpected_row").when(F.col("recomputed").isNull(), "missing_row")
        .when(~F.col("stored").eqNullSafe(F.col("recomputed")), "metric_differs")
    )
    return joined.withColumn("issue", issue).filter("issue IS NOT NULL").select(*GROUP, "issue")
