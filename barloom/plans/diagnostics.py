"""Diagnostics over a study's observation rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import AUTO, Layout, arrange
from barloom.operators.runs import episode_summary, episodes, events_since, run_starts
from barloom.operators.stats import deltas, describe, fill_counts, sign_code
from barloom.plans.study import CELL
from barloom.schemas import BEARISH, BULLISH, DIRECTIONAL, EVALUATED, NEUTRAL, OBSERVATION_STATES, REPORTED_STATES

TREND, MOMENTUM, CROSSOVER = "trend_alignment", "momentum_in_trend_context", "trend_crossover"
SEGMENT_MAJORITY = 4
EPISODE_SHARE = 0.25


@dataclass(frozen=True)
class Segments:
    """Contiguous half-open segments (label, start, end)."""

    items: tuple[tuple[str, str, str], ...]

    def __post_init__(self) -> None:
        for (_, a, b), (_, c, _) in zip(self.items, self.items[1:]):
            if not (a < b and b == c):
                raise ValueError("segments must be non-empty and contiguous")

    def label(self, ts: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, start, end in self.items:
            inside = (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))
            out = F.when(inside, name).otherwise(out)
        return out

    @property
    def names(self) -> list[str]:
        return [name for name, _, _ in self.items]


def one_horizon(rows: DataFrame) -> DataFrame:
    """Observation rows without the horizon dimension, outcomes as an array.

    Every observation has one row per horizon, so any single horizon represents it.
    """
    key = ("symbol", "timestamp", "hypothesis_id", "state", "reason_signature")
    return rows.groupBy(*key).agg(F.collect_list(F.struct("horizon_bars", "status", "outcome_value")).alias("outcomes"))


def study_episodes(rows: DataFrame, layout: Layout = AUTO) -> DataFrame:
    """Maximal same-state runs per symbol and hypothesis, with outcomes at the start."""
    return episodes(
        one_horizon(rows), ("symbol", "hypothesis_id"), carry=("reason_signature", "outcomes"), layout=layout
    ).withColumnRenamed("outcomes", "start_outcomes")


def episode_rows(runs: DataFrame) -> DataFrame:
    return episode_summary(runs, ("symbol", "hypothesis_id"))


def episode_start_rows(runs: DataFrame) -> DataFrame:
    """Statistics over the first member of each run, per horizon."""
    flat = runs.filter(F.col("state").isin(*REPORTED_STATES)).select(
        "symbol", "hypothesis_id", "state", F.inline("start_outcomes")
    )
    group = ["symbol", "hypothesis_id", "state", "horizon_bars"]
    value = F.when(F.col("status") == EVALUATED, F.col("outcome_value"))
    return describe(flat.withColumn("value", value), group, "value", extra=[F.count(F.lit(1)).alias("episode_count")])


def paired_states(rows: DataFrame) -> DataFrame:
    """Trend and momentum observations of the same symbol and timestamp."""
    base = one_horizon(rows)
    trend = base.filter(F.col("hypothesis_id") == TREND).select(
        "symbol", "timestamp", F.col("state").alias("trend_state"), F.col("outcomes").alias("outcomes")
    )
    momentum = base.filter(F.col("hypothesis_id") == MOMENTUM).select(
        "symbol", "timestamp", F.col("state").alias("momentum_state"), F.col("reason_signature").alias("momentum_signature")
    )
    return trend.join(momentum, ["symbol", "timestamp"], "full")


def pair_issues(pairs: DataFrame) -> DataFrame:
    """Bars only one of the two hypotheses classified."""
    return pairs.filter(F.col("trend_state").isNull() | F.col("momentum_state").isNull())


def gate_crosstab(pairs: DataFrame, symbols: list[str]) -> DataFrame:
    """Counts of every trend and momentum state pair, zeros included."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame(
        [(s, a, b) for s in symbols for a in OBSERVATION_STATES for b in OBSERVATION_STATES],
        "symbol string, trend_state string, momentum_state string",
    )
    counted = pairs.groupBy("symbol", "trend_state", "momentum_state").agg(F.count(F.lit(1)).alias("count"))
    return F.broadcast(grid).join(counted, ["symbol", "trend_state", "momentum_state"], "left").fillna(0, ["count"])


def gate_partitions(pairs: DataFrame, symbols: list[str], horizons: list[int]) -> DataFrame:
    """Directional trend bars split by what momentum says, compared with their parent."""
    trend, momentum = F.col("trend_state"), F.col("momentum_state")
    opposite = F.when(trend == BULLISH, BEARISH).otherwise(BULLISH)
    part = (
        F.when(momentum == trend, "retained").when(momentum == NEUTRAL, "removed")
        .when(momentum == opposite, "opposite").otherwise("ineligible")
    )
    flat = (
        pairs.filter(trend.isin(*DIRECTIONAL))
        .select("symbol", trend.alias("state"), part.alias("partition"), "momentum_signature", F.inline("outcomes"))
        .filter(F.col("status") == EVALUATED)
    )
    tag = lambda p, sig: F.struct(p.alias("group_partition"), sig.alias("reason_signature"))
    tags = F.array_compact(
        F.array(
            tag(F.lit("parent"), F.lit("")),
            tag(F.col("partition"), F.lit("")),
            F.when(F.col("partition") == "removed", tag(F.col("partition"), F.col("momentum_signature"))),
        )
    )
    group = ["symbol", "state", "horizon_bars", "group_partition", "reason_signature"]
    stats = describe(flat.select("symbol", "state", "horizon_bars", "outcome_value", F.inline(tags)), group, "outcome_value")
    spark = pairs.sparkSession
    grid = spark.createDataFrame(
        [(s, d, h, p, "") for s in symbols for d in DIRECTIONAL for h in horizons
         for p in ("parent", "retained", "removed", "opposite")],
        "symbol string, state string, horizon_bars int, group_partition string, reason_signature string",
    )
    cells = F.broadcast(grid).unionByName(stats.filter("reason_signature <> '' OR group_partition = 'ineligible'").select(*group))
    full = fill_counts(cells.join(stats, group, "left"))
    parent = full.filter(F.col("group_partition") == "parent")
    compared = deltas(full, parent, ["symbol", "state", "horizon_bars"], "mean_delta", "median_delta")
    return compared.filter(F.col("group_partition") != "parent").withColumnRenamed("group_partition", "partition")


def segment_rows(rows: DataFrame, segments: Segments, symbols: list[str], layout: Layout = AUTO) -> DataFrame:
    """State groups within each segment against the segment's matched group.

    Runs are flagged on the full sequence; membership is masked by the segment,
    so a run crossing a boundary starts again in the next segment.
    """
    labelled = rows.withColumn("segment", segments.label(F.col("timestamp")))
    arranged = arrange(labelled, CELL, before=1, layout=layout)
    done = F.col("status") == EVALUATED
    members = {"in_all": done, **{f"in_{s}": done & (F.col("state") == s) for s in REPORTED_STATES}}
    flagged = run_starts(arranged, members)
    # the first position of a segment continues nothing in that segment
    crossing = ~F.col("segment").eqNullSafe(F.lag("segment").over(flagged.window))
    flagged = flagged.with_columns(
        {n: F.col(n) | (crossing & m) for n, m in members.items()}
    ).own()
    starts = flagged.df.select(
        *CELL, "segment",
        F.explode(
            F.array_compact(
                F.array(*[F.when(F.col(n), F.lit(n.removeprefix("in_"))) for n in members])
            )
        ).alias("group_state"),
    )
    group = [*CELL, "segment", "group_state"]
    runs = starts.groupBy(*group).agg(F.count(F.lit(1)).alias("episode_count"))
    values = labelled.filter(done).select(
        *CELL, "segment", "outcome_value", F.explode(F.array(F.lit("all"), F.col("state"))).alias("group_state")
    )
    stats = describe(values, group, "outcome_value")
    spark = rows.sparkSession
    cells = rows.select("hypothesis_id", "horizon_bars").distinct().crossJoin(
        F.broadcast(
            spark.createDataFrame(
                [(s, n, g) for s in symbols for n in segments.names for g in ("all", *REPORTED_STATES)],
                "symbol string, segment string, group_state string",
            )
        )
    )
    full = fill_counts(cells.join(stats, group, "left").join(runs, group, "left"), ["episode_count"])
    matched = full.filter(F.col("group_state") == "all")
    compared = deltas(full, matched, [*CELL, "segment"], "mean_delta", "median_delta")
    is_state = F.col("group_state") != "all"
    return compared.withColumns({c: F.when(is_state, F.col(c)) for c in ("mean_delta", "median_delta")})


def segment_issues(rows: DataFrame, segments: Segments) -> DataFrame:
    """Observations outside every segment."""
    return rows.filter(segments.label(F.col("timestamp")).isNull()).select("symbol", "timestamp").distinct()


def class_signs(groups: DataFrame, classes: dict[str, str], order: list[str]) -> DataFrame:
    """Signs of the state differences, concatenated per asset class in symbol order."""
    spark = groups.sparkSession
    known = spark.createDataFrame(
        [(s, classes[s], i) for i, s in enumerate(order)], "symbol string, asset_class string, ord int"
    )
    states = groups.filter(F.col("row_type") == "state").select(
        "hypothesis_id", F.col("group_state").alias("state"), "horizon_bars", "symbol",
        sign_code(F.col("mean_delta_vs_matched_unconditional")).alias("mean_sign"),
        sign_code(F.col("median_delta_vs_matched_unconditional")).alias("median_sign"),
    )
    joined = states.join(F.broadcast(known), "symbol")
    ordered = F.sort_array(F.collect_list(F.struct("ord", "mean_sign", "median_sign")))
    per = joined.groupBy("hypothesis_id", "state", "horizon_bars", "asset_class").agg(
        ordered.alias("_s"), F.count(F.lit(1)).alias("count")
    )
    return per.select(
        "hypothesis_id", "state", "horizon_bars", "asset_class", "count",
        F.array_join(F.transform("_s", lambda x: x["mean_sign"]), "").alias("mean_delta_signs"),
        F.array_join(F.transform("_s", lambda x: x["median_sign"]), "").alias("median_delta_signs"),
    )


def crossover_events(rows: DataFrame, layout: Layout = AUTO) -> DataFrame:
    """Directional crossover bars and the bars since the previous one."""
    base = one_horizon(rows.filter(F.col("hypothesis_id") == CROSSOVER))
    return events_since(base, ("symbol",), F.col("state").isin(*DIRECTIONAL), layout=layout)


def segment_agreement(groups: DataFrame, segments: DataFrame) -> DataFrame:
    """How many segments share the full window's sign of each difference."""
    full = groups.filter(
        (F.col("row_type") == "state") & F.col("group_state").isin(*DIRECTIONAL) & F.col("hypothesis_id").isin(TREND, MOMENTUM)
    ).select(
        *CELL, F.col("group_state").alias("state"),
        sign_code(F.col("mean_delta_vs_matched_unconditional")).alias("full_mean_sign"),
        sign_code(F.col("median_delta_vs_matched_unconditional")).alias("full_median_sign"),
    )
    parts = segments.filter(F.col("group_state").isin(*DIRECTIONAL)).select(
        *CELL, F.col("group_state").alias("state"),
        sign_code(F.col("mean_delta")).alias("_m"), sign_code(F.col("median_delta")).alias("_d"),
    )
    joined = full.join(parts, [*CELL, "state"], "left")
    agrees = lambda part, whole: (F.col(part) == F.col(whole)) & (F.col(whole) != "")
    return joined.groupBy(*CELL, "state", "full_mean_sign", "full_median_sign").agg(
        F.count("_m").alias("segments"),
        F.count_if(agrees("_m", "full_mean_sign")).alias("segments_with_same_mean_sign"),
        F.count_if(agrees("_d", "full_median_sign")).alias("segments_with_same_median_sign"),
    )


def concentration(summary: DataFrame) -> DataFrame:
    """Directional states whose largest run holds more than the threshold share."""
    return summary.filter(F.col("state").isin(*DIRECTIONAL) & F.col("hypothesis_id").isin(TREND, MOMENTUM)).withColumn(
        "concentrated", F.col("share_largest_episode") > EPISODE_SHARE
    )


def partition_signs(partitions: DataFrame) -> DataFrame:
    """Counts and signs of the gate partitions side by side."""
    base = partitions.filter("reason_signature = ''")
    pick = lambda p, c: F.max(F.when(F.col("partition") == p, c))
    return base.groupBy("symbol", "state", "horizon_bars").agg(
        *[pick(p, F.col("sample_count")).alias(f"{p}_n") for p in ("retained", "removed", "opposite")],
        *[
            pick(p, sign_code(F.col(f"{m}_delta"))).alias(f"{p}_{m}_delta_sign")
            for p in ("retained", "removed") for m in ("median", "mean")
        ],
    )
