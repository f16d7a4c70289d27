"""Hypotheses: evidence columns to (state, reason codes) columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.definitions import Hypothesis, feature
from barloom.operators.features import (
    RECURSIVE,
    add_framed,
    add_recursive,
    drop_helpers,
    quoted,
    rows_needed,
    unique_features,
)
from barloom.operators.layout import AUTO, Arranged, Layout, arrange, interval_seconds
from barloom.schemas import BEARISH, BULLISH, INSUFFICIENT, NEUTRAL, SERIES_KEY


def verdict(state: str, *codes: str | Column) -> Column:
    """Struct of a state and its ordered reason codes."""
    return F.struct(
        F.lit(state).alias("state"),
        F.array(*[c if isinstance(c, Column) else F.lit(c) for c in codes]).alias("reason_codes"),
    )


FAST = feature("sma", period=20)
SLOW = feature("sma", period=50)
MOMENTUM = feature("rsi", period=14)


def read_trend(now, past, p):
    fast, slow = now(FAST), now(SLOW)
    gap = F.when(slow != 0, (fast - slow) / F.abs(slow))
    return (
        F.when(gap > p["margin"], verdict(BULLISH, "fast_above_slow"))
        .when(gap < -p["margin"], verdict(BEARISH, "fast_below_slow"))
        .when((slow == 0) | (fast == slow), verdict(NEUTRAL, "fast_equals_slow"))
        .otherwise(verdict(NEUTRAL, "trend_margin_below_threshold"))
    )


def read_momentum(now, past, p):
    fast, slow, rsi = now(FAST), now(SLOW), now(MOMENTUM)
    high, low = rsi > p["upper_band"], rsi < p["lower_band"]
    trend = (
        F.when(fast > slow, F.lit("fast_above_slow"))
        .when(fast < slow, F.lit("fast_below_slow"))
        .otherwise(F.lit("fast_equals_slow"))
    )
    strength = F.when(high, F.lit("momentum_elevated")).otherwise(F.lit("momentum_depressed"))
    return (
        F.when(~high & ~low, verdict(NEUTRAL, "momentum_midrange"))
        .when(high & (fast > slow), verdict(BULLISH, trend, strength, "momentum_confirms_trend"))
        .when(low & (fast < slow), verdict(BEARISH, trend, strength, "momentum_confirms_trend"))
        .otherwise(verdict(NEUTRAL, trend, strength, "momentum_contradicts_trend"))
    )


def read_crossover(now, past, p):
    above = now(FAST) > now(SLOW)
    was_above = past(FAST, 1) > past(SLOW, 1)
    return (
        F.when(above & ~was_above, verdict(BULLISH, "crossed_above", "fast_above_slow"))
        .when(was_above & ~above, verdict(BEARISH, "crossed_below", "fast_below_slow"))
        .otherwise(verdict(NEUTRAL, "relationship_unchanged"))
    )


TREND_ALIGNMENT = Hypothesis("trend_alignment", 1, (FAST, SLOW), read_trend, parameters={"margin": 0.001})
MOMENTUM_IN_TREND = Hypothesis(
    "momentum_in_trend_context", 1, (MOMENTUM, FAST, SLOW), read_momentum,
    parameters={"upper_band": 55.0, "lower_band": 45.0},
)
TREND_CROSSOVER = Hypothesis("trend_crossover", 1, (FAST, SLOW), read_crossover, lookback=1)
HYPOTHESES = (TREND_ALIGNMENT, MOMENTUM_IN_TREND, TREND_CROSSOVER)


def past_name(key: str, k: int) -> str:
    return f"_p{k}_{key}"


def classify(arranged: Arranged, hypotheses: Sequence[Hypothesis], extra: dict[str, Column] | None = None) -> Arranged:
    """Own rows with features, ``extra`` framed columns and one verdict struct
    ``h_<id>`` per hypothesis.

    Features are computed once for all hypotheses. Values of earlier rows are
    read by ``lag`` before halo rows go; those of recursive features need halo
    copies of the finished rows.
    """
    specs = unique_features(f for h in hypotheses for f in h.features)
    arranged = add_framed(arranged, specs)
    lags = {(f, k) for h in hypotheses for f in h.features for k in range(1, h.lookback + 1)}

    def lagged(pairs):
        return {past_name(f.key, k): F.lag(quoted(f.key), k).over(arranged.window) for f, k in pairs}

    framed = lagged([(f, k) for f, k in lags if f.name not in RECURSIVE])
    arranged = arranged.with_columns({**framed, **(extra or {})})
    arranged = add_recursive(arranged, specs)
    late = [(f, k) for f, k in lags if f.name in RECURSIVE]
    if late:
        arranged = arranged.again(before=max(k for _, k in late))
        arranged = arranged.with_columns(lagged(late)).own()
    arranged = drop_helpers(arranged)
    outs = {}
    for h in hypotheses:
        undefined = F.col("_rn") <= h.lookback
        for f in h.features:
            undefined = undefined | quoted(f.key).isNull()
            for k in range(1, h.lookback + 1):
                undefined = undefined | quoted(past_name(f.key, k)).isNull()
        read = h.classify(lambda f: quoted(f.key), lambda f, k: quoted(past_name(f.key, k)), dict(h.parameters))
        if h.basis is not None:
            wrong = F.raise_error(F.concat(F.lit(f"{h.hypothesis_id} needs {h.basis} bars, got "), F.col("basis")))
            read = F.when(F.col("basis") != h.basis, wrong.cast(
                "struct<state:string,reason_codes:array<string>>")).otherwise(read)
        outs[f"h_{h.hypothesis_id}"] = F.when(undefined, verdict(INSUFFICIENT, "warmup_incomplete")).otherwise(read)
    arranged = arranged.with_columns(outs)
    drop = [past_name(f.key, k) for f, k in lags]
    return Arranged(arranged.df.drop(*drop), arranged.keys, arranged.part, arranged.block_rows)


def knowable_at(timestamp: str = "timestamp", interval: str = "interval") -> Column:
    """Earliest instant at which a bar, and what is derived from it, is complete."""
    return F.timestamp_seconds(F.unix_timestamp(timestamp) + interval_seconds(F.col(interval)))


def evidence_map(h: Hypothesis) -> Column:
    """Feature key to value, NULL where undefined."""
    return F.map_from_arrays(
        F.array(*[F.lit(f.key) for f in h.features]), F.array(*[quoted(f.key) for f in h.features])
    )


def long_observations(classified: DataFrame, hypotheses: Sequence[Hypothesis], carry: Sequence[str] = ()) -> DataFrame:
    """One row per bar and hypothesis."""
    items = F.array(
        *[
            F.struct(
                F.lit(h.hypothesis_id).alias("hypothesis_id"),
                F.lit(h.version).alias("version"),
                F.lit(h.fingerprint).alias("fingerprint"),
                F.col(f"h_{h.hypothesis_id}.state").alias("state"),
                F.col(f"h_{h.hypothesis_id}.reason_codes").alias("reason_codes"),
                evidence_map(h).alias("evidence"),
            )
            for h in hypotheses
        ]
    )
    return classified.select(*SERIES_KEY, "timestamp", *carry, knowable_at().alias("evaluable_from"), F.inline(items))


def lookback_rows(hypotheses: Sequence[Hypothesis]) -> int:
    specs = [f for h in hypotheses for f in h.features]
    return rows_needed(specs) + max(h.lookback for h in hypotheses)


def observe(
    bars: DataFrame, hypotheses: Sequence[Hypothesis] = HYPOTHESES, tail_only: bool = False, layout: Layout = AUTO
) -> DataFrame:
    """Classify every bar, or only the last bar of each series.

    The last bar is the one no bar follows, which a frame sees; no series has to
    be aggregated for it.
    """
    arranged = arrange(bars, before=lookback_rows(hypotheses), after=int(tail_only), layout=layout)
    extra = {"_tail": F.lead("_rn", 1).over(arranged.window).isNull()} if tail_only else None
    rows = classify(arranged, hypotheses, extra).df
    if tail_only:
        rows = rows.filter("_tail")
    return long_observations(rows, hypotheses)


def last_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last row of each series by timestamp (an aggregate, so no series is gathered)."""
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*[quoted(c) for c in rows.columns if c not in keys]), "timestamp").alias("_r"))
    return packed.select(*keys, "_r.*")


def verdict_issues(observations: DataFrame) -> DataFrame:
    """Rows a classifier must never produce."""
    codes = F.size("reason_codes")
    warm = F.array_contains("reason_codes", "warmup_incomplete")
    issue = (
        F.when(codes == 0, "empty_reason_codes")
        .when((F.col("state") == INSUFFICIENT) & ~warm, "insufficient_from_classifier")
        .when(~F.col("state").isin(BULLISH, BEARISH, NEUTRAL, INSUFFICIENT), "unknown_state")
    )
    return observations.withColumn("issue", issue).filter("issue IS NOT NULL")
