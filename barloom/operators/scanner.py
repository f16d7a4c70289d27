"""Scans of a universe: latest assessment per symbol, category and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.definitions import Hypothesis, Policy
from barloom.operators.assess import assess
from barloom.operators.hypotheses import HYPOTHESES, observe
from barloom.operators.layout import AUTO, Layout
from barloom.schemas import CONFLICTED, INSUFFICIENT, NEUTRAL

# --- fixed values: categories in inspection order ---------------------------
CATEGORY_ORDER = ("unanimous_directional", "directional_with_neutral", "conflicted", "neutral", "not_assessable")

# --- fixed values: failure kind to scan error code --------------------------
ERROR_CODES = {
    "provider": "provider_unavailable",
    "data_quality": "data_quality",
    "domain": "symbol_mismatch",
    "request": "request_invalid",
    "unexpected": "unexpected",
}


def category(state: Column, reasons: Column) -> Column:
    unanimous = F.array_contains(reasons, "unanimous_bullish") | F.array_contains(reasons, "unanimous_bearish")
    return (
        F.when(state.isNull() | (state == INSUFFICIENT), "not_assessable")
        .when(state == CONFLICTED, "conflicted")
        .when(state == NEUTRAL, "neutral")
        .when(unanimous, "unanimous_directional")
        .otherwise("directional_with_neutral")
    )


def category_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), name)


def eligibility(state: Column) -> Column:
    return (
        F.when(state.isNull(), "no_data").when(state == INSUFFICIENT, "insufficient_evidence").otherwise("eligible")
    )


def error_code(kind: Column) -> Column:
    """Scan error of a failure kind; unknown kinds are unexpected."""
    table = F.create_map(*[F.lit(x) for pair in ERROR_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("unexpected"))


def normalize_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def symbol_ok(symbol: Column) -> Column:
    """At most 32 characters, no white space or control characters."""
    s = normalize_symbol(symbol)
    return (F.length(s).between(1, 32)) & ~s.rlike(r"[\s\p{Cntrl}]")


def universe(raw: DataFrame) -> DataFrame:
    """Exploded universes -> one row per normalised symbol with repeat counts."""
    return (
        raw.withColumn("symbol", normalize_symbol(F.col("symbol")))
        .groupBy("universe_id", "symbol")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def universe_issues(raw: DataFrame, most: int | None = None) -> DataFrame:
    """Bad symbols, empty universes and those over the caller's bound of symbols."""
    rows = universe(raw)
    per = rows.groupBy("universe_id").agg(
        F.count("symbol").alias("symbols"),
        F.sum(F.col("occurrences") - 1).alias("duplicates"),
        F.count_if(~symbol_ok(F.col("symbol"))).alias("bad_symbols"),
    )
    issue = F.when(F.col("bad_symbols") > 0, "bad_symbol")
    if most is not None:
        issue = F.when(F.col("symbols") > most, "too_many_symbols").otherwise(issue)
    return per.withColumn("issue", issue)


def rank_order() -> list[Column]:
    """Category, then classifying count, then freshness, then symbol; never direction."""
    return [
        category_rank(F.col("category")), F.col("classifying_count").desc(), F.col("latest_bar").desc_nulls_last(),
        F.col("symbol"),
    ]


def rank_rows(rows: DataFrame, eligible_only: bool = False) -> DataFrame:
    """Rows in the order of inspection."""
    if eligible_only:
        rows = rows.filter(F.col("eligibility") == "eligible")
    return rows.orderBy(*rank_order())


def scan(
    symbols: DataFrame, bars: DataFrame, policy: Policy | None = None,
    hypotheses: Sequence[Hypothesis] = HYPOTHESES, failures: DataFrame | None = None, layout: Layout = AUTO,
    now: Column | None = None,
) -> DataFrame:
    """Assess the last bar of every universe symbol and order the rows.

    ``failures`` (symbol, kind) marks symbols whose data could not be used. With
    ``now`` only the history window of each interval is read, by a filter that
    reaches the scan.
    """
    policy = policy or Policy.of(hypotheses, 2)
    members = symbols.select("symbol").distinct()
    if now is not None:
        bars = in_history(bars, now)
    wanted = bars.join(members, "symbol", "left_semi")
    latest = assess(observe(wanted, hypotheses, tail_only=True, layout=layout), policy)
    rows = members.join(latest, "symbol", "left")
    if failures is not None:
        rows = rows.join(failures.groupBy("symbol").agg(F.max("kind").alias("_kind")), "symbol", "left")
    else:
        rows = rows.withColumn("_kind", F.lit(None).cast("string"))
    state = F.when(F.col("_kind").isNull(), F.col("state"))
    out = rows.select(
        "symbol",
        F.when(F.col("_kind").isNotNull(), "failed").otherwise(eligibility(state)).alias("eligibility"),
        F.when(F.col("_kind").isNotNull(), error_code(F.col("_kind"))).alias("error_code"),
        category(state, F.col("reason_codes")).alias("category"),
        state.alias("state"),
        F.coalesce(F.col("bullish_count") + F.col("bearish_count") + F.col("neutral_count"), F.lit(0)).alias("classifying_count"),
        F.col("timestamp").alias("latest_bar"),
        "reason_codes",
    )
    return rank_rows(out)


def scan_counters(rows: DataFrame) -> DataFrame:
    """Counts per eligibility, their balance and the overall status."""
    e = F.col("eligibility")
    counted = rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(e == k).alias(k) for k in ("eligible", "no_data", "insufficient_evidence", "failed")],
    )
    failed, total = F.col("failed"), F.col("total")
    status = F.when(failed == 0, "all_ok").when(failed == total, "all_failed").otherwise("partial")
    balanced = F.col("eligible") + F.col("no_data") + F.col("insufficient_evidence") + failed == total
    return counted.withColumns({"status": status, "balanced": balanced})


# --- fixed values: days of history per interval, 730 for the others ---------
HISTORY_DAYS, OTHER_DAYS = {"1wk": 1095, "1mo": 3650}, 730


def history_start(now: Column, interval: Column) -> Column:
    """Start of the fetched history: fewer days for finer bars."""
    days = F.lit(OTHER_DAYS)
    for name, n in HISTORY_DAYS.items():
        days = F.when(interval == name, n).otherwise(days)
    return F.timestamp_seconds(F.unix_timestamp(now) - days * 86400)


def in_history(bars: DataFrame, now: Column) -> DataFrame:
    """Bars of the history window; bare column comparisons, so the scan can skip by them."""
    after = lambda days: F.col("timestamp") >= now - F.expr(f"INTERVAL {days} DAY")
    wanted = ~F.col("interval").isin(*HISTORY_DAYS) & after(OTHER_DAYS)
    for name, days in HISTORY_DAYS.items():
        wanted = wanted | ((F.col("interval") == name) & after(days))
    return bars.filter(wanted)
