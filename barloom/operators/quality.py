"""Validation of bars: row rules, sequence rules, gaps, and refusal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import AUTO, Layout, arrange, interval_seconds
from barloom.schemas import INTERVAL_SECONDS, PRICE_FIELDS, SERIES_KEY


class RefusedData(ValueError):
    """Raised by ``require_empty``; carries the first offending rows."""


def require_empty(violations: DataFrame, what: str, shown: int = 20) -> None:
    """Refuse when any violation exists; nothing is repaired."""
    rows = violations.limit(shown).collect()
    if rows:
        raise RefusedData(f"{what}: " + "; ".join(str(r) for r in rows))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def unsigned_zero(value: Column) -> Column:
    """-0.0 becomes 0.0."""
    return value + F.lit(0.0)


def normalize_bars(bars: DataFrame) -> DataFrame:
    """Symbols trimmed and upper-cased, sources trimmed."""
    return bars.withColumns({"symbol": F.upper(F.trim("symbol")), "source": F.trim("source")})


def row_issues() -> Column:
    """Array of issue codes of one bar; non-finite numbers end the numeric checks."""
    o, h, lo, c, v = (F.col(f) for f in (*PRICE_FIELDS, "volume"))
    numbers = finite(o) & finite(h) & finite(lo) & finite(c) & finite(v)
    relations = F.array(
        F.when((o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0), "non_positive_price"),
        F.when(v < 0, "negative_volume"),
        F.when(h < lo, "high_below_low"),
        F.when(h < o, "high_below_open"),
        F.when(h < c, "high_below_close"),
        F.when(lo > o, "low_above_open"),
        F.when(lo > c, "low_above_close"),
    )
    named = F.array(
        F.when(F.coalesce(F.trim("symbol"), F.lit("")) == "", "empty_symbol"),
        F.when(F.col("timestamp").isNull(), "naive_timestamp"),
    )
    numeric = F.when(numbers, relations).otherwise(F.array(F.lit("non_finite_value")))
    return F.array_compact(F.concat(named, numeric))


def bar_issues(bars: DataFrame) -> DataFrame:
    """Bars with at least one issue, and their codes."""
    return bars.withColumn("issues", row_issues()).filter(F.size("issues") > 0)


def series_issues(
    bars: DataFrame, batch: Sequence[str] = (), seq: str = "seq", expected: dict[str, str] | None = None,
    layout: Layout = AUTO,
) -> DataFrame:
    """Sequence rules in arrival order (``seq``) within each ``batch``.

    Duplicate instants are found by an aggregate and a join; the order check
    needs one row of history only.
    """
    batch = list(batch)
    expected = expected or {}
    key = [*batch, "timestamp"]
    first_at = bars.groupBy(*key).agg(F.min(seq).alias("_first_seq"))
    arranged = arrange(bars, batch, order=(seq,), before=1, layout=layout)
    rows = arranged.with_columns({"_prev": F.lag("timestamp").over(arranged.window)}).result()
    names = ("symbol", "interval", "source")
    if all(n in expected for n in names):
        rows = rows.withColumns({f"_e_{n}": F.lit(expected[n]) for n in names})
    else:
        heads = bars.groupBy(*batch).agg(F.min_by(F.struct(*names), seq).alias("_head"))
        rows = rows.join(heads, batch) if batch else rows.crossJoin(heads)
        rows = rows.withColumns(
            {f"_e_{n}": F.lit(expected[n]) if n in expected else F.col(f"_head.{n}") for n in names}
        ).drop("_head")
    rows = rows.join(first_at, key)
    issues = F.array_compact(
        F.array(
            *[F.when(F.col(n) != F.col(f"_e_{n}"), f"{n}_mismatch") for n in names],
            F.when(F.col(seq) > F.col("_first_seq"), "duplicate_timestamp"),
            F.when(F.col("timestamp") < F.col("_prev"), "unordered_timestamp"),
        )
    )
    return (
        rows.withColumn("issues", issues).filter(F.size("issues") > 0)
        .drop("_prev", "_first_seq", *[f"_e_{n}" for n in names])
    )


def key_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Series of ``left`` with no series of the same key, basis included, in ``right``."""
    return left.select(*SERIES_KEY).distinct().join(right.select(*SERIES_KEY).distinct(), list(SERIES_KEY), "left_anti")


def find_gaps(bars: DataFrame, calendar: DataFrame | None = None, layout: Layout = AUTO) -> DataFrame:
    """Consecutive bars further apart than one interval.

    ``calendar`` (symbol, interval, after, before, status) may classify a gap;
    without it the status is unknown.
    """
    arranged = arrange(bars, before=1, layout=layout)
    rows = arranged.with_columns({"after": F.lag("timestamp").over(arranged.window)}).result()
    elapsed = F.unix_timestamp("timestamp") - F.unix_timestamp("after")
    step = interval_seconds(F.col("interval"))
    gaps = rows.filter(elapsed > step).select(
        *SERIES_KEY, "after", F.col("timestamp").alias("before"),
        F.greatest(F.floor(elapsed / step) - 1, F.lit(1)).cast("long").alias("missing_intervals"),
    )
    if calendar is None:
        return gaps.withColumn("status", F.lit("unknown"))
    known = calendar.select("symbol", "interval", "after", "before", "status")
    return gaps.join(known, ["symbol", "interval", "after", "before"], "left").fillna("unknown", ["status"])


def gap_report(bars: DataFrame, gaps: DataFrame) -> DataFrame:
    """Bar and gap counts per series; a gap is missing data only if a calendar says so."""
    counts = bars.groupBy(*SERIES_KEY).agg(F.count(F.lit(1)).alias("bar_count"))
    found = gaps.groupBy(*SERIES_KEY).agg(
        F.count(F.lit(1)).alias("gap_count"),
        F.count_if(F.col("status") == "unknown").alias("unclassified"),
        F.count_if(F.col("status") == "expected_session_missing").alias("missing_sessions"),
        F.sum("missing_intervals").alias("missing_intervals"),
    )
    return counts.join(found, list(SERIES_KEY), "left").fillna(0)


def implausible(moment: Column, now: Column, hours: int = 26) -> Column:
    """Source times further ahead than any time zone explains."""
    return F.unix_timestamp(moment) > F.unix_timestamp(now) + hours * 3600


def settled_only(bars: DataFrame, now: Column) -> DataFrame:
    """Bars that have ended by ``now``; bare column comparisons, so the scan can skip by them."""
    ended = F.lit(False)
    for name, seconds in INTERVAL_SECONDS.items():
        ended = ended | ((F.col("interval") == name) & (F.col("timestamp") <= now - F.expr(f"INTERVAL {seconds} SECOND")))
    return bars.filter(ended)


def clip(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive time window; reaches the scan as a pushed filter."""
    if start is not None:
        bars = bars.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        bars = bars.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    return bars


def recent(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Last ``n`` rows per key.

    Spark limits each key inside every map partition before the shuffle
    (WindowGroupLimit) while ``n`` is below its threshold of 1000, so a hot key
    sends ``n`` rows per partition; for a larger ``n`` raise
    ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")
