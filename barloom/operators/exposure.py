"""Open exposure and limit checks of intents against a snapshot of positions."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RiskPolicy:
    """Inclusive limits; only exceeding one is a violation."""

    max_notional_per_position: Decimal = Decimal("10000")
    max_total_notional: Decimal = Decimal("50000")
    max_open_positions: int = 5
    allow_duplicate_symbol: bool = False

    def __post_init__(self) -> None:
        for name in ("max_notional_per_position", "max_total_notional"):
            value = getattr(self, name)
            if not isinstance(value, Decimal) or not value.is_finite() or value <= 0:
                raise ValueError(f"{name} must be a positive Decimal")


# --- fixed values: reason codes in reporting order --------------------------
REASONS = ("position_limit", "total_exposure_limit", "open_position_limit", "duplicate_symbol")


def open_exposure(positions: DataFrame) -> DataFrame:
    """One row: exact sum of open notionals and number of open positions."""
    held = positions.filter(F.col("status") == "open")
    return held.agg(
        F.coalesce(F.sum("notional"), F.lit(Decimal("0"))).cast("decimal(38,6)").alias("total_open"),
        F.count(F.lit(1)).alias("open_count"),
    )


def exposure_by_symbol(positions: DataFrame) -> DataFrame:
    held = positions.filter(F.col("status") == "open")
    return held.groupBy("symbol").agg(
        F.sum("notional").cast("decimal(38,6)").alias("open_notional"), F.count(F.lit(1)).alias("open_count")
    )


def check_limits(intents: DataFrame, positions: DataFrame, policy: RiskPolicy) -> DataFrame:
    """Every rule on every intent against the same snapshot (stateless)."""
    snapshot = F.broadcast(open_exposure(positions))
    symbols = positions.filter(F.col("status") == "open").select("symbol").distinct().withColumn("_held", F.lit(True))
    rows = intents.crossJoin(snapshot).join(symbols, "symbol", "left")
    notional = F.col("notional")
    reasons = F.array_compact(
        F.array(
            F.when(notional > F.lit(policy.max_notional_per_position), REASONS[0]),
            F.when(F.col("total_open") + notional > F.lit(policy.max_total_notional), REASONS[1]),
            F.when(F.col("open_count") + 1 > policy.max_open_positions, REASONS[2]),
            F.when(F.coalesce(F.col("_held"), F.lit(False)) & F.lit(not policy.allow_duplicate_symbol), REASONS[3]),
        )
    )
    return rows.withColumn("reason_codes", reasons).withColumn(
        "outcome", F.when(F.size("reason_codes") == 0, "approved").otherwise("rejected")
    ).drop("_held", "total_open", "open_count")
