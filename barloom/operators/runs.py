"""Runs of equal states and of membership, in observation order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import AUTO, Arranged, Layout, arrange, running


def run_starts(arranged: Arranged, members: dict[str, Column]) -> Arranged:
    """Flag the first row of every maximal TRUE run of each membership.

    Needs one halo row before. Counting the flags counts the runs.
    """
    held = arranged.with_columns({f"_m_{n}": F.coalesce(c, F.lit(False)) for n, c in members.items()})
    starts = {
        n: F.col(f"_m_{n}") & ~F.coalesce(F.lag(f"_m_{n}").over(held.window), F.lit(False)) for n in members
    }
    held = held.with_columns(starts)
    return Arranged(held.df.drop(*[f"_m_{n}" for n in members]), held.keys, held.part, held.block_rows)


def count_runs(df: DataFrame, keys: Sequence[str], order: str, member: Column, layout: Layout = AUTO) -> DataFrame:
    """Number of maximal TRUE runs per key over all rows in order."""
    arranged = arrange(df.withColumn("_member", member), keys, (order,), before=1, layout=layout)
    flagged = run_starts(arranged, {"_start": F.col("_member")}).own().df
    return flagged.groupBy(*keys).agg(F.count_if("_start").alias("episode_count"))


def episodes(
    df: DataFrame, keys: Sequence[str], order: str = "timestamp", state: str = "state",
    carry: Sequence[str] = (), layout: Layout = AUTO,
) -> DataFrame:
    """Maximal same-state runs: index, span, length and ``carry`` at the first row."""
    arranged = arrange(df, keys, (order,), before=1, layout=layout)
    changed = ~F.col(state).eqNullSafe(F.lag(state).over(arranged.window)) | (F.col("_rn") == 1)
    arranged = running(arranged.with_columns({"_new": changed.cast("long")}), {"_run": ("_new", "sum")})
    grouped = arranged.df.groupBy(*keys, "_run").agg(
        F.min_by(F.struct(state, *carry), "_rn").alias("_first"),
        F.min(order).alias("start_timestamp"),
        F.max(order).alias("end_timestamp"),
        F.count(F.lit(1)).alias("length"),
    )
    return grouped.select(
        *keys, (F.col("_run") - 1).alias("episode_index"), "_first.*", "start_timestamp", "end_timestamp", "length"
    )


def episode_summary(runs: DataFrame, keys: Sequence[str], state: str = "state") -> DataFrame:
    """Run counts and lengths, with the share of the largest and three largest.

    Lengths are counted first (few distinct values), so a group with very many
    runs stays small in the median and top-three steps.
    """
    group = [*keys, state]
    sizes = runs.groupBy(*group, "length").agg(F.count(F.lit(1)).alias("_c"))
    up = Window.partitionBy(*group).orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*group).orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*group)
    ranked = sizes.withColumns(
        {"_up": F.sum("_c").over(up), "_down": F.sum("_c").over(down), "_n": F.sum("_c").over(every)}
    )
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_up") >= rank) & (F.col("_up") - F.col("_c") < rank), F.col("length")))

    taken = F.greatest(F.lit(0), F.least(F.col("_c"), F.lit(3) - (F.col("_down") - F.col("_c"))))
    out = ranked.groupBy(*group).agg(
        F.sum(F.col("length") * F.col("_c")).alias("observations"),
        F.sum("_c").alias("episode_count"),
        F.min("length").alias("length_min"),
        ((at(low) + at(high)) / 2).alias("length_median"),
        F.max("length").alias("length_max"),
        F.sum(taken * F.col("length")).alias("_top"),
    )
    return out.withColumns(
        {
            "share_largest_episode": F.col("length_max") / F.col("observations"),
            "share_three_largest": F.col("_top") / F.col("observations"),
        }
    ).drop("_top")


def events_since(
    df: DataFrame, keys: Sequence[str], event: Column, order: str = "timestamp", layout: Layout = AUTO
) -> DataFrame:
    """Event rows with the number of rows since the previous event of the key."""
    arranged = arrange(df.withColumn("_event", event), keys, (order,), before=1, layout=layout)
    arranged = arranged.with_columns({"_at": F.when(F.col("_event"), F.col("_rn"))})
    arranged = running(arranged, {"_last": ("_at", "max")})
    # the running maximum includes the row itself; the one before it is the previous event
    shifted = arranged.again(before=1)
    shifted = shifted.with_columns({"_before": F.lag("_last").over(shifted.window)}).own()
    rows = shifted.df.filter("_event")
    since = (F.col("_rn") - F.col("_before")).alias("rows_since_previous")
    return rows.select(*df.columns, since)
