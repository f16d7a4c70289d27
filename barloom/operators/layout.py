"""Ordered series laid out so that no task ever holds an unbounded series.

A window over ``partitionBy(series key)`` puts a whole series into one task, and
one series may hold a third of all rows. ``arrange`` therefore lays every input
out in one way, whatever its size and the spacing of its rows: one range
exchange by (series, order), each sorted partition written once to the shared
folder with the number that a row has in it, and one small table with a row per
series and partition that turns these numbers into positions in the series.
Positions cut each series into blocks of a fixed number of rows; rows near a
block edge are copied into the neighbouring block ("halo" rows, ``_own`` false),
so bounded frames, ``lag`` and ``lead`` see exactly what they would see in the
uncut series. A series shorter than a block is one block without copies.

Quantities that run over the whole series (running counts, recursive averages)
are computed per block and joined with what the earlier blocks carry over.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schemas import INTERVAL_SECONDS, SERIES_KEY
from barloom.session import materialize

SUPER = 4096


@dataclass(frozen=True)
class Layout:
    """Rows of a block, and whether most rows belong to few long series."""

    block_rows: int = 8192
    long_series: bool = False


AUTO = Layout()
LONG = Layout(long_series=True)


@dataclass(frozen=True)
class Arranged:
    """Rows with ``_rn`` (1-based position in the series), ``_own`` and a block."""

    df: DataFrame
    keys: tuple[str, ...]
    part: tuple[str, ...]
    block_rows: int
    order: tuple[str, ...] = ("_rn",)

    @property
    def window(self):
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def back(self, rows: int):
        """Frame of ``rows`` rows that ends at the current row."""
        return self.window.rowsBetween(-(rows - 1), 0)

    def with_columns(self, columns: dict[str, Column]) -> "Arranged":
        return replace(self, df=self.df.withColumns(columns))

    def own(self) -> "Arranged":
        """Drop the halo copies."""
        return replace(self, df=self.df.filter("_own"))

    def again(self, before: int = 0, after: int = 0) -> "Arranged":
        """Fresh halo copies of already numbered rows."""
        rows = self.own().df.drop("_own", "_blk")
        return replace(self, df=cut(rows, self.block_rows, before, after))

    def result(self) -> DataFrame:
        return self.own().df.drop("_rn", "_own", "_blk")


def interval_seconds(interval: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, seconds in INTERVAL_SECONDS.items():
        out = F.when(interval == name, F.lit(seconds).cast("long")).otherwise(out)
    return out


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, null being equal to null."""
    own = [F.col(x).alias(f"_k_{x}") if x in keys else F.col(x) for x in right.columns]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(right.select(*own), same).drop(*[f"_k_{k}" for k in keys])


def exclusive_prefix(
    df: DataFrame, keys: Sequence[str], index: str, columns: dict[str, tuple[str, str]]
) -> DataFrame:
    """Add ``out = fn(value of all rows with a smaller index)`` in two levels.

    ``columns`` maps out -> (value column, 'sum' or 'max'). ``index`` is a long;
    runs of 4096 indexes are reduced first so neither level grows with a series.
    """
    fns = {"sum": F.sum, "max": F.max}
    keys = list(keys)
    df = df.withColumn("_sup", F.floor(F.col(index) / SUPER))
    tops = df.groupBy(*keys, "_sup").agg(*[fns[fn](v).alias(f"_t_{o}") for o, (v, fn) in columns.items()])
    upper = Window.partitionBy(*keys).orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        *keys, "_sup", *[fns[fn](f"_t_{o}").over(upper).alias(f"_c_{o}") for o, (_, fn) in columns.items()]
    )
    lower = Window.partitionBy(*keys, "_sup").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    rows = joined(df, tops, [*keys, "_sup"])
    outs = {}
    for o, (v, fn) in columns.items():
        before, inside = F.col(f"_c_{o}"), fns[fn](v).over(lower)
        outs[o] = (
            F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0)) if fn == "sum" else F.greatest(before, inside)
        )
    return rows.withColumns(outs).drop("_sup", *[f"_c_{o}" for o in columns])


def cut(df: DataFrame, block_rows: int, before: int, after: int) -> DataFrame:
    """Copy every row to each block whose frames may reach it."""
    i = F.col("_rn") - 1
    low = F.greatest(F.floor((i - after) / block_rows), F.lit(0))
    high = F.floor((i + before) / block_rows)
    if before or after:
        df = df.withColumn("_blk", F.explode(F.when(low == high, F.array(high)).otherwise(F.sequence(low, high))))
    else:
        df = df.withColumn("_blk", low)
    return df.withColumn("_own", F.col("_blk") == F.floor(i / block_rows))


def placed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "_rn", long_series: bool = False
) -> DataFrame:
    """Add the 1-based position of every row in its series; without keys all rows are one series.

    Partitions of the range exchange follow one another in the order, so a row's
    position is its number within its partition plus the rows of its series in
    the partitions before, of which there is one count per series and partition.
    Rows of one long series all begin with the same name, so that sorting them by
    series would compare whole rows: with ``long_series`` they are sorted by the
    order alone first, and the sort by series finds them in place.
    """
    keys = list(keys)
    ordered = [*map(F.col, keys), *[F.col(x) if isinstance(x, str) else x for x in order]]
    rows = df.repartitionByRange(*ordered)
    if keys and long_series:
        rows = rows.sortWithinPartitions(*ordered[len(keys):]).withColumn("_id", F.monotonically_increasing_id())
        ordered = [*ordered[:len(keys)], F.col("_id")]
    rows = rows.sortWithinPartitions(*ordered).withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(rows, "ordered").withColumn("_prt", F.shiftright("_id", 33))
    counts = rows.groupBy(*keys, "_prt").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_prt").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    starts = counts.select(*keys, "_prt", (before - F.col("_first") + 1).alias("_shift"))
    # written, so that its size is known before the join is planned: a small table is sent to the rows, which then stay where they are
    starts = materialize(starts, "starts")
    return joined(rows, starts, [*keys, "_prt"]).withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_prt", "_shift")


def arrange(
    df: DataFrame,
    keys: Sequence[str] = SERIES_KEY,
    order: Sequence[str | Column] = ("timestamp",),
    before: int = 0,
    after: int = 0,
    layout: Layout = AUTO,
) -> Arranged:
    """Number the rows of every series and lay them out in bounded blocks."""
    keys = tuple(keys)
    rows = cut(placed(df, keys, order, long_series=layout.long_series), layout.block_rows, before, after)
    return Arranged(rows, keys, (*keys, "_blk"), layout.block_rows)


def running(arranged: Arranged, columns: dict[str, tuple[str, str]]) -> Arranged:
    """Add inclusive running 'sum' or 'max' over the whole series.

    ``columns`` maps out -> (value column, function). Works on own rows only.
    """
    fns = {"sum": F.sum, "max": F.max}
    arranged = arranged.own()
    frame = arranged.window.rowsBetween(Window.unboundedPreceding, 0)
    totals = arranged.df.groupBy(*arranged.part).agg(
        *[fns[fn](v).alias(f"_v_{o}") for o, (v, fn) in columns.items()]
    )
    carried = exclusive_prefix(
        totals, arranged.keys, "_blk", {f"_p_{o}": (f"_v_{o}", fn) for o, (_, fn) in columns.items()}
    ).drop(*[f"_v_{o}" for o in columns])
    carrying = replace(arranged, df=joined(arranged.df, carried, arranged.part))
    outs = {}
    for o, (v, fn) in columns.items():
        inside, carry = fns[fn](v).over(frame), F.col(f"_p_{o}")
        outs[o] = F.coalesce(inside, F.lit(0)) + carry if fn == "sum" else F.greatest(inside, carry)
    carrying = carrying.with_columns(outs)
    return replace(carrying, df=carrying.df.drop(*[f"_p_{o}" for o in columns]))
