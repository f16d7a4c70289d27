"""Recursive averages ``y[i] = a*y[i-1] + u[i]`` as a blocked scan.

Affine steps compose, so a block is cut into short runs: inside a run the
recursion is a running sum of ``u * a^-pos``; a run's effect on later rows is
one number, decayed by ``a`` per row. The value carried into a run comes from
the ends of the block's earlier runs, nearest last, and from what precedes the
block. Only series longer than a block have such a value: the ends of their
blocks are a small table. A factor ``a^k`` below 1e-650 times any double is
exactly zero, so only a fixed number of earlier blocks can matter, and the
carries need a bounded frame over this table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import Arranged, cut

RUN_ROWS = 512
RUNS_PER_BLOCK = 4096


@dataclass(frozen=True)
class Recursion:
    """``y = seed`` at position ``first``; afterwards ``y = decay*y_prev + gain*x``."""

    out: str
    decay: float
    gain: float
    first: int
    seed: Column
    x: Column

    def reach(self, run_rows: int) -> int:
        """How many earlier runs can change a double."""
        if self.decay == 0.0:
            return 1
        return int(math.ceil(1500.0 / (run_rows * -math.log(self.decay)))) + 1


def decayed(step: float):
    return lambda total, d: total * F.lit(step) + d


def rows_of_a_run(arranged: Arranged) -> int:
    if arranged.block_rows % RUN_ROWS == 0:
        return RUN_ROWS
    if arranged.block_rows > RUN_ROWS:
        raise ValueError("block_rows must be a multiple of 512 or below 512")
    return arranged.block_rows


def with_runs(arranged: Arranged) -> Arranged:
    """Number the runs of every block (halo rows before it lie in runs below 0).

    Windows are then ordered by run and position, which is the order by position,
    so that windows over blocks and over runs share one sort.
    """
    run_rows = rows_of_a_run(arranged)
    i = F.col("_rn") - 1
    columns = {"_run": F.floor((i - F.col("_blk") * arranged.block_rows) / run_rows), "_pos": (i % run_rows).cast("int")}
    return replace(arranged.with_columns(columns), order=("_run", "_rn"))


def scan(arranged: Arranged, recursions: list[Recursion]) -> Arranged:
    """Add one column per recursion (NULL before its first position)."""
    if not recursions:
        return arranged.own()
    run_rows = rows_of_a_run(arranged)
    if "_run" not in arranged.df.columns:
        arranged = with_runs(arranged)
    rn = F.col("_rn")
    inputs = {
        f"_u_{i}": F.when(rn == r.first, r.seed).when(rn > r.first, F.lit(r.gain) * r.x).otherwise(F.lit(0.0))
        for i, r in enumerate(recursions)
    }
    arranged = arranged.with_columns(inputs).own()
    inside = (
        Window.partitionBy(*arranged.part, "_run").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    )
    local = {
        f"_l_{i}": F.pow(F.lit(r.decay), F.col("_pos")) * F.sum(F.col(f"_u_{i}") * F.pow(F.lit(r.decay), -F.col("_pos"))).over(inside)
        for i, r in enumerate(recursions) if r.decay != 0.0
    }
    if not local:
        return finished(arranged, recursions, inputs)
    arranged = arranged.with_columns(local)
    # ends of the earlier runs of the block, in order: at most block_rows / run_rows
    before = arranged.window.rowsBetween(Window.unboundedPreceding, -1)
    ends = {
        f"_e_{n[3:]}": F.collect_list(F.when(F.col("_pos") == run_rows - 1, F.coalesce(n, F.lit(0.0)))).over(before) for n in local
    }
    arranged = arranged.with_columns(ends)
    carries = block_carries(arranged, recursions, run_rows)
    part, held = list(arranged.part), [c for c in carries.columns if c.startswith("_c_")]
    same = F.lit(True)
    for k in part:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # one row per block of a series that is longer than a block
    named = F.broadcast(carries.select(*[F.col(k).alias(f"_k_{k}") for k in part], *held))
    rows = arranged.df.join(named, same, "left").drop(*[f"_k_{k}" for k in part])
    return finished(replace(arranged, df=rows), recursions, [*inputs, *local, *ends, *held], run_rows)


def in_block(i: int, r: Recursion, carried: Column, run_rows: int) -> Column:
    """The recursion's value at a row, given what the block's earlier rows are preceded by."""
    ends = F.col(f"_e_{i}")
    into_run = F.when(F.size(ends) == 0, carried).otherwise(F.aggregate(ends, carried, decayed(r.decay**run_rows)))
    return F.col(f"_l_{i}") + F.pow(F.lit(r.decay), F.col("_pos")) * F.lit(r.decay) * into_run


def block_carries(arranged: Arranged, recursions: list[Recursion], run_rows: int) -> DataFrame:
    """What every block of a longer series is preceded by: its key, ``_blk`` and one ``_c_`` column per recursion."""
    size = arranged.block_rows
    kept = [(i, r) for i, r in enumerate(recursions) if r.decay != 0.0]
    ending = F.col("_rn") % size == 0
    # short series have no such block, and their rows are left out before they are ordered
    full = arranged.df.filter(ending).select(*[F.col(k).alias(f"_f_{k}") for k in arranged.part])
    same = F.lit(True)
    for k in arranged.part:
        same = same & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
    last = arranged.df.join(F.broadcast(full), same, "left_semi").filter(ending)
    values = [F.coalesce(in_block(i, r, F.lit(0.0), run_rows), F.lit(0.0)).alias(f"_d_{i}") for i, r in kept]
    blocks = last.select(*arranged.keys, (F.col("_blk") + 2).alias("_rn"), *values)
    # the blocks of a long series are cut into parts as well; row n tells what block n - 1 is preceded by
    reach = max(r.reach(size) for _, r in kept)
    blocks = cut(blocks, RUNS_PER_BLOCK, reach, 0)
    order = Window.partitionBy(*arranged.keys, "_blk").orderBy("_rn")
    carries = {}
    for i, r in kept:
        nearest = F.collect_list(f"_d_{i}").over(order.rowsBetween(1 - r.reach(size), 0))
        carries[f"_c_{i}"] = F.aggregate(nearest, F.lit(0.0), decayed(r.decay**size))
    rows = blocks.withColumns(carries).filter("_own")
    return rows.select(*arranged.keys, (F.col("_rn") - 1).alias("_blk"), *carries)


def finished(arranged: Arranged, recursions: list[Recursion], helpers, run_rows: int = RUN_ROWS) -> Arranged:
    outs = {}
    for i, r in enumerate(recursions):
        value = F.col(f"_u_{i}") if r.decay == 0.0 else in_block(i, r, F.coalesce(f"_c_{i}", F.lit(0.0)), run_rows)
        outs[r.out] = F.when(F.col("_rn") >= r.first, value)
    rows = arranged.with_columns(outs)
    return replace(rows, df=rows.df.drop("_run", "_pos", *helpers), order=("_rn",))
