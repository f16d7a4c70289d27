"""Grouped descriptive statistics with an exact median.

The built-in exact median gathers a group's distinct values in one task, which a
group holding a third of all rows does not survive. Here a quantile sketch
(bounded, merged map-side) first brackets the middle of each group; a second
aggregation counts what lies below the bracket and the distinct values inside
it. The bracket is cut into bins, and only the values of the bin that holds the
middle are ordered, so a group's share of rows in one task is a few in ten
million.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize

ACCURACY = 10_000
MARGIN = 4 / ACCURACY
BINS = 4096


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; keeps the left copies."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def basic(value: Column) -> list[Column]:
    """Counts, mean and range of the non-NULL values."""
    return [
        F.count(value).alias("sample_count"),
        F.avg(value).alias("mean_forward_return"),
        F.min(value).alias("min_forward_return"),
        F.max(value).alias("max_forward_return"),
        F.count_if(value > 0).alias("positive_count"),
        F.count_if(value < 0).alias("negative_count"),
        F.count_if(value == 0).alias("zero_count"),
    ]


def describe(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    extra: Sequence[Column] = (),
    median: str = "median_forward_return",
) -> DataFrame:
    """Statistics of ``value`` per group; groups without values keep NULLs and n=0.

    ``df`` is evaluated once, into the shared folder; the passes read the keys
    and the value from there. Callers hand over the columns that are needed.
    """
    keys = list(keys)
    v = F.col(value)
    df = materialize(df, "described")
    sketch = F.percentile_approx(v, F.array(F.lit(0.5 - MARGIN), F.lit(0.5 + MARGIN)), F.lit(ACCURACY))
    first = materialize(df.groupBy(*keys).agg(*basic(v), sketch.alias("_mid"), *extra), "basic")
    bounds = first.select(
        *keys, F.col("sample_count").alias("_n"), F.get("_mid", F.lit(0)).alias("_lo"), F.get("_mid", F.lit(1)).alias("_hi")
    ).filter("_n > 0")
    near = null_safe(df.select(*keys, v.alias("_v")), bounds, keys).filter("_v <= _hi")
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    counts = (
        near.withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
        .groupBy(*keys, "_n", "_lo", "_hi", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # what lies below the bracket is bin -1; the bins of a group are few, whatever its size
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    counts = counts.withColumn("_bin", F.when(F.col("_v").isNull(), -1).otherwise(F.floor(share * BINS).cast("int")))
    counts = materialize(counts.drop("_lo", "_hi"), "middle")
    bins = counts.groupBy(*keys, "_n", "_bin").agg(F.sum("_c").alias("_in"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_before", F.sum("_in").over(earlier) - F.col("_in"))
    holds = lambda rank: (F.col("_before") < rank) & (F.col("_before") + F.col("_in") >= rank)
    hit = bins.filter(holds(lower) | holds(upper)).select(*keys, "_bin", "_before")
    w = Window.partitionBy(*keys, "_bin").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = null_safe(counts, hit, [*keys, "_bin"]).withColumn("_to", F.col("_before") + F.sum("_c").over(w))

    def at(rank: Column) -> Column:
        inside = (F.col("_to") >= rank) & (F.col("_to") - F.col("_c") < rank)
        return F.max(F.when(inside, F.struct(F.col("_v").isNotNull().alias("ok"), F.col("_v").alias("v"))))

    middle = ranked.groupBy(*keys).agg(at(lower).alias("_a"), at(upper).alias("_b"))
    missed = F.raise_error(F.lit("median outside its bracket")).cast("double")
    middle = middle.select(
        *keys,
        F.when(F.col("_a.ok") & F.col("_b.ok"), (F.col("_a.v") + F.col("_b.v")) / 2).otherwise(missed).alias(median),
    )
    out = null_safe(first.drop("_mid"), middle, keys, "left")
    lead = [*keys, "sample_count", "mean_forward_return", median]
    return out.select(*lead, *[c for c in out.columns if c not in lead])


# --- fixed values: names of the statistics -----------------------------------
STAT_COLUMNS = (
    "sample_count", "mean_forward_return", "median_forward_return", "min_forward_return", "max_forward_return",
    "positive_count", "negative_count", "zero_count",
)
COUNT_COLUMNS = ("sample_count", "positive_count", "negative_count", "zero_count")


def fill_counts(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Zero counts for grid cells that met no row."""
    return df.fillna(0, [*COUNT_COLUMNS, *extra])


def deltas(df: DataFrame, reference: DataFrame, keys: Sequence[str], mean: str, median: str) -> DataFrame:
    """Add mean and median differences to the reference row with the same keys."""
    ref = reference.select(
        *keys,
        F.col("mean_forward_return").alias("_ref_mean"),
        F.col("median_forward_return").alias("_ref_median"),
    )
    return null_safe(df, ref, keys, "left").withColumns(
        {
            mean: F.col("mean_forward_return") - F.col("_ref_mean"),
            median: F.col("median_forward_return") - F.col("_ref_median"),
        }
    ).drop("_ref_mean", "_ref_median")


def sign_code(value: Column) -> Column:
    """'+', '-', '0' or '' when undefined."""
    return (
        F.when(value.isNull(), F.lit(""))
        .when(value > 0, F.lit("+"))
        .when(value < 0, F.lit("-"))
        .otherwise(F.lit("0"))
    )


def fraction(numerator: Column, denominator: Column) -> Column:
    """NULL for a zero denominator."""
    return F.try_divide(numerator, denominator)
