"""Price adjustment, vendor factors and merging of stored and incoming bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.quality import finite
from barloom.schemas import ADJUSTED, BAR_FIELDS, PRICE_FIELDS, RAW, SERIES_KEY

FACTOR_KEY = ["symbol", "interval", "source", "timestamp"]


def adjust(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices times the bar's factor, volume untouched, basis relabelled.

    A bar that is not raw or has no factor ends the job with its key; ask
    ``adjust_issues`` first where such bars are expected.
    """
    joined = bars.join(factors.select(*FACTOR_KEY, "factor"), FACTOR_KEY, "left")
    problem = F.when(~F.col("basis").eqNullSafe(F.lit(RAW)), "not_raw").when(F.col("factor").isNull(), "missing_factor")
    named = F.concat_ws(" ", problem, "symbol", "interval", "source", F.col("timestamp").cast("string"))
    factor = F.when(problem.isNull(), F.col("factor")).otherwise(F.raise_error(named).cast("double"))
    return joined.withColumn("factor", factor).select(
        "symbol", "interval", "source", F.lit(ADJUSTED).alias("basis"), "timestamp",
        *[(F.col(f) * F.col("factor")).alias(f) for f in PRICE_FIELDS], "volume",
    )


def adjust_issues(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Bars already adjusted, without a factor, or with an unusable or repeated one."""
    key = [*SERIES_KEY, "timestamp"]
    not_raw = bars.filter(F.col("basis") != RAW).select(*key, F.lit("not_raw").alias("issue"))
    missing = bars.join(factors.select(*FACTOR_KEY), FACTOR_KEY, "left_anti").select(
        *key, F.lit("missing_factor").alias("issue")
    )
    per = factors.groupBy(*FACTOR_KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~(finite(F.col("factor")) & (F.col("factor") > 0))).alias("_bad")
    )
    wrong = F.when(F.col("_bad") > 0, "bad_factor").when(F.col("_n") > 1, "duplicate_factor")
    bad = bars.join(per, FACTOR_KEY).withColumn("issue", wrong).filter("issue IS NOT NULL").select(*key, "issue")
    return not_raw.unionByName(missing).unionByName(bad)


def adjustment_factors(raw: DataFrame, adjusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Factors from raw and adjusted closes, and the rows that do not pair up."""
    key = FACTOR_KEY
    left = raw.select(*key, F.col("close").alias("raw_close"), F.lit(True).alias("_in_raw"))
    right = adjusted.select(*key, F.col("close").alias("adjusted_close"), F.lit(True).alias("_in_adj"))
    both = left.join(right, key, "full")
    r, a = F.col("raw_close"), F.col("adjusted_close")
    issue = (
        F.when(F.col("_in_raw").isNull(), "only_adjusted")
        .when(F.col("_in_adj").isNull(), "only_raw")
        .when(~(finite(r) & finite(a)) | (r == 0), "unusable_close")
        .when(~(a / r > 0), "non_positive_factor")
    )
    checked = both.withColumn("issue", issue)
    factors = checked.filter("issue IS NULL").select(*key, (a / r).alias("factor"))
    return factors, checked.filter("issue IS NOT NULL").select(*key, "issue")


def vendor_adjustment(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Factors (adj_close / close where usable) and split and dividend actions."""
    close, adj = F.col("close"), F.col("adj_close")
    factor = F.when(finite(close) & finite(adj) & (close != 0), adj / close)
    factors = frame.withColumn("factor", factor).filter(finite(F.col("factor")) & (F.col("factor") > 0))
    actions = frame.select(
        "symbol", "source", F.col("timestamp").alias("effective_time"),
        F.inline(
            F.array(
                F.struct(F.lit("split").alias("action_type"), F.col("split").alias("value")),
                F.struct(F.lit("cash_dividend").alias("action_type"), F.col("dividend").alias("value")),
            )
        ),
    ).filter(finite(F.col("value")) & (F.col("value") > 0))
    return factors.select(*FACTOR_KEY, "factor"), actions


def merge_bars(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union by key and timestamp; identical rows once, differing ones reported."""
    key = [*SERIES_KEY, "timestamp"]
    both = stored.select(*key, *BAR_FIELDS).unionByName(incoming.select(*key, *BAR_FIELDS))
    content = F.struct(*BAR_FIELDS)
    seen = both.groupBy(*key).agg(F.min(content).alias("_low"), F.max(content).alias("_high"), F.count(F.lit(1)).alias("copies"))
    same = F.col("_low") == F.col("_high")
    merged = seen.filter(same).select(*key, "_low.*")
    conflicts = seen.filter(~same).select(*key, "copies")
    return merged, conflicts


def time_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Timestamps that only one of two series sets has."""
    key = [*SERIES_KEY, "timestamp"]
    a, b = left.select(*key), right.select(*key)
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("right_only"))
    )
