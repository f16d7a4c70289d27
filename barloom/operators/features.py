"""Causal features of bar series, for all series at once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.definitions import Feature
from barloom.operators.layout import AUTO, Arranged, Layout, arrange, joined
from barloom.operators.recursive import Recursion, scan, with_runs
from barloom.schemas import BAR_FIELDS, SERIES_KEY
from barloom.session import materialize

RECURSIVE = ("ema", "rsi", "atr")


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def unique_features(specs: Iterable[Feature]) -> list[Feature]:
    """Each distinct feature once, whoever asks for it."""
    return list({spec.key: spec for spec in specs}.values())


def rows_needed(specs: Iterable[Feature]) -> int:
    """Rows before the current one that the widest feature frame touches."""
    need = 0
    for spec in specs:
        params = dict(spec.params)
        need = max(need, params.get("period", 1) + 1)
    return need


def fields_read(specs: Iterable[Feature]) -> list[str]:
    """Bar columns that the features are computed from."""
    read: dict[str, None] = {}
    for spec in specs:
        if spec.name == "atr":
            read |= dict.fromkeys(("high", "low", "close"))
        elif spec.name in ("average_volume", "relative_volume"):
            read["volume"] = None
        else:
            read[spec["field"]] = None
    return list(read)


def true_range(arranged: Arranged) -> Column:
    """Largest of high-low and the distances to the previous close."""
    previous = F.lag("close").over(arranged.window)
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)
    )


def simple_return(arranged: Arranged, field: str) -> Column:
    previous = F.lag(field).over(arranged.window)
    return F.when(previous != 0, F.col(field) / previous - 1)


def log_return(arranged: Arranged, field: str) -> Column:
    previous = F.lag(field).over(arranged.window)
    return F.when((previous > 0) & (F.col(field) > 0), F.ln(F.col(field) / previous))


def full_mean(arranged: Arranged, value: str | Column, period: int) -> Column:
    """Mean of the last ``period`` rows; the frame is never shortened."""
    return F.when(F.col("_rn") >= period, F.avg(value).over(arranged.back(period)))


def seed_mean(arranged: Arranged, value: str, period: int, first: int) -> Column:
    """Mean of the ``period`` rows up to row ``first``, read there only: a growing frame adds each row once."""
    seeding = F.when(F.col("_rn").between(first - period + 1, first), F.col(value))
    return F.avg(seeding).over(arranged.window.rowsBetween(Window.unboundedPreceding, 0))


def rsi_value(gain: Column, loss: Column) -> Column:
    """RSI of smoothed averages; no losses is 100 (or 50 when flat), no gains is 0."""
    return (
        F.when(gain.isNull() | loss.isNull(), F.lit(None).cast("double"))
        .when(loss == 0, F.when(gain > 0, F.lit(100.0)).otherwise(F.lit(50.0)))
        .when(gain == 0, F.lit(0.0))
        .otherwise(100.0 - 100.0 / (1.0 + gain / loss))
    )


def add_framed(arranged: Arranged, specs: Sequence[Feature]) -> Arranged:
    """Features that a bounded frame can express, plus inputs of the recursive ones."""
    if any(spec.name in RECURSIVE for spec in specs):
        arranged = with_runs(arranged)
    first: dict[str, Column] = {}
    for spec in specs:
        if spec.name in ("log_return", "realized_volatility"):
            first[f"_lr_{spec['field']}"] = log_return(arranged, spec["field"])
        if spec.name == "rsi":
            previous = F.lag(spec["field"]).over(arranged.window)
            change = F.coalesce(F.col(spec["field"]) - previous, F.lit(0.0))
            first[f"_up_{spec['field']}"] = F.greatest(change, F.lit(0.0))
            first[f"_down_{spec['field']}"] = F.greatest(-change, F.lit(0.0))
        if spec.name == "atr":
            first["_tr"] = true_range(arranged)
    if first:
        arranged = arranged.with_columns(first)
    second: dict[str, Column] = {}
    for spec in specs:
        name = spec.name
        if name == "simple_return":
            second[spec.key] = simple_return(arranged, spec["field"])
        elif name == "log_return":
            second[spec.key] = F.col(f"_lr_{spec['field']}")
        elif name == "sma":
            second[spec.key] = full_mean(arranged, spec["field"], spec["period"])
        elif name == "average_volume":
            second[spec.key] = full_mean(arranged, "volume", spec["period"])
        elif name == "relative_volume":
            mean = full_mean(arranged, "volume", spec["period"])
            second[spec.key] = F.when(mean != 0, F.col("volume") / mean)
        elif name == "realized_volatility":
            p, lr = spec["period"], f"_lr_{spec['field']}"
            frame = arranged.back(p)
            ready = (F.col("_rn") > p) & (F.count(lr).over(frame) == p)
            second[spec.key] = F.when(ready, F.stddev_samp(lr).over(frame))
        elif name == "rsi":
            for side in ("up", "down"):
                second[f"_s{side}_{spec.key}"] = seed_mean(arranged, f"_{side}_{spec['field']}", spec["period"], spec["period"] + 1)
        elif name == "atr":
            second[f"_s_{spec.key}"] = seed_mean(arranged, "_tr", spec["period"], spec["period"])
        elif name == "ema":
            second[f"_s_{spec.key}"] = seed_mean(arranged, spec["field"], spec["period"], spec["period"])
    return arranged.with_columns(second) if second else arranged


def add_recursive(arranged: Arranged, specs: Sequence[Feature]) -> Arranged:
    """EMA, RSI and ATR; keeps own rows only."""
    recursions: list[Recursion] = []
    for spec in specs:
        if spec.name == "ema":
            p = spec["period"]
            decay = 1.0 - 2.0 / (p + 1)
            recursions.append(
                Recursion(spec.key, decay if p > 1 else 0.0, 2.0 / (p + 1), p, quoted(f"_s_{spec.key}"), F.col(spec["field"]))
            )
        elif spec.name == "atr":
            p = spec["period"]
            recursions.append(Recursion(spec.key, (p - 1) / p, 1.0 / p, p, quoted(f"_s_{spec.key}"), F.col("_tr")))
        elif spec.name == "rsi":
            p = spec["period"]
            for side in ("up", "down"):
                recursions.append(
                    Recursion(
                        f"_w{side}_{spec.key}", (p - 1) / p, 1.0 / p, p + 1,
                        quoted(f"_s{side}_{spec.key}"), F.col(f"_{side}_{spec['field']}"),
                    )
                )
    arranged = scan(arranged, recursions)
    rsi = {
        s.key: rsi_value(quoted(f"_wup_{s.key}"), quoted(f"_wdown_{s.key}")) for s in specs if s.name == "rsi"
    }
    return arranged.with_columns(rsi) if rsi else arranged


def drop_helpers(arranged: Arranged) -> Arranged:
    keep = ("_rn", "_own", "_blk")
    helpers = [
        c for c in arranged.df.columns
        if c not in keep and c.startswith(("_lr_", "_up_", "_down_", "_tr", "_s", "_w"))
    ]
    return replace(arranged, df=arranged.df.drop(*helpers))


def featured(arranged: Arranged, specs: Iterable[Feature]) -> Arranged:
    """Own rows with one column per feature key."""
    specs = unique_features(specs)
    return drop_helpers(add_recursive(add_framed(arranged, specs), specs))


def with_features(
    bars: DataFrame, specs: Iterable[Feature], keys: Sequence[str] = SERIES_KEY, layout: Layout = AUTO
) -> DataFrame:
    """Bars plus one column per feature, named by the feature's key."""
    specs = unique_features(specs)
    return featured(arrange(bars, keys, before=rows_needed(specs), layout=layout), specs).result()


def with_true_range(bars: DataFrame, keys: Sequence[str] = SERIES_KEY, layout: Layout = AUTO) -> DataFrame:
    arranged = arrange(bars, keys, before=1, layout=layout)
    return arranged.with_columns({"true_range": true_range(arranged)}).result()


def long_features(featured_bars: DataFrame, specs: Iterable[Feature], keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """One row per bar and feature: key columns, timestamp, feature_key, value."""
    pairs = F.array(*[F.struct(F.lit(s.key).alias("feature_key"), quoted(s.key).alias("value")) for s in specs])
    return featured_bars.select(*keys, "timestamp", F.inline(pairs))


def ready_pairs(features_long: DataFrame) -> DataFrame:
    """Only defined values."""
    return features_long.filter(F.col("value").isNotNull())


def ready_from(
    bars: DataFrame, specs: Iterable[Feature], keys: Sequence[str] = SERIES_KEY, layout: Layout = AUTO
) -> DataFrame:
    """0-based index of the first defined value of each feature (NULL when none)."""
    specs = unique_features(specs)
    bars = bars.select(*keys, "timestamp", *fields_read(specs))
    arranged = arrange(bars, keys, before=rows_needed(specs), layout=layout)
    # a feature reads no later row, so the rows up to where it is first defined are enough; nearly all series have
    # every feature defined soon after the widest frame is filled, and only the others are computed to their end
    head = 2 * rows_needed(specs)
    found = first_defined(replace(arranged, df=arranged.df.filter(F.col("_rn") <= head)), specs)
    found = materialize(found.withColumn("_done", (F.col("_rows") < head) | F.forall("_first", F.isnotnull)), "ready")
    open_ones = found.filter(~F.col("_done"))
    if not open_ones.isEmpty():
        whole = first_defined(replace(arranged, df=joined(arranged.df, open_ones.select(*keys), keys)), specs)
        found = found.filter("_done").drop("_done").unionByName(whole)
    names = F.array(*[F.lit(s.key) for s in specs])
    return found.select(*keys, F.inline(F.arrays_zip(names.alias("feature_key"), F.col("_first").alias("ready_from"))))


def first_defined(arranged: Arranged, specs: Sequence[Feature]) -> DataFrame:
    """One row per series: its own rows, and the 0-based index of the first defined value of each feature."""
    rows = featured(arranged, specs).own().df
    first = [F.min(F.when(quoted(s.key).isNotNull(), F.col("_rn") - 1)) for s in specs]
    return rows.groupBy(*arranged.keys).agg(F.count(F.lit(1)).alias("_rows"), F.array(*first).alias("_first"))


def field_values(bars: DataFrame, field: str, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """One OHLCV column with its key; other names are refused."""
    if field not in BAR_FIELDS:
        raise ValueError(f"unknown bar field {field!r}")
    return bars.select(*keys, "timestamp", field)


def prefix(bars: DataFrame, n: int, keys: Sequence[str] = SERIES_KEY, layout: Layout = AUTO) -> DataFrame:
    """First ``n`` bars of every series."""
    arranged = arrange(bars, keys, layout=layout)
    return Arranged(arranged.df.filter(F.col("_rn") <= n), arranged.keys, arranged.part, arranged.block_rows).result()
