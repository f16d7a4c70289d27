"""Bar tables on storage, vendor records and study files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.times import localize
from barloom.operators.adjust import merge_bars
from barloom.operators.quality import bar_issues, clip, require_empty
from barloom.schemas import BARS, BASES, BAR_FIELDS, OBSERVATION_STATES, OUTCOME_STATUSES, RAW, SERIES_KEY
from barloom.session import materialize
from barloom.sources.store import GROUP, Change, Store, bucket, bucket_of

# --- fixed values: accepted column names per bar field ----------------------
ALIASES: Mapping[str, tuple[str, ...]] = {
    "timestamp": ("timestamp", "time", "date", "datetime", "t"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c"),
    "volume": ("volume", "vol", "v"),
}
FRAME_COLUMNS: Mapping[str, tuple[str, ...]] = {field: (field,) for field in ALIASES}
CSV_COLUMNS = "symbol STRING, timestamp TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, interval STRING, source STRING"
PARTITIONS = ("source", "interval", "basis")


class SchemaProblem(ValueError):
    """Columns are missing, repeated or not understood."""


#: hash buckets of symbols per source, interval and basis
BUCKETS = 256


def grouped(bars: DataFrame) -> DataFrame:
    """Bars with the group of their file: source, interval, basis and a bucket of symbols."""
    return bars.withColumn(GROUP, F.concat_ws("~", *PARTITIONS, bucket(BUCKETS, "symbol")))


def _wanted(**key: str):
    """Which groups can hold a series; a source may contain any character."""
    def wanted(group: str) -> bool:
        held = dict(zip(("source", "interval", "basis", "bucket"), group.rsplit("~", 3), strict=True))
        return all(held[k] == v for k, v in key.items() if k in PARTITIONS) and ("symbol" not in key or held["bucket"] == bucket_of(BUCKETS, key["symbol"]))

    return wanted


def _plain(spark: SparkSession, path: str) -> DataFrame | None:
    """Bars of a folder without a manifest, if there are any."""
    try:
        return spark.read.schema(BARS).parquet(path)
    except AnalysisException:
        return None


def read_bars(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, **key: str
) -> DataFrame:
    """Bars of a stored table; only files of groups that the key can meet are opened, the time window reaches the scan.

    A plain folder of Parquet files is read as it is.
    """
    for name in key:
        if name not in SERIES_KEY:
            raise SchemaProblem(f"unknown key column {name!r}")
    store = Store(spark, path)
    bars = store.read("bars", _wanted(**key)) if store.exists() else spark.read.schema(BARS).parquet(path)
    for name, value in key.items():
        bars = bars.filter(F.col(name) == value)
    return clip(bars, start, end)


def write_bars(bars: DataFrame, path: str, check: bool = True) -> None:
    """Validate, then replace exactly the series present in ``bars``.

    ``bars`` is evaluated once, into new files; the check reads these. Other
    series of the same groups are carried over, files of other groups stay as
    they are, and one swap of the manifest makes the result visible: a writer
    that fails or dies before it leaves the table as it was. Rows are spread
    over several tasks per group. A table has one writer at a time.
    """
    spark = bars.sparkSession
    store = Store(spark, path)
    if not store.exists():
        held = _plain(spark, path)
        store.define(bars=bars.select(*SERIES_KEY, "timestamp", *BAR_FIELDS).schema)
        if held is not None:
            store.commit([Change("bars", grouped(held.select(*SERIES_KEY, "timestamp", *BAR_FIELDS)))])
    written = store.write("bars", grouped(bars.select(*SERIES_KEY, "timestamp", *BAR_FIELDS)))
    if not written:
        return
    fresh = store.open(written)
    if check:
        require_empty(bar_issues(fresh).select(*SERIES_KEY, "timestamp", "issues"), "invalid bars")
    carried = store.read("bars", written).join(fresh.select(*SERIES_KEY).distinct(), list(SERIES_KEY), "left_anti")
    store.commit([Change("bars", grouped(carried), list(written))], written={"bars": written})


def read_bar_csv(spark: SparkSession, path: str, header: Sequence[str], **key: str) -> tuple[DataFrame, DataFrame]:
    """Bars of CSV files and the rows that contradict the requested series.

    A header without ``price_basis`` is an old file and raw by definition; a
    file that has the column must fill it on every row.
    """
    names = list(header)
    missing = [c.split()[0] for c in CSV_COLUMNS.split(", ") if c.split()[0] not in names]
    if missing:
        raise SchemaProblem(f"missing columns {missing}")
    types = dict(c.split() for c in CSV_COLUMNS.split(", "))
    schema = ", ".join(f"`{n}` {types.get(n, 'STRING')}" for n in names) + ", _corrupt STRING"
    rows = spark.read.schema(schema).option("header", "true").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    basis = F.trim("price_basis") if "price_basis" in names else F.lit(RAW)
    rows = rows.withColumn("basis", basis)
    wrong = [F.when(F.col(n) != v, f"{n}_mismatch") for n, v in key.items()]
    issues = F.array_compact(
        F.array(
            F.when(F.col("_corrupt").isNotNull(), "unreadable_row"),
            F.when(F.coalesce(F.col("basis"), F.lit("")) == "", "missing_basis").when(~F.col("basis").isin(*BASES), "unknown_basis"),
            *wrong,
        )
    )
    judged = rows.withColumn("issues", issues)
    good = judged.filter(F.size("issues") == 0).select(*SERIES_KEY, "timestamp", *BAR_FIELDS)
    bad = judged.filter(F.size("issues") > 0).select(*SERIES_KEY, "timestamp", "issues")
    return good, bad


def merge_into(spark: SparkSession, path: str, incoming: DataFrame) -> DataFrame:
    """Merge bars into a stored table and return the conflicts; groups that ``incoming`` does not touch keep their files."""
    store = Store(spark, path)
    incoming = materialize(grouped(incoming), "incoming")
    touched = [r[0] for r in incoming.select(GROUP).distinct().collect()]  # at most BUCKETS per source, interval and basis
    merged, conflicts = merge_bars(store.read("bars", touched), incoming.drop(GROUP))
    store.commit([Change("bars", grouped(merged.select(*SERIES_KEY, "timestamp", *BAR_FIELDS)), touched)])
    return conflicts


def resolve_columns(columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = ALIASES) -> dict[str, str]:
    """Bar field -> actual column, by case-insensitive alias; missing or repeated names refused."""
    lowered: dict[str, str] = {}
    for name in columns:
        low = name.strip().lower()
        if low in lowered:
            raise SchemaProblem(f"column {name!r} appears twice")
        lowered[low] = name
    out = {}
    for field in ALIASES:
        found = [lowered[a.lower()] for a in aliases.get(field, ALIASES[field]) if a.lower() in lowered]
        if not found:
            raise SchemaProblem(f"no column for {field!r} among {sorted(columns)}")
        out[field] = found[0]
    return out


def normalize_records(
    df: DataFrame, symbol: str | Column, interval: str, source: str, aliases: Mapping[str, Sequence[str]] = ALIASES,
    tz: str | None = None, skip_incomplete: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Vendor records to bars, and the records refused with a reason.

    ``symbol`` is a column of the frame, by name or expression. Rows with an
    absent value are refused, or dropped when ``skip_incomplete``; nothing is
    filled in. Zone-less times need ``tz``.
    """
    picked = resolve_columns(df.columns, aliases)
    types = dict(df.dtypes)
    number = lambda f: F.nanvl(F.col(f"`{picked[f]}`").try_cast("double"), F.lit(None).cast("double"))
    raw_ts = F.col(f"`{picked['timestamp']}`")
    kind = types[picked["timestamp"]]
    if kind == "timestamp":
        ts, ts_issue = raw_ts, F.lit(None).cast("string")
    elif tz is not None:
        ts, ts_issue = localize(raw_ts.try_cast("timestamp_ntz").cast("timestamp"), tz)
    else:
        zoned = raw_ts.cast("string").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
        ts = F.when(zoned, raw_ts.cast("string").try_cast("timestamp"))
        ts_issue = F.when(raw_ts.isNotNull() & ~zoned, "naive_timestamp")
    named = F.col(symbol) if isinstance(symbol, str) else symbol
    absent = raw_ts.isNull()
    unreadable = F.lit(False)
    for f in BAR_FIELDS:
        c = F.col(f"`{picked[f]}`")
        text = F.lower(c.cast("string"))
        gone = c.isNull() | (text == "nan")
        absent = absent | gone
        unreadable = unreadable | (~gone & number(f).isNull())
    issue = (
        F.when(absent, "incomplete").when(unreadable, "not_a_number").when(ts_issue.isNotNull(), ts_issue)
        .when(ts.isNull(), "unreadable_timestamp")
    )
    rows = df.select(
        F.upper(F.trim(named)).alias("symbol"), F.lit(interval).alias("interval"), F.lit(source).alias("source"),
        F.lit(RAW).alias("basis"), ts.alias("timestamp"), *[number(f).alias(f) for f in BAR_FIELDS], issue.alias("issue"),
    )
    bars = rows.filter("issue IS NULL").drop("issue")
    refused = rows.filter("issue IS NOT NULL")
    if skip_incomplete:
        refused = refused.filter("issue <> 'incomplete'")
    return bars, refused


def price_frame(
    frame: DataFrame, symbol: str | Column, interval: str, source: str, start: str | None = None, end: str | None = None,
    skip_incomplete: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """A vendor's landed price table to bars within the requested window, and the records refused.

    Columns are told by their lower-cased names alone; one that is missing or
    there twice refuses the frame. Vendors send rows around the window, so it is
    clipped, both ends included.
    """
    bars, refused = normalize_records(frame, symbol, interval, source, FRAME_COLUMNS, skip_incomplete=skip_incomplete)
    return clip(bars, start, end), refused


# ---- study files ---------------------------------------------------------------

STUDY_FIXED = ("symbol", "timestamp", "hypothesis_id", "hypothesis_version", "hypothesis_fingerprint", "state", "reason_codes")


def study_columns(horizons: Sequence[int]) -> list[str]:
    per = ("status", "return", "reference_timestamp", "future_timestamp")
    return [*STUDY_FIXED, *[f"{p}_h{h}" for h in horizons for p in per]]


# --- fixed values: column orders of the study tables ------------------------
METRICS = (
    "sample_count", "mean_forward_return", "median_forward_return", "min_forward_return", "max_forward_return",
    "positive_count", "negative_count", "zero_count", "episode_count",
)
DELTAS = ("mean_delta_vs_matched_unconditional", "median_delta_vs_matched_unconditional")
SUMMARY_COLUMNS = (
    "row_type", "hypothesis_id", "hypothesis_version", "hypothesis_fingerprint", "symbol", "horizon_bars", "spec_fingerprint",
    "state", "reason_signature", *METRICS, *DELTAS, "first_evaluated_timestamp", "last_evaluated_timestamp",
    "total_observations", "bullish_count", "bearish_count", "neutral_count", "insufficient_data_count", "evaluated",
    "insufficient_future_data", "no_reference_bar", "ineligible", "bars_fetched", "warmup_bars", "observation_bars",
    "outcome_buffer_bars",
)
DIAGNOSTIC_COLUMNS = (
    "row_type", "hypothesis_id", "symbol", "asset_class", "state", "horizon_bars", "segment", "partition", "reason_signature",
    "momentum_state", "sampling_view", "count", "sample_count", "mean_forward_return", "median_forward_return",
    "min_forward_return", "max_forward_return", "positive_count", "negative_count", "zero_count", "episode_count", "mean_delta",
    "median_delta", "delta_reference", "length_min", "length_median", "length_max", "share_largest_episode",
    "share_three_largest", "mean_delta_sign", "median_delta_sign", "timestamp", "bars_since_previous_cross",
)
EPISODE_COLUMNS = (
    "hypothesis_id", "hypothesis_version", "hypothesis_fingerprint", "symbol", "state", "reason_signature", "episode_index",
    "start_timestamp", "end_timestamp", "length",
)


def diagnostic_columns(horizons: Sequence[int]) -> list[str]:
    return [*DIAGNOSTIC_COLUMNS, *[f"{p}_h{h}" for h in horizons for p in ("status", "return")]]


def episode_columns(horizons: Sequence[int]) -> list[str]:
    return [*EPISODE_COLUMNS, *[f"start_{p}_h{h}" for h in horizons for p in ("status", "return")]]


def in_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in a fixed column order; a column they do not have is NULL, one that the table does not know is refused."""
    unknown = [c for c in rows.columns if c not in columns]
    if unknown:
        raise SchemaProblem(f"columns {unknown} have no place in the table")
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def as_text(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in a fixed column order, every value as the text of a file."""
    laid = in_columns(rows, columns)
    zoned = {f.name for f in laid.schema.fields if f.dataType.simpleString() == "timestamp"}
    return laid.select(*[
        (F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX") if c in zoned else F.col(c).cast("string")).alias(c) for c in columns])


def diagnostic_table(parts: Mapping[str, DataFrame], horizons: Sequence[int]) -> DataFrame:
    """The diagnostics of a study as one table: rows of each kind under its ``row_type``, in the fixed columns."""
    columns, out = diagnostic_columns(horizons), None
    for kind, rows in parts.items():
        own = as_text(rows.withColumn("row_type", F.lit(kind)), columns)
        out = own if out is None else out.unionByName(own)
    return out


def episode_table(runs: DataFrame, identities: Sequence[tuple[str, int, str]], horizons: Sequence[int]) -> DataFrame:
    """Runs with the identity of their hypothesis and the outcomes at their start, one column per horizon."""
    known = runs.sparkSession.createDataFrame(list(identities), "hypothesis_id string, hypothesis_version int, hypothesis_fingerprint string")
    rows = runs.join(F.broadcast(known), "hypothesis_id", "left")
    for h in horizons:
        first = F.try_element_at(F.filter("start_outcomes", lambda x, h=h: x["horizon_bars"] == h), F.lit(1))
        rows = rows.withColumns({f"start_status_h{h}": first["status"], f"start_return_h{h}": first["outcome_value"]})
    return as_text(rows.drop("start_outcomes"), episode_columns(horizons))


def study_table(wide: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Observation table in the fixed column order of the study files."""
    renamed = wide.select(
        "symbol", "timestamp", "hypothesis_id", F.col("version").alias("hypothesis_version"),
        F.col("fingerprint").alias("hypothesis_fingerprint"), "state", F.col("reason_signature").alias("reason_codes"),
        *[
            F.col(f"h{h}_{c}").alias(f"{n}_h{h}")
            for h in horizons
            for c, n in (("status", "status"), ("outcome_value", "return"), ("reference_timestamp", "reference_timestamp"), ("future_timestamp", "future_timestamp"))
        ],
    )
    return renamed.select(*study_columns(horizons))


def write_study_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", "true").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").csv(path)


def read_study_csv(
    spark: SparkSession, path: str, horizons: Sequence[int], start: str, end: str,
    identities: Sequence[tuple[str, int, str]], symbols: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Study observations and the rows that break the file's contract."""
    kinds = {"timestamp": "TIMESTAMP", "hypothesis_version": "INT"}
    ddl = []
    for c in study_columns(horizons):
        kind = "DOUBLE" if c.startswith("return_h") else "TIMESTAMP" if "timestamp" in c else kinds.get(c, "STRING")
        ddl.append(f"`{c}` {kind}")
    rows = spark.read.schema(", ".join(ddl)).option("header", "true").option("enforceSchema", "false").csv(path)
    known = F.lit(False)
    for h, v, f in identities:
        known = known | (
            (F.col("hypothesis_id") == h) & (F.col("hypothesis_version") == v) & (F.col("hypothesis_fingerprint") == f)
        )
    ts = F.col("timestamp")
    bad_value, bad_status = F.lit(False), F.lit(False)
    for h in horizons:
        status, value = F.col(f"status_h{h}"), F.col(f"return_h{h}")
        bad_value = bad_value | ((status == "evaluated") != value.isNotNull())
        bad_status = bad_status | ~F.coalesce(status.isin(*OUTCOME_STATUSES), F.lit(False))
        bad_status = bad_status | ((status == "ineligible_observation") != (F.col("state") == "insufficient_data"))
    twice = rows.groupBy("symbol", "timestamp", "hypothesis_id").count().filter("count > 1").drop("count")
    rows = rows.join(twice.withColumn("_twice", F.lit(True)), ["symbol", "timestamp", "hypothesis_id"], "left")
    issues = F.array_compact(
        F.array(
            F.when(~F.col("symbol").isin(*symbols), "unknown_symbol"),
            F.when((ts < F.lit(start).cast("timestamp")) | (ts >= F.lit(end).cast("timestamp")), "outside_window"),
            F.when(~known, "identity_mismatch"),
            F.when(~F.coalesce(F.col("state").isin(*OBSERVATION_STATES), F.lit(False)), "unknown_state"),
            F.when(F.coalesce(F.col("reason_codes"), F.lit("")) == "", "empty_reason_codes"),
            F.when(bad_value, "value_status_mismatch"),
            F.when(bad_status, "status_mismatch"),
            F.when(F.col("_twice"), "duplicate_identity"),
        )
    )
    judged = rows.withColumn("issues", issues)
    return judged.filter(F.size("issues") == 0).drop("issues", "_twice"), judged.filter(F.size("issues") > 0).drop("_twice")
