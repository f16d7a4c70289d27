"""Catalogue: outcomes, the batch study and its diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.outcomes import (
    evaluate, match_issues, measure_forward, spacing_issues, state_metrics, status_issues, summarize,
)
from barloom.operators.hypotheses import HYPOTHESES, observe
from barloom.operators.runs import count_runs
from barloom.plans import diagnostics as dg
from barloom.plans import study as st
from barloom.plans.fixtures import DAILY_SQL, HOURLY_SQL, bars_daily, bars_hourly
from barloom.plans.registry import clock, clock_sql, query, rounded, rounded_sql
from barloom.plans.sql_steps import FRAMED, MEASURED, OBSERVED, TO_OUTCOMES, WILDER, steps
from barloom.session import materialize

TS = clock_sql("ts") + " AS ts"
STUDY = st.StudyDefinition(
    symbols=("A", "N", "R"), fetch_start="1995-01-01", observation_start="1996-01-01",
    observation_end="2001-01-01", outcome_data_end="2002-01-01",
)
SEGMENTS = dg.Segments(tuple((str(y), f"{y}-01-01", f"{y + 1}-01-01") for y in range(1996, 2001)))
CLASSES = {"A": "returned", "R": "returned", "N": "kept"}
HORIZONS = [s.horizon_bars for s in STUDY.specs]

ROWS = "rows AS MATERIALIZED (SELECT * FROM out WHERE ts >= '1996-01-01' AND ts < '2001-01-01')"
TO_ROWS = steps(FRAMED, WILDER, OBSERVED, MEASURED, ROWS)


def study_rows(spark, sf):
    bars = materialize(bars_daily(spark, sf), "bars")
    return materialize(st.observation_rows(bars, STUDY), "observations")


def daily_outcomes(spark, sf):
    bars = materialize(bars_daily(spark, sf), "bars")
    return evaluate(observe(bars, HYPOTHESES), bars)


def stats_sql(extra: str = "") -> str:
    return (
        "count(value) AS sample_count, avg(value) AS mean, median(value) AS med, min(value) AS lo, max(value) AS hi, "
        "count(*) FILTER (WHERE value > 0) AS pos, count(*) FILTER (WHERE value < 0) AS neg, "
        "count(*) FILTER (WHERE value = 0) AS zero" + extra
    )


SHOW_STATS = (
    f"coalesce(sample_count, 0) AS sample_count, {rounded_sql('mean')} AS mean_forward_return, {rounded_sql('med')} AS median_forward_return, "
    f"{rounded_sql('lo')} AS min_forward_return, {rounded_sql('hi')} AS max_forward_return, "
    "coalesce(pos, 0) AS positive_count, coalesce(neg, 0) AS negative_count, coalesce(zero, 0) AS zero_count"
)


def shown_stats():
    return [
        "sample_count",
        *[rounded(F.col(f"{m}_forward_return")).alias(f"{m}_forward_return") for m in ("mean", "median", "min", "max")],
        "positive_count", "negative_count", "zero_count",
    ]


@query(
    "forward_outcomes",
    TO_OUTCOMES + f"""SELECT symbol, {TS}, hypothesis_id, state, CAST(horizon_bars AS INT) AS horizon_bars, status,
  CASE WHEN status IN ('evaluated', 'insufficient_future_data') THEN {clock_sql('ref_ts')} END AS reference_ts,
  CASE WHEN status = 'evaluated' THEN {clock_sql('ft')} END AS future_ts, {rounded_sql('value')} AS outcome_value FROM out""",
)
def forward_outcomes(spark, sf):
    return daily_outcomes(spark, sf).select(
        "symbol", clock(F.col("timestamp")).alias("ts"), "hypothesis_id", "state", "horizon_bars", "status",
        clock(F.col("reference_timestamp")).alias("reference_ts"), clock(F.col("future_timestamp")).alias("future_ts"),
        rounded(F.col("outcome_value")).alias("outcome_value"),
    )


@query(
    "point_measurements",
    f"""WITH {HOURLY_SQL}, a AS (SELECT symbol, ts, lead(ts, 1) OVER w AS rt, lead(open, 1) OVER w AS rp,
  lead(close, 5) OVER w AS c5, lead(ts, 5) OVER w AS t5 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, {TS}, CASE WHEN rt IS NULL THEN 'no_reference_bar' WHEN t5 IS NULL THEN 'insufficient_future_data' ELSE 'evaluated' END AS status,
  {rounded_sql('c5 / rp - 1.0')} AS outcome_value FROM a""",
)
def point_measurements(spark, sf):
    from barloom.definitions import OutcomeSpec

    bars = bars_hourly(spark, sf)
    points = bars.select("symbol", "interval", "source", "basis", "timestamp")
    out = measure_forward(points, bars, [OutcomeSpec(5)])
    return out.select(
        "symbol", clock(F.col("timestamp")).alias("ts"), "status", rounded(F.col("outcome_value")).alias("outcome_value")
    )


@query(
    "outcome_integrity",
    steps(FRAMED, WILDER, OBSERVED, MEASURED) + """, hours AS (SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) AS t FROM events),
late AS (SELECT symbol, t FROM hours WHERE hour(t) = 3)
SELECT 'status_fields' AS rule, count(*) AS violations FROM out WHERE status = 'evaluated' AND dayofyear(ts) % 10 = 1
UNION ALL SELECT 'exact_bar', count(*) FROM obs WHERE dayofyear(ts) % 10 = 2
UNION ALL SELECT 'spacing', (SELECT count(*) FROM late) + (SELECT count(*) FROM late JOIN hours USING (symbol) WHERE hours.t = late.t + INTERVAL 1 HOUR)""",
)
def outcome_integrity(spark, sf):
    """Every rule meets rows that break it: values taken away, points off their bar, bars at half past."""
    bars = materialize(bars_daily(spark, sf), "bars")
    observed = materialize(observe(bars, HYPOTHESES), "observations")
    tenth = F.dayofyear("timestamp") % 10
    outcomes = evaluate(observed, bars)
    broken = outcomes.withColumn("outcome_value", F.when(~((tenth == 1) & (F.col("status") == "evaluated")), F.col("outcome_value")))
    moved = observed.withColumn("timestamp", F.when(tenth == 2, F.expr("timestamp + INTERVAL 1 HOUR")).otherwise(F.col("timestamp")))
    hourly = bars_hourly(spark, sf)
    between = hourly.filter(F.hour("timestamp") == 3).withColumn("timestamp", F.expr("timestamp + INTERVAL 30 MINUTE"))
    count = lambda df, rule: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    return (
        count(status_issues(broken), "status_fields")
        .unionByName(count(match_issues(moved, bars), "exact_bar"))
        .unionByName(count(spacing_issues(hourly.unionByName(between)), "spacing"))
    )


@query(
    "state_metrics",
    TO_OUTCOMES + f"""SELECT symbol, hypothesis_id, CAST(horizon_bars AS INT) AS horizon_bars, state, count(*) AS count,
  {rounded_sql('avg(value)')} AS mean, {rounded_sql('median(value)')} AS median,
  {rounded_sql('avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_rate,
  CASE state WHEN 'bullish' THEN {rounded_sql('avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END)')}
    WHEN 'bearish' THEN {rounded_sql('avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END)')} END AS hit_rate
FROM out WHERE status = 'evaluated' GROUP BY symbol, hypothesis_id, horizon_bars, state""",
)
def state_metric_rows(spark, sf):
    out = state_metrics(materialize(daily_outcomes(spark, sf), "outcomes"), ["symbol", "hypothesis_id", "horizon_bars"])
    return out.select(
        "symbol", "hypothesis_id", "horizon_bars", "state", "count", rounded(F.col("mean_forward_return")).alias("mean"),
        rounded(F.col("median_forward_return")).alias("median"), rounded(F.col("positive_return_rate")).alias("positive_rate"),
        rounded(F.col("directional_hit_rate")).alias("hit_rate"),
    )


def picked(group: str, what: str) -> str:
    where = "" if group == "all" else f" AND state = '{group}'"
    return {
        "count": f"count(*) FILTER (WHERE status = 'evaluated'{where})",
        "mean": rounded_sql(f"avg(value) FILTER (WHERE status = 'evaluated'{where})"),
        "median": rounded_sql(f"median(value) FILTER (WHERE status = 'evaluated'{where})"),
    }[what]


@query(
    "evaluation_summary",
    TO_OUTCOMES + """SELECT symbol, hypothesis_id, CAST(horizon_bars AS INT) AS horizon_bars, count(*) AS total_observations,
  count(*) FILTER (WHERE status = 'ineligible_observation') AS ineligible_observations,
  count(*) FILTER (WHERE status <> 'ineligible_observation') AS eligible_observations,
  count(*) FILTER (WHERE status = 'evaluated') AS evaluated_observations,
  count(*) FILTER (WHERE status = 'insufficient_future_data') AS insufficient_future_data,
  count(*) FILTER (WHERE status = 'no_reference_bar') AS no_reference_bar,
  """ + ", ".join(
        f"{picked(g, w)} AS {g}_{w}" for g in ("all", "bullish", "bearish", "neutral") for w in ("count", "mean", "median")
    ) + " FROM out GROUP BY symbol, hypothesis_id, horizon_bars",
)
def evaluation_summary(spark, sf):
    out = summarize(materialize(daily_outcomes(spark, sf), "outcomes"))
    counts = [
        "total_observations", "ineligible_observations", "eligible_observations", "evaluated_observations",
        "insufficient_future_data", "no_reference_bar",
    ]
    groups = [
        F.col(f"{g}_{w}") if w == "count" else rounded(F.col(f"{g}_{w}")).alias(f"{g}_{w}")
        for g in ("all", "bullish", "bearish", "neutral") for w in ("count", "mean", "median")
    ]
    return out.select("symbol", "hypothesis_id", "horizon_bars", *counts, *groups)


@query(
    "study_windows",
    f"""WITH {DAILY_SQL}, c AS (SELECT *, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1.0) AS ch FROM bars WHERE symbol <> 'R' OR ts >= '1995-12-01')
SELECT symbol, count(*) AS bars_fetched, count(*) FILTER (WHERE ts < '1996-01-01') AS warmup_bars,
  count(*) FILTER (WHERE ts >= '1996-01-01' AND ts < '2001-01-01') AS observation_bars,
  count(*) FILTER (WHERE ts >= '2001-01-01') AS outcome_buffer_bars, {clock_sql('min(ts)')} AS first_ts, {clock_sql('max(ts)')} AS last_ts,
  {clock_sql("min(ts) FILTER (WHERE ts >= '1996-01-01' AND ts < '2001-01-01')")} AS first_observed,
  {clock_sql("max(ts) FILTER (WHERE ts >= '1996-01-01' AND ts < '2001-01-01')")} AS last_observed,
  {rounded_sql('max(ch)', 4)} AS max_abs_change, count(*) FILTER (WHERE ts < '1996-01-01') >= {STUDY.minimum_warmup_bars} AS accepted
FROM c GROUP BY symbol""",
)
def study_windows(spark, sf):
    """One symbol's history begins too late for the study."""
    bars = materialize(bars_daily(spark, sf).filter("symbol <> 'R' or timestamp >= '1995-12-01'"), "bars")
    refused = st.study_issues(bars, STUDY).select("symbol").distinct().withColumn("accepted", F.lit(False))
    out = st.symbol_coverage(bars, STUDY).join(refused, "symbol", "left").fillna(True, ["accepted"])
    return out.select(
        "symbol", "bars_fetched", "warmup_bars", "observation_bars", "outcome_buffer_bars",
        clock(F.col("first_timestamp")).alias("first_ts"), clock(F.col("last_timestamp")).alias("last_ts"),
        clock(F.col("first_observation_timestamp")).alias("first_observed"),
        clock(F.col("last_observation_timestamp")).alias("last_observed"),
        rounded(F.col("max_abs_single_bar_close_return"), 4).alias("max_abs_change"), "accepted",
    )


@query(
    "study_observations",
    TO_ROWS + f"""SELECT symbol, {TS}, hypothesis_id, state, signature, """ + ", ".join(
        f"max(status) FILTER (WHERE horizon_bars = {h}) AS h{h}_status, "
        f"{rounded_sql(f'max(value) FILTER (WHERE horizon_bars = {h})')} AS h{h}_value" for h in (1, 5, 20)
    ) + " FROM rows GROUP BY symbol, ts, hypothesis_id, state, signature",
)
def study_observations(spark, sf):
    wide = st.wide_observations(study_rows(spark, sf))
    return wide.select(
        "symbol", clock(F.col("timestamp")).alias("ts"), "hypothesis_id", "state", F.col("reason_signature").alias("signature"),
        *[c for h in HORIZONS for c in (F.col(f"h{h}_status"), rounded(F.col(f"h{h}_outcome_value")).alias(f"h{h}_value"))],
    )


@query(
    "study_coverage",
    TO_ROWS + f"""SELECT hypothesis_id, symbol, CAST(horizon_bars AS INT) AS horizon_bars, count(*) AS total_observations,
  count(*) FILTER (WHERE state = 'bullish') AS bullish_count, count(*) FILTER (WHERE state = 'bearish') AS bearish_count,
  count(*) FILTER (WHERE state = 'neutral') AS neutral_count, count(*) FILTER (WHERE state = 'insufficient_data') AS insufficient_data_count,
  count(*) FILTER (WHERE status = 'evaluated') AS evaluated, count(*) FILTER (WHERE status = 'insufficient_future_data') AS insufficient_future_data,
  count(*) FILTER (WHERE status = 'no_reference_bar') AS no_reference_bar,
  count(*) FILTER (WHERE status = 'ineligible_observation') AS ineligible,
  {clock_sql('min(ts)')} AS first_ts, {clock_sql('max(ts)')} AS last_ts
FROM rows GROUP BY hypothesis_id, symbol, horizon_bars""",
)
def study_coverage(spark, sf):
    out = st.coverage(study_rows(spark, sf))
    return out.withColumns(
        {"first_ts": clock(F.col("first_observation_timestamp")), "last_ts": clock(F.col("last_observation_timestamp"))}
    ).drop("first_observation_timestamp", "last_observation_timestamp")


GROUPS_SQL = f"""tagged AS (
  SELECT *, 'matched_unconditional' AS row_type, 'all' AS gs, '' AS gsig FROM rows WHERE status = 'evaluated'
  UNION ALL SELECT *, 'state', state, '' FROM rows WHERE status = 'evaluated'
  UNION ALL SELECT *, 'neutral_reason', state, signature FROM rows WHERE status = 'evaluated' AND state = 'neutral'),
stats AS (SELECT hypothesis_id, symbol, horizon_bars, row_type, gs, gsig, {stats_sql(', min(ts) AS first_ts, max(ts) AS last_ts')}
  FROM tagged GROUP BY ALL),
seq AS (SELECT *, lag(s) OVER w AS ps, lag(sig) OVER w AS psig FROM (SELECT *, CASE WHEN status = 'evaluated' THEN state END AS s,
    CASE WHEN status = 'evaluated' AND state = 'neutral' THEN signature END AS sig FROM rows)
  WINDOW w AS (PARTITION BY hypothesis_id, symbol, horizon_bars ORDER BY ts)),
epi AS (
  SELECT hypothesis_id, symbol, horizon_bars, 'matched_unconditional' AS row_type, 'all' AS gs, '' AS gsig, count(*) AS episode_count
    FROM seq WHERE s IS NOT NULL AND ps IS NULL GROUP BY ALL
  UNION ALL SELECT hypothesis_id, symbol, horizon_bars, 'state', s, '', count(*) FROM seq WHERE s IS NOT NULL AND s IS DISTINCT FROM ps AND s <> 'insufficient_data' GROUP BY ALL
  UNION ALL SELECT hypothesis_id, symbol, horizon_bars, 'neutral_reason', 'neutral', sig, count(*) FROM seq WHERE sig IS NOT NULL AND sig IS DISTINCT FROM psig GROUP BY ALL),
grid AS (SELECT * FROM (SELECT unnest(['trend_alignment', 'momentum_in_trend_context', 'trend_crossover']) AS hypothesis_id)
  CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS symbol) CROSS JOIN (SELECT unnest([1, 5, 20]) AS horizon_bars)
  CROSS JOIN (SELECT unnest(['matched_unconditional', 'state', 'state', 'state']) AS row_type, unnest(['all', 'bullish', 'bearish', 'neutral']) AS gs)),
cells AS (SELECT *, '' AS gsig FROM grid UNION ALL SELECT hypothesis_id, symbol, horizon_bars, row_type, gs, gsig FROM stats WHERE row_type = 'neutral_reason'),
groups AS (SELECT c.*, stats.* EXCLUDE (hypothesis_id, symbol, horizon_bars, row_type, gs, gsig), coalesce(episode_count, 0) AS episode_count,
    CASE WHEN c.row_type <> 'matched_unconditional' THEN stats.mean - m.mean END AS mean_delta,
    CASE WHEN c.row_type <> 'matched_unconditional' THEN stats.med - m.med END AS median_delta
  FROM cells c LEFT JOIN stats USING (hypothesis_id, symbol, horizon_bars, row_type, gs, gsig)
  LEFT JOIN epi USING (hypothesis_id, symbol, horizon_bars, row_type, gs, gsig)
  LEFT JOIN stats m ON m.hypothesis_id = c.hypothesis_id AND m.symbol = c.symbol AND m.horizon_bars = c.horizon_bars
    AND m.row_type = 'matched_unconditional')"""
TO_GROUPS = steps(FRAMED, WILDER, OBSERVED, MEASURED, ROWS, GROUPS_SQL)


@query(
    "study_groups",
    TO_GROUPS + f"""SELECT hypothesis_id, symbol, CAST(horizon_bars AS INT) AS horizon_bars, row_type, gs AS state, gsig AS signature, {SHOW_STATS},
  episode_count, {rounded_sql('mean_delta')} AS mean_delta, {rounded_sql('median_delta')} AS median_delta,
  {clock_sql('first_ts')} AS first_ts, {clock_sql('last_ts')} AS last_ts FROM groups""",
)
def study_groups(spark, sf):
    out = st.result_groups(study_rows(spark, sf), STUDY)
    return out.select(
        "hypothesis_id", "symbol", "horizon_bars", "row_type", F.col("group_state").alias("state"),
        F.col("group_signature").alias("signature"), *shown_stats(), "episode_count",
        rounded(F.col("mean_delta_vs_matched_unconditional")).alias("mean_delta"),
        rounded(F.col("median_delta_vs_matched_unconditional")).alias("median_delta"),
        clock(F.col("first_evaluated_timestamp")).alias("first_ts"), clock(F.col("last_evaluated_timestamp")).alias("last_ts"),
    )


@query(
    "summary_recomputed",
    TO_GROUPS + """SELECT 'metric_differs' AS issue, count(*) AS groups FROM groups WHERE horizon_bars = 5
UNION ALL SELECT 'missing_row', count(*) FROM groups WHERE horizon_bars = 20""",
)
def summary_recomputed(spark, sf):
    """A stored summary with one metric changed at one horizon, and rows of another that the recomputation lacks."""
    again = materialize(st.result_groups(study_rows(spark, sf), STUDY), "summary")
    changed = F.col("sample_count") + (F.col("horizon_bars") == 5).cast("int")
    found = st.compare_summary(again.withColumn("sample_count", changed), again.filter("horizon_bars <> 20"))
    return found.groupBy("issue").agg(F.count(F.lit(1)).alias("groups"))


@query(
    "membership_runs",
    TO_OUTCOMES + """, flags AS (SELECT symbol, hypothesis_id, state IN ('bullish', 'bearish') AS m,
  lag(state IN ('bullish', 'bearish')) OVER (PARTITION BY symbol, hypothesis_id ORDER BY ts) AS pm FROM obs)
SELECT symbol, hypothesis_id, count(*) FILTER (WHERE m AND NOT coalesce(pm, false)) AS episode_count FROM flags GROUP BY 1, 2""",
)
def membership_runs(spark, sf):
    rows = materialize(observe(materialize(bars_daily(spark, sf), "bars"), HYPOTHESES), "observations")
    return count_runs(rows, ("symbol", "hypothesis_id"), "timestamp", F.col("state").isin("bullish", "bearish"))


EPISODES_SQL = """one AS (SELECT DISTINCT symbol, hypothesis_id, ts, state, signature FROM rows),
marked AS (SELECT *, sum(CASE WHEN state IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, hypothesis_id ORDER BY ts) AS run
  FROM (SELECT *, lag(state) OVER (PARTITION BY symbol, hypothesis_id ORDER BY ts) AS p FROM one)),
episodes AS (SELECT symbol, hypothesis_id, CAST(run - 1 AS BIGINT) AS episode_index, min(state) AS state, arg_min(signature, ts) AS signature,
  min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length FROM marked GROUP BY symbol, hypothesis_id, run)"""
TO_EPISODES = steps(FRAMED, WILDER, OBSERVED, MEASURED, ROWS, EPISODES_SQL)


@query(
    "state_episodes",
    TO_EPISODES + f"SELECT symbol, hypothesis_id, episode_index, state, signature, {clock_sql('start_ts')} AS start_ts, {clock_sql('end_ts')} AS end_ts, length FROM episodes",
)
def state_episodes(spark, sf):
    runs = dg.study_episodes(study_rows(spark, sf))
    return runs.select(
        "symbol", "hypothesis_id", "episode_index", "state", F.col("reason_signature").alias("signature"),
        clock(F.col("start_timestamp")).alias("start_ts"), clock(F.col("end_timestamp")).alias("end_ts"), "length",
    )


@query(
    "episode_summary",
    TO_EPISODES + f"""SELECT symbol, hypothesis_id, state, CAST(sum(length) AS BIGINT) AS observations, count(*) AS episode_count,
  min(length) AS length_min, median(length) AS length_median, max(length) AS length_max,
  {rounded_sql('max(length) / sum(length)')} AS share_largest_episode,
  {rounded_sql('list_sum(list_reverse_sort(list(length))[1:3]) / sum(length)')} AS share_three_largest
FROM episodes GROUP BY symbol, hypothesis_id, state""",
)
def episode_summary_rows(spark, sf):
    out = dg.episode_rows(dg.study_episodes(study_rows(spark, sf)))
    return out.withColumns(
        {c: rounded(F.col(c)) for c in ("share_largest_episode", "share_three_largest")}
    )


@query(
    "episode_starts",
    TO_EPISODES + f""", s AS (SELECT e.symbol, e.hypothesis_id, e.state, r.horizon_bars, r.value FROM episodes e
  JOIN rows r ON r.symbol = e.symbol AND r.hypothesis_id = e.hypothesis_id AND r.ts = e.start_ts WHERE e.state <> 'insufficient_data'),
t AS (SELECT symbol, hypothesis_id, state, horizon_bars, {stats_sql(', count(*) AS episode_count')} FROM s GROUP BY ALL)
SELECT symbol, hypothesis_id, state, CAST(horizon_bars AS INT) AS horizon_bars, {SHOW_STATS}, episode_count FROM t""",
)
def episode_starts(spark, sf):
    out = dg.episode_start_rows(dg.study_episodes(study_rows(spark, sf)))
    return out.select("symbol", "hypothesis_id", "state", "horizon_bars", *shown_stats(), "episode_count")


PAIRS_SQL = """tr AS (SELECT * FROM rows WHERE hypothesis_id = 'trend_alignment'),
mo AS (SELECT symbol, ts, horizon_bars, state AS m_state, signature AS m_sig FROM rows WHERE hypothesis_id = 'momentum_in_trend_context'),
pairs AS MATERIALIZED (SELECT * FROM tr JOIN mo USING (symbol, ts, horizon_bars))"""
TO_PAIRS = steps(FRAMED, WILDER, OBSERVED, MEASURED, ROWS, PAIRS_SQL)


@query(
    "gate_crosstab",
    TO_PAIRS + """SELECT symbol, trend_state, momentum_state, coalesce(n, 0) AS count FROM (SELECT unnest(['A', 'N', 'R']) AS symbol)
  CROSS JOIN (SELECT unnest(['bullish', 'bearish', 'neutral', 'insufficient_data']) AS trend_state)
  CROSS JOIN (SELECT unnest(['bullish', 'bearish', 'neutral', 'insufficient_data']) AS momentum_state) g
  LEFT JOIN (SELECT symbol, state AS trend_state, m_state AS momentum_state, count(*) AS n FROM pairs WHERE horizon_bars = 1 GROUP BY ALL)
  USING (symbol, trend_state, momentum_state)""",
)
def gate_crosstab(spark, sf):
    return dg.gate_crosstab(dg.paired_states(study_rows(spark, sf)), list(STUDY.symbols))


PARTITIONS_SQL = f"""parts AS (SELECT symbol, state, horizon_bars, value, m_sig, CASE WHEN m_state = state THEN 'retained' WHEN m_state = 'neutral' THEN 'removed'
    WHEN m_state IN ('bullish', 'bearish') THEN 'opposite' ELSE 'ineligible' END AS part
  FROM pairs WHERE state IN ('bullish', 'bearish') AND status = 'evaluated'),
ptag AS (SELECT *, 'parent' AS p, '' AS sig FROM parts UNION ALL SELECT *, part, '' FROM parts UNION ALL SELECT *, part, m_sig FROM parts WHERE part = 'removed'),
pstat AS (SELECT symbol, state, horizon_bars, p, sig, {stats_sql()} FROM ptag GROUP BY ALL),
pcell AS (SELECT *, '' AS sig FROM (SELECT unnest(['A', 'N', 'R']) AS symbol) CROSS JOIN (SELECT unnest(['bullish', 'bearish']) AS state)
    CROSS JOIN (SELECT unnest([1, 5, 20]) AS horizon_bars) CROSS JOIN (SELECT unnest(['retained', 'removed', 'opposite']) AS p)
  UNION ALL SELECT symbol, state, horizon_bars, p, sig FROM pstat WHERE sig <> ''),
partitions AS (SELECT c.*, s.* EXCLUDE (symbol, state, horizon_bars, p, sig), s.mean - q.mean AS mean_delta, s.med - q.med AS median_delta
  FROM pcell c LEFT JOIN pstat s USING (symbol, state, horizon_bars, p, sig)
  LEFT JOIN pstat q ON q.symbol = c.symbol AND q.state = c.state AND q.horizon_bars = c.horizon_bars AND q.p = 'parent')"""
TO_PARTITIONS = steps(FRAMED, WILDER, OBSERVED, MEASURED, ROWS, PAIRS_SQL, PARTITIONS_SQL)


@query(
    "gate_partitions",
    TO_PARTITIONS + f"""SELECT symbol, state, CAST(horizon_bars AS INT) AS horizon_bars, p AS "partition", sig AS signature, {SHOW_STATS},
  {rounded_sql('mean_delta')} AS mean_delta, {rounded_sql('median_delta')} AS median_delta FROM partitions""",
)
def gate_partitions(spark, sf):
    pairs = materialize(dg.paired_states(study_rows(spark, sf)), "pairs")
    out = dg.gate_partitions(pairs, list(STUDY.symbols), HORIZONS)
    return out.select(
        "symbol", "state", "horizon_bars", "partition", F.col("reason_signature").alias("signature"), *shown_stats(),
        rounded(F.col("mean_delta")).alias("mean_delta"), rounded(F.col("median_delta")).alias("median_delta"),
    )


SIGN = lambda x: f"CASE WHEN {x} IS NULL THEN '' WHEN {x} > 0 THEN '+' WHEN {x} < 0 THEN '-' ELSE '0' END"


@query(
    "partition_signs",
    TO_PARTITIONS + f"""SELECT symbol, state, CAST(horizon_bars AS INT) AS horizon_bars,
  {', '.join(f"coalesce(max(sample_count) FILTER (WHERE p = '{p}'), 0) AS {p}_n" for p in ('retained', 'removed', 'opposite'))},
  {', '.join(f"max({SIGN(m + '_delta')}) FILTER (WHERE p = '{p}') AS {p}_{m}_delta_sign" for p in ('retained', 'removed') for m in ('median', 'mean'))}
FROM partitions WHERE sig = '' GROUP BY symbol, state, horizon_bars""",
)
def partition_signs(spark, sf):
    pairs = materialize(dg.paired_states(study_rows(spark, sf)), "pairs")
    return dg.partition_signs(dg.gate_partitions(pairs, list(STUDY.symbols), HORIZONS))


SEGMENTS_SQL = f"""srow AS (SELECT *, strftime(ts, '%Y') AS segment, CASE WHEN status = 'evaluated' THEN state END AS s FROM rows),
sseq AS (SELECT *, lag(s) OVER w AS ps FROM srow WINDOW w AS (PARTITION BY hypothesis_id, symbol, horizon_bars, segment ORDER BY ts)),
stag AS (SELECT *, 'all' AS gs FROM srow WHERE s IS NOT NULL UNION ALL SELECT *, s FROM srow WHERE s IS NOT NULL),
sstat AS (SELECT hypothesis_id, symbol, horizon_bars, segment, gs, {stats_sql()} FROM stag GROUP BY ALL),
sepi AS (SELECT hypothesis_id, symbol, horizon_bars, segment, 'all' AS gs, count(*) AS episode_count FROM sseq WHERE s IS NOT NULL AND ps IS NULL GROUP BY ALL
  UNION ALL SELECT hypothesis_id, symbol, horizon_bars, segment, s, count(*) FROM sseq WHERE s IS NOT NULL AND s IS DISTINCT FROM ps GROUP BY ALL),
scell AS (SELECT * FROM (SELECT unnest(['trend_alignment', 'momentum_in_trend_context', 'trend_crossover']) AS hypothesis_id)
  CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS symbol) CROSS JOIN (SELECT unnest([1, 5, 20]) AS horizon_bars)
  CROSS JOIN (SELECT unnest(['1996', '1997', '1998', '1999', '2000']) AS segment)
  CROSS JOIN (SELECT unnest(['all', 'bullish', 'bearish', 'neutral']) AS gs)),
segs AS (SELECT c.*, s.* EXCLUDE (hypothesis_id, symbol, horizon_bars, segment, gs), coalesce(episode_count, 0) AS episode_count,
    CASE WHEN c.gs <> 'all' THEN s.mean - m.mean END AS mean_delta, CASE WHEN c.gs <> 'all' THEN s.med - m.med END AS median_delta
  FROM scell c LEFT JOIN sstat s USING (hypothesis_id, symbol, horizon_bars, segment, gs)
  LEFT JOIN sepi USING (hypothesis_id, symbol, horizon_bars, segment, gs)
  LEFT JOIN sstat m ON m.hypothesis_id = c.hypothesis_id AND m.symbol = c.symbol AND m.horizon_bars = c.horizon_bars AND m.segment = c.segment AND m.gs = 'all')"""


@query(
    "segment_groups",
    steps(FRAMED, WILDER, OBSERVED, MEASURED, ROWS, SEGMENTS_SQL) + f"""SELECT hypothesis_id, symbol, CAST(horizon_bars AS INT) AS horizon_bars,
  segment, gs AS state, {SHOW_STATS}, episode_count, {rounded_sql('mean_delta')} AS mean_delta, {rounded_sql('median_delta')} AS median_delta FROM segs""",
)
def segment_groups(spark, sf):
    out = dg.segment_rows(study_rows(spark, sf), SEGMENTS, list(STUDY.symbols))
    return out.select(
        "hypothesis_id", "symbol", "horizon_bars", "segment", F.col("group_state").alias("state"), *shown_stats(),
        "episode_count", rounded(F.col("mean_delta")).alias("mean_delta"), rounded(F.col("median_delta")).alias("median_delta"),
    )


@query(
    "class_signs",
    TO_GROUPS + f""", signed AS (SELECT hypothesis_id, gs AS state, horizon_bars, symbol, CASE symbol WHEN 'N' THEN 'kept' ELSE 'returned' END AS asset_class,
  {SIGN('mean_delta')} AS ms, {SIGN('median_delta')} AS ds FROM groups WHERE row_type = 'state')
SELECT hypothesis_id, state, CAST(horizon_bars AS INT) AS horizon_bars, asset_class, count(*) AS count, string_agg(ms, '' ORDER BY symbol) AS mean_delta_signs,
  string_agg(ds, '' ORDER BY symbol) AS median_delta_signs FROM signed GROUP BY ALL""",
)
def class_signs(spark, sf):
    return dg.class_signs(st.result_groups(study_rows(spark, sf), STUDY), CLASSES, list(STUDY.symbols))


@query(
    "segment_agreement",
    steps(FRAMED, WILDER, OBSERVED, MEASURED, ROWS, GROUPS_SQL, SEGMENTS_SQL) + f"""SELECT g.hypothesis_id, g.symbol, CAST(g.horizon_bars AS INT) AS horizon_bars,
  g.gs AS state, {SIGN('g.mean_delta')} AS full_mean_sign, {SIGN('g.median_delta')} AS full_median_sign, count(*) AS segments,
  count(*) FILTER (WHERE {SIGN('g.mean_delta')} <> '' AND {SIGN('s.mean_delta')} = {SIGN('g.mean_delta')}) AS segments_with_same_mean_sign,
  count(*) FILTER (WHERE {SIGN('g.median_delta')} <> '' AND {SIGN('s.median_delta')} = {SIGN('g.median_delta')}) AS segments_with_same_median_sign
FROM groups g JOIN segs s ON s.hypothesis_id = g.hypothesis_id AND s.symbol = g.symbol AND s.horizon_bars = g.horizon_bars AND s.gs = g.gs
WHERE g.row_type = 'state' AND g.gs IN ('bullish', 'bearish') AND g.hypothesis_id <> 'trend_crossover' GROUP BY ALL""",
)
def segment_agreement(spark, sf):
    rows = study_rows(spark, sf)
    return dg.segment_agreement(st.result_groups(rows, STUDY), dg.segment_rows(rows, SEGMENTS, list(STUDY.symbols)))


@query(
    "episode_concentration",
    TO_EPISODES + f"""SELECT symbol, hypothesis_id, state, CAST(sum(length) AS BIGINT) AS observations, count(*) AS episode_count,
  {rounded_sql('max(length) / sum(length)')} AS share_largest_episode, max(length) / sum(length) > 0.25 AS concentrated
FROM episodes WHERE state IN ('bullish', 'bearish') AND hypothesis_id <> 'trend_crossover' GROUP BY symbol, hypothesis_id, state""",
)
def episode_concentration(spark, sf):
    out = dg.concentration(dg.episode_rows(dg.study_episodes(study_rows(spark, sf))))
    return out.select(
        "symbol", "hypothesis_id", "state", "observations", "episode_count",
        rounded(F.col("share_largest_episode")).alias("share_largest_episode"), "concentrated",
    )


@query(
    "crossover_events",
    TO_ROWS + f""", o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM rows WHERE hypothesis_id = 'trend_crossover' AND horizon_bars = 1)
SELECT symbol, {TS}, state, CAST(i - lag(i) OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS bars_since_previous_cross
FROM o WHERE state IN ('bullish', 'bearish')""",
)
def crossover_events(spark, sf):
    out = dg.crossover_events(study_rows(spark, sf))
    return out.select(
        "symbol", clock(F.col("timestamp")).alias("ts"), "state",
        F.col("rows_since_previous").cast("double").alias("bars_since_previous_cross"),
    )
