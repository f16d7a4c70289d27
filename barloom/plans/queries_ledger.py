"""Catalogue: claims ledger, provenance audit and validation.

The ledger is derived from the daily bars: bars are stamped at New York
midnight, every post-activation bar gets one claim per hypothesis and one
assessment claim, recorded at 03:30 (plus a minute per symbol) of the next
New York day; outcomes are recorded at the same clock of the day their last bar
is seen. Fixed day-of-year rules inject late, foreign and interrupted records.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.definitions import Policy
from barloom.functions import times
from barloom.operators import ledger as lg
from barloom.operators import provenance as pv
from barloom.operators import validation as vl
from barloom.operators.assess import assess
from barloom.operators.hypotheses import HYPOTHESES, TREND_ALIGNMENT, observe
from barloom.operators.outcomes import SPECS
from barloom.operators.quality import require_empty
from barloom.plans.fixtures import bars_daily, folder, lineitem_sql, table
from barloom.plans.queries_features import ASSESSED
from barloom.plans.registry import clock, clock_sql, query, rounded, rounded_sql
from barloom.plans.sql_steps import FRAMED, OBSERVED, WILDER, steps
from barloom.session import materialize
from barloom.sources import records as rc

ACTIVATED = "1996-01-01 00:00:00"
SYMBOLS = ("A", "N", "R")
POLICY = Policy.of(HYPOTHESES, 2)


def to_utc_sql(x: str) -> str:
    return f"((({x}) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC')"


def to_local_sql(x: str) -> str:
    return f"((({x}) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


def run_clock(ts, symbol):
    """03:30 New York of the day after the bar, one minute later per symbol."""
    day = F.date_trunc("day", times.new_york(ts))
    minute = F.when(symbol == "N", 1).when(symbol == "R", 2).otherwise(0)
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(day) + 27 * 3600 + 1800 + minute * 60), times.NEW_YORK)


def run_clock_sql(ts: str, symbol: str = "symbol") -> str:
    minute = f"(CASE {symbol} WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 0 END)"
    return to_utc_sql(f"date_trunc('day', {to_local_sql(ts)}) + INTERVAL 27 HOUR + INTERVAL 30 MINUTE + {minute} * INTERVAL 1 MINUTE")


def day_of_year(ts):
    return F.dayofyear(times.new_york(ts))


def doy_sql(ts: str) -> str:
    return f"dayofyear({to_local_sql(ts)})"


NY_BARS = lineitem_sql("l_returnflag", "raw_bars") + f""",
bars AS MATERIALIZED (SELECT * REPLACE ({to_utc_sql('ts')} AS ts) FROM raw_bars)"""

CLAIMS = f"""claims AS MATERIALIZED (SELECT *, {run_clock_sql('ts')} AS recorded_at FROM (
    SELECT symbol, ts, 'observation' AS kind, hypothesis_id, state, signature FROM obs
    UNION ALL SELECT symbol, ts, 'assessment', NULL, state, reasons FROM reasoned)
  WHERE ts >= TIMESTAMP '{ACTIVATED}'),
ahead AS MATERIALIZED (SELECT symbol, ts, lead(ts, 1) OVER x AS ref_ts, lead(open, 1) OVER x AS ref_px, unnest([1, 5, 20]) AS h,
    unnest([lead(ts, 1) OVER x, lead(ts, 5) OVER x, lead(ts, 20) OVER x]) AS ft,
    unnest([lead(close, 1) OVER x, lead(close, 5) OVER x, lead(close, 20) OVER x]) AS fc
  FROM bars WINDOW x AS (PARTITION BY symbol ORDER BY ts)),
records AS MATERIALIZED (SELECT c.*, a.h AS horizon_bars, a.ref_ts, a.ft, a.fc / a.ref_px - 1.0 AS value, {run_clock_sql('a.ft', 'c.symbol')} AS evaluated_at
  FROM claims c JOIN ahead a USING (symbol, ts) WHERE c.state <> 'insufficient_data' AND a.ft IS NOT NULL)"""
TO_CLAIMS = steps(FRAMED, WILDER, OBSERVED, ASSESSED, CLAIMS, bars=NY_BARS)


def new_york_bars(spark, sf):
    bars = bars_daily(spark, sf).withColumn("timestamp", F.to_utc_timestamp("timestamp", times.NEW_YORK))
    return materialize(bars, "bars")


def ledger_claims(bars):
    seen = materialize(observe(bars, HYPOTHESES), "observations")
    recorded = run_clock(F.col("timestamp"), F.col("symbol"))
    one = lg.claims_from_observations(seen, bars, recorded)
    two = lg.claims_from_assessments(assess(seen, POLICY), bars, recorded)
    both = one.unionByName(two).filter(F.col("timestamp") >= F.lit(ACTIVATED).cast("timestamp"))
    return materialize(both, "claims")


def ledger_records(claims, bars):
    clock_then = run_clock(F.col("future_timestamp"), F.col("symbol"))
    return materialize(lg.new_outcomes(lg.track(claims, bars, SPECS, None, clock_then)), "outcomes")


def ledger(spark, sf):
    bars = new_york_bars(spark, sf)
    claims = ledger_claims(bars)
    return bars, claims, ledger_records(claims, bars)


@query(
    "claim_registration",
    TO_CLAIMS + f""", sent AS (SELECT *, {doy_sql('ts')} % 10 = 0 AS altered, ts < TIMESTAMP '2000-01-01' AS stored FROM claims)
SELECT symbol, kind, CASE WHEN NOT stored THEN 'written' WHEN altered THEN 'conflict' ELSE 'duplicate' END AS status, count(*) AS claims
FROM sent GROUP BY ALL""",
)
def claim_registration(spark, sf):
    claims = ledger_claims(new_york_bars(spark, sf))
    held = claims.filter(F.col("timestamp") < F.lit("2000-01-01").cast("timestamp"))
    altered = F.when(day_of_year(F.col("timestamp")) % 10 == 0, F.lit("altered")).otherwise(F.col("state"))
    incoming = claims.withColumns({"state": altered, "recorded_at": F.expr("recorded_at + INTERVAL 1 DAY")})
    out = lg.register(incoming.unionByName(incoming), held)
    return out.groupBy("symbol", "kind", "status").agg(F.count(F.lit(1)).alias("claims"))


@query(
    "outcome_tracking",
    TO_CLAIMS + f""", tracked AS (SELECT c.symbol, c.kind, a.h, CASE WHEN c.state = 'insufficient_data' THEN 'ineligible'
      WHEN c.ts < (SELECT min(ts) FROM bars b WHERE b.symbol = c.symbol AND b.ts >= TIMESTAMP '1996-06-01') THEN 'out_of_window'
      WHEN {doy_sql('c.ts')} % 29 = 0 THEN 'refused' WHEN a.ft IS NULL THEN 'pending' ELSE 'evaluated' END AS status
    FROM claims c JOIN ahead a USING (symbol, ts))
SELECT symbol, kind, CAST(h AS INT) AS horizon_bars, status, count(*) AS items FROM tracked GROUP BY ALL""",
)
def outcome_tracking(spark, sf):
    bars = new_york_bars(spark, sf)
    claims = ledger_claims(bars)
    later = bars.filter(F.col("timestamp") >= F.lit("1996-06-01").cast("timestamp"))
    revised = later.withColumn(
        "volume", F.when(day_of_year(F.col("timestamp")) % 29 == 0, F.col("volume") + 1).otherwise(F.col("volume"))
    )
    out = lg.track(claims, revised, SPECS, None, F.lit("2002-01-01").cast("timestamp"))
    return out.groupBy("symbol", "kind", "horizon_bars", "status").agg(F.count(F.lit(1)).alias("items"))


@query(
    "refresh_report",
    TO_CLAIMS + """, st AS (SELECT c.symbol, a.h, CASE WHEN c.state <> 'insufficient_data' AND a.ft < TIMESTAMP '2000-01-01' THEN 'present'
      WHEN c.state = 'insufficient_data' THEN 'ineligible' WHEN a.ft IS NULL THEN 'pending' ELSE 'evaluated' END AS status
    FROM claims c JOIN ahead a USING (symbol, ts))
SELECT symbol, CAST(h AS INT) AS horizon_bars, status, count(*) AS items FROM st GROUP BY ALL""",
)
def refresh_report(spark, sf):
    bars, claims, records = ledger(spark, sf)
    present = records.filter(F.col("future_timestamp") < F.lit("2000-01-01").cast("timestamp"))
    return lg.refresh_counts(lg.track(claims, bars, SPECS, present, F.lit("2002-01-01").cast("timestamp")))


@query(
    "consumed_bars",
    TO_CLAIMS + """SELECT symbol, CAST(horizon_bars AS INT) AS horizon_bars, count(*) AS outcomes, count(DISTINCT ts) AS distinct_windows
FROM records GROUP BY ALL""",
)
def consumed_bars(spark, sf):
    _, _, records = ledger(spark, sf)
    return records.groupBy("symbol", "horizon_bars").agg(
        F.count(F.lit(1)).alias("outcomes"), F.countDistinct("consumed_bars_fingerprint").alias("distinct_windows")
    )


COVERED = """cov AS (SELECT h.h, kind, hypothesis_id, state, count(*) AS artifacts_registered,
    count(*) FILTER (WHERE state <> 'insufficient_data') AS artifacts_evaluable, count(d.h) AS artifacts_completed,
    min(c.ts) AS first_ts, max(c.ts) AS last_ts
  FROM claims c CROSS JOIN (SELECT unnest([1, 5, 20]) AS h) h
  LEFT JOIN (SELECT symbol, ts, kind AS k, coalesce(hypothesis_id, '') AS hy, horizon_bars AS h FROM records) d
    ON d.symbol = c.symbol AND d.ts = c.ts AND d.k = c.kind AND d.hy = coalesce(c.hypothesis_id, '') AND d.h = h.h
  GROUP BY h.h, kind, hypothesis_id, state)"""


@query(
    "ledger_coverage",
    TO_CLAIMS + ", " + COVERED + f"""SELECT CAST(h AS INT) AS horizon_bars, kind, coalesce(hypothesis_id, '') AS hypothesis_id, state,
  artifacts_registered, artifacts_evaluable, artifacts_completed, {clock_sql('first_ts')} AS first_ts, {clock_sql('last_ts')} AS last_ts,
  {rounded_sql('artifacts_completed / artifacts_registered')} AS raw_coverage,
  CASE WHEN artifacts_evaluable > 0 THEN {rounded_sql('artifacts_completed / artifacts_evaluable')} END AS evaluable_coverage,
  row_number() OVER (ORDER BY h, kind, hypothesis_id NULLS FIRST, state) AS place FROM cov""",
)
def ledger_coverage_rows(spark, sf):
    _, claims, records = ledger(spark, sf)
    out = lg.summary_places(lg.ledger_coverage(claims, records, SPECS))
    return out.select(
        "horizon_bars", "kind", F.coalesce("hypothesis_id", F.lit("")).alias("hypothesis_id"), "state",
        "artifacts_registered", "artifacts_evaluable", "artifacts_completed",
        clock(F.col("first_artifact_timestamp")).alias("first_ts"), clock(F.col("last_artifact_timestamp")).alias("last_ts"),
        rounded(F.col("raw_coverage_fraction")).alias("raw_coverage"),
        rounded(F.col("evaluable_coverage_fraction")).alias("evaluable_coverage"), "place",
    )


@query(
    "ledger_metrics",
    TO_CLAIMS + ", " + COVERED + f""", met AS (SELECT horizon_bars AS h, kind, hypothesis_id, state, count(*) AS n, avg(value) AS mean, median(value) AS med,
    min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE value > 0) AS pos, count(*) FILTER (WHERE value < 0) AS neg FROM records GROUP BY ALL)
SELECT CAST(met.h AS INT) AS horizon_bars, met.kind, coalesce(met.hypothesis_id, '') AS hypothesis_id, met.state, n AS sample_count, artifacts_registered,
  artifacts_evaluable, {rounded_sql('mean')} AS mean, {rounded_sql('med')} AS median, {rounded_sql('lo')} AS lowest, {rounded_sql('hi')} AS highest,
  pos AS positive_count, neg AS negative_count, {rounded_sql('n / artifacts_evaluable')} AS evaluable_coverage, n >= 20 AS sample_floor_met
FROM met JOIN cov ON cov.h = met.h AND cov.kind = met.kind AND cov.state = met.state AND cov.hypothesis_id IS NOT DISTINCT FROM met.hypothesis_id""",
)
def ledger_metric_rows(spark, sf):
    _, claims, records = ledger(spark, sf)
    out = lg.ledger_metrics(claims, records, SPECS)
    return out.select(
        "horizon_bars", "kind", F.coalesce("hypothesis_id", F.lit("")).alias("hypothesis_id"), "state", "sample_count",
        "artifacts_registered", "artifacts_evaluable",
        *[rounded(F.col(f"{c}_forward_return")).alias(n) for c, n in (("mean", "mean"), ("median", "median"), ("min", "lowest"), ("max", "highest"))],
        "positive_count", "negative_count", rounded(F.col("evaluable_coverage_fraction")).alias("evaluable_coverage"),
        "sample_floor_met",
    )


@query(
    "ledger_integrity",
    TO_CLAIMS + f"""SELECT 'duplicate_key' AS issue, count(*) AS records FROM claims WHERE {doy_sql('ts')} % 100 = 1
UNION ALL SELECT 'key_mismatch', count(*) FROM claims WHERE {doy_sql('ts')} % 100 = 2
UNION ALL SELECT 'return_disagrees', count(*) FROM records WHERE {doy_sql('ts')} % 100 = 3
UNION ALL SELECT 'orphan_outcome', count(*) FROM records WHERE {doy_sql('ts')} % 100 = 2
UNION ALL SELECT 'evaluated_before_recorded', count(*) FROM records WHERE {doy_sql('ts')} % 100 = 4
UNION ALL SELECT 'evaluated_before_future', count(*) FROM records WHERE {doy_sql('ts')} % 100 = 4""",
)
def ledger_integrity(spark, sf):
    _, claims, records = ledger(spark, sf)
    doy = day_of_year(F.col("timestamp")) % 100
    broken = claims.withColumn(
        "artifact_key", F.when(doy == 2, F.concat(F.lit("x"), "artifact_key")).otherwise(F.col("artifact_key"))
    )
    claims_twice = broken.unionByName(broken.filter(doy == 1))
    stamped = records.join(claims.select("artifact_key", "timestamp"), "artifact_key")
    bad = stamped.withColumns(
        {
            "forward_return": F.when(doy == 3, F.col("forward_return") + 1).otherwise(F.col("forward_return")),
            "evaluated_at": F.when(doy == 4, F.col("timestamp")).otherwise(F.col("evaluated_at")),
        }
    ).drop("timestamp")
    found = lg.claim_issues(claims_twice).select("issue").unionByName(lg.outcome_issues(bad, broken).select("issue"))
    return found.groupBy("issue").agg(F.count(F.lit(1)).alias("records"))


@query(
    "unclaimed_tails",
    TO_CLAIMS + f""", kept AS (SELECT DISTINCT symbol, ts FROM claims WHERE ts < TIMESTAMP '2001-06-01' AND {doy_sql('ts')} % 9 <> 0)
SELECT b.symbol, {clock_sql('b.ts')} AS ts FROM bars b LEFT JOIN kept k USING (symbol, ts) WHERE k.ts IS NULL
  AND b.ts > (SELECT max(ts) FROM kept WHERE kept.symbol = b.symbol) AND b.ts < (SELECT max(ts) FROM bars z WHERE z.symbol = b.symbol)
  AND b.ts + INTERVAL 1 DAY > TIMESTAMP '{ACTIVATED}'""",
)
def unclaimed_tails(spark, sf):
    bars = new_york_bars(spark, sf)
    claims = ledger_claims(bars)
    kept = claims.filter(
        (F.col("timestamp") < F.lit("2001-06-01").cast("timestamp")) & (day_of_year(F.col("timestamp")) % 9 != 0)
    )
    out = lg.missed_tails(bars, kept, F.lit(ACTIVATED).cast("timestamp"))
    return out.select("symbol", clock(F.col("timestamp")).alias("ts"))


# ---- provenance -------------------------------------------------------------

COMMIT, OTHER_COMMIT = "a" * 40, "b" * 40
PRODUCERS = tuple(
    ("observation", h.hypothesis_id, str(h.version), h.fingerprint) for h in HYPOTHESES
) + (("assessment", POLICY.fingerprint),)
AUDIT = pv.ProvenancePolicy(
    universe=SYMBOLS, activated_at=ACTIVATED, collection_fingerprint="c1", policy_fingerprint="p1", collector_commit=COMMIT,
    producers=PRODUCERS, spec_horizons=tuple((s.fingerprint, s.horizon_bars) for s in SPECS), provider="lineitem",
)


def run_log(bars, records):
    """One start per bar day, and its completed record unless the run was interrupted."""
    live = bars.filter(F.col("timestamp") >= F.lit(ACTIVATED).cast("timestamp"))
    written = records.groupBy("symbol", F.col("evaluated_at").alias("built_at")).agg(F.count(F.lit(1)).alias("outcomes_new"))
    per = live.select("symbol", F.col("timestamp").alias("tail"), run_clock(F.col("timestamp"), F.col("symbol")).alias("built_at"))
    per = per.join(written, ["symbol", "built_at"], "left").fillna(0, ["outcomes_new"])
    doy = day_of_year(F.col("tail"))
    per = per.withColumn("artifacts_new", F.when(doy % 41 == 3, 5).otherwise(4))
    runs = per.groupBy("tail").agg(
        F.collect_list(F.struct("symbol", "built_at", "artifacts_new", "outcomes_new")).alias("_s")
    )

    def entry(name):
        return F.try_element_at(F.filter("_s", lambda x: x["symbol"] == name), F.lit(1))

    symbols = F.array(
        *[
            F.struct(
                F.lit(s).alias("symbol"),
                F.when(entry(s).isNotNull(), "ok").otherwise("no_settled_bar").alias("status"),
                entry(s)["built_at"].alias("built_at"),
                F.when(entry(s).isNotNull(), F.col("tail")).alias("tail"),
                entry(s)["artifacts_new"].cast("int").alias("artifacts_new"),
                entry(s)["outcomes_new"].cast("int").alias("outcomes_new"),
                F.array().cast("array<timestamp>").alias("missed_tails"),
            )
            for s in SYMBOLS
        ]
    )
    day_number = F.datediff(times.new_york(F.col("tail")), F.lit("1995-12-01"))
    start_at = times.plus_seconds(run_clock(F.col("tail"), F.lit("A")), -600)
    base = runs.withColumns(
        {
            "run_id": F.concat(F.lit("run-"), day_number.cast("string")), "started_at": start_at,
            "collection_fingerprint": F.lit("c1"), "policy_fingerprint": F.lit("p1"),
            "activated_at": F.lit(ACTIVATED).cast("timestamp"),
            "collector_commit": F.when(day_of_year(F.col("tail")) % 97 == 5, OTHER_COMMIT).otherwise(COMMIT),
            "universe": F.array(*[F.lit(s) for s in SYMBOLS]),
        }
    )
    shared = ["run_id", "started_at", "collection_fingerprint", "policy_fingerprint", "activated_at", "collector_commit", "universe"]
    none = F.array().cast("array<struct<symbol:string,status:string,built_at:timestamp,tail:timestamp,artifacts_new:int,outcomes_new:int,missed_tails:array<timestamp>>>")
    starts = base.select(
        (day_number * 2).cast("long").alias("position"), F.lit("start").alias("record_type"), *shared,
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("run_status"), none.alias("symbols"),
    )
    records_ = base.filter(day_of_year(F.col("tail")) % 37 != 0).select(
        (day_number * 2 + 1).cast("long").alias("position"), F.lit("record").alias("record_type"), *shared,
        times.plus_seconds(F.col("started_at"), 1200).alias("finished_at"), F.lit("completed").alias("run_status"),
        symbols.alias("symbols"),
    )
    return materialize(starts.unionByName(records_), "run-log")


def landed(spark, log):
    """The log as its writer leaves it, one appended file of tagged JSON lines, and read back."""
    path = folder(spark, "run-log")
    lines = log.repartition(1).sortWithinPartitions("position").drop("position")
    lines.select(F.to_json(F.struct(*lines.columns)).alias("value")).write.text(path)
    back, corrupt = rc.read_run_log(spark, path)
    require_empty(corrupt, "corrupt run log")
    return back


def audited(spark, sf):
    bars, claims, records = ledger(spark, sf)
    doy = day_of_year(F.col("timestamp"))
    line = F.xxhash64("artifact_key")
    marked = claims.withColumns(
        {
            "recorded_at": F.when(doy % 50 == 7, F.expr("recorded_at + INTERVAL 10 HOURS")).otherwise(F.col("recorded_at")),
            "source": F.when((doy % 61 == 5) & (F.col("symbol") == "N"), F.lit("other")).otherwise(F.col("source")),
            "partition_symbol": F.col("symbol"), "line": line,
        }
    )
    outs = records.withColumns({"partition_symbol": F.col("symbol"), "line": F.xxhash64("outcome_key")})
    return (*pv.reconcile(marked, outs, landed(spark, run_log(bars, records)), AUDIT), claims, records)


AUDITED = f"""mc AS MATERIALIZED (SELECT symbol, ts, kind, coalesce(hypothesis_id, '') AS hy, state, {doy_sql('ts')} AS doy,
    CASE WHEN {doy_sql('ts')} % 50 = 7 THEN recorded_at + INTERVAL 10 HOUR ELSE recorded_at END AS rec, recorded_at AS plan,
    {doy_sql('ts')} % 61 = 5 AND symbol = 'N' AS foreign_source FROM claims),
ok_runs AS (SELECT DISTINCT symbol, {run_clock_sql('ts')} AS built_at, ts AS tail, {doy_sql('ts')} AS doy FROM bars
  WHERE ts >= TIMESTAMP '{ACTIVATED}' AND {doy_sql('ts')} % 37 <> 0),
cv AS MATERIALIZED (SELECT mc.*, CASE WHEN r.symbol IS NOT NULL THEN 'matched'
    WHEN mc.doy % 37 = 0 AND mc.doy % 50 <> 7 AND NOT foreign_source THEN 'interrupted_run' ELSE 'unmatched_claim' END AS verdict
  FROM mc LEFT JOIN ok_runs r ON r.symbol = mc.symbol AND r.built_at = mc.rec AND r.tail = mc.ts),
ov AS MATERIALIZED (SELECT o.symbol, o.ts, o.horizon_bars, o.evaluated_at, cv.verdict AS claim_verdict,
    o.evaluated_at <= cv.rec AS broken, r.symbol IS NOT NULL AS has_run
  FROM records o JOIN cv ON cv.symbol = o.symbol AND cv.ts = o.ts AND cv.kind = o.kind AND cv.hy = coalesce(o.hypothesis_id, '')
  LEFT JOIN ok_runs r ON r.symbol = o.symbol AND r.built_at = o.evaluated_at),
counts AS (SELECT r.symbol, r.built_at, r.doy, (SELECT count(*) FROM cv WHERE cv.verdict = 'matched' AND cv.symbol = r.symbol AND cv.rec = r.built_at) AS n,
    (SELECT count(*) FROM ov WHERE NOT ov.broken AND ov.symbol = r.symbol AND ov.evaluated_at = r.built_at) AS m,
    (SELECT count(*) FROM records q WHERE q.symbol = r.symbol AND q.evaluated_at = r.built_at) AS expected FROM ok_runs r),
days AS (SELECT DISTINCT ts, {doy_sql('ts')} AS doy FROM bars WHERE ts >= TIMESTAMP '{ACTIVATED}')"""


@query(
    "provenance_reasons",
    TO_CLAIMS + ", " + AUDITED + """, found AS (
  SELECT verdict AS reason FROM cv WHERE verdict <> 'matched'
  UNION ALL SELECT 'unexpected_source' FROM cv WHERE foreign_source
  UNION ALL SELECT 'claim_outside_window' FROM cv WHERE doy % 50 = 7
  UNION ALL SELECT CASE WHEN broken THEN 'unmatched_outcome' ELSE 'interrupted_run' END FROM ov WHERE broken OR NOT has_run
  UNION ALL SELECT CASE WHEN n < (CASE WHEN doy % 41 = 3 THEN 5 ELSE 4 END) THEN 'missing_claimed_artifacts' END FROM counts
  UNION ALL SELECT CASE WHEN m < expected THEN 'missing_claimed_outcomes' END FROM counts
  UNION ALL SELECT 'collector_commit_mismatch' FROM days WHERE doy % 97 = 5
  UNION ALL SELECT 'collector_commit_mismatch' FROM days WHERE doy % 97 = 5 AND doy % 37 <> 0)
SELECT reason, count(*) AS findings FROM found WHERE reason IS NOT NULL GROUP BY reason""",
)
def provenance_reasons(spark, sf):
    return pv.reason_counts(audited(spark, sf)[0])


@query(
    "provenance_exclusions",
    TO_CLAIMS + ", " + AUDITED + """SELECT 'invalid' AS status, (SELECT count(*) FROM cv WHERE verdict = 'interrupted_run') AS excluded_claims,
  (SELECT count(*) FROM ov WHERE NOT broken AND (claim_verdict = 'interrupted_run' OR NOT has_run)) AS excluded_outcomes""",
)
def provenance_exclusions(spark, sf):
    findings, out_claims, out_outcomes, _, _ = audited(spark, sf)
    return (
        pv.verdict(findings).select("status")
        .crossJoin(out_claims.agg(F.count(F.lit(1)).alias("excluded_claims")))
        .crossJoin(out_outcomes.agg(F.count(F.lit(1)).alias("excluded_outcomes")))
    )


@query(
    "ledger_paths",
    """SELECT 'unexpected_partition' AS reason, 'ledger:' || path AS component FROM (
  SELECT DISTINCT l_returnflag || '/1d/raw/' || l_linestatus || '.jsonl' AS path FROM lineitem
  UNION SELECT DISTINCT l_returnflag || '/1d/raw' FROM lineitem UNION SELECT DISTINCT l_returnflag || '/1h' FROM lineitem)
WHERE path NOT IN ('A/1d/raw', 'N/1d/raw', 'R/1d/raw')""",
)
def ledger_paths(spark, sf):
    lines = table(spark, sf, "lineitem")
    odd = lines.select(F.concat("l_returnflag", F.lit("/1d/raw/"), "l_linestatus", F.lit(".jsonl")).alias("path"))
    good = lines.select(F.concat("l_returnflag", F.lit("/1d/raw")).alias("path"))
    wrong = lines.select(F.concat("l_returnflag", F.lit("/1h")).alias("path"))
    paths = odd.unionByName(good).unionByName(wrong).distinct()
    return pv.path_findings(paths, AUDIT).select("reason", "component")


@query(
    "ledger_health",
    TO_CLAIMS + f""", c AS (SELECT * FROM claims WHERE {doy_sql('ts')} % 46 <> 4), r AS (SELECT * FROM records WHERE {doy_sql('ts')} % 46 <> 4),
m AS (SELECT symbol, count(DISTINCT ts) AS missed_dates FROM bars b WHERE ts >= TIMESTAMP '{ACTIVATED}' AND {doy_sql('ts')} % 37 <> 0 AND {doy_sql('ts')} % 23 = 4
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.symbol = b.symbol AND c.ts = b.ts) GROUP BY symbol)
SELECT symbol, count(*) AS claims_total, count(DISTINCT ts) AS tails_registered,
  count(*) FILTER (WHERE state <> 'insufficient_data') AS claims_evaluable, count(*) FILTER (WHERE state = 'insufficient_data') AS claims_insufficient,
  {clock_sql('max(ts)')} AS last_tail, any_value(h1) AS matured_h1, any_value(h5) AS matured_h5, any_value(h20) AS matured_h20,
  3 * count(*) FILTER (WHERE state <> 'insufficient_data') - any_value(h1) - any_value(h5) - any_value(h20) AS pending, coalesce(any_value(missed_dates), 0) AS missed_dates
FROM c JOIN (SELECT symbol, count(*) FILTER (WHERE horizon_bars = 1) AS h1, count(*) FILTER (WHERE horizon_bars = 5) AS h5,
  count(*) FILTER (WHERE horizon_bars = 20) AS h20 FROM r GROUP BY symbol) USING (symbol) LEFT JOIN m USING (symbol) GROUP BY symbol""",
)
def ledger_health_rows(spark, sf):
    """Some tails are not claimed; the runs report these as missed and others that were claimed after all."""
    bars, claims, records = ledger(spark, sf)
    kept = claims.filter(day_of_year(F.col("timestamp")) % 46 != 4)
    reported = lambda s: s.withField("missed_tails", F.when(
        day_of_year(s["tail"]) % 23 == 4, F.array(s["tail"])).otherwise(s["missed_tails"]))
    runs = run_log(bars, records)
    runs = runs.withColumn("symbols", F.transform("symbols", reported))
    universe = spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")
    out = lg.ledger_health(kept, records.join(kept.select("artifact_key"), "artifact_key", "left_semi"), runs, universe, SPECS)
    return out.withColumn("last_tail", clock(F.col("last_tail")))


# ---- validation ---------------------------------------------------------------

DEFINITION = vl.ValidationDefinition(
    activated_at=ACTIVATED,
    primary_hypothesis=(TREND_ALIGNMENT.hypothesis_id, 1, TREND_ALIGNMENT.fingerprint),
    primary_state="bullish", primary_horizon=20, primary_symbols=("A", "N"), secondary_symbols=("R",),
    specs=((5, SPECS[1].fingerprint), (20, SPECS[2].fingerprint)),
    references=(("A", -0.5, 0.01), ("N", 0.5, -0.01)),
)


def validation_inputs(spark, sf):
    """Claims, outcomes, missed sessions and exclusions by day-of-year rules."""
    _, claims, records = ledger(spark, sf)
    doy = day_of_year(F.col("timestamp"))
    missed = claims.filter(doy % 23 == 4).select("symbol", "timestamp").distinct()
    kept = claims.filter(doy % 23 != 4)
    values = records.join(kept.select("artifact_key"), "artifact_key", "left_semi")
    out_claims = kept.filter(doy % 31 == 6).select("artifact_key")
    out_outcomes = values.join(out_claims, "artifact_key", "left_semi").select("outcome_key")
    return kept, values, missed, out_claims, out_outcomes


VALIDATED = f"""vc AS MATERIALIZED (SELECT *, {doy_sql('ts')} AS doy FROM claims),
sessions AS (SELECT DISTINCT symbol, ts, doy % 23 = 4 AS is_missed FROM vc),
pop AS MATERIALIZED (SELECT symbol, ts, state FROM vc WHERE hypothesis_id = 'trend_alignment' AND doy % 23 <> 4 AND doy % 31 <> 6),
val AS MATERIALIZED (SELECT r.symbol, r.ts, r.horizon_bars, r.value FROM records r JOIN pop USING (symbol, ts)
  WHERE r.hypothesis_id = 'trend_alignment' AND r.horizon_bars IN (5, 20)),
cut AS MATERIALIZED (SELECT symbol, max(ts) AS cutoff, count(*) AS matured FROM val WHERE horizon_bars = 20 GROUP BY symbol),
pos AS MATERIALIZED (SELECT s.symbol, s.ts, h.h AS horizon_bars, p.state, v.value FROM sessions s JOIN cut c ON c.symbol = s.symbol AND s.ts <= c.cutoff
  CROSS JOIN (SELECT unnest([5, 20]) AS h) h LEFT JOIN pop p ON p.symbol = s.symbol AND p.ts = s.ts
  LEFT JOIN val v ON v.symbol = s.symbol AND v.ts = s.ts AND v.horizon_bars = h.h)"""
TO_VALIDATED = TO_CLAIMS + ", " + VALIDATED


@query(
    "stop_rule",
    TO_VALIDATED + f"""SELECT {clock_sql("(SELECT max(ts) + INTERVAL 1 DAY FROM vc WHERE doy % 23 <> 4 AND doy % 31 <> 6)")} AS evidence_through,
  (SELECT min(matured) FROM cut WHERE symbol IN ('A', 'N')) AS least_matured, (SELECT min(matured) >= 750 FROM cut WHERE symbol IN ('A', 'N')) AS e2_met,
  '2000-01-01 00:00:00' AS e1_due, '2002-01-01 00:00:00' AS forced_due,
  (SELECT max(ts) + INTERVAL 1 DAY FROM vc WHERE doy % 23 <> 4 AND doy % 31 <> 6) >= TIMESTAMP '2000-01-01' AS e1_met,
  (SELECT max(ts) + INTERVAL 1 DAY FROM vc WHERE doy % 23 <> 4 AND doy % 31 <> 6) >= TIMESTAMP '2002-01-01' AS f_met""",
)
def stop_rule_row(spark, sf):
    claims, outcomes, _, out_c, out_o = validation_inputs(spark, sf)
    out = vl.stop_rule(claims, outcomes, out_c, out_o, DEFINITION)
    return out.select(
        clock(F.col("evidence_through")).alias("evidence_through"), "least_matured", "e2_met",
        clock(F.col("e1_due")).alias("e1_due"), clock(F.col("forced_due")).alias("forced_due"), "e1_met", "f_met",
    )


@query("matured_claims", TO_VALIDATED + f"SELECT symbol, matured, {clock_sql('cutoff')} AS cutoff FROM cut")
def matured_claims(spark, sf):
    claims, outcomes, _, out_c, out_o = validation_inputs(spark, sf)
    out = vl.matured(claims, outcomes, out_c, out_o, DEFINITION)
    return out.select("symbol", "matured", clock(F.col("cutoff")).alias("cutoff"))


def cell_sql(keys: str, where: str = "") -> str:
    return f"""flags AS (SELECT *, CASE WHEN value IS NOT NULL THEN state END AS s, lag(CASE WHEN value IS NOT NULL THEN state END) OVER (PARTITION BY {keys} ORDER BY ts) AS ps FROM spine),
cell AS (SELECT {keys}, count(*) FILTER (WHERE s = '{{st}}' AND ps IS DISTINCT FROM '{{st}}') AS episode_count, count(*) FILTER (WHERE s IS NOT NULL AND ps IS NULL) AS matched_episode_count,
  count(value) FILTER (WHERE s = '{{st}}') AS sample_count, avg(value) FILTER (WHERE s = '{{st}}') AS mean, median(value) FILTER (WHERE s = '{{st}}') AS med,
  count(value) AS matched_count, avg(value) AS m_mean, median(value) AS m_med FROM flags GROUP BY {keys})"""


RELATION = lambda v, r: f"CASE WHEN {v} IS NULL OR {v} = 0 THEN 'z' WHEN ({v} > 0) = ({r} > 0) THEN 's' ELSE 'o' END"


@query(
    "primary_validation",
    TO_VALIDATED + ", spine AS (SELECT * FROM pos WHERE horizon_bars = 20 AND symbol IN ('A', 'N')), " + cell_sql("symbol").replace("{st}", "bullish") + f""",
ref AS (SELECT * FROM (VALUES ('A', -0.5, 0.01), ('N', 0.5, -0.01)) AS t(symbol, rm, rd)),
res AS (SELECT *, mean - m_mean AS md, med - m_med AS dd FROM cell JOIN ref USING (symbol))
SELECT symbol, sample_count, episode_count, matched_count, matched_episode_count, {rounded_sql('md')} AS mean_delta, {rounded_sql('dd')} AS median_delta,
  episode_count >= 8 AS adequate, true AS valid, CASE WHEN episode_count < 8 THEN 'inconclusive_insufficient_sample'
    WHEN {RELATION('md', 'rm')} = 's' AND {RELATION('dd', 'rd')} = 's' THEN 'directionally_consistent'
    WHEN {RELATION('md', 'rm')} = 'o' AND {RELATION('dd', 'rd')} = 'o' THEN 'directionally_reversed' ELSE 'mixed' END AS category,
  {rounded_sql('abs(md) / abs(rm)')} AS mean_ratio, {rounded_sql('abs(dd) / abs(rd)')} AS median_ratio FROM res""",
)
def primary_validation(spark, sf):
    claims, outcomes, missed, out_c, out_o = validation_inputs(spark, sf)
    rows = materialize(vl.positions(claims, outcomes, missed, out_c, out_o, DEFINITION), "positions")
    out = vl.primary_results(rows, DEFINITION)
    return out.select(
        "symbol", "sample_count", "episode_count", "matched_count", "matched_episode_count",
        rounded(F.col("mean_delta")).alias("mean_delta"), rounded(F.col("median_delta")).alias("median_delta"),
        "adequate", "valid", "category", rounded(F.col("abs_mean_delta_ratio")).alias("mean_ratio"),
        rounded(F.col("abs_median_delta_ratio")).alias("median_ratio"),
    )


@query(
    "validation_by_year",
    TO_VALIDATED + ", spine AS (SELECT *, CAST(year(ts) AS INT) AS year FROM pos WHERE horizon_bars = 20), "
    + cell_sql("symbol, year").replace("{st}", "bearish")
    + f"""SELECT symbol, year, sample_count, episode_count, matched_count, matched_episode_count,
  {rounded_sql('mean - m_mean')} AS mean_delta, {rounded_sql('med - m_med')} AS median_delta FROM cell""",
)
def validation_by_year(spark, sf):
    claims, outcomes, missed, out_c, out_o = validation_inputs(spark, sf)
    rows = materialize(vl.positions(claims, outcomes, missed, out_c, out_o, DEFINITION), "positions")
    out = vl.cells(vl.by_year(rows), ["bearish"], keys=("symbol", "year"))
    return out.select(
        "symbol", "year", "sample_count", "episode_count", "matched_count", "matched_episode_count",
        rounded(F.col("mean_delta")).alias("mean_delta"), rounded(F.col("median_delta")).alias("median_delta"),
    )


@query(
    "validation_episode_starts",
    TO_VALIDATED + f""", flags AS (SELECT *, CASE WHEN value IS NOT NULL THEN state END AS s,
    lag(CASE WHEN value IS NOT NULL THEN state END) OVER (PARTITION BY symbol, horizon_bars ORDER BY ts) AS ps FROM pos)
SELECT symbol, CAST(horizon_bars AS INT) AS horizon_bars, s AS state, count(*) AS sample_count, {rounded_sql('avg(value)')} AS mean,
  {rounded_sql('median(value)')} AS median FROM flags WHERE s IN ('bullish', 'bearish') AND s IS DISTINCT FROM ps GROUP BY ALL""",
)
def validation_episode_starts(spark, sf):
    claims, outcomes, missed, out_c, out_o = validation_inputs(spark, sf)
    rows = materialize(vl.positions(claims, outcomes, missed, out_c, out_o, DEFINITION, horizons=[5, 20]), "positions")
    out = vl.episode_start_stats(rows, ["bullish", "bearish"])
    return out.select(
        "symbol", "horizon_bars", "state", "sample_count", rounded(F.col("mean_forward_return")).alias("mean"),
        rounded(F.col("median_forward_return")).alias("median"),
    )


@query(
    "validation_coverage",
    TO_VALIDATED + """, t AS (SELECT v.*, ts <= cutoff AS early, doy % 31 = 6 AS out FROM vc v JOIN cut USING (symbol)
    WHERE hypothesis_id = 'trend_alignment' AND doy % 23 <> 4),
m AS (SELECT symbol, ts FROM val WHERE horizon_bars = 20)
SELECT t.symbol, CAST(0 AS BIGINT) AS claims_reserved, count(*) FILTER (WHERE out AND early) AS claims_excluded,
  count(*) FILTER (WHERE NOT out AND early) AS claims_in_population, count(*) FILTER (WHERE NOT out AND early AND state = 'insufficient_data') AS claims_insufficient_history,
  count(m.ts) FILTER (WHERE NOT out AND early) AS claims_matured,
  (SELECT count(*) FROM sessions s JOIN cut c USING (symbol) WHERE s.symbol = t.symbol AND is_missed AND s.ts <= c.cutoff) AS missed_sessions,
  count(*) FILTER (WHERE NOT out AND early) - count(m.ts) FILTER (WHERE NOT out AND early) - count(*) FILTER (WHERE NOT out AND early AND state = 'insufficient_data') AS claims_unmatured
FROM t LEFT JOIN m USING (symbol, ts) GROUP BY t.symbol""",
)
def validation_coverage(spark, sf):
    return vl.coverage_accounting(*validation_inputs(spark, sf), DEFINITION)


@query(
    "collection_status",
    f"""WITH {NY_BARS}, c AS (SELECT symbol, ts AS tail, {run_clock_sql('ts')} AS built_at, {doy_sql('ts')} AS doy,
    row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bars, dayofweek({to_local_sql('ts')}) AS dow FROM bars),
a AS (SELECT *, CASE WHEN doy % 11 = 0 THEN built_at + INTERVAL 12 HOUR WHEN doy % 13 = 0 THEN built_at + INTERVAL 3 DAY ELSE built_at END AS clock,
    CASE WHEN doy % 17 = 0 THEN 4 ELSE 0 END AS held FROM c),
s AS (SELECT *, date_trunc('day', {to_local_sql('tail')}) AS td, date_trunc('day', {to_local_sql('clock')}) AS rd,
    hour({to_local_sql('clock')}) * 60 + minute({to_local_sql('clock')}) AS lm FROM a)
SELECT symbol, CASE WHEN lm < 30 OR lm >= 540 THEN 'outside_collection_window' WHEN doy % 19 = 0 THEN 'config_mismatch'
    WHEN tail + INTERVAL 1 DAY <= TIMESTAMP '{ACTIVATED}' THEN 'pre_activation'
    WHEN held < 4 AND NOT (td < rd AND rd <= td + CASE dow WHEN 5 THEN INTERVAL 3 DAY WHEN 6 THEN INTERVAL 2 DAY ELSE INTERVAL 1 DAY END) THEN 'stale_tail'
    WHEN bars < 51 THEN 'insufficient_history' WHEN held = 4 THEN 'duplicate_already_exists' ELSE 'ok' END AS status, count(*) AS attempts
FROM s GROUP BY ALL""",
)
def collection_status_rows(spark, sf):
    bars = new_york_bars(spark, sf)
    from barloom.operators.layout import arrange

    numbered = arrange(bars).own().df
    doy = day_of_year(F.col("timestamp"))
    clock_at = run_clock(F.col("timestamp"), F.col("symbol"))
    attempts = numbered.select(
        "symbol", "basis", "interval", F.col("_rn").alias("bars"), F.col("timestamp").alias("tail"),
        F.when(doy % 19 == 0, "elsewhere").otherwise(F.col("source")).alias("provider"),
        F.when(doy % 11 == 0, times.plus_seconds(clock_at, 43200)).when(doy % 13 == 0, times.plus_seconds(clock_at, 259200)).otherwise(clock_at).alias("built_at"),
        F.when(times.is_new_york_midnight(F.col("timestamp")), 0).otherwise(1).alias("off_convention"),
        F.when(doy % 17 == 0, 4).otherwise(0).alias("tail_claims"),
        F.when(doy % 17 == 0, 0).otherwise(4).alias("new_claims"),
    )
    out = vl.collection_status(attempts, "lineitem", "raw", "1d", F.lit(ACTIVATED).cast("timestamp"))
    return out.groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("attempts"))


@query(
    "run_status_histogram",
    f"""WITH {NY_BARS}, d AS (SELECT DISTINCT ts FROM bars WHERE ts >= TIMESTAMP '{ACTIVATED}' AND {doy_sql('ts')} % 37 <> 0)
SELECT CASE WHEN b.ts IS NULL THEN 'no_settled_bar' ELSE 'ok' END AS status, count(*) AS symbol_runs
FROM d CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS symbol) s LEFT JOIN bars b ON b.ts = d.ts AND b.symbol = s.symbol GROUP BY 1""",
)
def run_status_histogram(spark, sf):
    bars, _, records = ledger(spark, sf)
    return lg.status_histogram(landed(spark, run_log(bars, records)).filter("record_type = 'record'"))


@query(
    "orphan_runs",
    f"""WITH r AS (SELECT c_custkey AS position, TIMESTAMP '2024-01-10 05:00:00' + c_custkey * INTERVAL 40 SECOND AS started_at,
    CASE WHEN c_custkey % 10 <> 0 THEN TIMESTAMP '2024-01-10 05:00:00' + (c_custkey * 40 + 55) * INTERVAL 1 SECOND END AS window_end FROM customer),
e AS (SELECT event_id, TIMESTAMP '2024-01-10 05:00:00' + (event_id * 7 % 70000) * INTERVAL 1 SECOND AS t FROM events),
m AS (SELECT event_id, max(position) AS position FROM e JOIN r ON started_at - INTERVAL {pv.BACKWARD_SECONDS} SECOND <= t AND (window_end IS NULL OR t < window_end)
    AND t <= started_at + INTERVAL {pv.MAX_SPAN_SECONDS} SECOND AND CAST(t - INTERVAL 5 HOUR AS DATE) = CAST(started_at - INTERVAL 5 HOUR AS DATE) GROUP BY event_id)
SELECT 'r' || position AS orphan_run, count(*) AS loose_rows FROM m GROUP BY position""",
)
def orphan_runs(spark, sf):
    """A crowded day: every event is a loose row, every customer an interrupted run, one in ten without an end."""
    def seconds_after(moment, n):
        return F.timestamp_seconds(F.unix_timestamp(moment) + n)

    day = F.lit("2024-01-10 05:00:00").cast("timestamp")
    start = seconds_after(day, F.col("c_custkey") * 40)
    runs = table(spark, sf, "customer").select(
        F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("run_id"), F.col("c_custkey").alias("position"), start.alias("started_at"),
        F.when(F.col("c_custkey") % 10 != 0, seconds_after(start, F.lit(55))).alias("window_end"), times.new_york_date(start).alias("run_day"))
    loose = table(spark, sf, "events").select("event_id", seconds_after(day, F.col("event_id") * 7 % 70000).alias("t"))
    return pv.interrupted_for(loose, "t", "event_id", runs).groupBy("orphan_run").agg(F.count(F.lit(1)).alias("loose_rows"))
