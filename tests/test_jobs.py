"""Streaming jobs, ledger and provenance on small fixtures."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.operators import ledger as lg
from barloom.operators import provenance as pv
from barloom.operators.hypotheses import TREND_ALIGNMENT, observe
from barloom.operators.outcomes import SPECS
from barloom.sources.store import Store
from barloom.streaming.jobs import ingest_bars, ingest_feed, register_claims
from tests.conftest import bars_frame, walk_bars

REASONS = "symbol string, interval string, source string, basis string, timestamp timestamp, reason string"
NEW_YORK_MIDNIGHT = datetime(2024, 1, 1, 5)


def new_york_bars(n):
    return [(*r[:4], NEW_YORK_MIDNIGHT + timedelta(days=i), *r[5:]) for i, r in enumerate(walk_bars(n))]


def test_replayed_batches_change_nothing(spark, tmp_path):
    landing, check = str(tmp_path / "landing"), str(tmp_path / "check")
    rows = walk_bars(20)
    bars_frame(spark, rows[:12]).coalesce(1).write.mode("append").parquet(landing)
    schema = bars_frame(spark, rows[:1]).schema
    store = Store(spark, str(tmp_path / "store")).define(bars=schema, refused=REASONS, pending=schema)

    def run(folder, day=15):
        now = F.lit(f"2020-01-{day} 12:00:00").cast("timestamp")
        stream = spark.readStream.schema(bars_frame(spark, rows[:1]).schema).parquet(landing)
        ingest_bars(stream, store, now, folder).awaitTermination()

    run(check)
    assert store.read("bars").count() == 12 and store.read("pending").count() == 0
    changed = (*rows[11][:9], rows[11][9] + 1)
    bars_frame(spark, rows[10:11] + [changed] + rows[12:]).coalesce(1).write.mode("append").parquet(landing)
    run(check)
    # bars after "now" are not settled yet
    assert store.read("bars").count() == 14 and store.read("pending").count() == 6
    assert [r.reason for r in store.read("refused").collect()] == ["conflict"]
    # a fresh checkpoint replays everything and adds nothing
    run(str(tmp_path / "other"))
    assert store.read("bars").count() == 14 == store.read("bars").dropDuplicates(["symbol", "timestamp"]).count()
    # the clock moves on: what waited is stored with the next batch, whatever that holds
    bars_frame(spark, rows[:1]).coalesce(1).write.mode("append").parquet(landing)
    run(check, day=31)
    assert store.read("pending").count() == 0
    assert store.read("bars").count() == 20 == store.read("bars").dropDuplicates(["symbol", "timestamp"]).count()
    assert len(store.read("refused").select("timestamp").distinct().collect()) == 1


def claims_for(spark, bars, hours=27.5):
    recorded = F.timestamp_seconds(F.unix_timestamp("timestamp") + int(hours * 3600))
    return lg.claims_from_observations(observe(bars, (TREND_ALIGNMENT,)), bars, recorded)


def test_late_claims_go_to_the_side(spark, tmp_path):
    bars = bars_frame(spark, new_york_bars(60))
    claims = claims_for(spark, bars)
    late = claims.withColumn("recorded_at", F.when(F.col("timestamp") < "2024-01-06", F.expr("recorded_at + INTERVAL 9 DAYS")).otherwise(F.col("recorded_at")))
    late.coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store")).define(claims=claims.schema, refused="artifact_key string, reason string")
    stream = spark.readStream.schema(claims.schema).parquet(str(tmp_path / "in"))
    register_claims(stream, store, str(tmp_path / "check")).awaitTermination()
    assert store.read("claims").count() == 55 and store.read("refused").filter("reason = 'late_claim'").count() == 5
    # the same claims again, and one that now says something else
    again = lg.register(claims.withColumn("state", F.when(F.col("timestamp") == F.lit(NEW_YORK_MIDNIGHT + timedelta(days=59)), "odd").otherwise(F.col("state"))), store.read("claims"))
    counts = {r.status: r["count"] for r in again.groupBy("status").count().collect()}
    assert counts == {"duplicate": 54, "conflict": 1, "written": 5}


def test_tracking_and_integrity(spark):
    rows = new_york_bars(60)
    bars = bars_frame(spark, rows)
    claims = claims_for(spark, bars).cache()
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    outcomes = lg.new_outcomes(lg.track(claims, bars, SPECS, None, now)).cache()
    assert outcomes.count() == (11 - 1) + (11 - 5)
    assert lg.outcome_issues(outcomes, claims).count() == 0 and lg.claim_issues(claims).count() == 0
    revised = bars_frame(spark, [(*r[:9], r[9] + (1 if i == 55 else 0)) for i, r in enumerate(rows)])
    got = {r.status: r["count"] for r in lg.track(claims, revised, SPECS, outcomes, now).groupBy("status").count().collect()}
    assert got["present"] == 16 and got["ineligible"] == 49 * 3
    assert got["refused"] == 2 and got["pending"] == 33 - 16 - 2
    moved = lg.track(claims, bars.withColumn("source", F.lit("other")), SPECS, None, now)
    assert {r.refusal for r in moved.filter("status = 'refused'").collect()} == {"source_mismatch"}
    # a revision inside the horizon changes what was consumed, one outside does not
    keyed = lambda df: {(r.outcome_key): r.consumed_bars_fingerprint for r in lg.new_outcomes(lg.track(claims, df, SPECS, None, now)).collect()}
    before, after = keyed(bars), keyed(revised)
    assert any(before[k] != after[k] for k in after) and any(before[k] == after[k] for k in after)
    health = lg.ledger_coverage(claims, outcomes, SPECS)
    assert health.agg(F.sum("artifacts_completed")).first()[0] == 16


ACTIVE = "2024-01-01 00:00:00"
POLICY = pv.ProvenancePolicy(
    ("AAA",), ACTIVE, "c", "p", "x" * 40, (("observation", TREND_ALIGNMENT.hypothesis_id, "1", TREND_ALIGNMENT.fingerprint),),
    tuple((s.fingerprint, s.horizon_bars) for s in SPECS), provider="test", claims_per_tail=1,
)


def run_rows(days, interrupted=(), **odd):
    out = []
    for d in days:
        tail = NEW_YORK_MIDNIGHT + timedelta(days=d)
        clock = tail + timedelta(hours=27.5)
        begun = clock - timedelta(minutes=5)
        base = (f"r{d}", begun, None, None, "c", "p", datetime(2024, 1, 1), odd.get("commit", {}).get(d, "x" * 40), ["AAA"])
        out.append((2 * d, "start", *base, []))
        if d not in interrupted:
            new = odd.get("new", {}).get(d, 1)
            done = (base[0], begun, clock, "completed", *base[4:])
            out.append((2 * d + 1, "record", *done, [("AAA", "ok", clock, tail, new, 0, [])]))
    return out


def audit(spark, claims, log):
    frame = spark.createDataFrame(log, pv.RUN_LOG)
    marked = claims.withColumns({"partition_symbol": F.lit("AAA"), "line": F.monotonically_increasing_id()})
    none = spark.createDataFrame(
        [], "outcome_key string, artifact_key string, symbol string, spec_fingerprint string, horizon_bars int, evaluation_version int, evaluated_at timestamp, partition_symbol string, line long"
    )
    findings, excluded, _ = pv.reconcile(marked, none, frame, POLICY)
    rows = findings.cache()
    return {r.reason: r.findings for r in pv.reason_counts(rows).collect()}, excluded.count(), pv.verdict(rows).first().status


def test_provenance_cases(spark):
    bars = bars_frame(spark, new_york_bars(12))
    claims = claims_for(spark, bars).cache()
    days = range(12)
    assert audit(spark, claims, run_rows(days, interrupted=(3, 4))) == ({"interrupted_run": 2}, 2, "degraded")
    # a completed record that pairs with no start leaves its claim unmatched
    log = [r for r in run_rows(days, new={5: 2, 6: 0}, commit={7: "y" * 40}) if r[0] != 4]
    reasons, _, status = audit(spark, claims, log)
    assert status == "invalid"
    assert reasons == {
        "missing_claimed_artifacts": 1, "artifact_count_mismatch": 1, "collector_commit_mismatch": 2,
        "run_record_inconsistent": 1, "unmatched_claim": 1,
    }


def test_feed_counts_are_stored_with_the_entries(spark, tmp_path):
    schema = "feed_id string, feed_item_id string, rejected string"
    store = Store(spark, str(tmp_path / "store")).define(entries=schema, counts="feed_id string, seen bigint, kept bigint, rejected bigint")
    for k, rows in enumerate([[("f", "a", None), ("f", "b", "no_title"), ("g", "c", None)], [("f", "d", "no_link")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_feed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "check")).awaitTermination()
    totals = store.read("counts").groupBy("feed_id").agg(*[F.sum(x).alias(x) for x in ("seen", "kept", "rejected")])
    assert sorted(map(tuple, totals.collect())) == [("f", 3, 1, 2), ("g", 1, 1, 0)] and store.read("entries").count() == 2


def test_a_batch_opens_the_files_of_its_buckets_only(spark, tmp_path, monkeypatch):
    """Twelve symbols are stored; a batch of one symbol reads one bucket, and a replayed batch nothing."""
    symbols = tuple(f"S{k}" for k in range(12))
    schema = bars_frame(spark, walk_bars(1)).schema
    store = Store(spark, str(tmp_path / "store")).define(bars=schema, refused=REASONS, pending=schema)
    landing, now = str(tmp_path / "in"), F.lit("2021-01-01 00:00:00").cast("timestamp")
    opened, plain = [], Store.read

    def read(self, table, groups=None):
        opened.append((table, len(self.folders(table, groups))))
        return plain(self, table, groups)

    monkeypatch.setattr(Store, "read", read)

    def run(rows):
        opened.clear()
        if rows:
            bars_frame(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        ingest_bars(spark.readStream.schema(schema).parquet(landing), store, now, str(tmp_path / "check")).awaitTermination()
        return [n for table, n in opened if table == "bars"]

    assert run(walk_bars(4, symbols)) == [0]
    stored = len(store.folders("bars"))
    assert run(walk_bars(6, ("S3",))[4:]) == [1] and stored > 6
    query = next(iter(store.manifest()["batches"]))
    assert store.applied(query, 1) and not store.applied(query, 2)
    assert plain(store, "bars").count() == 50
