"""Catalogue: the incremental jobs, run to completion over landed slices of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.ledger import new_outcomes, track
from barloom.operators.outcomes import SPECS
from barloom.plans.fixtures import DAILY_SQL, bars_daily, folder, table
from barloom.plans.queries_documents import ITEM, JUDGED_SQL, document_versions
from barloom.plans.queries_ledger import TO_CLAIMS, doy_sql, day_of_year, ledger_claims, new_york_bars
from barloom.plans.registry import query
from barloom.session import materialize
from barloom.sources.store import Store
from barloom.streaming import jobs


def in_slices(spark, df, slice_column, slices: int, start) -> None:
    """Land the slices one after the other and run the job after each.

    ``start(stream, checkpoint)`` starts the job; every run but the first resumes
    from the checkpoint.
    """
    path, checkpoint = folder(spark, "landing"), folder(spark, "stream")
    held = materialize(df.withColumn("_slice", slice_column), "slices")
    rows = held.drop("_slice")
    for k in range(slices):
        held.filter(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(path)
        start(spark.readStream.schema(rows.schema).parquet(path), checkpoint).awaitTermination()


def store_of(spark, **schemas):
    return Store(spark, folder(spark, "store")).define(**schemas)


REASONS = "symbol string, interval string, source string, basis string, timestamp timestamp, reason string"


@query(
    "streamed_bars",
    f"""WITH {DAILY_SQL}, s AS (SELECT symbol, ts, dayofyear(ts) AS d FROM bars WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2001-06-01')
SELECT symbol, 'stored' AS result, count(*) AS bars FROM s WHERE d % 50 <> 1 GROUP BY symbol
UNION ALL SELECT symbol, 'negative_volume', count(*) FROM s WHERE d % 50 = 1 GROUP BY symbol
UNION ALL SELECT symbol, 'conflict', count(*) FROM s WHERE d % 50 = 2 AND ts + INTERVAL 1 DAY <= TIMESTAMP '1999-06-01' GROUP BY symbol""",
)
def streamed_bars(spark, sf):
    """Slices read by a clock that moves on, a late one that repeats some bars and changes others.

    Bars that have not ended wait; a change to a waiting bar takes its place, one
    to a stored bar is a conflict.
    """
    bars = materialize(bars_daily(spark, sf), "bars")
    doy = F.dayofyear("timestamp")
    first = bars.withColumn("volume", F.when(doy % 50 == 1, -F.col("volume")).otherwise(F.col("volume")))
    again = bars.filter((doy % 50 == 2) | (doy % 50 == 3)).withColumn(
        "volume", F.when(doy % 50 == 2, F.col("volume") + 1).otherwise(F.col("volume"))
    )
    sliced = first.withColumn("k", F.when(F.year("timestamp") < 1998, 0).otherwise(1)).unionByName(again.withColumn("k", F.lit(2)))
    store = store_of(spark, bars=bars.schema, refused=REASONS, pending=bars.schema)
    clocks = iter([F.lit(f"{day} 00:00:00").cast("timestamp") for day in ("1995-01-01", "1999-06-01", "2001-06-01")])
    in_slices(spark, sliced, F.col("k"), 3, lambda s, c: jobs.ingest_bars(s.drop("k"), store, next(clocks), c))
    kept = store.read("bars").select("symbol", F.lit("stored").alias("result"))
    side = store.read("refused").select("symbol", F.col("reason").alias("result"))
    return kept.unionByName(side).groupBy("symbol", "result").agg(F.count(F.lit(1)).alias("bars"))


@query(
    "streamed_revisions",
    "WITH " + JUDGED_SQL + """ SELECT item AS source_item_id, count(*) AS stored, max(revision) AS last_revision FROM judged
WHERE outcome IN ('accepted', 'revision') GROUP BY item""",
)
def streamed_revisions(spark, sf):
    rows = document_versions(spark, sf)
    top = rows.agg(F.max("seq").alias("_top"))
    sliced = rows.crossJoin(F.broadcast(top)).withColumn("k", F.floor(F.col("seq") * 3 / (F.col("_top") + 1))).drop("_top")
    ledger_schema = rows.withColumn("revision", F.lit(1).cast("long")).schema
    counters = (
        "source string, fetched bigint, accepted bigint, duplicate bigint, errors bigint, rejected bigint, revision bigint"
    )
    store = store_of(spark, documents=ledger_schema, counters=counters)
    in_slices(spark, sliced, F.col("k"), 3, lambda s, c: jobs.ingest_documents(s.drop("k"), store, c, item=ITEM))
    return store.read("documents").groupBy("source_item_id").agg(
        F.count(F.lit(1)).alias("stored"), F.max("revision").cast("double").alias("last_revision")
    )


@query(
    "streamed_claims",
    TO_CLAIMS + f"""SELECT kind, CASE WHEN {doy_sql('ts')} % 40 = 5 THEN 'late_claim' ELSE 'registered' END AS result, count(*) AS claims FROM claims GROUP BY ALL""",
)
def streamed_claims(spark, sf):
    """Claims in two slices with repeats; some recorded far too late."""
    claims = ledger_claims(new_york_bars(spark, sf))
    late = day_of_year(F.col("timestamp")) % 40 == 5
    sent = claims.withColumn("recorded_at", F.when(late, F.expr("recorded_at + INTERVAL 9 DAYS")).otherwise(F.col("recorded_at")))
    k = F.when(F.col("timestamp") < F.lit("1999-01-01").cast("timestamp"), 0).otherwise(1)
    repeats = sent.filter(F.month("timestamp") == 3).withColumn("k", F.lit(1))
    both = sent.withColumn("k", k).unionByName(repeats)
    store = store_of(spark, claims=claims.schema, refused="artifact_key string, reason string")
    in_slices(spark, both, F.col("k"), 2, lambda s, c: jobs.register_claims(s.drop("k"), store, c))
    kept = store.read("claims").select("artifact_key", F.lit("registered").alias("result"))
    side = store.read("refused").select("artifact_key", F.col("reason").alias("result")).distinct()
    judged = kept.unionByName(side).join(claims.select("artifact_key", "kind"), "artifact_key")
    return judged.groupBy("kind", "result").agg(F.count(F.lit(1)).alias("claims"))


@query(
    "streamed_outcomes",
    TO_CLAIMS + "SELECT symbol, CAST(horizon_bars AS INT) AS horizon_bars, count(*) AS outcomes FROM records GROUP BY ALL",
)
def streamed_outcomes(spark, sf):
    """Outcomes that mature as three slices of bars arrive."""
    bars = new_york_bars(spark, sf)
    claims = ledger_claims(bars)
    year = F.year("timestamp")
    slices = F.when(year < 1998, 0).when(year < 2000, 1).otherwise(2)
    now = F.lit("2002-01-01 00:00:00").cast("timestamp")
    schema = new_outcomes(track(claims, bars, SPECS, None, now)).schema
    store = store_of(spark, bars=bars.schema, outcomes=schema, refused=REASONS)
    in_slices(spark, bars, slices, 3, lambda s, c: jobs.mature_outcomes(s, store, lambda: claims, SPECS, now, c))
    return store.read("outcomes").groupBy("symbol", "horizon_bars").agg(F.count(F.lit(1)).alias("outcomes"))


@query(
    "streamed_feed_counts",
    """WITH e AS (SELECT 'feed-' || page_id % 7 AS feed_id, page_id % 3 AS k, CASE WHEN page_id % 10 = 0 THEN 'no_title' WHEN url NOT LIKE 'https:%' THEN 'bad_url' END AS rejected FROM pages)
SELECT feed_id, count(*) AS seen, count(*) FILTER (WHERE rejected IS NULL) AS kept, count(rejected) AS rejected,
  count(*) FILTER (WHERE rejected IS NULL) AS stored, count(DISTINCT k) AS batches FROM e GROUP BY feed_id""",
)
def streamed_feed_counts(spark, sf):
    """What three batches counted per feed, read back from the store beside the entries they kept."""
    rejected = F.when(F.col("page_id") % 10 == 0, "no_title").when(~F.col("url").startswith("https:"), "bad_url")
    rows = table(spark, sf, "pages").select(
        F.concat(F.lit("feed-"), (F.col("page_id") % 7).cast("string")).alias("feed_id"), "page_id", rejected.alias("rejected"))
    store = store_of(spark, entries=rows.schema, counts="feed_id string, seen bigint, kept bigint, rejected bigint")
    in_slices(spark, rows, F.col("page_id") % 3, 3, lambda s, c: jobs.ingest_feed(s, store, c))
    counted = store.read("counts").groupBy("feed_id").agg(*[F.sum(x).alias(x) for x in ("seen", "kept", "rejected")], F.count(F.lit(1)).alias("batches"))
    return counted.join(store.read("entries").groupBy("feed_id").agg(F.count(F.lit(1)).alias("stored")), "feed_id", "left").select(
        "feed_id", "seen", "kept", "rejected", F.coalesce("stored", F.lit(0)).alias("stored"), "batches")
