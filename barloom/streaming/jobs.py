"""Incremental ingestion as Structured Streaming jobs.

Every job writes through ``foreachBatch`` into a ``Store``: ledgers, side tables
and waiting bars lie in hash buckets of their key, a micro-batch reads the
buckets that it touches and commits all its tables with one swap of the
manifest, which also names the batch. A replayed batch finds its own number
there and changes nothing; a fresh checkpoint is another query and compares
with what is stored. Rows that are refused go to a side table with a reason;
nothing is dropped silently. Each store has one writing job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.definitions import OutcomeSpec
from barloom.functions.times import is_current_tail
from barloom.operators import documents as dc
from barloom.operators import ledger as lg
from barloom.operators.adjust import merge_bars
from barloom.operators.quality import row_issues, settled_only
from barloom.schemas import BAR_FIELDS, SERIES_KEY
from barloom.sources.store import GROUP, Change, Store, bucket

BAR_KEY = (*SERIES_KEY, "timestamp")
#: hash buckets of a job's key
BUCKETS = 64


def keyed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with the group of their key."""
    return rows.withColumn(GROUP, bucket(BUCKETS, *keys))


def touched(rows: DataFrame) -> list[str]:
    """Groups of some rows, ``BUCKETS`` at most."""
    return [r[0] for r in rows.select(GROUP).distinct().collect()]


def run(stream: DataFrame, store: Store, checkpoint: str, each: Callable[[DataFrame], list[Change]], name: str) -> StreamingQuery:
    """Process everything available, one micro-batch at a time.

    ``each`` returns a batch's changes, which are committed together. The query
    id lives in the checkpoint: a restart keeps it.
    """

    def once(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if store.applied(query, number):
            return
        batch.persist()
        try:
            store.commit(each(batch), (query, number))
        finally:
            batch.unpersist()

    return (
        stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(once).start()
    )


def within(held: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows in the batch's time span, so that the scan skips older files."""
    low, high = batch.agg(F.min("timestamp"), F.max("timestamp")).first()
    return held.filter(F.col("timestamp").between(F.lit(low), F.lit(high)))


def ingest_bars(stream: DataFrame, store: Store, now: Column, checkpoint: str) -> StreamingQuery:
    """Append settled, valid bars; unchanged bars are skipped, changed ones refused as conflicts.

    Bars that have not ended yet wait in ``pending`` and are looked at again with
    every batch; once stored or refused they leave it. A later version of a
    waiting bar takes its place, so that what is stored is the last one seen.
    """

    def each(batch: DataFrame) -> list[Change]:
        rows = batch.select(*BAR_KEY, *BAR_FIELDS)
        ended = settled_only(rows, now)
        waiting = store.read("pending").join(rows.select(*BAR_KEY).distinct(), list(BAR_KEY), "left_anti")
        due = settled_only(waiting, now)
        last = rows.exceptAll(ended).groupBy(*BAR_KEY).agg(F.max(F.struct(*BAR_FIELDS)).alias("b")).select(*BAR_KEY, "b.*")
        open_ = last.unionByName(waiting.exceptAll(due))
        settled = keyed(ended.unionByName(due), "symbol").withColumn("issues", row_issues())
        bad = settled.filter(F.size("issues") > 0).select(*BAR_KEY, F.array_join("issues", ",").alias("reason"), GROUP)
        good = settled.filter(F.size("issues") == 0).drop("issues")
        held = within(store.read("bars", touched(good)), good)
        near = held.join(good.select(*BAR_KEY).distinct(), list(BAR_KEY), "left_semi")
        merged, conflicts = merge_bars(near, good.drop(GROUP))
        new = merged.join(near.select(*BAR_KEY), list(BAR_KEY), "left_anti").select(*BAR_KEY, *BAR_FIELDS)
        refused = bad.unionByName(keyed(conflicts.select(*BAR_KEY, F.lit("conflict").alias("reason")), "symbol"))
        return [Change("bars", keyed(new, "symbol")), Change("refused", refused), Change("pending", keyed(open_, "symbol"), "*")]

    return run(stream, store, checkpoint, each, "ingest-bars")


def register_claims(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Register claims once; late and conflicting claims go to the side table.

    A claim is late when its bar is not the current tail at its recording time.
    Late claims are never back-filled.
    """

    def each(batch: DataFrame) -> list[Change]:
        current = is_current_tail(F.col("timestamp"), F.col("recorded_at"))
        held = within(store.read("claims", touched(keyed(batch, "symbol"))), batch)
        known = held.select("artifact_key")
        late = batch.filter(~current).join(known, "artifact_key", "left_anti")
        judged = lg.register(batch.join(late.select("artifact_key"), "artifact_key", "left_anti"), held)
        written = judged.filter(F.col("status") == "written").select(*held.columns)
        side = late.select("artifact_key", F.lit("late_claim").alias("reason")).unionByName(
            judged.filter(F.col("status") == "conflict").select("artifact_key", F.col("status").alias("reason"))
        )
        return [Change("claims", keyed(written, "symbol")), Change("refused", keyed(side.distinct(), "artifact_key"))]

    return run(stream, store, checkpoint, each, "register-claims")


def mature_outcomes(
    bar_stream: DataFrame, store: Store, claims: Callable[[], DataFrame], specs: Sequence[OutcomeSpec], now: Column, checkpoint: str,
) -> StreamingQuery:
    """Append outcomes whose horizon has settled; each at most once.

    ``bar_stream`` carries settled, validated bars; those not stored yet are
    appended to ``bars`` once, and bars that contradict a stored one or each
    other go to ``refused``. A claim can mature only with a new bar of its
    symbol, so only claims, bars and outcomes of the batch's buckets are read,
    and bars from the earliest open claim on.
    """

    def each(batch: DataFrame) -> list[Change]:
        groups = touched(keyed(batch, "symbol"))
        stored = store.read("bars", groups)
        near = within(stored, batch).join(batch.select(*BAR_KEY).distinct(), list(BAR_KEY), "left_semi")
        merged, conflicts = merge_bars(near, batch)
        new = merged.join(near.select(*BAR_KEY), list(BAR_KEY), "left_anti").select(*BAR_KEY, *BAR_FIELDS)
        held = store.read("outcomes", groups)
        done = held.groupBy("artifact_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= len(specs))
        pending = keyed(claims(), "symbol").filter(F.col(GROUP).isin(groups)).drop(GROUP).join(done.select("artifact_key"), "artifact_key", "left_anti")
        floors = pending.groupBy("symbol").agg(F.min("timestamp").alias("_from"))
        recent = stored.unionByName(new.select(*stored.columns)).join(floors, "symbol").filter(F.col("timestamp") >= F.col("_from")).drop("_from")
        tracked = lg.track(pending, recent, specs, held, now)
        return [
            Change("bars", keyed(new, "symbol")), Change("outcomes", keyed(lg.new_outcomes(tracked), "symbol")),
            Change("refused", keyed(conflicts.select(*BAR_KEY, F.lit("conflict").alias("reason")), "symbol")),
        ]

    return run(bar_stream, store, checkpoint, each, "mature-outcomes")


def ingest_documents(stream: DataFrame, store: Store, checkpoint: str, item: Sequence[str] = dc.ITEM) -> StreamingQuery:
    """Classify arriving versions against the stored ones of their buckets and append what is new."""

    def each(batch: DataFrame) -> list[Change]:
        held = store.read("documents", touched(keyed(batch, *item)))
        near = held.join(batch.select(*item).distinct(), list(item), "left_semi")
        judged = dc.classify_revisions(near, batch, item=item)
        new = dc.to_append(judged).select(*held.columns)
        counters = dc.ingestion_counters(judged).filter(F.col("source").isNotNull())
        return [Change("documents", keyed(new, *item)), Change("counters", keyed(counters, "source"))]

    return run(stream, store, checkpoint, each, "ingest-documents")


def ingest_feed(stream: DataFrame, store: Store, checkpoint: str, feed: str = "feed_id") -> StreamingQuery:
    """Append the kept entries and, per feed, what was seen, kept and rejected by reason.

    The counts are part of the batch's commit, so they stay with the entries
    that they count, also when a batch is replayed.
    """

    def each(batch: DataFrame) -> list[Change]:
        rejected = F.col("rejected")
        counts = batch.groupBy(feed).agg(
            F.count(F.lit(1)).alias("seen"), F.count_if(rejected.isNull()).alias("kept"), F.count_if(rejected.isNotNull()).alias("rejected"))
        return [Change("entries", keyed(batch.filter(rejected.isNull()), feed)), Change("counts", keyed(counts, feed))]

    return run(stream, store, checkpoint, each, "ingest-feed")
