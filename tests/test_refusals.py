"""Nothing is erased, doubled or left out without a word."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.definitions import OutcomeSpec
from barloom.functions.times import mail_date
from barloom.operators import ledger as lg
from barloom.operators.adjust import adjust
from barloom.operators.hypotheses import TREND_ALIGNMENT, observe
from barloom.operators.outcomes import evaluate, measure_forward
from barloom.operators.scanner import in_history
from barloom.schemas import ADJUSTED
from barloom.session import checkpoint_folder, materialize, release
from barloom.sources.bars import SchemaProblem, in_columns, price_frame, read_bars, write_bars
from barloom.sources.records import NEWS_JSON, normalize_news
from barloom.sources.store import Store
from barloom.streaming.jobs import mature_outcomes
from tests.conftest import bars_frame, walk_bars

def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def test_a_write_replaces_its_own_series_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    write_bars(bars_frame(spark, walk_bars(20, ("AAA",))), path)
    write_bars(bars_frame(spark, walk_bars(10, ("BBB",))), path)
    assert read_bars(spark, path).count() == 30
    write_bars(bars_frame(spark, walk_bars(5, ("AAA",))), path)
    got = {r.symbol: r["count"] for r in read_bars(spark, path).groupBy("symbol").count().collect()}
    assert got == {"AAA": 5, "BBB": 10}


def test_adjusting_refuses_adjusted_bars_and_missing_factors(spark):
    bars = bars_frame(spark, walk_bars(6))
    factors = bars.select("symbol", "interval", "source", "timestamp", F.lit(0.5).alias("factor"))
    assert adjust(bars, factors).count() == 6
    with pytest.raises(PySparkException, match="not_raw"):
        adjust(bars.withColumn("basis", F.lit(ADJUSTED)), factors).collect()
    with pytest.raises(PySparkException, match="missing_factor"):
        adjust(bars, factors.filter(F.col("timestamp") > "2020-01-02")).collect()


def test_points_are_measured_under_their_own_basis(spark):
    raw, adjusted = OutcomeSpec(1), OutcomeSpec(1, basis=ADJUSTED)
    bars = bars_frame(spark, walk_bars(80))
    observed = observe(bars, (TREND_ALIGNMENT,))
    assert evaluate(observed, bars, (raw,)).count() == 80
    with pytest.raises(PySparkException, match="basis"):
        evaluate(observed, bars, (adjusted,)).collect()
    both = bars.unionByName(bars.withColumn("basis", F.lit(ADJUSTED)))
    got = evaluate(observe(both, (TREND_ALIGNMENT,)), both, (raw, adjusted))
    assert {(r.basis, r.spec_fingerprint) for r in got.collect()} == {("raw", raw.fingerprint), (ADJUSTED, adjusted.fingerprint)}
    with pytest.raises(PySparkException, match="no_matching_bar"):
        measure_forward(bars.withColumn("timestamp", F.expr("timestamp + INTERVAL 1 HOUR")), bars, (raw,)).collect()


def test_a_second_source_does_not_double_claims(spark):
    start = datetime(2024, 1, 1, 5)
    rows = [(*r[:4], start + timedelta(days=i), *r[5:]) for i, r in enumerate(walk_bars(60))]
    bars = bars_frame(spark, rows)
    recorded = F.timestamp_seconds(F.unix_timestamp("timestamp") + 99000)
    claims = lg.claims_from_observations(observe(bars, (TREND_ALIGNMENT,)), bars, recorded)
    spec = (OutcomeSpec(1),)
    other = bars.withColumns({"source": F.lit("other"), "close": F.col("close") + 1, "high": F.col("high") + 1})
    alone = {r.status: r["count"] for r in lg.track(claims, bars, spec, None, now()).groupBy("status").count().collect()}
    twice = {r.status: r["count"] for r in lg.track(claims, bars.unionByName(other), spec, None, now()).groupBy("status").count().collect()}
    assert alone == twice
    refused = lg.track(claims, other, spec, None, now()).filter("status = 'refused'").select("refusal").distinct().collect()
    assert [r.refusal for r in refused] == ["source_mismatch"]


def test_revised_and_repeated_bars_of_a_batch(spark, tmp_path):
    rows = walk_bars(6)
    bars = bars_frame(spark, rows)
    claims = lg.claims_from_observations(observe(bars, (TREND_ALIGNMENT,)), bars, F.col("timestamp"))
    outcomes = lg.new_outcomes(lg.track(claims, bars, (OutcomeSpec(1),), None, now())).schema
    reasons = "symbol string, interval string, source string, basis string, timestamp timestamp, reason string"
    store = Store(spark, str(tmp_path / "store")).define(bars=bars.schema, refused=reasons, outcomes=outcomes)
    landing = str(tmp_path / "in")
    for batch in (rows[:3] + rows[:1], [(*rows[2][:9], rows[2][9] + 1), *rows[3:], rows[4]]):
        bars_frame(spark, batch).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(bars.schema).parquet(landing)
        mature_outcomes(stream, store, lambda: claims, (OutcomeSpec(1),), now(), str(tmp_path / "check")).awaitTermination()
    assert store.read("bars").count() == 6
    assert [r.reason for r in store.read("refused").collect()] == ["conflict"]


def test_named_zones_are_fixed_offsets(spark):
    texts = {
        "Mon, 01 Jul 2024 12:00:00 EST": "2024-07-01 17:00:00", "1 Jul 2024 12:00:00 PST": "2024-07-01 20:00:00",
        "8 Jan 2024 12:00 EDT": "2024-01-08 16:00:00", "8 Jan 2024 12:00:00 Z": "2024-01-08 12:00:00",
        "8 Jan 2024 12:00:00 -0000": None, "8 Jan 24 12:00:00 +0100": "2024-01-08 11:00:00", "8 Jan 2024 12:00:00 XYZ": None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mail_date(F.col("t")).cast("string").alias("at")).collect()
    assert {r.t: r["at"] for r in rows} == texts


def test_empty_fields_fall_through_and_long_texts_stay(spark):
    content = {"id": "c1", "title": "headline " * 500, "summary": "s" * 9000, "pubDate": " ", "displayTime": "2024-01-01T00:00:00Z", "canonicalUrl": {"url": "https://x.example/a"}}
    raw = spark.createDataFrame([{"id": "", "title": "", "link": None, "publisher": None, "content": content}], NEWS_JSON)
    row = normalize_news(raw, now()).first()
    assert row.rejected is None and row.source_item_id == "c1" and len(row.headline) == 4499 and len(row.summary) == 9000
    assert row.source_published_at == datetime(2024, 1, 1)
    other = raw.withColumn("content", F.col("content").withField("summary", F.lit("s" * 8999 + "t")))
    assert normalize_news(other, now()).first().content_hash != row.content_hash


def test_history_price_frames_and_fixed_columns(spark):
    bars = bars_frame(spark, walk_bars(1000) + walk_bars(1000, interval="1wk"))
    got = {r.interval: r["count"] for r in in_history(bars, F.lit("2022-09-26").cast("timestamp")).groupBy("interval").count().collect()}
    assert got == {"1d": 731, "1wk": 1000}
    frame = bars_frame(spark, walk_bars(10)).selectExpr("symbol AS ticker", "timestamp AS TIMESTAMP", "open AS Open", "high", "low", "close", "volume")
    inside, refused = price_frame(frame, F.col("ticker"), "1d", "vendor", "2020-01-03", "2020-01-05")
    assert inside.count() == 3 and refused.count() == 0
    with pytest.raises(SchemaProblem):
        price_frame(frame.withColumnRenamed("Open", "Close "), F.col("ticker"), "1d", "vendor")
    with pytest.raises(SchemaProblem):
        in_columns(frame, ("ticker",))


def test_copies_are_released(spark):
    import os

    release(spark)
    held = materialize(spark.range(3), "three")
    assert held.count() == 3
    assert release(spark) == 1 and release(spark) == 0
    assert not [n for n in os.listdir(checkpoint_folder(spark).removeprefix("file:")) if n.startswith("three-")]
