"""Versioned tables: what a commit touches, what a dead writer leaves, what is merged."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from barloom.operators import quality as ql
from barloom.sources import bars as sb
from barloom.sources.store import GROUP, Change, Store, bucket, bucket_of
from tests.conftest import bars_frame, walk_bars

SYMBOLS = tuple(f"S{k}" for k in range(12))


def files(spark, path):
    return set(sb.read_bars(spark, path).inputFiles())


def test_writing_two_symbols_rewrites_their_files_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    sb.write_bars(bars_frame(spark, walk_bars(20, SYMBOLS)), path)
    before = files(spark, path)
    sb.write_bars(bars_frame(spark, walk_bars(7, SYMBOLS[:2])), path)
    after = files(spark, path)
    touched = {bucket_of(sb.BUCKETS, s) for s in SYMBOLS[:2]}
    assert {f.split("%7E")[-1].split("~")[-1].split("/")[0] for f in before - after} == touched
    got = {r.symbol: r["count"] for r in sb.read_bars(spark, path).groupBy("symbol").count().collect()}
    assert got == {s: 7 if s in SYMBOLS[:2] else 20 for s in SYMBOLS}


def test_a_writer_that_dies_before_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bars")
    sb.write_bars(bars_frame(spark, walk_bars(20, ("AAA", "BBB"))), path)

    def dies(self, manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(Store, "swap", dies)
    with pytest.raises(KeyboardInterrupt):
        sb.write_bars(bars_frame(spark, walk_bars(5, ("AAA",))), path)
    monkeypatch.undo()
    assert sb.read_bars(spark, path).count() == 40
    with pytest.raises(ql.RefusedData):
        sb.write_bars(bars_frame(spark, walk_bars(5, ("AAA",))).withColumn("volume", F.lit(-1.0)), path)
    assert sb.read_bars(spark, path).count() == 40
    sb.write_bars(bars_frame(spark, walk_bars(5, ("AAA",))), path)
    assert sb.read_bars(spark, path).count() == 25
    # what the dead and the refused writer left is removed, what is named stays
    assert Store(spark, path).vacuum(keep=1) >= 3 and sb.read_bars(spark, path).count() == 25
    assert Store(spark, path).vacuum(keep=1) == 0


def test_a_plain_folder_becomes_a_table(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars_frame(spark, walk_bars(10, ("AAA", "BBB"))).write.partitionBy("source", "interval", "basis").parquet(path)
    assert sb.read_bars(spark, path, symbol="AAA").count() == 10
    sb.write_bars(bars_frame(spark, walk_bars(3, ("BBB",))), path)
    assert sb.read_bars(spark, path).count() == 13


def test_tables_of_a_store_change_together_and_appends_are_merged(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), fan=3).define(a="k bigint, v string", b="k bigint")
    assert store.read("a").count() == 0 and not store.applied("q", 0)

    def rows(low, high):
        return spark.range(low, high).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v")).withColumn(GROUP, bucket(2, "k"))

    for n in range(9):
        store.commit([Change("a", rows(4 * n, 4 * n + 4)), Change("b", rows(n, n + 1).drop("v"), "*")], ("q", n))
    assert sorted(r.k for r in store.read("a").collect()) == list(range(36))
    assert [r.k for r in store.read("b").collect()] == [8] and store.applied("q", 8) and not store.applied("q", 9)
    entries = store.manifest()["tables"]["a"]
    assert all(len(e) <= 4 for e in entries.values()) and max(level for e in entries.values() for _, level in e) >= 1
    own = [r.k for r in store.read("a", [bucket_of(2, "5")]).collect()]
    assert 5 in own and all(bucket_of(2, str(k)) == bucket_of(2, "5") for k in own)
    with pytest.raises(RuntimeError):
        store.swap(store.manifest())
    assert not [x for x in os.listdir(f"{tmp_path}/store/manifest") if x.startswith(".") and not x.endswith(".crc")]
