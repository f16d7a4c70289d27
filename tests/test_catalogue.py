"""Registered queries against DuckDB on the smallest tables."""

import os
from datetime import datetime

import pytest

import __spark_entry__ as entry
from tools.compare import differences, oracle

SF = "/root/testdata/sf0.001"
FAST = (
    "trend_state_counts", "average_true_range", "assessments", "universe_scan", "study_groups", "state_episodes", "crossover_events",
    "bar_issues", "derived_factors", "document_revisions", "url_policy", "cleaned_text", "limit_checks", "feed_entries",
    "collection_status", "current_tails", "streamed_revisions",
)


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, name, SF) is None


@pytest.mark.parametrize("name", ["feed_entries", "atom_entries"])
def test_feeds_that_land_long_after_now(spark, tmp_path, name):
    """Pages whose minute lies more than 26 hours behind the fixed clock of the queries."""
    ids = [*range(6), 134_040, 134_041, 134_042, 900_000]
    pages = spark.createDataFrame([(i, f"https://example.com/{i}", "") for i in ids], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert differences(spark, oracle(str(tmp_path)), name, str(tmp_path)) is None


def test_failures_are_told_within_the_history_of_the_scan(spark, tmp_path):
    """Suppliers with bars of the history window, older bars only, and none."""
    days = [(k, f"{year}-{1 + d // 28:02d}-{1 + d % 28:02d}") for k, year in ((1, 2001), (2, 1995), (3, 2001), (7, 1995), (11, 2001)) for d in range(60)]
    lines = spark.createDataFrame([(i, i % 9, k, 1, 2.0, 100.0 + i % 7, "A", datetime.fromisoformat(day)) for i, (k, day) in enumerate(days)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp")
    for name, rows in (("lineitem", lines), ("supplier", spark.range(1, 14).withColumnRenamed("id", "s_suppkey"))):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    assert differences(spark, oracle(str(tmp_path)), "scan_failures", str(tmp_path)) is None


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100
