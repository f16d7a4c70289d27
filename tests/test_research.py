"""Hypotheses, assessments, outcomes and studies on small fixtures."""

import math
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.definitions import DefinitionError, Hypothesis, OutcomeSpec, Policy, feature
from barloom.operators.assess import assess, ensemble_issues, ordered_codes
from barloom.operators.hypotheses import HYPOTHESES, TREND_ALIGNMENT, observe, verdict, verdict_issues
from barloom.operators.layout import LONG, Layout
from barloom.operators.outcomes import SPECS, evaluate, match_issues, measure_forward, spacing_issues, status_issues, summarize
from barloom.operators.runs import count_runs, episode_summary, episodes, events_since
from barloom.operators.scanner import scan, scan_counters, universe_issues
from barloom.operators.stats import describe
from barloom.plans.study import StudyDefinition, coverage, coverage_issues, observation_rows, result_groups, study_issues
from barloom.session import copies
from tests.conftest import bars_frame, walk_bars

CUT = Layout(16)


def test_pinned_fingerprints():
    assert [h.fingerprint for h in HYPOTHESES] == ["650add07184f8440", "6589cb8021b76574", "f1126ca778e6f7ce"]
    assert [s.fingerprint for s in SPECS] == ["83e9dabf9b4e27de", "b586481caf972d58", "a040ca488aa3f51f"]
    assert Policy.of(HYPOTHESES, 2).fingerprint == "a829b9bde41c3332"
    assert Policy.of(HYPOTHESES[::-1], 2).fingerprint == Policy.of(HYPOTHESES, 2).fingerprint


def test_bad_definitions():
    with pytest.raises(DefinitionError):
        Policy.of(HYPOTHESES, 4)
    with pytest.raises(DefinitionError):
        OutcomeSpec(0)
    with pytest.raises(DefinitionError):
        Hypothesis("x", 1, (), lambda *a: None)


def test_cut_and_whole_series_classify_alike(spark):
    bars = bars_frame(spark, walk_bars(150, ("A", "B", "C")))
    key = ["symbol", "timestamp", "hypothesis_id", "state", "reason_codes"]
    one = observe(bars, layout=Layout()).select(*key).collect()
    two = observe(bars, layout=CUT).select(*key).collect()
    assert len(one) == 3 * 450 and sorted(map(str, one)) == sorted(map(str, two))
    assert verdict_issues(observe(bars)).count() == 0


def test_lookback_over_a_recursive_feature(spark):
    """A hypothesis that reads yesterday's RSI needs it across block edges too."""
    rsi = feature("rsi", period=5)

    def read(now, past, p):
        return F.when(now(rsi) > past(rsi, 1), verdict("bullish", "momentum_elevated")).otherwise(verdict("neutral", "momentum_midrange"))

    h = Hypothesis("rising", 1, (rsi,), read, lookback=1)
    bars = bars_frame(spark, walk_bars(90))
    pick = lambda layout: [r.state for r in observe(bars, (h,), layout=layout).orderBy("timestamp").collect()]
    whole = pick(Layout())
    assert whole == pick(CUT)
    assert whole[:6] == ["insufficient_data"] * 6 and "bullish" in whole


def test_required_basis_is_enforced(spark):
    h = Hypothesis("adjusted_only", 1, TREND_ALIGNMENT.features, TREND_ALIGNMENT.classify, parameters={"margin": 0.001}, basis="split_and_dividend_adjusted")
    with pytest.raises(Exception, match="needs split_and_dividend_adjusted"):
        observe(bars_frame(spark, walk_bars(60)), (h,)).collect()


def test_assessment_rules(spark):
    cases = [
        (("bullish", "bullish", "bullish"), "bullish", ["unanimous_bullish"]),
        (("bullish", "neutral", "insufficient_data"), "bullish", ["directional_bullish_with_neutral", "insufficient_inputs_excluded"]),
        (("bullish", "bearish", "neutral"), "conflicted", ["conflicting_directional_evidence"]),
        (("neutral", "insufficient_data", "insufficient_data"), "insufficient_data", ["insufficient_evidence", "insufficient_inputs_excluded"]),
        (("neutral", "neutral", "neutral"), "neutral", ["unanimous_neutral"]),
        (("bearish", "bearish", "insufficient_data"), "bearish", ["unanimous_bearish", "insufficient_inputs_excluded"]),
    ]
    rows = []
    for i, (states, _, _) in enumerate(cases):
        for h, s in zip(HYPOTHESES, states):
            rows.append(("A", "1d", "t", "raw", datetime(2024, 1, 1) + timedelta(days=i), datetime(2024, 1, 2) + timedelta(days=i), h.hypothesis_id, 1, h.fingerprint, s))
    cols = "symbol string, interval string, source string, basis string, timestamp timestamp, evaluable_from timestamp, hypothesis_id string, version int, fingerprint string, state string"
    observed = spark.createDataFrame(rows, cols)
    policy = Policy.of(HYPOTHESES, 2)
    out = assess(observed, policy).orderBy("timestamp").collect()
    assert [(r.state, r.reason_codes) for r in out] == [(s, c) for _, s, c in cases]
    assert ensemble_issues(observed, policy).count() == 0
    broken = observed.filter("NOT (day(timestamp) = 1 AND hypothesis_id = 'trend_crossover')").unionByName(observed.filter("day(timestamp) = 2 AND hypothesis_id = 'trend_crossover'"))
    broken = broken.withColumn("fingerprint", F.when(F.expr("day(timestamp) = 3 AND hypothesis_id = 'trend_alignment'"), "x").otherwise(F.col("fingerprint")))
    broken = broken.withColumn("hypothesis_id", F.when(F.expr("day(timestamp) = 4 AND hypothesis_id = 'trend_alignment'"), "odd").otherwise(F.col("hypothesis_id")))
    found = {(r.issue, r.timestamp.day) for r in ensemble_issues(broken, policy).collect()}
    assert {("missing_hypothesis", 1), ("duplicate_hypothesis", 2), ("fingerprint_mismatch", 3), ("unexpected_hypothesis", 4)} <= found


def test_code_order(spark):
    row = spark.range(1).select(ordered_codes(F.array(F.lit("insufficient_inputs_excluded"), F.lit("unanimous_bullish"))).alias("c")).first()
    assert row.c == ["unanimous_bullish", "insufficient_inputs_excluded"]


def test_outcome_statuses(spark, layout=CUT):
    rows = walk_bars(80)
    bars = bars_frame(spark, rows)
    out = evaluate(observe(bars, (TREND_ALIGNMENT,), layout=layout), bars, layout=layout)
    got = {(r.timestamp, r.horizon_bars): r for r in out.collect()}
    for i, r in enumerate(rows):
        for h in (1, 5, 20):
            o = got[(r[4], h)]
            if i < 49:
                assert o.status == "ineligible_observation" and o.reference_price is None
            elif i + 1 >= 80:
                assert o.status == "no_reference_bar"
            elif i + h >= 80:
                assert o.status == "insufficient_future_data" and o.reference_price == rows[i + 1][5] and o.outcome_value is None
            else:
                assert o.outcome_value == rows[i + h][8] / rows[i + 1][5] - 1.0
                assert o.future_timestamp == rows[i + h][4]
    assert status_issues(out).count() == 0
    summary = summarize(out)
    for r in summary.collect():
        assert r.evaluated_observations + r.ineligible_observations + r.insufficient_future_data + r.no_reference_bar == r.total_observations
        assert r.bullish_count + r.bearish_count + r.neutral_count == r.all_count


def test_outcome_violations(spark):
    bars = bars_frame(spark, walk_bars(60))
    observed = observe(bars, (TREND_ALIGNMENT,))
    assert match_issues(observed, bars.filter("day(timestamp) <> 5")).count() == 2
    assert {r.issue for r in match_issues(observed.unionByName(observed), bars).collect()} == {"duplicate_observation"}
    hourly = [(*r[:1], "1h", *r[2:4], datetime(2020, 1, 1) + timedelta(minutes=30 * i), *r[5:]) for i, r in enumerate(walk_bars(5))]
    assert spacing_issues(bars_frame(spark, hourly)).count() == 4


def test_exact_median_with_ties_and_a_hot_group(spark):
    values = [("hot", float(i % 7) - 3) for i in range(30_001)] + [("hot", i / 1000) for i in range(25_000)] + [("one", 4.0)] + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(values, "g string, v double").repartition(6)
    got = {r.g: r for r in describe(df, ["g"], "v").collect()}
    for g in ("hot", "one", "two"):
        mine = [v for k, v in values if k == g]
        assert got[g].median_forward_return == statistics.median(mine)
        assert got[g].sample_count == len(mine)
        assert got[g].positive_count + got[g].negative_count + got[g].zero_count == len(mine)
    empty = describe(spark.createDataFrame([("x", None)], "g string, v double"), ["g"], "v").first()
    assert empty.sample_count == 0 and empty.median_forward_return is None


STATES = "nbbnnnrrbbbbnrnrrrbnnb"


@pytest.mark.parametrize("layout", [Layout(), Layout(4)], ids=["whole", "cut"])
def test_runs_against_brute_force(spark, layout):
    rows = [(k, datetime(2024, 1, 1) + timedelta(days=i), s) for k in ("x", "y") for i, s in enumerate(STATES)]
    df = spark.createDataFrame(rows, "k string, timestamp timestamp, state string")
    counted = {r.k: r.episode_count for r in count_runs(df, ("k",), "timestamp", F.col("state") == "b", layout).collect()}
    want = sum(1 for i, s in enumerate(STATES) if s == "b" and (i == 0 or STATES[i - 1] != "b"))
    assert counted == {"x": want, "y": want}
    runs, i = [], 0
    while i < len(STATES):
        j = i
        while j + 1 < len(STATES) and STATES[j + 1] == STATES[i]:
            j += 1
        runs.append((len(runs), STATES[i], rows[i][1], rows[j][1], j - i + 1))
        i = j + 1
    got = episodes(df, ("k",), layout=layout)
    mine = sorted((r.episode_index, r.state, r.start_timestamp, r.end_timestamp, r.length) for r in got.filter("k='x'").collect())
    assert mine == runs
    lengths = sorted((n for *_, s, _, _, n in [(a, b, c, d, e) for a, b, c, d, e in runs] if s), reverse=True)
    for r in episode_summary(got.filter("k='x'"), ("k",)).collect():
        sizes = sorted((n for _, s, _, _, n in runs if s == r.state), reverse=True)
        assert (r.observations, r.episode_count, r.length_min, r.length_median, r.length_max) == (sum(sizes), len(sizes), sizes[-1], statistics.median(sizes), sizes[0])
        assert math.isclose(r.share_three_largest, sum(sizes[:3]) / sum(sizes))
    events = events_since(df, ("k",), F.col("state") == "r", layout=layout).filter("k='y'").orderBy("timestamp").collect()
    at = [i for i, s in enumerate(STATES) if s == "r"]
    assert [e.rows_since_previous for e in events] == [None] + [b - a for a, b in zip(at, at[1:])]


STUDY = StudyDefinition(("AAA", "BBB"), "2020-01-01", "2020-03-15", "2020-07-01", "2020-08-01")


def test_study_accounting(spark, layout=CUT):
    bars = bars_frame(spark, walk_bars(200, ("AAA", "BBB")))
    assert study_issues(bars, STUDY).count() == 0
    rows = observation_rows(bars, STUDY, layout).cache()
    assert coverage_issues(coverage(rows)).count() == 0
    groups = result_groups(rows, STUDY, layout).cache()
    assert groups.filter("row_type <> 'neutral_reason'").count() == 2 * 3 * 3 * 4
    matched = {(r.hypothesis_id, r.symbol, r.horizon_bars): r.sample_count for r in groups.filter("row_type = 'matched_unconditional'").collect()}
    parts = groups.filter("row_type = 'state'").groupBy("hypothesis_id", "symbol", "horizon_bars").agg(F.sum("sample_count").alias("n")).collect()
    assert all(matched[(r.hypothesis_id, r.symbol, r.horizon_bars)] == r.n for r in parts)
    # runs: brute force over the collected rows
    for (h, s, hz), _ in matched.items():
        seq = rows.filter((F.col("hypothesis_id") == h) & (F.col("symbol") == s) & (F.col("horizon_bars") == hz)).orderBy("timestamp").collect() if hz == 5 and s == "AAA" else None
        if seq:
            flags = [r.status == "evaluated" and r.state == "neutral" for r in seq]
            want = sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))
            got = groups.filter((F.col("hypothesis_id") == h) & (F.col("symbol") == s) & (F.col("horizon_bars") == hz) & (F.col("row_type") == "state") & (F.col("group_state") == "neutral")).first()
            assert got.episode_count == want


def test_study_is_causal(spark):
    """Bars after the window's outcomes cannot change a classification."""
    rows = walk_bars(200, ("AAA", "BBB"))
    wild = [r if r[4] < datetime(2020, 7, 1) else (*r[:5], *[v * 3 for v in r[5:]]) for r in rows]
    key = ["symbol", "timestamp", "hypothesis_id", "state", "reason_signature"]
    a = observation_rows(bars_frame(spark, rows), STUDY).select(*key).distinct()
    b = observation_rows(bars_frame(spark, wild), STUDY).select(*key).distinct()
    assert a.exceptAll(b).count() == 0


def test_study_refusals(spark):
    bars = bars_frame(spark, walk_bars(200, ("AAA", "CCC")))
    issues = {(r.symbol, r.issue) for r in study_issues(bars.filter("timestamp > '2020-02-20'"), STUDY).collect()}
    assert {("BBB", "missing_symbol"), ("CCC", "unexpected_symbol"), ("AAA", "insufficient_warmup")} <= issues


def test_scan_order_and_failures(spark):
    bars = bars_frame(spark, walk_bars(120, ("AAA", "BBB", "CCC")) + walk_bars(10, ("DDD",)))
    universe = spark.createDataFrame([(s,) for s in ("AAA", "BBB", "CCC", "DDD", "EEE")], "symbol string")
    failures = spark.createDataFrame([("CCC", "provider"), ("BBB", "odd kind")], "symbol string, kind string")
    rows = scan(universe, bars, failures=failures).collect()
    by = {r.symbol: r for r in rows}
    assert by["CCC"].error_code == "provider_unavailable" and by["BBB"].error_code == "unexpected"
    assert by["EEE"].eligibility == "no_data" and by["DDD"].eligibility == "insufficient_evidence"
    assert rows[0].symbol == "AAA"
    counts = scan_counters(scan(universe, bars, failures=failures)).first()
    assert (counts.total, counts.failed, counts.status, counts.balanced) == (5, 2, "partial", True)
    many = spark.createDataFrame([("u", f"S{i}") for i in range(101)] + [("v", "a b")], "universe_id string, symbol string")
    assert {(r.universe_id, r.issue) for r in universe_issues(many, most=100).collect()} == {("u", "too_many_symbols"), ("v", "bad_symbol")}


@pytest.mark.parametrize("layout", [LONG, Layout(16, long_series=True), CUT], ids=["long", "long cut", "cut"])
def test_every_point_is_measured_under_the_specs_of_its_basis(spark, layout):
    rows = walk_bars(70, ("A", "B")) + [(*r[:3], "split_and_dividend_adjusted", *r[4:]) for r in walk_bars(40, ("A",))]
    specs = (OutcomeSpec(1), OutcomeSpec(5, "high"), OutcomeSpec(3, "low", basis="split_and_dividend_adjusted"))
    bars = bars_frame(spark, rows)
    before = set(copies(spark))
    found = measure_forward(bars.select("symbol", "interval", "source", "basis", "timestamp"), bars, specs, layout)
    assert found.columns[:5] == ["symbol", "interval", "source", "basis", "timestamp"]
    series, want = {}, {}
    for r in rows:
        series.setdefault((r[0], r[3]), []).append(r)
    for (symbol, basis), mine in series.items():
        for s in (s for s in specs if s.basis == basis):
            field = {"high": 6, "low": 7, "close": 8}[s.future_field]
            for i, r in enumerate(mine):
                value = mine[i + s.horizon_bars][field] / mine[i + 1][5] - 1 if i + s.horizon_bars < len(mine) else None
                want[symbol, basis, r[4], s.horizon_bars] = value
    got = {(r.symbol, r.basis, r.timestamp, r.horizon_bars): r.outcome_value for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else math.isclose(got[k], v, abs_tol=1e-12) for k, v in want.items())
    # outcomes are compiled, rows meet by time first, and only what is read is placed
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "SortMergeJoin [symbol" not in plan
    ordered = next(p for p in copies(spark) if p not in before and "/ordered-" in p)
    assert not {"volume"} & set(spark.read.parquet(ordered).columns)
