"""Features against plain loops, in whole and in cut series."""

import math
import random
import statistics

import pytest

from barloom.definitions import DefinitionError, feature
from barloom.operators.features import field_values, prefix, ready_from, with_features
from barloom.operators.layout import Layout, arrange, placed, running
from barloom.session import copies
from tests.conftest import bars_frame, closes_frame, walk_bars

CUT = Layout(16)
WHOLE = Layout()

# a published example of the Wilder RSI (14 periods, exact arithmetic 70.4641)
WILDER_CLOSES = [
    44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28,
]


def loop_ema(x, p):
    out = [None] * len(x)
    if len(x) >= p:
        out[p - 1] = sum(x[:p]) / p
        for i in range(p, len(x)):
            out[i] = out[i - 1] + (x[i] - out[i - 1]) * 2 / (p + 1)
    return out


def loop_wilder(x, p, first):
    """Smoothed average seeded by the mean of the p values ending at index first."""
    out = [None] * len(x)
    if len(x) > first:
        out[first] = sum(x[first - p + 1 : first + 1]) / p
        for i in range(first + 1, len(x)):
            out[i] = (out[i - 1] * (p - 1) + x[i]) / p
    return out


def loop_rsi(x, p):
    up = [0.0] + [max(b - a, 0) for a, b in zip(x, x[1:])]
    down = [0.0] + [max(a - b, 0) for a, b in zip(x, x[1:])]
    out = []
    for g, d in zip(loop_wilder(up, p, p), loop_wilder(down, p, p)):
        if g is None:
            out.append(None)
        elif d == 0:
            out.append(100.0 if g > 0 else 50.0)
        else:
            out.append(0.0 if g == 0 else 100 - 100 / (1 + g / d))
    return out


def table(df):
    """Rows in time order, collected once."""
    return df.orderBy("timestamp").collect()


def column(rows, spec):
    rows = rows if isinstance(rows, list) else table(rows)
    return [r[spec.key] for r in rows]


def close_to(got, want, tol=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None)
        if g is not None:
            assert math.isclose(g, w, rel_tol=tol, abs_tol=tol), (g, w)


@pytest.mark.parametrize("layout", [WHOLE, CUT], ids=["whole", "cut"])
def test_features_equal_plain_loops(spark, layout):
    rows = walk_bars(140)
    bars = bars_frame(spark, rows)
    closes = [r[8] for r in rows]
    tr = [r[6] - r[7] if i == 0 else max(r[6] - r[7], abs(r[6] - rows[i - 1][8]), abs(r[7] - rows[i - 1][8])) for i, r in enumerate(rows)]
    lr = [None] + [math.log(b / a) for a, b in zip(closes, closes[1:])]
    specs = {
        "sma": feature("sma", period=20), "ema2": feature("ema", period=2), "ema1": feature("ema", period=1),
        "ema20": feature("ema", period=20), "rsi": feature("rsi"), "atr": feature("atr"),
        "vol": feature("realized_volatility", period=10), "ret": feature("simple_return"), "rel": feature("relative_volume", period=5),
    }
    out = table(with_features(bars, specs.values(), layout=layout))
    close_to(column(out, specs["sma"]), [None if i < 19 else sum(closes[i - 19 : i + 1]) / 20 for i in range(140)])
    for name, p in (("ema1", 1), ("ema2", 2), ("ema20", 20)):
        close_to(column(out, specs[name]), loop_ema(closes, p))
    close_to(column(out, specs["rsi"]), loop_rsi(closes, 14))
    close_to(column(out, specs["atr"]), loop_wilder(tr, 14, 13))
    close_to(column(out, specs["vol"]), [None if i < 10 else statistics.stdev(lr[i - 9 : i + 1]) for i in range(140)])
    close_to(column(out, specs["ret"]), [None] + [b / a - 1 for a, b in zip(closes, closes[1:])])
    vol = [r[9] for r in rows]
    close_to(column(out, specs["rel"]), [None if i < 4 else vol[i] / (sum(vol[i - 4 : i + 1]) / 5) for i in range(140)])


def test_published_rsi(spark):
    out = column(with_features(closes_frame(spark, WILDER_CLOSES), [feature("rsi")]), feature("rsi"))
    assert out[:14] == [None] * 14
    assert abs(out[14] - 70.4641) < 1e-3


@pytest.mark.parametrize("closes,last", [([10.0] * 20, 50.0), ([float(i) for i in range(1, 21)], 100.0), ([float(i) for i in range(20, 0, -1)], 0.0)])
def test_degenerate_rsi(spark, closes, last):
    assert column(with_features(closes_frame(spark, closes), [feature("rsi")], layout=CUT), feature("rsi"))[-1] == last


def test_flat_stretch_keeps_the_ratio_of_tiny_averages(spark):
    closes = [100.0 + (i % 5) for i in range(40)] + [104.0] * 900
    spec = feature("rsi")
    close_to(column(with_features(closes_frame(spark, closes), [spec], layout=CUT), spec), loop_rsi(closes, 14), 1e-7)


def test_long_series_across_many_runs(spark):
    rows = walk_bars(2600)
    specs = [feature("ema", period=200), feature("rsi")]
    whole = table(with_features(bars_frame(spark, rows), specs, layout=WHOLE))
    cut = table(with_features(bars_frame(spark, rows), specs, layout=Layout(1024)))
    closes = [r[8] for r in rows]
    close_to(column(whole, specs[0]), loop_ema(closes, 200))
    close_to(column(cut, specs[0]), loop_ema(closes, 200))
    close_to(column(cut, specs[1]), loop_rsi(closes, 14))


def test_positions_over_range_partitions(spark):
    """One busy series over several partitions, single rows, null keys and equal instants."""
    draw = random.Random(3)
    rows = [("hot", draw.random()) for _ in range(400)] + [(f"s{k}", 0.5) for k in range(30)] + [(None, draw.random()) for _ in range(60)] + [("tie", 1.0)] * 20
    draw.shuffle(rows)
    df = spark.createDataFrame([(s, x, k) for k, (s, x) in enumerate(rows)], "s string, x double, k int")
    got = placed(df, ("s",), ("x",)).collect()
    assert len(got) == len(rows) and sorted(r.k for r in got) == list(range(len(rows)))
    for s in {r[0] for r in rows}:
        own = sorted((r._rn, r.x) for r in got if r.s == s)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [x for _, x in own] == sorted(x for _, x in own)
    everything = sorted((r._rn, r.k) for r in placed(df, (), ("k",)).collect())
    assert everything == [(k + 1, k) for k in range(len(rows))]
    assert placed(df.limit(0), ("s",), ("x",)).collect() == []


def test_null_series_keep_their_running_sums(spark):
    rows = [(None if k % 2 else "a", k, 1) for k in range(40)]
    arranged = arrange(spark.createDataFrame(rows, "s string, k int, v int"), ("s",), ("k",), layout=Layout(4))
    got = {r.k: r.total for r in running(arranged, {"total": ("v", "sum")}).df.collect()}
    assert got == {k: k // 2 + 1 for k in range(40)}


@pytest.mark.parametrize("layout", [WHOLE, CUT], ids=["whole", "cut"])
def test_no_look_ahead(spark, layout):
    """Features of the first bars do not change when later bars do."""
    rows = walk_bars(120)
    wild = rows[:80] + [(*r[:5], r[5] * 9, r[6] * 11, r[7] / 7, r[8] * 5, r[9] * 3) for r in rows[80:]]
    specs = [feature("sma", period=20), feature("ema", period=9), feature("rsi"), feature("atr"), feature("realized_volatility", period=8)]
    full = table(with_features(bars_frame(spark, rows), specs, layout=layout))
    for other in (wild, rows[:80]):
        part = table(with_features(bars_frame(spark, other), specs, layout=layout))
        for s in specs:
            close_to(column(full, s)[:80], column(part, s)[:80], 1e-12)


def test_ready_from_prefix_and_fields(spark):
    bars = bars_frame(spark, walk_bars(30, ("A", "B")))
    ready = {r.feature_key: r.ready_from for r in ready_from(bars, [feature("rsi"), feature("sma", period=40)], layout=CUT).filter("symbol='A'").collect()}
    assert ready == {feature("rsi").key: 14, feature("sma", period=40).key: None}
    assert prefix(bars, 7, layout=CUT).groupBy("symbol").count().filter("count = 7").count() == 2
    with pytest.raises(ValueError):
        field_values(bars, "vwap")


def test_feature_definitions():
    assert feature("sma", period=20).key == "sma(field='close',period=20)"
    assert feature("rsi").key == "rsi(field='close',period=14)"
    for bad in (dict(name="nope"), dict(name="sma"), dict(name="sma", period=0), dict(name="sma", period=True), dict(name="rsi", length=3)):
        with pytest.raises(DefinitionError):
            feature(**bad)


def joins_of_rows(spark, df):
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


@pytest.fixture
def narrow(spark):
    """Only tables of a few KB count as small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_stay_where_they_are_for_positions_and_carries(spark, narrow):
    """Start positions and block ends go to the rows, so these are dealt by range and by block only."""
    bars = bars_frame(spark, walk_bars(1500, ("AAA", "BBB")))
    specs = [feature("sma", period=50), feature("rsi")]
    assert joins_of_rows(spark, with_features(bars, specs)) == 0
    assert joins_of_rows(spark, ready_from(bars, specs)) == 0


@pytest.mark.parametrize("layout", [WHOLE, CUT], ids=["whole", "cut"])
def test_features_defined_late_are_found_beyond_the_head(spark, layout):
    """Volume that starts late, in one series of several; a short series and one without a name."""
    late = [(*r[:9], 0.0 if i < 150 else r[9]) for i, r in enumerate(walk_bars(200, ("LATE",)))]
    never = [(*r[:9], 0.0) for r in walk_bars(90, ("NEVER",))]
    unnamed = [(None, *r[1:]) for r in late]
    bars = bars_frame(spark, late + never + unnamed + walk_bars(90, ("SOON",)) + walk_bars(10, ("SHORT",)))
    rel, rsi = feature("relative_volume", period=20), feature("rsi")
    got = {(r.symbol, r.feature_key): r.ready_from for r in ready_from(bars, [rel, rsi], layout=layout).collect()}
    want = {"LATE": (150, 14), None: (150, 14), "NEVER": (None, 14), "SOON": (19, 14), "SHORT": (None, None)}
    assert got == {(s, f.key): v for s, both in want.items() for f, v in zip((rel, rsi), both)}


def test_windows_of_a_block_share_one_sort(spark):
    """Framed features, runs and ends of runs follow one order; before, rows were sorted three times."""
    plan = with_features(bars_frame(spark, walk_bars(60)), [feature("sma", period=5), feature("rsi")])._jdf.queryExecution().executedPlan().toString()
    rows = plan[:plan.index("BroadcastExchange")]
    assert rows.count("Window [") >= 3 and rows.count("Sort [") == 1


def test_readiness_orders_and_keeps_only_what_it_reads(spark):
    before = set(copies(spark))
    ready_from(bars_frame(spark, walk_bars(1500)), [feature("sma", period=5), feature("rsi")]).collect()
    new = [p for p in copies(spark) if p not in before]
    ordered, found = [next(p for p in new if f"/{label}-" in p) for label in ("ordered", "ready")]
    assert not {"open", "high", "low", "volume"} & set(spark.read.parquet(ordered).columns)
    # every row is placed; the windows see the head of the series
    assert spark.read.parquet(ordered).count() == 1500 and spark.read.parquet(found).first()["_rows"] < 100


def test_long_series_are_placed_by_time_and_then_by_name(spark):
    draw = random.Random(5)
    rows = [(s, draw.random(), k) for k, s in enumerate(["hot"] * 300 + [None] * 40 + ["a", "b", "c"] * 20)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, x double, k int")
    one, two = [sorted((r.k, r._rn) for r in placed(df, ("s",), ("x",), long_series=long).collect()) for long in (True, False)]
    assert one == two and len(one) == len(rows)
