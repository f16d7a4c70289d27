"""Revisioned records, text and URL rules, clocks, sources."""

import json
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.functions import times
from barloom.functions.urls import url_host, url_issue
from barloom.operators import documents as dc
from barloom.operators import exposure as ex
from barloom.operators import quality as ql
from barloom.operators.adjust import adjustment_factors, merge_bars
from barloom.operators.layout import Layout
from barloom.sources import bars as sb
from barloom.sources import records as rc
from tests.conftest import bars_frame, walk_bars

CUT = Layout(4)
VERSION = "source string, source_item_id string, seq long, immutable_signature string, content_hash string, retrieved_at timestamp, revision int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def sequential(versions):
    """Arrival by arrival, with one remembered version per item."""
    held, out = {}, {}
    for item, seq, sig, content in versions:
        if item not in held:
            held[item] = (sig, content, 1)
            out[seq] = ("accepted", 1)
        elif held[item][0] != sig:
            out[seq] = ("id_reuse_conflict", None)
        elif held[item][1] and held[item][1] == content:
            out[seq] = ("duplicate", held[item][2])
        else:
            held[item] = (sig, content, held[item][2] + 1)
            out[seq] = ("revision", held[item][2])
    return out


@pytest.mark.parametrize("layout", [Layout(), CUT], ids=["whole", "cut"])
def test_revisions_in_two_batches(spark, layout):
    rng = random.Random(7)
    versions = [(f"i{rng.randint(0, 2)}", seq, rng.choice("aaaab"), rng.choice(["h1", "h2", ""])) for seq in range(60)]
    want = sequential(versions)
    frame = lambda part: spark.createDataFrame(
        [("s", i, q, g, h, datetime(2024, 1, 1) + timedelta(minutes=q), 0) for i, q, g, h in part], VERSION
    )
    first = dc.classify_revisions(None, frame(versions[:30]), layout=layout).collect()
    stored = spark.createDataFrame([r for r in first if r.outcome in ("accepted", "revision")], spark.createDataFrame(first).schema).drop("outcome")
    second = dc.classify_revisions(stored, frame(versions[30:]), layout=layout).collect()
    got = {r.seq: (r.outcome, r.revision) for r in [*first, *second]}
    # an item first stored earlier is never "accepted" again
    assert got == want


def test_latest_revision_keeps_the_first_stored_on_ties(spark):
    rows = [("s", "i", 1, "a", "h1", datetime(2024, 1, 1), 2), ("s", "i", 2, "a", "h2", datetime(2024, 1, 2), 2), ("s", "i", 3, "a", "h3", datetime(2024, 1, 3), 3)]
    docs = spark.createDataFrame(rows, VERSION)
    assert dc.latest_revisions(docs, F.lit(datetime(2024, 1, 2))).first().content_hash == "h1"
    assert dc.latest_revisions(docs).first().content_hash == "h3"


def test_point_in_time_visibility(spark):
    rows = [
        ("published", datetime(2024, 1, 1), datetime(2024, 1, 5), "source_published", datetime(2024, 1, 1)),
        ("unknown", None, datetime(2024, 1, 1), "unknown", None),
    ]
    docs = spark.createDataFrame(rows, "n string, available_from timestamp, retrieved_at timestamp, availability_basis string, source_time timestamp")
    at = F.lit(datetime(2024, 1, 3))
    names = lambda **k: [r.n for r in dc.filter_documents(docs, as_of=at, **k).collect()]
    assert names() == ["published"]
    assert names(trust="system_observed") == []
    assert names(mode="source_time") == ["published"]
    with pytest.raises(ValueError):
        names(mode="guess")


def test_text_rules(spark):
    assert one(spark, tx.safe_text(F.lit("  a\x00b\tc\n "), 10)) == "ab\tc"
    assert one(spark, tx.safe_text(F.lit("abcdef  gh"), 8)) == "abcdef"
    assert one(spark, tx.safe_text(F.lit(" \x01 "), 5, "none")) == "none"
    assert one(spark, tx.plain_text(F.lit("a\n\n b  c\x02"), 50)) == "a b c"
    assert one(spark, tx.reason_label(F.lit("fast_above_slow"))) == "fast above slow"
    assert one(spark, tx.slug(F.lit(" My-Feed_1 "))) == "my-feed_1" and one(spark, tx.slug(F.lit("a b"))) is None
    assert one(spark, tx.decimal_amount(F.lit("1,234.50"))) == Decimal("1234.500000")
    assert one(spark, tx.decimal_amount(F.lit("12x"))) is None
    for text, want in (("100", "1E2"), ("100.50", "1005E-1"), ("0.000", "0"), ("1200", "12E2")):
        assert one(spark, tx.canonical_amount(F.lit(text).cast("decimal(38,6)"))) == want


TERMS = {
    "a strong buy now": "strong buy", "b.u.y it": "buy", "s e l l": "sell", "holding steady": None, "(h)old": "hold",
    "Overweight": "overweight", "fair value": None, "the price target": "price target", "ＢＵＹ": "buy", "bu​y": "buy",
    "household buyers": "buyers", "you should se-ll": "sell", "position": None, "STOP   LOSS": "stop loss", "é buy": "buy",
}


def test_boundary_terms(spark):
    rows = spark.createDataFrame([(k,) for k in TERMS], "t string")
    assert {r.t: r.b for r in rows.select("t", tx.boundary_term(F.col("t")).alias("b")).collect()} == TERMS


def test_boundary_audit_reads_whole_texts(spark):
    """A term at the very end of a long text is found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = docs.select(tx.boundary_term(F.concat("text", F.lit(" guaranteed"))).alias("b"), tx.boundary_term(F.col("text")).alias("own")).collect()
    assert len(got) == docs.count() and all(r.b in ("guaranteed", r.own) for r in got)


URLS = {
    "https://Example.com:8443/a?b#c": None, "http://example.com": "scheme_not_allowed", "//example.com": "scheme_relative",
    "example.com/a": "no_scheme", "javascript:alert(1)": "unsafe_scheme", "https:///x": "no_host", "https://u:p@example.com": "credentials",
    "": "empty", "https://a.b/\x07": "control_characters", "https://a.b/" + "x" * 2000: "too_long", "https://127.0.0.1/": "closed_address",
    "https://8.8.8.8/": None, "https://[::1]/": "closed_address", "https://[::ffff:10.0.0.1]/": "closed_address",
    "https://[2001:4860:4860::8888]/": None, "https://224.0.0.1/": "closed_address", "https://100.64.1.1/": "closed_address",
}


def test_url_policy_and_hosts(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = {r.u: r.i for r in rows.select("u", url_issue(F.col("u"), feeds=True).alias("i")).collect()}
    assert got == URLS
    assert one(spark, url_host(F.lit("https://WWW.Example.com:80/x"))) == "www.example.com"
    assert one(spark, url_host(F.lit("https://bücher.example/x"))) == "xn--bcher-kva.example"


def ts(text):
    return F.lit(text).cast("timestamp")


def test_clocks(spark):
    assert one(spark, times.next_weekday(F.lit(date(2024, 3, 8)))) == date(2024, 3, 11)  # Friday
    assert one(spark, times.is_current_tail(ts("2024-03-08 05:00:00"), ts("2024-03-11 08:00:00")))
    assert not one(spark, times.is_current_tail(ts("2024-03-08 05:00:00"), ts("2024-03-12 08:00:00")))
    assert one(spark, times.is_new_york_midnight(ts("2024-07-01 04:00:00"))) and not one(spark, times.is_new_york_midnight(ts("2024-07-01 05:00:00")))
    assert one(spark, times.in_collection_window(ts("2024-01-02 05:30:00"))) and not one(spark, times.in_collection_window(ts("2024-01-02 14:00:00")))
    assert one(spark, times.add_months(ts("2026-01-31 10:00:00"), 1)) == datetime(2026, 2, 28, 10)
    assert one(spark, times.add_months(ts("2028-02-29 00:00:00"), 72)) == datetime(2034, 2, 28)
    for text, want in (("2024-03-10 02:30:00", "nonexistent_local_time"), ("2024-11-03 01:30:00", "ambiguous_local_time"), ("2024-06-03 01:30:00", None)):
        instant, issue = times.localize(ts(text), "America/New_York")
        assert one(spark, issue) == want and (one(spark, instant) is None) == (want is not None)
    mail = {"Mon, 02 Sep 2024 10:00:00 +0200": datetime(2024, 9, 2, 8), "2 Sep 2024 10:00:00 GMT": datetime(2024, 9, 2, 10), "yesterday": None}
    for text, want in mail.items():
        assert one(spark, times.mail_date(F.lit(text))) == want
    iso = {"2026-09-03T22:30:44.000Z": datetime(2026, 9, 3, 22, 30, 44), "2026-09-03T22:30:44": None, "2026-09-03T22:30:44+02:00": datetime(2026, 9, 3, 20, 30, 44)}
    for text, want in iso.items():
        assert one(spark, times.offset_instant(F.lit(text))) == want


def test_bar_rules(spark):
    base = ("AAA", "1d", "t", "raw", datetime(2024, 1, 2), 100.0, 110.0, 95.0, 105.0, 1000.0)
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(("symbol", "interval", "source", "basis", "timestamp", "open", "high", "low", "close", "volume"), base))
    cases = {
        change(): [], change(symbol=" "): ["empty_symbol"], change(close=float("inf")): ["non_finite_value"], change(open=None): ["non_finite_value"],
        change(low=-1.0): ["non_positive_price"], change(volume=-1.0): ["negative_volume"], change(volume=0.0): [],
        change(high=90.0): ["high_below_low", "high_below_open", "high_below_close"], change(low=106.0): ["low_above_open", "low_above_close"],
    }
    rows = bars_frame(spark, list(cases))
    got = [r.i for r in rows.select(ql.row_issues().alias("i")).collect()]
    assert got == list(cases.values())
    with pytest.raises(ql.RefusedData):
        ql.require_empty(ql.bar_issues(rows), "bars")
    normal = ql.normalize_bars(bars_frame(spark, [change(symbol=" aaa ", source=" t ")])).first()
    assert (normal.symbol, normal.source) == ("AAA", "t")


def test_sequence_rules(spark):
    days = [0, 1, 1, 3, 2, 5]
    rows = [(*walk_bars(1)[0][:4], datetime(2024, 1, 1) + timedelta(days=d), *walk_bars(1)[0][5:]) for d in days]
    bars = bars_frame(spark, rows).withColumn("seq", F.monotonically_increasing_id())
    bars = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], bars.schema)
    for layout in (Layout(), Layout(2)):
        got = {r.seq: r.issues for r in ql.series_issues(bars, layout=layout).collect()}
        assert got == {2: ["duplicate_timestamp"], 4: ["unordered_timestamp"]}
    expected = ql.series_issues(bars, expected={"symbol": "ZZZ", "interval": "1d", "source": "test"})
    assert expected.filter(F.array_contains("issues", "symbol_mismatch")).count() == 6


def test_merge_and_factors(spark):
    rows = walk_bars(10)
    stored = bars_frame(spark, rows[:6])
    changed = (*rows[5][:8], rows[5][8] + 1, rows[5][9])
    merged, conflicts = merge_bars(stored, bars_frame(spark, rows[3:5] + [changed] + rows[6:]))
    assert merged.count() == 9 and conflicts.count() == 1
    zero = (*rows[2][:8], 0.0, rows[2][9])
    factors, issues = adjustment_factors(bars_frame(spark, rows[:2] + [zero]), bars_frame(spark, rows[1:4]))
    assert factors.count() == 1 and factors.first().factor == 1.0
    assert sorted(r.issue for r in issues.collect()) == ["only_adjusted", "only_raw", "unusable_close"]


def test_bar_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars = bars_frame(spark, walk_bars(40, ("AAA", "BBB")) + walk_bars(5, ("CCC",), interval="1wk"))
    sb.write_bars(bars, path)
    replaced = bars_frame(spark, [(*r[:9], r[9] + 5) for r in walk_bars(5, ("CCC",), interval="1wk")])
    sb.write_bars(replaced, path)
    back = sb.read_bars(spark, path, "2020-01-03", "2020-01-10", interval="1d", source="test", basis="raw")
    assert back.count() == 16 and sb.read_bars(spark, path).count() == 85
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(timestamp)" in plan and not any("1wk" in f for f in back.inputFiles())
    assert len(sb.read_bars(spark, path, symbol="AAA").inputFiles()) < len(sb.read_bars(spark, path).inputFiles())
    with pytest.raises(ql.RefusedData):
        sb.write_bars(bars.withColumn("volume", F.lit(-1.0)), path)
    conflicts = sb.merge_into(spark, path, bars_frame(spark, walk_bars(45, ("AAA",))))
    assert conflicts.count() == 0 and sb.read_bars(spark, path, interval="1d").count() == 85
    with pytest.raises(sb.SchemaProblem):
        sb.read_bars(spark, path, colour="red")


def test_vendor_columns():
    assert sb.resolve_columns(["Date", "O", "h", "LOW", "Close", "vol"])["volume"] == "vol"
    with pytest.raises(sb.SchemaProblem):
        sb.resolve_columns(["Date", "Open", "open", "High", "Low", "Close", "Volume"])
    with pytest.raises(sb.SchemaProblem):
        sb.resolve_columns(["Date", "Open", "High", "Low", "Close"])


def test_json_lines_and_ledger_rules(spark, tmp_path):
    lines = ['{"schema_version": 1, "k": "a"}', "", '{"schema_version": 2, "k": "b"}', "{broken", "[1]", '{"schema_version": 1, "k": "a"}', '{"schema']
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    records, corrupt = rc.read_jsonl(spark, str(tmp_path / "l.jsonl"), "schema_version INT, k STRING", layout=Layout(2))
    assert [(r.line_number, r.kind) for r in corrupt.orderBy("line_number").collect()] == [(4, "corrupt_interior"), (5, "corrupt_interior"), (7, "corrupt_tail")]
    assert sorted(r.line_number for r in records.collect()) == [1, 3, 6]
    issues = sorted((r.k, r.issue) for r in rc.ledger_issues(records, "k", F.lower("k")).collect())
    assert issues == [("a", "duplicate_key"), ("b", "unsupported_schema")]
    assert rc.unterminated_files(spark, str(tmp_path / "l.jsonl")).count() == 1
    (tmp_path / "ok.jsonl").write_text("{}\n")
    assert rc.unterminated_files(spark, str(tmp_path / "ok.jsonl")).count() == 0


def test_run_log_and_registrants(spark, tmp_path):
    start = {"record_type": "start", "run_id": "r1", "started_at": "2024-01-02T06:00:00Z", "universe": ["A"]}
    done = {**start, "record_type": "record", "run_status": "completed", "symbols": [{"symbol": "A", "status": "ok", "missed_tails": ["2024-01-01T05:00:00Z"]}]}
    (tmp_path / "runs.jsonl").write_text(json.dumps(start) + "\n" + json.dumps(done) + "\n")
    log, corrupt = rc.read_run_log(spark, str(tmp_path / "runs.jsonl"))
    assert corrupt.count() == 0 and [r.record_type for r in log.orderBy("position").collect()] == ["start", "record"]
    from barloom.operators.ledger import run_missed

    assert run_missed(log.filter("record_type = 'record'")).first().timestamp == datetime(2024, 1, 1, 5)
    rows = {"0": {"cik_str": 320193, "ticker": "aapl"}, "1": {"cik_str": 0, "ticker": "BAD"}, "2": {"ticker": "X"}, "3": {"cik_str": 7, "ticker": "AAPL"}, "4": {"cik_str": 9, "ticker": "BRK-B"}}
    (tmp_path / "map.json").write_text(json.dumps(rows))
    assert {r.symbol: r.cik for r in rc.read_registrants(spark, str(tmp_path / "map.json")).collect()} == {"AAPL": "0000000007", "BRK-B": "0000000009"}


def test_filing_columns_of_other_length_are_absent(spark, tmp_path):
    recent = {"accessionNumber": ["1-1", "1-2"], "form": ["8-K", ""], "acceptanceDateTime": ["2024-01-02T03:04:05.000Z"], "filingDate": ["2024-01-02", "2024-01-03"]}
    (tmp_path / "f.json").write_text(json.dumps({"cik": "320193", "filings": {"recent": recent}}))
    out = rc.normalize_filings(rc.read_filings(spark, str(tmp_path / "f.json")), ts("2024-06-01 00:00:00")).orderBy("source_item_id").collect()
    assert (out[0].availability_basis, out[0].source_event_time, out[0].rejected) == ("system_observed", None, None)
    assert out[1].rejected == "identity_unsafe"
    assert out[0].canonical_url == "https://www.sec.gov/Archives/edgar/data/320193/11/"


def test_limits(spark):
    held = spark.createDataFrame([("p1", "A", Decimal("100.000000"), "open"), ("p2", "B", Decimal("50.000000"), "closed")], "position_id string, symbol string, notional decimal(38,6), status string")
    intents = spark.createDataFrame([("i1", "A", Decimal("10")), ("i2", "B", Decimal("100")), ("i3", "B", Decimal("101"))], "intent_id string, symbol string, notional decimal(38,6)")
    policy = ex.RiskPolicy(Decimal("100"), Decimal("200"), 2)
    got = {r.intent_id: (r.outcome, r.reason_codes) for r in ex.check_limits(intents, held, policy).collect()}
    assert got == {"i1": ("rejected", ["duplicate_symbol"]), "i2": ("approved", []), "i3": ("rejected", ["position_limit", "total_exposure_limit"])}
    with pytest.raises(ValueError):
        ex.RiskPolicy(max_total_notional=5.0)
