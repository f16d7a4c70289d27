"""Catalogue: rules and small operators that the larger queries do not meet."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barloom.definitions import OutcomeSpec, feature
from barloom.functions import text as tx
from barloom.operators import documents as dc
from barloom.operators import validation as vl
from barloom.operators.assess import REASON_ORDER, ordered_codes
from barloom.operators.features import with_features
from barloom.operators.hypotheses import HYPOTHESES, observe, verdict_issues
from barloom.operators.layout import LONG, arrange, placed, running
from barloom.operators.outcomes import measure_forward
from barloom.operators.quality import implausible, normalize_bars
from barloom.operators.runs import episodes
from barloom.operators.scanner import rank_order
from barloom.plans import diagnostics as dg
from barloom.plans import study as st
from barloom.plans.fixtures import DAILY_SQL, as_bars, bars_daily, folder, table
from barloom.plans.queries_features import SCAN_SQL, scan_suppliers
from barloom.plans.queries_study import HORIZONS, STUDY, study_rows
from barloom.plans.registry import SQL, clock, clock_sql, query, rounded, rounded_sql
from barloom.plans.sql_steps import FRAMED, MEASURED, OBSERVED, WILDER, steps
from barloom.session import materialize
from barloom.sources import bars as sb
from barloom.sources import records as rc

@query("normalized_bars", f"WITH {DAILY_SQL} SELECT symbol, source, count(*) AS bars FROM bars GROUP BY ALL")
def normalized_bars(spark, sf):
    """Untidy names come out as the tidy ones."""
    bars = bars_daily(spark, sf)
    untidy = bars.withColumns({"symbol": F.concat(F.lit(" "), F.lower("symbol"), F.lit("\t ")), "source": F.concat(F.lit("  "), "source")})
    tidy = normalize_bars(untidy.withColumn("symbol", F.regexp_replace("symbol", "\t", "")))
    return tidy.groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("bars"))


@query(
    "filtered_feed_items",
    "SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en' AND doc_id BETWEEN 20 AND 900",
)
def filtered_feed_items(spark, sf):
    """Source, class and window filters together."""
    at = F.timestamp_seconds(F.col("doc_id") * 60)
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("source_class"), at.alias("available_from"), at.alias("retrieved_at"))
    moment = lambda n: F.timestamp_seconds(F.lit(n * 60))
    return dc.filter_documents(docs, start=moment(20), end=moment(900), source="src3", source_class="en").select("doc_id")


@query(
    "implausible_times",
    """WITH n AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS now FROM events)
SELECT event_type, count(*) AS events FROM events, n WHERE epoch_ms(ts) // 1000 > epoch_ms(now) // 1000 + 26 * 3600 GROUP BY event_type""",
)
def implausible_times(spark, sf):
    """Events read by a clock that stands at the middle of the table."""
    events = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    middle = F.timestamp_micros(((F.unix_micros("low") + F.unix_micros("high")) / 2).cast("long"))
    rows = events.join(F.broadcast(ends.select(middle.alias("now"))))
    return rows.filter(implausible(F.col("ts"), F.col("now"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    "ordered_reason_codes",
    "SELECT l_linenumber, concat_ws(',', " + ", ".join(
        f"CASE WHEN (l_orderkey + {k}) % 3 = 0 THEN '{c}' END" for k, c in enumerate(REASON_ORDER)
    ) + ") AS codes, count(*) AS lines FROM lineitem GROUP BY ALL",
)
def ordered_reason_codes(spark, sf):
    """Codes given backwards come out in canonical order."""
    given = F.array_compact(F.array(*[
        F.when((F.col("l_orderkey") + k) % 3 == 0, F.lit(c)) for k, c in reversed(list(enumerate(REASON_ORDER)))
    ]))
    rows = table(spark, sf, "lineitem").select("l_linenumber", F.array_join(ordered_codes(given), ",").alias("codes"))
    return rows.groupBy("l_linenumber", "codes").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "reason_labels",
    "SELECT event_type, replace(event_type || '_' || user_id, '_', ' ') AS label, count(*) AS events FROM events GROUP BY ALL",
)
def reason_labels(spark, sf):
    label = tx.reason_label(F.concat_ws("_", "event_type", F.col("user_id").cast("string")))
    return table(spark, sf, "events").groupBy("event_type", label.alias("label")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "canonical_amounts",
    """SELECT o_orderkey, CASE WHEN v = 0 THEN '0' ELSE rtrim(CAST(v AS VARCHAR), '0') || 'E' || (length(CAST(v AS VARCHAR)) - length(rtrim(CAST(v AS VARCHAR), '0')) - 2) END AS amount
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) * 100000 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS v FROM orders)""",
)
def canonical_amounts(spark, sf):
    """Cents, whole thousands and zeros, each by its significant digits and power of ten."""
    price = F.col("o_totalprice")
    cents = F.when(F.col("o_orderkey") % 7 == 0, F.lit(0)).when(
        F.col("o_orderkey") % 3 == 0, F.floor(price / 1000) * 100000).otherwise(F.round(price * 100).cast("long"))
    amount = tx.canonical_amount((cents.cast("decimal(30,0)") / 100).cast("decimal(38,6)"))
    return table(spark, sf, "orders").select("o_orderkey", amount.alias("amount"))


HASHED = """SELECT lang AS t, source AS p, doc_id % 5 AS k, doc_id % 3 AS u FROM documents"""


@query(
    "content_hashes",
    f"""SELECT 'news' AS kind, count(*) AS contents FROM (SELECT DISTINCT t, p, k FROM ({HASHED}))
UNION ALL SELECT 'filing', count(*) FROM (SELECT DISTINCT t, p, k FROM ({HASHED}))
UNION ALL SELECT 'feed', count(*) FROM (SELECT DISTINCT t, p, k, CASE u WHEN 0 THEN NULL WHEN 1 THEN k ELSE k + 100 END FROM ({HASHED}))""",
)
def content_hashes(spark, sf):
    """Distinct hashes of each kind; a feed entry whose update equals its publication differs from one without an update."""
    d = F.col("doc_id")
    at = F.timestamp_seconds((d % 5) * 86400)
    docs = table(spark, sf, "documents").select(
        F.col("lang").alias("headline"), F.lit("s").alias("summary"), F.lit("http://x.example").alias("canonical_url"),
        F.col("source").alias("publisher"), at.alias("source_published_at"), F.col("lang").alias("title"), F.lit("e").alias("excerpt"),
        F.when(d % 3 == 1, at).when(d % 3 == 2, F.expr("timestamp_seconds((doc_id % 5 + 100) * 86400)")).alias("updated"),
        F.col("lang").alias("cik"), F.col("source").alias("form"), F.array(F.lit("1"), F.lit("2")).alias("items"),
        F.lit("d").alias("filing_date"), F.lit("r").alias("report_date"), F.lit("u").alias("primary_document_url"), at.alias("source_event_time"),
    )
    kinds = {"news": dc.news_hash(), "filing": dc.filing_hash(), "feed": dc.feed_hash(F.col("updated"))}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), h.alias("h")) for k, h in kinds.items()]))
    return docs.select(pairs.alias("x")).select("x.*").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("contents"))


@query(
    "study_refusals",
    f"""WITH {DAILY_SQL} SELECT 'X' AS symbol, 'missing_symbol' AS issue WHERE NOT EXISTS (SELECT 1 FROM bars WHERE symbol = 'X')
UNION ALL SELECT DISTINCT symbol, 'unexpected_symbol' FROM bars WHERE symbol NOT IN ('A', 'X')
UNION ALL SELECT symbol, 'wrong_interval_or_basis' FROM bars WHERE symbol = 'A' GROUP BY symbol""",
)
def study_refusals(spark, sf):
    """A universe that the bars do not hold, bars that it does not name, and a series of another interval."""
    definition = replace(STUDY, symbols=("A", "X"))
    bars = bars_daily(spark, sf).filter((F.col("timestamp") >= definition.fetch_start) & (F.col("timestamp") < definition.outcome_data_end))
    bars = bars.withColumn("interval", F.when((F.col("symbol") == "A") & (F.dayofyear("timestamp") == 60), "1wk").otherwise(F.col("interval")))
    return st.study_issues(bars, definition)


@query(
    "verdict_violations",
    steps(FRAMED, WILDER, OBSERVED) + """SELECT issue, count(*) AS rows FROM (SELECT CASE dayofyear(ts) % 7 WHEN 0 THEN 'unknown_state' WHEN 1 THEN 'empty_reason_codes'
  WHEN 2 THEN CASE WHEN state <> 'insufficient_data' THEN 'insufficient_from_classifier' END END AS issue FROM obs) WHERE issue IS NOT NULL GROUP BY issue""",
)
def verdict_violations(spark, sf):
    """Observations with unknown states, without codes, and insufficient without the warm-up code."""
    rows = observe(bars_daily(spark, sf), HYPOTHESES)
    week = F.dayofyear("timestamp") % 7
    broken = rows.withColumns({
        "state": F.when(week == 0, "odd").when(week == 2, "insufficient_data").otherwise(F.col("state")),
        "reason_codes": F.when(week == 1, F.array().cast("array<string>")).otherwise(F.col("reason_codes")),
    })
    return verdict_issues(broken).groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "scan_order",
    SCAN_SQL + "SELECT symbol, eligibility, place, CASE WHEN eligibility = 'eligible' THEN row_number() OVER (PARTITION BY eligibility ORDER BY place) END AS eligible_place FROM ranked",
)
def scan_order(spark, sf):
    """The place of every row, among all and among the eligible ones."""
    rows = placed(scan_suppliers(spark, sf), (), rank_order(), "place").select("symbol", "eligibility", "place")
    return placed(rows, ("eligibility",), ("place",), "own").select(
        "symbol", "eligibility", "place", F.when(F.col("eligibility") == "eligible", F.col("own")).alias("eligible_place"))


@query(
    "appended_lines",
    "SELECT event_type, 2 * count(*) AS records, 0 + count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def appended_lines(spark, sf):
    """A table appended twice and read back."""
    path = folder(spark, "appended")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    for _ in range(2):
        rc.append_jsonl(events, path)
    records, _ = rc.read_jsonl(spark, path, "event_id BIGINT, user_id BIGINT, event_type STRING")
    return records.groupBy("event_type").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("user_id").alias("users"))


@query(
    "strict_ledger_rules",
    """WITH r AS (SELECT event_id AS k FROM events) SELECT 'unsupported_schema' AS issue, count(*) AS records FROM r WHERE k % 11 IN (0, 1)
UNION ALL SELECT 'key_mismatch', count(*) FROM r WHERE k % 13 = 0 UNION ALL SELECT 'wrong_record_type', count(*) FROM r WHERE k % 17 IN (0, 1)
UNION ALL SELECT 'foreign_partition', count(*) FROM r WHERE k % 19 = 0""",
)
def strict_ledger_rules(spark, sf):
    """Records of another version or none, another type or none, a false key, and a foreign partition."""
    k = F.col("event_id")
    records = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("k"), k).alias("key"),
        F.when(k % 11 == 0, 2).when(k % 11 > 1, 1).alias("schema_version"),
        F.when(k % 17 == 0, "outcome").when(k % 17 > 1, "claim").alias("record_type"),
    )
    recomputed = F.when(k % 13 == 0, "other").otherwise(F.concat(F.lit("k"), k))
    found = rc.ledger_issues(records, "key", recomputed, 1, "claim", k % 19 != 0)
    return found.groupBy("issue").agg(F.count(F.lit(1)).alias("records"))


@query(
    "price_frames",
    f"""WITH {DAILY_SQL} SELECT symbol, count(*) AS bars, {clock_sql('min(ts)')} AS first_ts, {clock_sql('max(ts)')} AS last_ts
FROM bars WHERE ts BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1996-02-29' GROUP BY symbol""",
)
def price_frames(spark, sf):
    """A vendor's table under its own spelling of the names, with rows around the requested window."""
    names = {"timestamp": "Timestamp", "open": "Open", "high": "HIGH", "low": "low", "close": "Close", "volume": "Volume"}
    frame = bars_daily(spark, sf).select(F.col("symbol").alias("ticker"), *[F.col(k).alias(v) for k, v in names.items()])
    bars, _ = sb.price_frame(frame, F.col("ticker"), "1d", "vendor", "1995-03-01", "1996-02-29")
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), clock(F.min("timestamp")).alias("first_ts"), clock(F.max("timestamp")).alias("last_ts"))


@query(
    "summary_table",
    steps(FRAMED, WILDER, OBSERVED, MEASURED) + f"""SELECT 'coverage' AS row_type, symbol, hypothesis_id, CAST(horizon_bars AS INT) AS horizon_bars, count(*) AS total_observations,
  count(*) FILTER (WHERE status = 'evaluated') AS evaluated, CAST({len(sb.SUMMARY_COLUMNS)} AS INT) AS columns
FROM out WHERE ts >= '1996-01-01' AND ts < '2001-01-01' GROUP BY symbol, hypothesis_id, horizon_bars""",
)
def summary_table(spark, sf):
    """Coverage rows laid out in the fixed columns of the summary, written and read back."""
    counted = st.coverage(study_rows(spark, sf)).withColumn("row_type", F.lit("coverage"))
    known = [c for c in counted.columns if c in sb.SUMMARY_COLUMNS]
    path = folder(spark, "summary")
    sb.in_columns(counted.select(*known), sb.SUMMARY_COLUMNS).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.select(
        "row_type", "symbol", "hypothesis_id", "horizon_bars", "total_observations", "evaluated",
        F.lit(len(rows.columns)).alias("columns"),
    )


@query(
    "study_sinks",
    f"""SELECT 'episodes' AS row_type, count(*) AS rows, CAST(sum(length) AS BIGINT) AS total, CAST({len(sb.episode_columns(HORIZONS))} AS INT) AS columns FROM ({SQL["state_episodes"]})
UNION ALL SELECT 'episode_summary', count(*), CAST(sum(observations) AS BIGINT), {len(sb.diagnostic_columns(HORIZONS))} FROM ({SQL["episode_summary"]})
UNION ALL SELECT 'crossover', count(*), CAST(sum(bars_since_previous_cross) AS BIGINT), {len(sb.diagnostic_columns(HORIZONS))} FROM ({SQL["crossover_events"]})""",
)
def study_sinks(spark, sf):
    """Episodes and diagnostics in the fixed columns of their files, written and read back."""
    rows = study_rows(spark, sf)
    runs = materialize(dg.study_episodes(rows), "episodes")
    identities = [(h.hypothesis_id, h.version, h.fingerprint) for h in STUDY.hypotheses]
    crosses = dg.crossover_events(rows).withColumnRenamed("rows_since_previous", "bars_since_previous_cross").drop("outcomes")
    tables = {
        "episodes": sb.episode_table(runs, identities, HORIZONS),
        "diagnostics": sb.diagnostic_table({"episode_summary": dg.episode_rows(runs).withColumnRenamed("observations", "count"), "crossover": crosses}, HORIZONS),
    }
    out = []
    for name, laid in tables.items():
        path = folder(spark, name)
        sb.write_study_csv(laid, path)
        back = spark.read.schema(laid.schema).option("header", "true").option("enforceSchema", "false").csv(path)
        kind = F.lit("episodes") if name == "episodes" else F.col("row_type")
        size = F.col("length") if name == "episodes" else F.coalesce("count", "bars_since_previous_cross")
        out.append(back.groupBy(kind.alias("row_type")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(size.cast("bigint")).alias("total"), F.lit(len(back.columns)).alias("columns")))
    return out[0].unionByName(out[1])


@query(
    "missed_sessions",
    f"WITH {DAILY_SQL} SELECT symbol, count(*) AS sessions FROM bars WHERE dayofyear(ts) % 9 IN (1, 2) GROUP BY symbol",
)
def missed_sessions(spark, sf):
    """Sessions that two overlapping runs report, each once."""
    bars = materialize(bars_daily(spark, sf).select("symbol", "timestamp"), "sessions")
    ninth = F.dayofyear("timestamp") % 9
    runs = [
        bars.filter(rule).groupBy("symbol").agg(F.sort_array(F.collect_list("timestamp")).alias("missed_tails"))
        .select(F.array(F.struct("symbol", "missed_tails")).alias("symbols"))
        for rule in (ninth == 1, ninth.isin(1, 2))
    ]
    return vl.missed_sessions(runs[0].unionByName(runs[1])).groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions"))


# ---- long series of irregular spacing, cut into blocks of the production size ----

TICKS_SQL = """ticks AS MATERIALIZED (SELECT symbol, t, min(price) AS close, sum(qty) AS volume FROM (
  SELECT CASE WHEN l_orderkey % 6 < 5 THEN 'HOT' ELSE l_returnflag END AS symbol, epoch_ms(CAST(l_shipdate AS TIMESTAMP)) + l_orderkey * 10 + l_linenumber AS t,
    l_extendedprice / l_quantity AS price, l_quantity AS qty FROM lineitem) GROUP BY symbol, t)"""


def ticks(spark, sf):
    """Lines as ticks of few series, five sixths of them in one; milliseconds tell most lines of a day apart."""
    k = F.col("l_orderkey")
    lines = table(spark, sf, "lineitem").select(
        F.when(k % 6 < 5, "HOT").otherwise(F.col("l_returnflag")).alias("symbol"),
        F.timestamp_millis(F.unix_millis(F.col("l_shipdate").cast("timestamp")) + k * 10 + F.col("l_linenumber")).alias("timestamp"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity",
    )
    each = lines.groupBy("timestamp", "symbol").agg(F.min("price").alias("close"), F.sum("l_quantity").alias("volume"))
    return as_bars(each.withColumns({f: F.col("close") for f in ("open", "high", "low")}), "tick", "lineitem")


@query(
    "tick_averages",
    f"""WITH {TICKS_SQL} SELECT symbol, t, {rounded_sql("CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END", 4)} AS average,
  {rounded_sql("close / lag(close) OVER w - 1")} AS change FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY t)""",
)
def tick_averages(spark, sf):
    """Frames that reach over the edges of blocks."""
    average, change = feature("sma", period=20), feature("simple_return")
    rows = with_features(ticks(spark, sf), [average, change], layout=LONG)
    return rows.select(
        "symbol", F.unix_millis("timestamp").alias("t"), rounded(F.col(f"`{average.key}`"), 4).alias("average"),
        rounded(F.col(f"`{change.key}`")).alias("change"),
    )


@query(
    "tick_runs",
    f"""WITH {TICKS_SQL}, m AS (SELECT symbol, t, close > 1500 AS up, lag(close > 1500) OVER (PARTITION BY symbol ORDER BY t) AS before FROM ticks),
r AS (SELECT symbol, up, sum(CASE WHEN before IS DISTINCT FROM up THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY t) AS run FROM m),
e AS (SELECT symbol, up, run, count(*) AS length FROM r GROUP BY ALL)
SELECT symbol, CASE WHEN up THEN 'up' ELSE 'down' END AS state, count(*) AS runs, max(length) AS longest, CAST(max(run) - 1 AS BIGINT) AS last_index FROM e GROUP BY ALL""",
)
def tick_runs(spark, sf):
    """Runs numbered over all blocks of a series."""
    state = F.when(F.col("close") > 1500, "up").otherwise("down")
    runs = episodes(ticks(spark, sf).withColumn("state", state), ("symbol",), layout=LONG)
    return runs.groupBy("symbol", "state").agg(
        F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.max("episode_index").alias("last_index"))


@query(
    "tick_strength",
    f"""WITH {TICKS_SQL}, g AS (SELECT symbol, row_number() OVER w AS rn, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down
  FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY t)),
s AS (SELECT symbol, avg(up) FILTER (WHERE rn <= 15) AS u0, avg(down) FILTER (WHERE rn <= 15) AS d0, list(up ORDER BY rn) FILTER (WHERE rn > 15) AS u,
  list(down ORDER BY rn) FILTER (WHERE rn > 15) AS d FROM g WHERE rn > 1 GROUP BY symbol),
e AS (SELECT symbol, list_reduce(list_prepend(u0, u), lambda a, x: (a * 13 + x) / 14) AS ag, list_reduce(list_prepend(d0, d), lambda a, x: (a * 13 + x) / 14) AS al FROM s)
SELECT symbol, {rounded_sql("100 - 100 / (1 + ag / al)")} AS last_rsi FROM e""",
)
def tick_strength(spark, sf):
    """The recursive average at the end of every series, carried over all blocks."""
    rsi = feature("rsi")
    rows = with_features(ticks(spark, sf), [rsi], layout=LONG)
    last = rows.groupBy("symbol").agg(F.max_by(F.col(f"`{rsi.key}`"), "timestamp").alias("v"))
    return last.select("symbol", rounded(F.col("v")).alias("last_rsi"))


@query(
    "tick_recursions",
    f"""WITH {TICKS_SQL}, g AS (SELECT symbol, row_number() OVER w AS rn, close, volume, coalesce(abs(close - lag(close) OVER w), 0) AS tr FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY t)),
s AS (SELECT symbol, avg(close) FILTER (WHERE rn <= 12) AS e0, list(close ORDER BY rn) FILTER (WHERE rn > 12) AS e, avg(tr) FILTER (WHERE rn <= 14) AS a0, list(tr ORDER BY rn) FILTER (WHERE rn > 14) AS a,
  count(*) AS ticks FROM g GROUP BY symbol)
SELECT symbol, {rounded_sql("list_reduce(list_prepend(e0, e), lambda y, x: y + (x - y) * 2 / 13)", 4)} AS last_ema, {rounded_sql("list_reduce(list_prepend(a0, a), lambda y, x: (y * 13 + x) / 14)", 4)} AS last_atr, ticks FROM s""",
)
def tick_recursions(spark, sf):
    """Exponential average and average true range at the end of every series."""
    ema, atr = feature("ema", period=12), feature("atr", period=14)
    rows = with_features(ticks(spark, sf), [ema, atr], layout=LONG)
    last = rows.groupBy("symbol").agg(
        *[F.max_by(F.col(f"`{x.key}`"), "timestamp").alias(name) for x, name in ((ema, "e"), (atr, "a"))], F.count(F.lit(1)).alias("ticks"))
    return last.select("symbol", rounded(F.col("e"), 4).alias("last_ema"), rounded(F.col("a"), 4).alias("last_atr"), "ticks")


@query(
    "tick_sums",
    f"""WITH {TICKS_SQL} SELECT symbol, t, CAST(sum(volume) OVER w AS BIGINT) AS volume_so_far, CAST(row_number() OVER w AS BIGINT) AS place,
  {rounded_sql("max(close) OVER w", 4)} AS highest FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY t)""",
)
def tick_sums(spark, sf):
    """Running sum and maximum of every tick, over all blocks before its own."""
    rows = running(arrange(ticks(spark, sf), layout=LONG), {"_sum": ("volume", "sum"), "_max": ("close", "max")}).df
    return rows.select(
        "symbol", F.unix_millis("timestamp").alias("t"), F.col("_sum").cast("long").alias("volume_so_far"), F.col("_rn").alias("place"),
        rounded(F.col("_max"), 4).alias("highest"))


@query(
    "tick_outcomes",
    f"""WITH {TICKS_SQL}, h AS (SELECT unnest([1, 20]) AS horizon_bars),
f AS (SELECT symbol, t, horizon_bars, lead(close) OVER w AS reference, lead(close, CAST(horizon_bars AS INT)) OVER w AS future FROM ticks, h WINDOW w AS (PARTITION BY symbol, horizon_bars ORDER BY t)),
o AS (SELECT symbol, horizon_bars, CASE WHEN reference IS NULL THEN 'no_reference_bar' WHEN future IS NULL THEN 'insufficient_future_data' ELSE 'evaluated' END AS status, future / reference - 1 AS v FROM f)
SELECT symbol, CAST(horizon_bars AS BIGINT) AS horizon_bars, status, count(*) AS points, {rounded_sql("avg(CASE WHEN status = 'evaluated' THEN v END)")} AS mean FROM o GROUP BY ALL""",
)
def tick_outcomes(spark, sf):
    """Outcomes whose reference or future tick lies in the next block."""
    bars = ticks(spark, sf)
    points = bars.select("symbol", "interval", "source", "basis", "timestamp")
    found = measure_forward(points, bars, (OutcomeSpec(1), OutcomeSpec(20)), LONG)
    return found.groupBy("symbol", F.col("horizon_bars").cast("bigint").alias("horizon_bars"), "status").agg(
        F.count(F.lit(1)).alias("points"), rounded(F.avg("outcome_value")).alias("mean"))
