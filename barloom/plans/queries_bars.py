"""Catalogue: bar storage, normalisation, validation, adjustment and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import times
from barloom.operators import adjust as ad
from barloom.operators import quality as ql
from barloom.plans.fixtures import DAILY_SQL, HOURLY_SQL, SUPPLIER_SQL, bars_daily, bars_hourly, bars_supplier, folder, table
from barloom.plans.queries_ledger import to_local_sql, to_utc_sql
from barloom.plans.queries_study import HORIZONS, STUDY, TO_ROWS, study_rows
from barloom.plans.registry import clock, clock_sql, query, rounded, rounded_sql
from barloom.plans import study as st
from barloom.schemas import SERIES_KEY
from barloom.session import materialize
from barloom.sources import bars as sb

TS = clock_sql("ts") + " AS ts"


def day_number(ts):
    return F.dayofyear(ts)


@query(
    "stored_bars",
    f"""WITH {DAILY_SQL} SELECT symbol, {TS}, open, high, low, close, volume FROM bars
WHERE symbol IN ('A', 'R') AND ts >= '1997-01-01' AND ts <= '1998-12-31'""",
)
def stored_bars(spark, sf):
    path = folder(spark, "bars")
    sb.write_bars(bars_daily(spark, sf), path)
    back = sb.read_bars(spark, path, "1997-01-01", "1998-12-31", interval="1d", source="lineitem", basis="raw")
    return back.filter(F.col("symbol").isin("A", "R")).select(
        "symbol", clock(F.col("timestamp")).alias("ts"), "open", "high", "low", "close", "volume"
    )


@query(
    "rewritten_series",
    f"""WITH {DAILY_SQL} SELECT symbol, count(*) FILTER (WHERE symbol <> 'R' OR ts < '1997-01-01') AS bars, symbol = 'R' AS rewritten FROM bars GROUP BY symbol""",
)
def rewritten_series(spark, sf):
    """One series of three is written again with fewer bars; which series' files changed."""
    path = folder(spark, "bars")
    bars = materialize(bars_daily(spark, sf), "bars")
    sb.write_bars(bars, path)
    before = {s: set(sb.read_bars(spark, path, symbol=s).inputFiles()) for s in "ANR"}
    sb.write_bars(bars.filter((F.col("symbol") == "R") & (F.col("timestamp") < "1997-01-01")), path)
    changed = [s for s in "ANR" if before[s] != set(sb.read_bars(spark, path, symbol=s).inputFiles())]
    return sb.read_bars(spark, path).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max(F.col("symbol").isin(changed)).alias("rewritten"))


@query(
    "bar_files",
    f"""WITH {DAILY_SQL}, m AS (SELECT symbol, CASE WHEN dayofyear(ts) % 40 = 1 THEN 'missing_basis' WHEN dayofyear(ts) % 40 = 2 THEN 'unknown_basis'
    WHEN dayofyear(ts) % 40 = 3 THEN 'source_mismatch' ELSE 'accepted' END AS result FROM bars)
SELECT symbol, result, count(*) AS bars FROM m GROUP BY ALL""",
)
def bar_files(spark, sf):
    doy = day_number(F.col("timestamp"))
    rows = bars_daily(spark, sf).select(
        "symbol", "timestamp", "open", "high", "low", "close", "volume", "interval",
        F.when(doy % 40 == 3, "other").otherwise(F.col("source")).alias("source"),
        F.when(doy % 40 == 1, "").when(doy % 40 == 2, "odd").otherwise(F.col("basis")).alias("price_basis"),
    )
    path = folder(spark, "csv")
    rows.write.option("header", "true").csv(path)
    good, bad = sb.read_bar_csv(spark, path, rows.columns, source="lineitem", interval="1d")
    judged = good.select("symbol", F.lit("accepted").alias("result")).unionByName(
        bad.select("symbol", F.explode("issues").alias("result"))
    )
    return judged.groupBy("symbol", "result").agg(F.count(F.lit(1)).alias("bars"))


@query(
    "merged_bars",
    f"""WITH {DAILY_SQL}, stored AS (SELECT * FROM bars WHERE ts < '1999-01-01'),
sent AS (SELECT * REPLACE (CASE WHEN dayofyear(ts) % 20 = 0 THEN volume + 1 ELSE volume END AS volume) FROM bars WHERE ts >= '1997-01-01'),
u AS (SELECT symbol, ts, volume FROM stored UNION ALL SELECT symbol, ts, volume FROM sent),
g AS (SELECT symbol, ts, count(DISTINCT volume) AS versions FROM u GROUP BY symbol, ts)
SELECT symbol, count(*) FILTER (WHERE versions = 1) AS merged, count(*) FILTER (WHERE versions > 1) AS conflicts FROM g GROUP BY symbol""",
)
def merged_bars(spark, sf):
    bars = materialize(bars_daily(spark, sf), "bars")
    stored = bars.filter(F.col("timestamp") < F.lit("1999-01-01").cast("timestamp"))
    sent = bars.filter(F.col("timestamp") >= F.lit("1997-01-01").cast("timestamp")).withColumn(
        "volume", F.when(day_number(F.col("timestamp")) % 20 == 0, F.col("volume") + 1).otherwise(F.col("volume"))
    )
    merged, conflicts = ad.merge_bars(stored, sent)
    a = merged.groupBy("symbol").agg(F.count(F.lit(1)).alias("merged"))
    b = conflicts.groupBy("symbol").agg(F.count(F.lit(1)).alias("conflicts"))
    return a.join(b, "symbol", "full").fillna(0)


@query(
    "normalized_records",
    f"""WITH {HOURLY_SQL}, r AS (SELECT symbol, CASE WHEN hour(ts) = 3 THEN 'incomplete' WHEN hour(ts) = 5 THEN 'not_a_number' WHEN hour(ts) = 7 THEN 'naive_timestamp'
  ELSE 'accepted' END AS result, close FROM bars)
SELECT upper(symbol) AS symbol, result, count(*) AS records, {rounded_sql("sum(CASE WHEN result = 'accepted' THEN close ELSE 0 END)", 4)} AS close_sum FROM r GROUP BY ALL""",
)
def normalized_records(spark, sf):
    bars = bars_hourly(spark, sf)
    hour = F.hour("timestamp")
    vendor = bars.select(
        F.concat(F.lit(" "), F.lower("symbol")).alias("Ticker"),
        F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(hour == 7, "").otherwise("Z")).alias("Date"),
        F.col("open").cast("string").alias("Open"), F.col("high").cast("string").alias("HIGH"),
        F.col("low").cast("string").alias("l"), F.when(hour == 3, None).when(hour == 5, "n/a").otherwise(F.col("close").cast("string")).alias("Close"),
        F.col("volume").cast("string").alias("Vol"),
    )
    good, bad = sb.normalize_records(vendor, "Ticker", "1h", "vendor")
    judged = good.select("symbol", F.lit("accepted").alias("result"), "close").unionByName(
        bad.select("symbol", F.col("issue").alias("result"), F.lit(0.0).alias("close"))
    )
    return judged.groupBy("symbol", "result").agg(
        F.count(F.lit(1)).alias("records"), rounded(F.sum("close"), 4).alias("close_sum")
    )


@query(
    "settled_bars",
    f"""WITH {HOURLY_SQL} SELECT symbol, count(*) AS settled, {clock_sql('max(ts)')} AS last_settled FROM bars
WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 12:30:00' GROUP BY symbol""",
)
def settled_bars(spark, sf):
    out = ql.settled_only(bars_hourly(spark, sf), F.lit("2024-01-20 12:30:00").cast("timestamp"))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("settled"), clock(F.max("timestamp")).alias("last_settled"))


BAD_SQL = f"""WITH {DAILY_SQL}, b AS (SELECT symbol, ts, dayofyear(ts) AS d, open, low, close,
    CASE WHEN dayofyear(ts) % 50 = 1 THEN low / 2 ELSE high END AS high, CASE WHEN dayofyear(ts) % 50 = 2 THEN -volume ELSE volume END AS volume FROM bars)"""


def broken_bars(spark, sf):
    doy = day_number(F.col("timestamp"))
    bars = bars_daily(spark, sf)
    return bars.withColumns(
        {
            "high": F.when(doy % 50 == 1, F.col("low") / 2).otherwise(F.col("high")),
            "volume": F.when(doy % 50 == 2, -F.col("volume")).otherwise(F.col("volume")),
            "close": F.when(doy % 50 == 3, F.lit(float("nan"))).otherwise(F.col("close")),
            "symbol": F.when(doy % 50 == 4, F.lit(" ")).otherwise(F.col("symbol")),
        }
    )


@query(
    "bar_issues",
    BAD_SQL + f""", i AS (SELECT CASE WHEN d % 50 = 4 THEN ' ' ELSE symbol END AS symbol, ts, concat_ws(',', CASE WHEN d % 50 = 4 THEN 'empty_symbol' END,
  CASE WHEN d % 50 = 3 THEN 'non_finite_value' ELSE nullif(concat_ws(',', CASE WHEN volume < 0 THEN 'negative_volume' END,
    CASE WHEN high < low THEN 'high_below_low' END, CASE WHEN high < open THEN 'high_below_open' END, CASE WHEN high < close THEN 'high_below_close' END,
    CASE WHEN low > open THEN 'low_above_open' END, CASE WHEN low > close THEN 'low_above_close' END), '') END) AS issues FROM b)
SELECT symbol, {TS}, issues FROM i WHERE issues <> ''""",
)
def bar_issue_rows(spark, sf):
    out = ql.bar_issues(broken_bars(spark, sf))
    return out.select("symbol", clock(F.col("timestamp")).alias("ts"), F.array_join("issues", ",").alias("issues"))


@query(
    "series_issues",
    f"""WITH {DAILY_SQL}, s AS (SELECT symbol AS batch, CASE WHEN dayofyear(ts) % 60 = 7 THEN 'X' ELSE symbol END AS symbol,
    CASE dayofyear(ts) % 60 WHEN 11 THEN ts - INTERVAL 1 DAY WHEN 31 THEN ts - INTERVAL 5 DAY ELSE ts END AS t,
    row_number() OVER (PARTITION BY symbol ORDER BY ts) AS seq FROM bars),
p AS (SELECT *, lag(t) OVER (PARTITION BY batch ORDER BY seq) AS pt, row_number() OVER (PARTITION BY batch, t ORDER BY seq) AS k,
  first_value(symbol) OVER (PARTITION BY batch ORDER BY seq) AS head FROM s),
i AS (SELECT batch, seq, concat_ws(',', CASE WHEN symbol <> head THEN 'symbol_mismatch' END, CASE WHEN k > 1 THEN 'duplicate_timestamp' END,
  CASE WHEN t < pt THEN 'unordered_timestamp' END) AS issues FROM p)
SELECT batch, seq, issues FROM i WHERE issues <> ''""",
)
def series_issue_rows(spark, sf):
    from barloom.operators.layout import arrange

    numbered = arrange(bars_daily(spark, sf)).own().df
    doy = day_number(F.col("timestamp")) % 60
    arrived = numbered.select(
        F.col("symbol").alias("batch"), F.when(doy == 7, "X").otherwise(F.col("symbol")).alias("symbol"), "interval", "source",
        F.when(doy == 11, F.expr("timestamp - INTERVAL 1 DAY")).when(doy == 31, F.expr("timestamp - INTERVAL 5 DAYS")).otherwise(F.col("timestamp")).alias("timestamp"),
        F.col("_rn").alias("seq"),
    )
    out = ql.series_issues(materialize(arrived, "arrived"), batch=("batch",))
    return out.select("batch", "seq", F.array_join("issues", ",").alias("issues"))


@query(
    "gaps",
    f"""WITH {HOURLY_SQL}, p AS (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS a, ts FROM bars)
SELECT symbol, {clock_sql('a')} AS after, {clock_sql('ts')} AS before, greatest(CAST(date_diff('second', a, ts) // 3600 AS BIGINT) - 1, 1) AS missing_intervals,
  CASE WHEN hour(a) >= 20 THEN 'expected_session_missing' ELSE 'unknown' END AS status FROM p WHERE date_diff('second', a, ts) > 3600""",
)
def gap_rows(spark, sf):
    bars = materialize(bars_hourly(spark, sf), "bars")
    plain = ql.find_gaps(bars)
    calendar = plain.filter(F.hour("after") >= 20).select(
        "symbol", "interval", "after", "before", F.lit("expected_session_missing").alias("status")
    )
    out = ql.find_gaps(bars, calendar)
    return out.select("symbol", clock(F.col("after")).alias("after"), clock(F.col("before")).alias("before"), "missing_intervals", "status")


@query(
    "gap_report",
    f"""WITH {SUPPLIER_SQL}, p AS (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS a, ts FROM bars),
g AS (SELECT symbol, count(*) AS n, sum(greatest(date_diff('second', a, ts) // 86400 - 1, 1)) AS miss FROM p WHERE date_diff('second', a, ts) > 86400 GROUP BY symbol)
SELECT b.symbol, b.n AS bar_count, coalesce(g.n, 0) AS gap_count, coalesce(g.n, 0) AS unclassified, CAST(0 AS BIGINT) AS missing_sessions,
  CAST(coalesce(miss, 0) AS BIGINT) AS missing_intervals FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) b LEFT JOIN g USING (symbol)""",
)
def gap_report_rows(spark, sf):
    bars = materialize(bars_supplier(spark, sf), "bars")
    return ql.gap_report(bars, ql.find_gaps(bars)).drop("interval", "source", "basis")


@query(
    "adjusted_bars",
    f"""WITH {DAILY_SQL} SELECT symbol, 'split_and_dividend_adjusted' AS basis, {TS},
  {", ".join(f"{c} * (CASE WHEN ts < '1998-06-01' THEN 0.5 ELSE 1.0 END)::DOUBLE AS {c}" for c in ('open', 'high', 'low', 'close'))}, volume
FROM bars WHERE dayofyear(ts) <> 100""",
)
def adjusted_bars(spark, sf):
    bars = bars_daily(spark, sf).filter(day_number(F.col("timestamp")) != 100)
    split = F.when(F.col("timestamp") < F.lit("1998-06-01").cast("timestamp"), 0.5).otherwise(1.0)
    factors = bars.select("symbol", "interval", "source", "timestamp", split.alias("factor"))
    out = ad.adjust(bars, factors)
    return out.select(
        "symbol", "basis", clock(F.col("timestamp")).alias("ts"), "open", "high", "low", "close", "volume"
    )


@query(
    "adjustment_issues",
    f"""WITH {DAILY_SQL} SELECT symbol, CASE dayofyear(ts) % 30 WHEN 1 THEN 'missing_factor' WHEN 2 THEN 'bad_factor' WHEN 3 THEN 'duplicate_factor' ELSE 'not_raw' END AS issue,
  count(*) AS bars FROM bars WHERE dayofyear(ts) % 30 BETWEEN 1 AND 4 GROUP BY ALL""",
)
def adjustment_issues(spark, sf):
    bars = materialize(bars_daily(spark, sf), "bars")
    doy = day_number(F.col("timestamp")) % 30
    factors = bars.filter(doy != 1).select(
        "symbol", "interval", "source", "timestamp", F.when(doy == 2, 0.0).otherwise(1.0).alias("factor")
    )
    factors = factors.unionByName(factors.filter(doy == 3))
    mixed = bars.withColumn("basis", F.when(doy == 4, "split_and_dividend_adjusted").otherwise(F.col("basis")))
    return ad.adjust_issues(mixed, factors).groupBy("symbol", "issue").agg(F.count(F.lit(1)).alias("bars"))


@query(
    "derived_factors",
    f"""WITH {DAILY_SQL}, f AS (SELECT symbol, CASE dayofyear(ts) % 45 WHEN 1 THEN 'only_raw' WHEN 2 THEN 'only_adjusted' WHEN 3 THEN 'unusable_close' ELSE 'factor' END AS result FROM bars)
SELECT symbol, result, count(*) AS bars, CAST(CASE WHEN result = 'factor' THEN count(*) * 0.75 ELSE 0.0 END AS DOUBLE) AS factor_sum FROM f GROUP BY symbol, result""",
)
def derived_factors(spark, sf):
    bars = materialize(bars_daily(spark, sf), "bars")
    doy = day_number(F.col("timestamp")) % 45
    raw = bars.filter(doy != 2).withColumn("close", F.when(doy == 3, 0.0).otherwise(F.col("close")))
    adjusted = bars.filter(doy != 1).withColumn("close", F.col("close") * 0.75)
    factors, issues = ad.adjustment_factors(raw, adjusted)
    both = factors.select("symbol", F.lit("factor").alias("result"), "factor").unionByName(
        issues.select("symbol", F.col("issue").alias("result"), F.lit(0.0).alias("factor"))
    )
    return both.groupBy("symbol", "result").agg(F.count(F.lit(1)).alias("bars"), rounded(F.sum("factor"), 4).alias("factor_sum"))


@query(
    "vendor_adjustments",
    f"""WITH {DAILY_SQL}, v AS (SELECT symbol, dayofyear(ts) AS d FROM bars)
SELECT symbol, 'factor' AS kind, count(*) AS rows, CAST(count(*) * 0.5 AS DOUBLE) AS total FROM v WHERE d % 33 <> 1 GROUP BY symbol
UNION ALL SELECT symbol, 'split', count(*), CAST(count(*) * 2.0 AS DOUBLE) FROM v WHERE d % 33 = 2 GROUP BY symbol
UNION ALL SELECT symbol, 'cash_dividend', count(*), CAST(count(*) * 0.25 AS DOUBLE) FROM v WHERE d % 33 = 3 GROUP BY symbol""",
)
def vendor_adjustments(spark, sf):
    doy = day_number(F.col("timestamp")) % 33
    frame = bars_daily(spark, sf).select(
        "symbol", "interval", "source", "timestamp", "close",
        F.when(doy == 1, None).otherwise(F.col("close") * 0.5).alias("adj_close"),
        F.when(doy == 2, 2.0).otherwise(0.0).alias("split"), F.when(doy == 3, 0.25).otherwise(0.0).alias("dividend"),
    )
    factors, actions = ad.vendor_adjustment(frame)
    both = factors.select("symbol", F.lit("factor").alias("kind"), F.col("factor").alias("v")).unionByName(
        actions.select("symbol", F.col("action_type").alias("kind"), F.col("value").alias("v"))
    )
    return both.groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("v"), 4).alias("total"))


@query(
    "time_differences",
    f"""WITH {DAILY_SQL} SELECT symbol, {TS}, CASE WHEN dayofyear(ts) % 25 = 1 THEN 'left_only' ELSE 'right_only' END AS side FROM bars WHERE dayofyear(ts) % 25 IN (1, 2)""",
)
def time_differences(spark, sf):
    bars = materialize(bars_daily(spark, sf), "bars")
    doy = day_number(F.col("timestamp")) % 25
    out = ad.time_difference(bars.filter(doy != 2), bars.filter(doy != 1))
    return out.select("symbol", clock(F.col("timestamp")).alias("ts"), "side")


@query(
    "incompatible_series",
    f"""WITH {SUPPLIER_SQL} SELECT DISTINCT symbol, 'split_and_dividend_adjusted' AS basis FROM bars WHERE CAST(symbol AS BIGINT) % 3 = 0""",
)
def incompatible_series(spark, sf):
    bars = materialize(bars_supplier(spark, sf), "bars")
    other = bars.withColumn(
        "basis", F.when(F.col("symbol").cast("long") % 3 == 0, "split_and_dividend_adjusted").otherwise(F.col("basis"))
    )
    return ql.key_mismatches(other, bars).select("symbol", "basis")


@query(
    "recent_bars",
    f"""WITH {SUPPLIER_SQL} SELECT symbol, {TS}, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 30""",
)
def recent_bars(spark, sf):
    out = ql.recent(bars_supplier(spark, sf), SERIES_KEY, "timestamp", 30)
    return out.select("symbol", clock(F.col("timestamp")).alias("ts"), "close")


@query(
    "history_windows",
    f"""WITH {DAILY_SQL} SELECT symbol, count(*) AS bars, {clock_sql('min(ts)')} AS first_ts FROM bars
WHERE ts >= TIMESTAMP '2001-06-30 00:00:00' - INTERVAL 730 DAY AND ts <= TIMESTAMP '2001-06-30' GROUP BY symbol""",
)
def history_windows(spark, sf):
    from barloom.operators.scanner import history_start

    now = F.lit("2001-06-30 00:00:00").cast("timestamp")
    bars = bars_daily(spark, sf)
    kept = bars.filter((F.col("timestamp") >= history_start(now, F.col("interval"))) & (F.col("timestamp") <= now))
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), clock(F.min("timestamp")).alias("first_ts"))


@query(
    "decision_points",
    f"""WITH {SUPPLIER_SQL} SELECT symbol, {clock_sql('max(ts)')} AS ts, arg_max(close, ts) AS close FROM bars GROUP BY symbol""",
)
def decision_points(spark, sf):
    from barloom.operators.hypotheses import last_rows

    out = last_rows(bars_supplier(spark, sf), SERIES_KEY)
    return out.select("symbol", clock(F.col("timestamp")).alias("ts"), "close")


@query(
    "study_files",
    TO_ROWS + """SELECT hypothesis_id, CASE WHEN dayofyear(ts) % 70 = 1 THEN 'unknown_state' WHEN dayofyear(ts) % 70 = 2 THEN 'identity_mismatch,unknown_state' ELSE 'accepted' END AS result,
  count(*) AS observations FROM rows WHERE horizon_bars = 1 GROUP BY ALL""",
)
def study_files(spark, sf):
    wide = st.wide_observations(study_rows(spark, sf))
    table_ = sb.study_table(wide, HORIZONS)
    doy = day_number(F.col("timestamp")) % 70
    table_ = table_.withColumns(
        {
            "state": F.when(doy.isin(1, 2) & (F.col("state") != "insufficient_data"), "odd").otherwise(F.col("state")),
            "hypothesis_version": F.when(doy == 2, 9).otherwise(F.col("hypothesis_version")),
        }
    )
    path = folder(spark, "study")
    sb.write_study_csv(table_, path)
    good, bad = sb.read_study_csv(
        spark, path, HORIZONS, STUDY.observation_start, STUDY.observation_end,
        [(h.hypothesis_id, h.version, h.fingerprint) for h in STUDY.hypotheses], STUDY.symbols,
    )
    judged = good.select("hypothesis_id", F.lit("accepted").alias("result")).unionByName(
        bad.select("hypothesis_id", F.array_join("issues", ",").alias("result"))
    )
    return judged.groupBy("hypothesis_id", "result").agg(F.count(F.lit(1)).alias("observations"))


LOCAL = to_local_sql("ts")


@query(
    "collection_clocks",
    f"""SELECT event_type, CAST(CAST({LOCAL} AS DATE) AS VARCHAR) AS new_york_date, count(*) AS events,
  count(*) FILTER (WHERE hour({LOCAL}) * 60 + minute({LOCAL}) BETWEEN 30 AND 539) AS in_window,
  count(*) FILTER (WHERE {to_local_sql("date_trunc('hour', ts)")} = date_trunc('day', {to_local_sql("date_trunc('hour', ts)")})) AS at_midnight,
  count(*) FILTER (WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-10 12:00:00') AS before_activation
FROM events GROUP BY ALL""",
)
def collection_clocks(spark, sf):
    events = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    ts = F.col("ts")
    return events.groupBy("event_type", times.new_york_date(ts).cast("string").alias("new_york_date")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(times.in_collection_window(ts)).alias("in_window"),
        F.count_if(times.is_new_york_midnight(F.date_trunc("hour", ts))).alias("at_midnight"),
        F.count_if(times.is_pre_activation(ts, F.lit("2024-01-10 12:00:00").cast("timestamp"))).alias("before_activation"),
    )


@query(
    "current_tails",
    """WITH o AS (SELECT o_orderdate AS d, o_orderkey % 6 AS k, dayofweek(o_orderdate) AS w FROM orders)
SELECT w AS weekday, k AS days_later, count(*) AS orders,
  count(*) FILTER (WHERE k >= 1 AND k <= CASE w WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) AS current FROM o GROUP BY ALL""",
)
def current_tails(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("d"), (F.col("o_orderkey") % 6).alias("k"))
    noon = lambda c: F.to_utc_timestamp(c + F.expr("INTERVAL 12 HOURS"), times.NEW_YORK)
    tail = noon(F.col("d"))
    moment = noon(F.timestamp_seconds(F.unix_timestamp("d") + F.col("k") * 86400))
    rows = orders.select((F.dayofweek("d") - 1).cast("long").alias("weekday"), F.col("k").alias("days_later"), times.is_current_tail(tail, moment).alias("c"))
    return rows.groupBy("weekday", "days_later").agg(F.count(F.lit(1)).alias("orders"), F.count_if("c").alias("current"))


@query(
    "calendar_months",
    f"""SELECT {clock_sql('o_orderdate')} AS start, {clock_sql('o_orderdate + INTERVAL 1 MONTH')} AS one, {clock_sql('o_orderdate + INTERVAL 48 MONTH')} AS four_years, count(*) AS orders
FROM orders GROUP BY o_orderdate""",
)
def calendar_months(spark, sf):
    ts = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf, "orders").select(ts.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("orders"))
    return rows.select(
        clock(F.col("d")).alias("start"), clock(times.add_months(F.col("d"), 1)).alias("one"),
        clock(times.add_months(F.col("d"), 48)).alias("four_years"), "orders",
    )


@query(
    "local_times",
    f"""WITH n AS (SELECT DISTINCT date_trunc('day', o_orderdate) + INTERVAL 1 HOUR + (o_orderkey % 3) * INTERVAL 30 MINUTE AS t FROM orders),
r AS (SELECT t, {to_utc_sql('t')} AS u FROM n)
SELECT {clock_sql('t')} AS local_time, CASE WHEN {to_local_sql('u')} <> t THEN 'nonexistent_local_time'
  WHEN {to_local_sql('u - INTERVAL 1 HOUR')} = t OR {to_local_sql('u + INTERVAL 1 HOUR')} = t THEN 'ambiguous_local_time' END AS issue FROM r""",
)
def local_times(spark, sf):
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    naive = F.timestamp_seconds(F.unix_timestamp(day) + 3600 + (F.col("o_orderkey") % 3) * 1800)
    rows = table(spark, sf, "orders").select(naive.alias("t")).distinct()
    _, issue = times.localize(F.col("t"), times.NEW_YORK)
    return rows.select(clock(F.col("t")).alias("local_time"), issue.alias("issue"))


@query(
    "parsed_dates",
    f"""SELECT {clock_sql('ts')} AS ts, {clock_sql("date_trunc('second', ts) - INTERVAL 1 HOUR")} AS mail_numeric, {clock_sql("date_trunc('second', ts)")} AS mail_named,
  {clock_sql("date_trunc('second', ts) - INTERVAL 2 HOUR")} AS iso_offset, CAST(NULL AS VARCHAR) AS iso_naive, count(*) AS events FROM events GROUP BY ALL""",
)
def parsed_dates(spark, sf):
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf, "events").select(ts.alias("t"))
    mail = lambda zone: F.concat(F.date_format("t", "EEE, d MMM yyyy HH:mm:ss "), F.lit(zone))
    iso = lambda zone: F.concat(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))
    parsed = rows.select(
        clock(F.col("t")).alias("ts"), clock(times.mail_date(mail("+0100"))).alias("mail_numeric"),
        clock(times.mail_date(mail("GMT"))).alias("mail_named"), clock(times.offset_instant(iso("+02:00"))).alias("iso_offset"),
        clock(times.offset_instant(iso(""))).alias("iso_naive"),
    )
    return parsed.groupBy("ts", "mail_numeric", "mail_named", "iso_offset", "iso_naive").agg(F.count(F.lit(1)).alias("events"))
