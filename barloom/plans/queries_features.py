"""Catalogue: features, hypotheses and assessments over derived bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.definitions import Policy, feature
from barloom.operators import features as ft
from barloom.operators.assess import assess, ensemble_issues
from barloom.operators.hypotheses import HYPOTHESES, TREND_ALIGNMENT, observe
from barloom.operators.features import quoted, with_features, with_true_range
from barloom.operators.scanner import in_history, scan, scan_counters, universe, universe_issues
from barloom.plans.fixtures import DAILY_SQL, HOURLY_SQL, SUPPLIER_SQL, bars_daily, bars_hourly, bars_supplier, table
from barloom.plans.registry import clock, clock_sql, query, rounded, rounded_sql
from barloom.plans.sql_steps import FRAMED, OBSERVED, TO_FEATURES, TO_OBSERVATIONS, WILDER, steps
from barloom.session import materialize

TS = clock_sql("ts") + " AS ts"


def feature_table(bars, **specs):
    out = with_features(bars, list(specs.values()))
    return out.select(
        "symbol", clock(F.col("timestamp")).alias("ts"), *[rounded(quoted(s.key)).alias(n) for n, s in specs.items()]
    )


@query(
    "trend_state_counts",
    TO_OBSERVATIONS + "SELECT symbol, state, count(*) AS n FROM obs WHERE hypothesis_id = 'trend_alignment' GROUP BY symbol, state",
)
def trend_state_counts(spark, sf):
    rows = observe(bars_daily(spark, sf), (TREND_ALIGNMENT,))
    return rows.groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "returns",
    f"""WITH {DAILY_SQL}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars)
SELECT symbol, {TS}, {rounded_sql('close / pc - 1')} AS simple_return, {rounded_sql('ln(close / pc)')} AS log_return FROM p""",
)
def returns(spark, sf):
    return feature_table(bars_daily(spark, sf), simple_return=feature("simple_return"), log_return=feature("log_return"))


@query(
    "moving_averages",
    f"""WITH {HOURLY_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)
SELECT symbol, {TS},
  CASE WHEN rn >= 20 THEN {rounded_sql('avg(close) OVER (w ROWS 19 PRECEDING)')} END AS sma20,
  CASE WHEN rn >= 50 THEN {rounded_sql('avg(close) OVER (w ROWS 49 PRECEDING)')} END AS sma50,
  CASE WHEN rn >= 10 THEN {rounded_sql('avg(high) OVER (w ROWS 9 PRECEDING)')} END AS sma10_high
FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
)
def moving_averages(spark, sf):
    return feature_table(
        bars_hourly(spark, sf), sma20=feature("sma", period=20), sma50=feature("sma", period=50),
        sma10_high=feature("sma", period=10, field="high"),
    )


@query(
    "exponential_average",
    f"""WITH RECURSIVE {DAILY_SQL},
f AS MATERIALIZED (SELECT *, row_number() OVER w AS rn, avg(close) OVER (w ROWS 11 PRECEDING) AS seed12,
  avg(close) OVER (w ROWS 19 PRECEDING) AS seed20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
a(symbol, rn, y) AS (SELECT symbol, rn, seed12 FROM f WHERE rn = 12 UNION ALL
  SELECT f.symbol, f.rn, f.close * (2.0 / 13) + a.y * (1 - 2.0 / 13) FROM a JOIN f ON f.symbol = a.symbol AND f.rn = a.rn + 1),
b(symbol, rn, y) AS (SELECT symbol, rn, seed20 FROM f WHERE rn = 20 UNION ALL
  SELECT f.symbol, f.rn, f.close * (2.0 / 21) + b.y * (1 - 2.0 / 21) FROM b JOIN f ON f.symbol = b.symbol AND f.rn = b.rn + 1)
SELECT f.symbol, {clock_sql('f.ts')} AS ts, {rounded_sql('a.y', 4)} AS ema12, {rounded_sql('b.y', 4)} AS ema20
FROM f LEFT JOIN a USING (symbol, rn) LEFT JOIN b USING (symbol, rn)""",
)
def exponential_average(spark, sf):
    e12, e20 = feature("ema", period=12), feature("ema", period=20)
    out = with_features(bars_daily(spark, sf), [e12, e20])
    return out.select(
        "symbol", clock(F.col("timestamp")).alias("ts"),
        rounded(quoted(e12.key), 4).alias("ema12"), rounded(quoted(e20.key), 4).alias("ema20"),
    )


@query(
    "relative_strength",
    TO_FEATURES + f"SELECT symbol, {TS}, {rounded_sql('rsi')} AS rsi14 FROM feat",
)
def relative_strength(spark, sf):
    return feature_table(bars_daily(spark, sf), rsi14=feature("rsi"))


@query(
    "relative_strength_hourly",
    steps(FRAMED, WILDER, bars=HOURLY_SQL) + f"SELECT symbol, {TS}, {rounded_sql('rsi')} AS rsi14 FROM feat",
)
def relative_strength_hourly(spark, sf):
    return feature_table(bars_hourly(spark, sf), rsi14=feature("rsi"))


@query(
    "realized_volatility",
    f"""WITH {DAILY_SQL}, p AS (SELECT *, row_number() OVER w AS rn, ln(close / lag(close) OVER w) AS lr FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
q AS (SELECT *, count(lr) OVER v AS n, stddev_samp(lr) OVER v AS sd FROM p
  WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT symbol, {TS}, CASE WHEN rn > 20 AND n = 20 THEN {rounded_sql('sd')} END AS volatility20 FROM q""",
)
def realized_volatility(spark, sf):
    return feature_table(bars_daily(spark, sf), volatility20=feature("realized_volatility", period=20))


@query(
    "true_range",
    f"""WITH {HOURLY_SQL}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars)
SELECT symbol, {TS}, {rounded_sql('greatest(high - low, abs(high - pc), abs(low - pc))')} AS true_range FROM p""",
)
def true_range(spark, sf):
    out = with_true_range(bars_hourly(spark, sf))
    return out.select("symbol", clock(F.col("timestamp")).alias("ts"), rounded(F.col("true_range")).alias("true_range"))


@query(
    "average_true_range",
    f"""WITH RECURSIVE {DAILY_SQL},
p AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
f AS MATERIALIZED (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY rn ROWS 13 PRECEDING) AS seed
  FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p)),
a(symbol, rn, y) AS (SELECT symbol, rn, seed FROM f WHERE rn = 14 UNION ALL
  SELECT f.symbol, f.rn, (a.y * 13 + f.tr) / 14 FROM a JOIN f ON f.symbol = a.symbol AND f.rn = a.rn + 1)
SELECT f.symbol, {clock_sql('f.ts')} AS ts, {rounded_sql('a.y', 4)} AS atr14 FROM f LEFT JOIN a USING (symbol, rn)""",
)
def average_true_range(spark, sf):
    spec = feature("atr")
    out = with_features(bars_daily(spark, sf), [spec])
    return out.select("symbol", clock(F.col("timestamp")).alias("ts"), rounded(quoted(spec.key), 4).alias("atr14"))


@query(
    "volume_features",
    f"""WITH {SUPPLIER_SQL}, g AS (SELECT *, row_number() OVER w AS rn, avg(volume) OVER (w ROWS 19 PRECEDING) AS av
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, {TS}, CASE WHEN rn >= 20 THEN {rounded_sql('av')} END AS average_volume20,
  CASE WHEN rn >= 20 AND av <> 0 THEN {rounded_sql('volume / av')} END AS relative_volume20 FROM g""",
)
def volume_features(spark, sf):
    return feature_table(
        bars_supplier(spark, sf), average_volume20=feature("average_volume", period=20),
        relative_volume20=feature("relative_volume", period=20),
    )


@query(
    "feature_readiness",
    f"""WITH {SUPPLIER_SQL}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol),
k AS (SELECT * FROM (VALUES ('sma50', 49), ('rsi14', 14), ('log_return', 1)) AS t(feature, first))
SELECT symbol, feature, CAST(CASE WHEN n > first THEN first END AS BIGINT) AS ready_from FROM n CROSS JOIN k""",
)
def feature_readiness(spark, sf):
    named = {"sma50": feature("sma", period=50), "rsi14": feature("rsi"), "log_return": feature("log_return")}
    out = ft.ready_from(bars_supplier(spark, sf), named.values())
    label = F.create_map(*[F.lit(x) for n, s in named.items() for x in (s.key, n)])
    return out.select("symbol", label[F.col("feature_key")].alias("feature"), "ready_from")


@query(
    "long_feature_pairs",
    f"""WITH {HOURLY_SQL}, g AS (SELECT *, row_number() OVER w AS rn, avg(close) OVER (w ROWS 19 PRECEDING) AS m,
  lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, {TS}, 'sma20' AS feature, {rounded_sql('m')} AS value FROM g WHERE rn >= 20
UNION ALL SELECT symbol, {TS}, 'simple_return', {rounded_sql('close / pc - 1')} FROM g WHERE pc <> 0""",
)
def long_feature_pairs(spark, sf):
    named = {"sma20": feature("sma", period=20), "simple_return": feature("simple_return")}
    specs = list(named.values())
    long = ft.ready_pairs(ft.long_features(with_features(bars_hourly(spark, sf), specs), specs))
    label = F.create_map(*[F.lit(x) for n, s in named.items() for x in (s.key, n)])
    return long.select(
        "symbol", clock(F.col("timestamp")).alias("ts"), label[F.col("feature_key")].alias("feature"),
        rounded(F.col("value")).alias("value"),
    )


@query(
    "series_prefix",
    f"""WITH {SUPPLIER_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)
SELECT symbol, {TS}, close FROM g WHERE rn <= 60""",
)
def series_prefix(spark, sf):
    head = ft.field_values(ft.prefix(bars_supplier(spark, sf), 60), "close")
    return head.select("symbol", clock(F.col("timestamp")).alias("ts"), "close")


@query(
    "observations",
    TO_OBSERVATIONS + f"SELECT symbol, {TS}, hypothesis_id, state, signature, {clock_sql('ts + INTERVAL 1 DAY')} AS evaluable_from FROM obs",
)
def observations(spark, sf):
    rows = observe(bars_daily(spark, sf), HYPOTHESES)
    return rows.select(
        "symbol", clock(F.col("timestamp")).alias("ts"), "hypothesis_id", "state",
        F.array_join("reason_codes", ",").alias("signature"), clock(F.col("evaluable_from")).alias("evaluable_from"),
    )


EVIDENCE = TO_OBSERVATIONS + f"""SELECT o.symbol, {clock_sql('o.ts')} AS ts, o.hypothesis_id, o.state,
  {rounded_sql('f.sma20')} AS sma20, {rounded_sql('f.sma50')} AS sma50,
  CASE WHEN o.hypothesis_id = 'momentum_in_trend_context' THEN {rounded_sql('f.rsi')} END AS rsi14
FROM obs o JOIN feat f USING (symbol, rn)
WHERE o.ts = (SELECT max(ts) FROM bars b WHERE b.symbol = o.symbol)"""


@query("decision_point_evidence", EVIDENCE)
def decision_point_evidence(spark, sf):
    rows = observe(bars_daily(spark, sf), HYPOTHESES, tail_only=True)
    value = lambda s: rounded(F.try_element_at("evidence", F.lit(s.key)))
    return rows.select(
        "symbol", clock(F.col("timestamp")).alias("ts"), "hypothesis_id", "state",
        value(feature("sma", period=20)).alias("sma20"), value(feature("sma", period=50)).alias("sma50"),
        value(feature("rsi")).alias("rsi14"),
    )


ASSESSED = """tally AS (SELECT symbol, ts, count(*) FILTER (WHERE state = 'bullish') AS b,
  count(*) FILTER (WHERE state = 'bearish') AS r, count(*) FILTER (WHERE state = 'neutral') AS n,
  count(*) FILTER (WHERE state = 'insufficient_data') AS i, string_agg(hypothesis_id || ':' || state, ';' ORDER BY hypothesis_id) AS inputs
  FROM obs GROUP BY symbol, ts),
assessed AS (SELECT *, CASE WHEN b + r + n < 2 THEN 'insufficient_data' WHEN b > 0 AND r > 0 THEN 'conflicted'
  WHEN b > 0 THEN 'bullish' WHEN r > 0 THEN 'bearish' ELSE 'neutral' END AS state FROM tally),
reasoned AS (SELECT *, CASE state WHEN 'insufficient_data' THEN 'insufficient_evidence'
    WHEN 'conflicted' THEN 'conflicting_directional_evidence' WHEN 'neutral' THEN 'unanimous_neutral'
    ELSE CASE WHEN n = 0 THEN 'unanimous_' || state ELSE 'directional_' || state || '_with_neutral' END END
  || CASE WHEN i > 0 THEN ',insufficient_inputs_excluded' ELSE '' END AS reasons FROM assessed)"""
TO_ASSESSED = steps(FRAMED, WILDER, OBSERVED, ASSESSED)
SUPPLIER_ASSESSED = steps(FRAMED, WILDER, OBSERVED, ASSESSED, bars=SUPPLIER_SQL)


@query(
    "assessments",
    TO_ASSESSED + f"""SELECT symbol, {TS}, state, reasons, b AS bullish, r AS bearish, n AS neutral, i AS insufficient, inputs,
  {clock_sql('ts + INTERVAL 1 DAY')} AS assessment_as_of FROM reasoned""",
)
def assessments(spark, sf):
    out = assess(observe(bars_daily(spark, sf)), Policy.of(HYPOTHESES, 2))
    inputs = F.array_join(F.transform("inputs", lambda x: F.concat(x["hypothesis_id"], F.lit(":"), x["state"])), ";")
    return out.select(
        "symbol", clock(F.col("timestamp")).alias("ts"), "state", F.array_join("reason_codes", ",").alias("reasons"),
        F.col("bullish_count").alias("bullish"), F.col("bearish_count").alias("bearish"),
        F.col("neutral_count").alias("neutral"), F.col("insufficient_count").alias("insufficient"),
        inputs.alias("inputs"), clock(F.col("assessment_as_of")).alias("assessment_as_of"),
    )


SCAN_DAY = "2001-11-15"
# the scan reads the history window of its interval only
SCAN_SQL = SUPPLIER_ASSESSED.replace(
    "FROM lineitem)", f"FROM lineitem WHERE date_trunc('day', l_shipdate) >= TIMESTAMP '{SCAN_DAY}' - INTERVAL 730 DAY)"
) + f""", latest AS (SELECT * FROM reasoned QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
members AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier),
scanned AS (SELECT m.symbol, CASE WHEN state IS NULL THEN 'no_data' WHEN state = 'insufficient_data' THEN 'insufficient_evidence'
    ELSE 'eligible' END AS eligibility, state,
  CASE WHEN state IS NULL OR state = 'insufficient_data' THEN 'not_assessable' WHEN state = 'conflicted' THEN 'conflicted'
    WHEN state = 'neutral' THEN 'neutral' WHEN reasons LIKE 'unanimous%' THEN 'unanimous_directional'
    ELSE 'directional_with_neutral' END AS category, coalesce(b + r + n, 0) AS classifying_count, ts
  FROM members m LEFT JOIN latest USING (symbol)),
ranked AS (SELECT *, row_number() OVER (ORDER BY CASE category WHEN 'unanimous_directional' THEN 1 WHEN 'directional_with_neutral' THEN 2
    WHEN 'conflicted' THEN 3 WHEN 'neutral' THEN 4 ELSE 5 END, classifying_count DESC, ts DESC NULLS LAST, symbol) AS place FROM scanned)
"""


def scan_suppliers(spark, sf, failures=None):
    members = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    now = F.lit(SCAN_DAY).cast("timestamp")
    bars = materialize(in_history(bars_supplier(spark, sf), now), "bars")
    return scan(members, bars, failures=failures, now=now)


@query(
    "universe_scan",
    SCAN_SQL + f"SELECT symbol, eligibility, category, state, classifying_count, {TS} FROM ranked",
)
def universe_scan(spark, sf):
    return scan_suppliers(spark, sf).select(
        "symbol", "eligibility", "category", "state", "classifying_count", clock(F.col("latest_bar")).alias("ts")
    )


@query(
    "scan_counters",
    SCAN_SQL + """, marked AS (SELECT CASE WHEN CAST(symbol AS BIGINT) % 10 = 3 THEN 'failed' ELSE eligibility END AS e FROM scanned)
SELECT count(*) AS total, count(*) FILTER (WHERE e = 'eligible') AS eligible, count(*) FILTER (WHERE e = 'no_data') AS no_data,
  count(*) FILTER (WHERE e = 'insufficient_evidence') AS insufficient_evidence, count(*) FILTER (WHERE e = 'failed') AS failed,
  'partial' AS status, true AS balanced FROM marked""",
)
def scan_counter_row(spark, sf):
    """Every tenth symbol could not be fetched."""
    names = table(spark, sf, "supplier").filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return scan_counters(scan_suppliers(spark, sf, names.withColumn("kind", F.lit("provider"))))


@query(
    "universe_members",
    """SELECT c_mktsegment AS universe_id, upper(trim(CAST(c_nationkey AS VARCHAR))) AS symbol, count(*) AS occurrences
FROM customer GROUP BY 1, 2""",
)
def universe_members(spark, sf):
    raw = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("universe_id"), F.col("c_nationkey").cast("string").alias("symbol")
    )
    return universe(raw)


@query(
    "universe_refusals",
    """WITH u AS (SELECT c_mktsegment AS universe_id, CASE c_nationkey % 6 WHEN 0 THEN 'A B' WHEN 1 THEN repeat('X', 33) ELSE 'S' || c_nationkey END AS symbol, c_custkey FROM customer
  WHERE c_mktsegment <> 'MACHINERY' OR c_nationkey % 6 > 1),
m AS (SELECT universe_id, symbol, count(*) AS k FROM u WHERE universe_id <> 'BUILDING' OR symbol IN ('S2', 'S3') GROUP BY ALL)
SELECT universe_id, count(*) AS symbols, CAST(sum(k - 1) AS BIGINT) AS duplicates, count(*) FILTER (WHERE symbol = 'A B' OR symbol LIKE 'XXX%') AS bad_symbols,
  CASE WHEN count(*) > 17 THEN 'too_many_symbols' WHEN count(*) FILTER (WHERE symbol = 'A B' OR symbol LIKE 'XXX%') > 0 THEN 'bad_symbol' END AS issue FROM m GROUP BY universe_id""",
)
def universe_refusals(spark, sf):
    """Segments as universes: bad symbols in most, one without, one small, one too large for the caller."""
    k, segment = F.col("c_nationkey") % 6, F.col("c_mktsegment")
    symbol = F.when(k == 0, " a b").when(k == 1, F.repeat(F.lit("x"), 33)).otherwise(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")))
    raw = table(spark, sf, "customer").filter((segment != "MACHINERY") | (k > 1)).select(segment.alias("universe_id"), symbol.alias("symbol"))
    raw = raw.filter((F.col("universe_id") != "BUILDING") | F.col("symbol").isin("s2", "s3"))
    return universe_issues(raw, most=17).select("universe_id", "symbols", "duplicates", "bad_symbols", "issue")


@query(
    "ensemble_issues",
    f"""WITH {DAILY_SQL}, d AS (SELECT symbol, dayofyear(ts) % 30 AS k FROM bars)
SELECT symbol, 'missing_hypothesis' AS issue, count(*) AS points FROM d WHERE k IN (1, 3, 4) GROUP BY symbol
UNION ALL SELECT symbol, 'duplicate_hypothesis', count(*) FROM d WHERE k = 2 GROUP BY symbol
UNION ALL SELECT symbol, 'fingerprint_mismatch', count(*) FROM d WHERE k = 3 GROUP BY symbol
UNION ALL SELECT symbol, 'unexpected_hypothesis', count(*) FROM d WHERE k = 4 GROUP BY symbol""",
)
def ensemble_issue_counts(spark, sf):
    """Observations with members removed, repeated, re-parameterised and renamed."""
    seen = materialize(observe(bars_daily(spark, sf), HYPOTHESES), "observations")
    k, who = F.dayofyear("timestamp") % 30, F.col("hypothesis_id")
    odd = seen.filter(~((k == 1) & (who == "trend_crossover")))
    odd = odd.unionByName(seen.filter((k == 2) & (who == "trend_crossover")))
    aligned = who == "trend_alignment"
    odd = odd.withColumns(
        {
            "fingerprint": F.when((k == 3) & aligned, "x").otherwise(F.col("fingerprint")),
            "hypothesis_id": F.when((k == 4) & aligned, "odd").otherwise(who),
        }
    )
    found = ensemble_issues(odd, Policy.of(HYPOTHESES, 2))
    return found.groupBy("symbol", "issue").agg(F.count(F.lit(1)).alias("points"))


@query(
    "scan_failures",
    SCAN_SQL + """, marked AS (SELECT symbol, CAST(symbol AS BIGINT) % 7 = 0 AS a, CAST(symbol AS BIGINT) % 11 = 0 AS b, eligibility FROM scanned)
SELECT CASE WHEN a OR b THEN 'failed' ELSE eligibility END AS eligibility, CASE WHEN a THEN 'provider_unavailable' WHEN b THEN 'unexpected' END AS error_code,
  count(*) AS symbols FROM marked GROUP BY ALL""",
)
def scan_failures(spark, sf):
    """A scan in which some symbols' data could not be used; the others are unaffected."""
    members = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    key = F.col("symbol").cast("long")
    kinds = members.filter(key % 7 == 0).withColumn("kind", F.lit("provider")).unionByName(
        members.filter(key % 11 == 0).withColumn("kind", F.lit("odd"))
    )
    rows = scan_suppliers(spark, sf, kinds)
    return rows.groupBy("eligibility", "error_code").agg(F.count(F.lit(1)).alias("symbols"))
