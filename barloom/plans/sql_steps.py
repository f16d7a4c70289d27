"""SQL text of the steps that several comparison queries share."""

from __future__ import annotations

from barloom.plans.fixtures import DAILY_SQL

# row numbers, changes and framed features of `bars`
FRAMED = """g AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
f AS MATERIALIZED (SELECT *,
  CASE WHEN rn >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS sma20,
  CASE WHEN rn >= 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END AS sma50,
  greatest(coalesce(close - pc, 0), 0) AS up, greatest(coalesce(pc - close, 0), 0) AS down,
  avg(greatest(coalesce(close - pc, 0), 0)) OVER (w ROWS 13 PRECEDING) AS s_up,
  avg(greatest(coalesce(pc - close, 0), 0)) OVER (w ROWS 13 PRECEDING) AS s_down
  FROM g WINDOW w AS (PARTITION BY symbol ORDER BY rn))"""

WILDER = """w(symbol, rn, ag, al) AS (
  SELECT symbol, rn, s_up, s_down FROM f WHERE rn = 15
  UNION ALL
  SELECT f.symbol, f.rn, (w.ag * 13 + f.up) / 14, (w.al * 13 + f.down) / 14
  FROM w JOIN f ON f.symbol = w.symbol AND f.rn = w.rn + 1),
feat AS MATERIALIZED (SELECT f.*, CASE WHEN al IS NULL THEN NULL
    WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100.0 ELSE 50.0 END
    WHEN ag = 0 THEN 0.0 ELSE 100.0 - 100.0 / (1.0 + ag / al) END AS rsi,
  lag(sma20) OVER x AS p20, lag(sma50) OVER x AS p50
  FROM f LEFT JOIN w USING (symbol, rn) WINDOW x AS (PARTITION BY symbol ORDER BY rn))"""

# states and comma-joined reason codes, one row per bar and hypothesis
OBSERVED = """obs AS MATERIALIZED (
  SELECT symbol, "interval", source, basis, ts, rn, open, close, 'trend_alignment' AS hypothesis_id,
    CASE WHEN sma50 IS NULL THEN 'insufficient_data' WHEN (sma20 - sma50) / sma50 > 0.001 THEN 'bullish'
      WHEN (sma20 - sma50) / sma50 < -0.001 THEN 'bearish' ELSE 'neutral' END AS state,
    CASE WHEN sma50 IS NULL THEN 'warmup_incomplete' WHEN (sma20 - sma50) / sma50 > 0.001 THEN 'fast_above_slow'
      WHEN (sma20 - sma50) / sma50 < -0.001 THEN 'fast_below_slow' WHEN sma20 = sma50 THEN 'fast_equals_slow'
      ELSE 'trend_margin_below_threshold' END AS signature
  FROM feat
  UNION ALL
  SELECT symbol, "interval", source, basis, ts, rn, open, close, 'momentum_in_trend_context',
    CASE WHEN sma50 IS NULL OR rsi IS NULL THEN 'insufficient_data'
      WHEN rsi > 55 AND sma20 > sma50 THEN 'bullish' WHEN rsi < 45 AND sma20 < sma50 THEN 'bearish' ELSE 'neutral' END,
    CASE WHEN sma50 IS NULL OR rsi IS NULL THEN 'warmup_incomplete' WHEN rsi BETWEEN 45 AND 55 THEN 'momentum_midrange'
      ELSE CASE WHEN sma20 > sma50 THEN 'fast_above_slow' WHEN sma20 < sma50 THEN 'fast_below_slow' ELSE 'fast_equals_slow' END
        || ',' || CASE WHEN rsi > 55 THEN 'momentum_elevated' ELSE 'momentum_depressed' END || ','
        || CASE WHEN (rsi > 55 AND sma20 > sma50) OR (rsi < 45 AND sma20 < sma50)
             THEN 'momentum_confirms_trend' ELSE 'momentum_contradicts_trend' END END
  FROM feat
  UNION ALL
  SELECT symbol, "interval", source, basis, ts, rn, open, close, 'trend_crossover',
    CASE WHEN p50 IS NULL THEN 'insufficient_data' WHEN sma20 > sma50 AND NOT p20 > p50 THEN 'bullish'
      WHEN p20 > p50 AND NOT sma20 > sma50 THEN 'bearish' ELSE 'neutral' END,
    CASE WHEN p50 IS NULL THEN 'warmup_incomplete' WHEN sma20 > sma50 AND NOT p20 > p50 THEN 'crossed_above,fast_above_slow'
      WHEN p20 > p50 AND NOT sma20 > sma50 THEN 'crossed_below,fast_below_slow' ELSE 'relationship_unchanged' END
  FROM feat)"""

# outcomes of `obs` at horizons 1, 5 and 20
MEASURED = """ahead AS MATERIALIZED (SELECT symbol, ts, lead(ts, 1) OVER x AS ref_ts, lead(open, 1) OVER x AS ref_px,
    lead(ts, 1) OVER x AS t1, lead(close, 1) OVER x AS c1, lead(ts, 5) OVER x AS t5, lead(close, 5) OVER x AS c5,
    lead(ts, 20) OVER x AS t20, lead(close, 20) OVER x AS c20
  FROM bars WINDOW x AS (PARTITION BY symbol ORDER BY ts)),
out AS MATERIALIZED (SELECT o.*, h.h AS horizon_bars,
    CASE WHEN o.state = 'insufficient_data' THEN 'ineligible_observation' WHEN a.ref_ts IS NULL THEN 'no_reference_bar'
      WHEN ft IS NULL THEN 'insufficient_future_data' ELSE 'evaluated' END AS status,
    a.ref_ts, a.ref_px, ft, fc, CASE WHEN o.state <> 'insufficient_data' AND ft IS NOT NULL THEN fc / a.ref_px - 1.0 END AS value
  FROM obs o JOIN (SELECT symbol, ts, ref_ts, ref_px, unnest([1, 5, 20]) AS h, unnest([t1, t5, t20]) AS ft,
                   unnest([c1, c5, c20]) AS fc FROM ahead) a USING (symbol, ts)
  JOIN (SELECT unnest([1, 5, 20]) AS h) h ON h.h = a.h)"""


def steps(*parts: str, bars: str = DAILY_SQL) -> str:
    return "WITH RECURSIVE " + ",\n".join((bars, *parts)) + "\n"


TO_FEATURES = steps(FRAMED, WILDER)
TO_OBSERVATIONS = steps(FRAMED, WILDER, OBSERVED)
TO_OUTCOMES = steps(FRAMED, WILDER, OBSERVED, MEASURED)
