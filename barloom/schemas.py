"""Table schemas and fixed vocabularies."""

from __future__ import annotations

# --- fixed values: series key and bar layout -------------------------------
SERIES_KEY = ("symbol", "interval", "source", "basis")
PRICE_FIELDS = ("open", "high", "low", "close")
BAR_FIELDS = PRICE_FIELDS + ("volume",)

BARS = (
    "symbol STRING, interval STRING, source STRING, basis STRING, timestamp TIMESTAMP, "
    "open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
)
FACTORS = "symbol STRING, interval STRING, source STRING, timestamp TIMESTAMP, factor DOUBLE"
ACTIONS = "symbol STRING, source STRING, effective_time TIMESTAMP, action_type STRING, value DOUBLE"

# --- fixed values: longest duration of a bar, in seconds --------------------
INTERVAL_SECONDS = {
    "1m": 60,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "1d": 86400,
    "1wk": 604800,
    "1mo": 2678400,
}
INTRADAY = ("1m", "5m", "15m", "30m", "1h")

RAW = "raw"
ADJUSTED = "split_and_dividend_adjusted"
BASES = (RAW, ADJUSTED)

# --- fixed values: research states and statuses -----------------------------
BULLISH, BEARISH, NEUTRAL = "bullish", "bearish", "neutral"
INSUFFICIENT, CONFLICTED = "insufficient_data", "conflicted"
DIRECTIONAL = (BULLISH, BEARISH)
REPORTED_STATES = (BULLISH, BEARISH, NEUTRAL)
OBSERVATION_STATES = REPORTED_STATES + (INSUFFICIENT,)

EVALUATED = "evaluated"
NO_FUTURE = "insufficient_future_data"
NO_REFERENCE = "no_reference_bar"
INELIGIBLE = "ineligible_observation"
OUTCOME_STATUSES = (EVALUATED, NO_FUTURE, NO_REFERENCE, INELIGIBLE)
