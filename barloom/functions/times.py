"""Clock and calendar expressions (UTC columns; New York local rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: collection window and settlement -------------------------
NEW_YORK = "America/New_York"
WINDOW_START_SECONDS = 30 * 60
WINDOW_END_SECONDS = 9 * 3600
DAY_SECONDS = 86400


def plus_seconds(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"INTERVAL '{int(seconds)}' SECOND")


def new_york(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, NEW_YORK)


def new_york_date(ts: Column) -> Column:
    return F.to_date(new_york(ts))


def in_collection_window(ts: Column) -> Column:
    """00:30 <= New York time of day < 09:00."""
    local = new_york(ts)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return (second >= WINDOW_START_SECONDS) & (second < WINDOW_END_SECONDS)


def is_new_york_midnight(ts: Column) -> Column:
    local = new_york(ts)
    return local == F.date_trunc("day", local)


def settles_at(ts: Column) -> Column:
    return plus_seconds(ts, DAY_SECONDS)


def is_pre_activation(ts: Column, activated_at: Column) -> Column:
    """The bar had settled when collection was activated."""
    return settles_at(ts) <= activated_at


def next_weekday(day: Column) -> Column:
    """First Monday-to-Friday date after ``day`` (dayofweek: Sunday is 1)."""
    weekday = F.dayofweek(day)
    return F.date_add(day, F.when(weekday == 6, 3).when(weekday == 7, 2).otherwise(1))


def is_current_tail(tail: Column, moment: Column) -> Column:
    """The run is after the tail's date and not after the next weekday."""
    tail_day, run_day = new_york_date(tail), new_york_date(moment)
    return (tail_day < run_day) & (run_day <= next_weekday(tail_day))


# --- fixed values: zone names of mail dates ---------------------------------
MAIL_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def add_months(ts: Column, months: int) -> Column:
    """Calendar months later, the day clamped to the month's end."""
    return ts + F.make_ym_interval(F.lit(0), F.lit(months))


def localize(naive: Column, zone: str) -> tuple[Column, Column]:
    """UTC instant of a zone-less local time, and why it is refused.

    A time the clock skips does not survive the round trip; a time that happens
    twice also maps back from one hour before or after.
    """
    instant = F.to_utc_timestamp(naive, zone)
    back = F.from_utc_timestamp(instant, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(instant - hour, zone) == naive) | (F.from_utc_timestamp(instant + hour, zone) == naive)
    issue = F.when(back != naive, "nonexistent_local_time").when(twice, "ambiguous_local_time")
    return F.when(issue.isNull(), instant), issue


def offset_instant(text: Column) -> Column:
    """ISO 8601 with an explicit offset or Z; anything else is NULL."""
    has_offset = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2})$")
    return F.when(has_offset, F.try_to_timestamp(F.regexp_replace(text, "z$", "Z")))


def mail_date(text: Column) -> Column:
    """RFC 822 dates, with or without weekday, numeric or named zone.

    A named zone is its fixed offset whatever the season; ``-0000`` says that
    the zone is unknown, so there is no instant.
    """
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},\s*", ""))
    for name, offset in MAIL_ZONES.items():
        bare = F.regexp_replace(bare, rf"\s{name}$", f" {offset}")
    known = F.when(~bare.endswith("-0000"), bare)
    return F.coalesce(*[
        F.try_to_timestamp(known, F.lit(form))
        for form in ("d MMM yyyy HH:mm:ss Z", "d MMM yy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm Z")
    ])
