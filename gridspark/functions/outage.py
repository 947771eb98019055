"""Derived outage fields as Column expressions.

Times are zone-free UTC timestamps. Calendar fields that people read (year, month, hour, season)
are in local time; model features use UTC fields, so both exist under different names.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridspark.functions.coerce import ratio, to_double

LOCAL_ZONE = "Europe/London"

# Season names, duration classes and month names in display order.
SEASONS = ("Winter", "Spring", "Summer", "Autumn")
WINTER_MONTHS = (12, 1, 2)
WINTER_MONTH_NAMES = ("December", "January", "February")
DURATION_CATEGORIES = ("x < 3 hours", "3 ≤ x < 6 hours", "6 ≤ x < 12 hours", "x > 12 hours")
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
)

CAUSE_COLUMN = "direct_cause_category"


def rank_in(col: Column, names) -> Column:
    """1-based position of ``col`` in a fixed list, null when it is not there."""
    position = F.array_position(F.array(*[F.lit(n) for n in names]), col)
    return F.when(position > 0, position).cast("int")


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 3.6e9


def duration_hours(minutes: Column, start: Column, end: Column) -> Column:
    """The recorded duration in hours, or the time to restoration where none was recorded."""
    return F.coalesce(to_double(minutes) / 60.0, hours_between(start, end))


def local_time(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def season_of(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .when(month.isNotNull(), "Autumn")
    )


def duration_category(hours: Column, null_as_longest: bool = False) -> Column:
    """Duration class. Exactly 12 hours counts as the longest class.

    A null duration has no class, or the longest one when ``null_as_longest`` is set.
    """
    short, medium, long, longest = DURATION_CATEGORIES
    category = (
        F.when(hours < 3, short)
        .when(hours < 6, medium)
        .when(hours < 12, long)
        .when(hours >= 12, longest)
    )
    return F.coalesce(category, F.lit(longest)) if null_as_longest else category


def is_exceptional(event_id: Column) -> Column:
    return F.coalesce(F.trim(event_id) != "", F.lit(False))


def significance_ratio(minutes_lost: Column, hours: Column) -> Column:
    """Customer minutes lost per outage minute: infinite for a zero duration with losses."""
    value = (
        F.when((hours == 0) & (minutes_lost > 0), F.lit(float("inf")))
        .when(hours == 0, F.lit(0.0))
        .otherwise(ratio(minutes_lost, hours * 60.0))
    )
    return F.coalesce(value, F.lit(0.0))


def customer_hours_from_minutes(minutes_lost: Column) -> Column:
    """Customer hours as recorded minutes / 60 (one of two meanings in use)."""
    return minutes_lost / 60.0


def customer_hours_from_duration(customers: Column, hours: Column) -> Column:
    """Customer hours as customers times duration (the other meaning in use)."""
    return to_double(customers, 0.0) * to_double(hours, 0.0)


def contains_text(col: Column, text: str) -> Column:
    """Case-insensitive substring match; a null value does not match."""
    return F.coalesce(F.contains(F.lower(col), F.lit(text.lower())), F.lit(False))
