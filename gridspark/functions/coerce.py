"""Tolerant conversions: bad input becomes null (or a given value), never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_double(col: Column, fill: float | None = None) -> Column:
    """Numeric coercion of a string or number; ``fill`` replaces what cannot be read."""
    value = col.try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if fill is None else F.coalesce(value, F.lit(float(fill)))


def to_utc(col: Column) -> Column:
    """Parse to a zone-free UTC timestamp; strings may carry an offset."""
    parsed = col.try_cast("timestamp")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), parsed.cast("timestamp_ntz"))


def unquote(col: Column) -> Column:
    """Trim blanks, then surrounding double quotes."""
    return F.regexp_replace(F.trim(col), '^"+|"+$', "")


def blank_to_null(col: Column) -> Column:
    text = F.trim(col)
    return F.when(text != "", text)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of raising on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100.0


def correlation(a: Column, b: Column) -> Column:
    """Correlation over the rows that have both values: null below two, NaN where one of them does not vary.

    The built-in one divides by zero there, an error in ANSI mode.
    """
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(x) > 1, F.when(flat, F.lit(float("nan"))).otherwise(r))
