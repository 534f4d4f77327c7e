"""Typed conversions and small column expressions, all JVM-side."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text layouts accepted for event times, besides ISO 8601 text.
TIME_LAYOUTS = (
    "dd.MM.yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
)
UUID_LAYOUT = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def moment(value: dt.datetime | dt.date | Column | None) -> Column:
    """A point in time as a constant column; None is now.

    A datetime without zone means session time (UTC) whatever the zone of the Python
    process, which a plain literal would go by.
    """
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    if not isinstance(value, dt.datetime):
        return F.lit(value)
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat()).cast("timestamp_ntz")


def parse_time(text: Column) -> Column:
    """Best-effort text to timestamp, cut to milliseconds; NULL if nothing fits.

    Digit-only text is read by its length: 8 a day, 10 Unix seconds, 13 Unix
    milliseconds, 14 a compact date and time. Any other digit-only text is no time.
    """
    text = F.trim(text)
    digits = text.rlike("^[0-9]+$")
    number = text.try_cast("bigint")
    length = F.length(text)
    from_digits = (
        F.when(length == 8, F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .when(length == 10, F.timestamp_seconds(number))
        .when(length == 13, F.timestamp_millis(number))
        .when(length == 14, F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))
    )
    from_layouts = F.coalesce(
        text.try_cast("timestamp"),
        *(F.try_to_timestamp(text, F.lit(layout)) for layout in TIME_LAYOUTS),
    )
    return F.date_trunc("MILLISECOND", F.when(digits, from_digits).otherwise(from_layouts))


def to_unsigned(value: Column) -> Column:
    """Non-negative bigint, or NULL."""
    number = value.try_cast("bigint")
    return F.when(number >= 0, number)


def to_uuid(text: Column) -> Column:
    """Lower-case 8-4-4-4-12 hex text, or NULL."""
    lowered = F.lower(F.trim(text))
    return F.when(lowered.rlike(UUID_LAYOUT), lowered)


def to_money(value: Column, precision: int = 12, scale: int = 2) -> Column:
    """Decimal, or NULL when the value is no number or too large."""
    return value.try_cast(f"decimal({precision},{scale})")


def uuid_from_digest(digest: Column) -> Column:
    """UUID-shaped text from the first 32 characters of a hex digest."""
    return F.regexp_replace(
        F.substring(digest, 1, 32),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )


def month_number(date: Column) -> Column:
    """Integer yyyymm of a date, the partition key of raw tables."""
    return F.year(date) * 100 + F.month(date)
