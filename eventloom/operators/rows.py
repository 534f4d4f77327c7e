"""Row-wise operators: filters relative to a moment, flattening, keys, partitions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.functions.scalars import moment, month_number


def newest(df: DataFrame, column: str):
    """Greatest value of a column, as a driver-side scalar (one row).

    An instant comes as session time (UTC) without zone, see ``moment``.
    """
    return scalar(df, F.max(column))


def scalar(df: DataFrame, aggregate: Column):
    found = df.agg(aggregate.alias("value"))
    if found.dtypes[0][1] == "timestamp":
        found = found.select(F.col("value").cast("timestamp_ntz"))
    return found.first()[0]


def trailing(
    df: DataFrame, column: str, hours: int, as_of: dt.datetime | Column | None = None
) -> DataFrame:
    """Rows not older than ``hours`` before ``as_of`` (bound included, default now).

    The bound is a constant, so the filter reaches the Parquet scan.
    """
    bound = moment(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return df.where(F.col(column) >= bound)


def trailing_days(
    df: DataFrame, column: str, days: int, as_of: dt.date | dt.datetime | Column | None = None
) -> DataFrame:
    """Rows whose date is not before ``as_of`` minus ``days`` (bound included)."""
    return df.where(F.col(column) >= F.date_sub(F.to_date(moment(as_of)), days))


def month_filter(df: DataFrame, days: int, as_of: dt.date | dt.datetime | Column | None = None):
    """Drop whole ``month`` partitions older than the trailing days.

    Spark does not derive this from a date filter; add it next to ``trailing_days``.
    """
    first_day = F.date_sub(F.to_date(moment(as_of)), days)
    return df.where(F.col("month") >= month_number(first_day))


def with_event_date(df: DataFrame) -> DataFrame:
    """Fill ``event_date`` from the event time where it is not given."""
    derived = F.to_date("event_time")
    if "event_date" in df.columns:
        derived = F.coalesce(F.col("event_date"), derived)
    return df.withColumn("event_date", derived)


def explode_items(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """One row per array element; rows with an empty or NULL array disappear."""
    return df.select("*", F.explode(items).alias(name))


def key_by(df: DataFrame, key: Column) -> DataFrame:
    """(key, row) pairs."""
    return df.select(key.alias("key"), F.struct(*df.columns).alias("row"))


def map_partitions(
    df: DataFrame, fn: Callable[[Iterator], Iterator], schema: StructType | str
) -> DataFrame:
    """Apply ``fn`` to each partition's iterator of Arrow record batches.

    The partition is streamed batch by batch and never held whole in Python.
    """
    return df.mapInArrow(fn, schema)


def flatten_window(df: DataFrame, window: str, as_of: Column | None = None) -> DataFrame:
    """Replace a window struct by its two bounds and stamp the row."""
    rest = [c for c in df.columns if c != window]
    return df.select(
        F.col(f"{window}.start").alias("window_start"),
        F.col(f"{window}.end").alias("window_end"),
        *rest,
        (F.current_timestamp() if as_of is None else as_of).alias("updated_at"),
    )
