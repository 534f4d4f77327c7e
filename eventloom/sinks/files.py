"""File sinks: Parquet, the month-partitioned raw table, text lines, batched files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.scalars import month_number
from eventloom.operators.joins import comparable_columns

# Sort key of the raw table inside a month.
CLUSTER_KEYS = ("event_date", "event_name", "user_id")


def write_parquet(df: DataFrame, path: str) -> None:
    """Replace ``path`` with snappy Parquet."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", month_number(F.col("event_date")))


def cluster(df: DataFrame, files: int | None = None) -> DataFrame:
    """Range-partition by month and sort key, then sort each partition.

    Files cover narrow, non-overlapping key ranges, so row-group statistics skip
    data for filters on a prefix of the key. The range key goes on with the event
    time and a row hash: a month, day or user holding a large share of the rows is
    spread over several tasks instead of landing in one. Finding the ranges samples
    the input, which reads it once more; the later scans earn that back.

    There are as many ranges as shuffle partitions, which adaptive execution merges up to
    the advisory partition size, or as many as ``files`` says.
    """
    keys = [F.col("month"), *(F.col(k) for k in CLUSTER_KEYS)]
    spread = [*keys, F.col("event_time"), F.xxhash64(*comparable_columns(df))]
    ranged = df.repartitionByRange(files, *spread) if files else df.repartitionByRange(*spread)
    return ranged.sortWithinPartitions(*keys)


def write_raw_events(df: DataFrame, path: str, files: int | None = None) -> None:
    """Raw table: ``month`` partitions, rows clustered by date, event and user."""
    cluster(with_month(df), files).write.mode("overwrite").partitionBy("month").parquet(path)


def write_daily_lake(df: DataFrame, base: str) -> None:
    """Lake layout ``date=YYYY-MM-DD``, a busy day spread over several tasks."""
    daily = df.withColumn("date", F.col("event_date"))
    (
        daily.repartitionByRange("date", "event_time", F.xxhash64(*comparable_columns(df)))
        .write.mode("overwrite")
        .partitionBy("date")
        .parquet(base)
    )


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text line per row."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_batched(df: DataFrame, path: str, target_rows: int) -> None:
    """Few files of at most ``target_rows`` rows instead of one per small input piece.

    Rows are brought together to the advisory partition size; a task that then holds more
    rows than a file may starts the next one.
    """
    df.hint("rebalance").write.mode("append").option("maxRecordsPerFile", target_rows).parquet(path)
