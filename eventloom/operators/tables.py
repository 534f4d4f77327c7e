"""Upkeep of month-partitioned Parquet tables: expiry, mutation, compaction, health.

Only the months concerned are read and written; months that lose all rows are
removed as folders.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sinks.files import cluster
from eventloom.storage import drop_partitions, overwrite_partitions, partition_values


def apply_ttl(
    spark: SparkSession, table: str, days: int, as_of: dt.date, column: str = "event_date"
) -> None:
    """Drop rows whose date plus ``days`` lies before ``as_of``; the bound day stays.

    Months that ended before the bound are removed without reading them, and the
    month of the bound is rewritten.
    """
    first_kept = as_of - dt.timedelta(days=days)
    bound_month = first_kept.year * 100 + first_kept.month
    months = [int(m) for m in partition_values(spark, table, "month")]
    drop_partitions(spark, table, "month", [m for m in months if m < bound_month])
    if bound_month in months and first_kept.day > 1:
        mutate(spark, table, F.col(column) < F.lit(first_kept), months=[bound_month])


def mutate(
    spark: SparkSession,
    table: str,
    predicate: Column,
    set_exprs: Mapping[str, Column] | None = None,
    months: list[int] | None = None,
) -> list[int]:
    """Update the matching rows with ``set_exprs``, or delete them without it.

    Returns the months that were touched. Rows where the predicate is NULL stay.
    Cluster keys of updated rows are sorted anew; the partition key ``month``
    follows the date only on load, so do not set ``event_date`` here.
    """
    rows = spark.read.parquet(table)
    if months is not None:
        rows = rows.where(F.col("month").isin(months))
    hit = F.coalesce(predicate, F.lit(False))
    # One row per month, so the result is bounded by the number of folders.
    found = (
        rows.groupBy("month")
        .agg(F.count_if(hit).alias("hits"), F.count("*").alias("rows"))
        .where(F.col("hits") > 0)
        .collect()
    )
    emptied = [r["month"] for r in found if not set_exprs and r["hits"] == r["rows"]]
    rewritten = [r["month"] for r in found if r["month"] not in emptied]
    if rewritten:
        affected = rows.where(reduce(or_, (F.col("month").eqNullSafe(m) for m in rewritten)))
        if set_exprs:
            types = dict(rows.dtypes)
            changed = affected.withColumns(
                {
                    name: F.when(hit, value).otherwise(F.col(name)).cast(types[name])
                    for name, value in set_exprs.items()
                }
            )
        else:
            changed = affected.where(~hit)
        overwrite_partitions(cluster(changed), table, "month")
    drop_partitions(spark, table, "month", emptied)
    return sorted(emptied + rewritten, key=lambda month: month or 0)


def drop_partition(spark: SparkSession, table: str, month: int) -> None:
    """Remove one month as a folder."""
    drop_partitions(spark, table, "month", [month])


def compact(spark: SparkSession, table: str, month: int, target_files: int | None = None) -> None:
    """Rewrite one month into few files in cluster order.

    The files have about the advisory partition size, or there are ``target_files`` at most.
    """
    rows = spark.read.parquet(table).where(F.col("month") == month)
    overwrite_partitions(cluster(rows, target_files), table, "month")


def file_health(df: DataFrame, partition: str = "month") -> DataFrame:
    """Files, rows and bytes per partition of a file-backed table.

    Rows are counted per file first; that takes the Parquet footers only.
    """
    per_file = df.groupBy(
        partition,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
    ).agg(F.count("*").alias("rows"))
    return per_file.groupBy(partition).agg(
        F.count("*").alias("files"),
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.min("rows").alias("smallest_file_rows"),
    )
