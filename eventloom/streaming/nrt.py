"""Near-real-time revenue per minute and platform.

Exact buyers per minute need a distinct count, which a streaming aggregate does
not offer, and a set of buyers per group would be one growing state row. Here the
state is one small row per (minute, platform, buyer): it is spread by buyer, so a
minute or platform with most of the traffic is spread as well, and the watermark
bounds it. Rows that are no purchase share the NULL buyer. The sink keeps every
update as a version, and a reader rolls the latest versions up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.functions.aggregates import count_if, is_purchase, purchase_metrics, sum_if
from eventloom.operators.rows import flatten_window, scalar
from eventloom.sinks.streams import (
    fold_versions,
    foreach_batch_sink,
    read_versions,
    write_version,
)

WATERMARK = "10 minutes"
WINDOW = "1 minute"

BUYER_KEYS = ("window_start", "window_end", "platform", "buyer")
TOTAL_KEYS = ("window_start", "window_end", "platform")


def with_watermark(df: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return df.withWatermark("event_time", delay)


def minute(size: str = WINDOW) -> Column:
    return F.window("event_time", size).alias("w")


def nrt_revenue_1m(
    events: DataFrame, exact: bool = True, rsd: float = 0.05, as_of: Column | None = None
) -> DataFrame:
    """Revenue, purchases and buyers per minute and platform.

    Exact on batch input. On a stream use ``exact=False`` (buyers by sketch, state
    of fixed size per group) or ``nrt_stream`` for exact buyers.
    """
    if exact and events.isStreaming:
        raise ValueError("exact buyers on a stream: use nrt_stream")
    metrics = purchase_metrics("_1m")
    if not exact:
        buyers = F.approx_count_distinct(F.when(is_purchase(), F.col("user_id")), rsd)
        metrics[-1] = buyers.alias("buyers_1m")
    grouped = with_watermark(events) if events.isStreaming else events
    return flatten_window(grouped.groupBy(minute(), "platform").agg(*metrics), "w", as_of)


def buyer_revenue(events: DataFrame) -> DataFrame:
    """The same by buyer: the partial result that streams exactly.

    Revenue keeps the type of its sum; it is rounded once, in the total.
    """
    grouped = with_watermark(events) if events.isStreaming else events
    partial = grouped.groupBy(
        minute(), "platform", F.when(is_purchase(), F.col("user_id")).alias("buyer")
    ).agg(
        sum_if(F.col("price"), is_purchase()).alias("revenue"),
        count_if(is_purchase()).alias("purchases"),
    )
    return flatten_window(partial, "w")


def roll_up(partial: DataFrame) -> DataFrame:
    """One row per minute and platform from latest buyer rows."""
    return partial.groupBy(*TOTAL_KEYS).agg(
        F.sum("revenue").cast("decimal(18,2)").alias("revenue_1m"),
        F.sum("purchases").alias("purchases_1m"),
        F.count("buyer").alias("buyers_1m"),
        F.max("updated_at").alias("updated_at"),
    )


def nrt_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    emit: Callable[[DataFrame, int], None] | None = None,
    files: int | None = None,
    fold_every: int | None = 32,
) -> StreamingQuery:
    """Run the exact stream into a versioned table at ``path``.

    Every ``fold_every`` micro-batches the versions written since the last fold become one
    folder, so that there is one for so many batches instead of one for each.

    With ``emit`` each micro-batch also hands on the new totals of the groups it
    changed, for a database or console. They are read back from the open minutes of
    the table, pre-aggregated, then reduced to the changed groups.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_version(batch, path, batch_id, files)
        if emit is not None:
            emit(changed_totals(batch.sparkSession, path, batch_id), batch_id)
        if fold_every and batch_id and batch_id % fold_every == 0:
            # up to the batch before: this one may still be repeated
            fold_versions(
                batch.sparkSession, path, BUYER_KEYS, batch_id - 1, batch_id - 1 - fold_every
            )

    return foreach_batch_sink(buyer_revenue(events), write, checkpoint, trigger)


def nrt_read(spark: SparkSession, path: str) -> DataFrame:
    """Totals over the latest versions of the table."""
    return roll_up(read_versions(spark, path, BUYER_KEYS))


def changed_totals(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """New totals of the groups that micro-batch ``batch_id`` updated."""
    versions = spark.read.parquet(path)
    batch = versions.where(F.col("batch_id") == batch_id)
    first = scalar(batch, F.min("window_start"))
    if first is None:
        return roll_up(batch)
    # Versions only come for minutes the watermark has not closed, so the range
    # from the earliest changed minute on is short; it prunes by row group.
    recent = read_versions(spark, path, BUYER_KEYS, since=("window_start", first))
    touched = batch.select(*TOTAL_KEYS).distinct()
    return roll_up(recent).join(touched, list(TOTAL_KEYS), "left_semi")
