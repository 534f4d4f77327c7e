"""Micro-batch sinks: arbitrary batch code, versioned tables, raw ingest.

Batch code may run again for the same batch after a failure. Every sink here writes
a batch to its own folder and replaces that folder on a rerun, so nothing doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.functions.scalars import moment
from eventloom.operators.versions import latest_version
from eventloom.storage import drop_partitions, overwrite_partitions, partition_values

DEFAULT_TRIGGER = {"processingTime": "10 seconds"}


def foreach_batch_sink(
    stream: DataFrame,
    fn: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    mode: str = "update",
) -> StreamingQuery:
    """Run ``fn(batch, batch_id)`` on each micro-batch; progress and state survive
    in ``checkpoint``. ``trigger`` holds the arguments of the writer's trigger."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DEFAULT_TRIGGER))
        .foreachBatch(fn)
        .start()
    )


def console_sink(
    stream: DataFrame, checkpoint: str, trigger: dict | None = None, mode: str = "update"
) -> StreamingQuery:
    """Print each micro-batch untruncated."""
    return (
        stream.writeStream.outputMode(mode)
        .format("console")
        .option("truncate", "false")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DEFAULT_TRIGGER))
        .start()
    )


def write_version(
    batch: DataFrame, path: str, batch_id: int, files: int | None = None
) -> None:
    """Store one micro-batch, replacing an earlier try.

    A stateful batch comes in as many pieces as there are state partitions; ``files``
    shuffles its (changed rows only) output into fewer files.
    """
    if files is not None:
        batch = batch.repartition(files)
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def versioned_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    files: int | None = None,
) -> StreamingQuery:
    """Keep every update as a new version of its key, see ``read_versions``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_version(batch, path, batch_id, files)

    return foreach_batch_sink(stream, write, checkpoint, trigger)


def read_versions(
    spark: SparkSession, path: str, keys: Sequence[str], since: tuple | None = None
) -> DataFrame:
    """Latest version per key; the last batch wins, also on equal update times."""
    versions = spark.read.parquet(path)
    if since is not None:
        column, bound = since
        versions = versions.where(F.col(column) >= moment(bound))
    return latest_version(versions, keys, "updated_at", tie="batch_id").drop("batch_id")


def fold_versions(
    spark: SparkSession, path: str, keys: Sequence[str], into: int, after: int = -1
) -> None:
    """Merge the versions of the batches from ``after`` (excluded) to ``into`` into the
    folder of ``into``.

    Keeps folders and superseded rows of a long-running table few. Ranges folded
    earlier need not be read again: the versions of a key lie in batches close to
    each other, and readers resolve the rest. ``into`` must be a batch that the
    stream has committed. Repeating a fold after a crash does no harm.
    """
    batches = [int(v) for v in partition_values(spark, path, "batch_id")]
    folded = [b for b in batches if after < b <= into]
    if not folded:
        return
    rows = spark.read.parquet(path).where(F.col("batch_id").isin(folded))
    latest = latest_version(rows, keys, "updated_at", tie="batch_id")
    overwrite_partitions(latest.withColumn("batch_id", F.lit(into)), path, "batch_id")
    drop_partitions(spark, path, "batch_id", [b for b in folded if b != into])


def ingest_events(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Decoded events to ``path/events``, unreadable messages to ``path/rejects``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Both writes share one read of the source; lost blocks are read again.
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            readable = F.col("bad_message").isNull()
            write_version(batch.where(readable).drop("bad_message"), f"{path}/events", batch_id)
            write_version(batch.where(~readable).select("bad_message"), f"{path}/rejects", batch_id)
        finally:
            batch.unpersist()

    return foreach_batch_sink(stream, write, checkpoint, trigger, mode="append")
