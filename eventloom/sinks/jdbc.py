"""Append to an external database table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    properties: Mapping[str, str] | None = None,
    connections: int | None = None,
    rows_per_insert: int = 10_000,
) -> None:
    """Append rows in batches, a connection for each task.

    ``connections`` bounds them where the database needs it; the stage that makes the rows
    then has no more tasks either.
    Struct columns have no JDBC type: flatten windows first. A retried task sends
    its rows again, so the target should keep the last version per key.
    """
    writer = (
        df.write.format("jdbc")
        .options(**(properties or {}))
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", rows_per_insert)
        .mode("append")
    )
    if connections is not None:
        writer = writer.option("numPartitions", connections)
    writer.save()
