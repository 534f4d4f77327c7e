"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from eventloom.storage import remove

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Window state lives on disk with changelog checkpoints, not on the executor heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every model here relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: what spark.checkpoint.dir names, else the session's
    own table folder. Neither is made up here, so nothing lands on one machine's disk
    unless the session says so."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/eventloom/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_dir(spark: SparkSession, label: str) -> Iterator[str]:
    """A path as above whose content goes when the block ends, also by an error."""
    path = new_dir(spark, label)
    try:
        yield path
    finally:
        remove(spark, path)
