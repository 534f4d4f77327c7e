"""Slowly changing history: one row per version with valid_from and valid_to.

An open version has a NULL valid_to. A key that disappeared from the current state
has its open version closed. History and state meet in one full outer join on the
key, unique on both sides; NULL is a key like any other. A state with two rows of one key
is refused. Closed versions bypass the join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.scalars import moment
from eventloom.session import scratch_dir
from eventloom.storage import drop_partitions, overwrite_partitions, partition_values


def start_history(cur: DataFrame, valid_from: Column) -> DataFrame:
    """History of a first snapshot: every row open."""
    valid_from = valid_from.alias("valid_from")
    return cur.select("*", valid_from).withColumn(
        "valid_to", F.lit(None).cast(cur.select(valid_from).schema[0].dataType)
    )


def _one_per_key(cur: DataFrame, key: str) -> DataFrame:
    """``cur``; reading it fails if a key has two rows, which would open two versions."""
    rows = F.count("*").over(Window.partitionBy(key))
    message = F.concat(F.lit("two rows of one key: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    checked = cur.withColumn("_rows", rows)
    refused = F.when(F.col("_rows") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return checked.where(refused).drop("_rows")


def _advance(
    hist: DataFrame,
    cur: DataFrame,
    key: str,
    changed: Column,
    opened_at: Column,
    closed_at: Column,
) -> DataFrame:
    """Close and open versions; ``changed`` and the times see rows ``old`` and ``new``."""
    columns = [c for c in cur.columns if c != "_closed"]
    cur = _one_per_key(cur, key)
    old = hist.where(F.col("valid_to").isNull()).select(
        F.col(key).alias("_key"), F.struct(*hist.columns).alias("old")
    )
    new = cur.select(F.col(key).alias("_key"), F.struct(*cur.columns).alias("new"))
    time_type = hist.schema["valid_to"].dataType

    def version(side: str, start: Column, end: Column) -> Column:
        return F.struct(
            *(F.col(f"{side}.{c}").alias(c) for c in columns),
            start.cast(time_type).alias("valid_from"),
            end.cast(time_type).alias("valid_to"),
        )

    removed = F.col("new").isNull()
    added = F.col("old").isNull()
    replaced = ~removed & ~added & F.coalesce(changed, F.lit(False))
    open_end = F.lit(None)
    old_end = F.when(removed | replaced, closed_at)
    versions = F.array_compact(
        F.array(
            F.when(~added, version("old", F.col("old.valid_from"), old_end)),
            F.when(added | replaced, version("new", opened_at, open_end)),
        )
    )
    advanced = (
        old.join(new, old["_key"].eqNullSafe(new["_key"]), "full_outer")
        .select(F.explode(versions).alias("v"))
        .select("v.*")
    )
    closed = hist.where(F.col("valid_to").isNotNull())
    return closed.select(*columns, "valid_from", "valid_to").unionByName(advanced)


def scd2_timestamp(
    hist: DataFrame,
    cur: DataFrame,
    key: str,
    updated_at: str,
    as_of: dt.datetime | Column,
    closed: DataFrame | None = None,
) -> DataFrame:
    """New version when ``updated_at`` is newer; removed keys close at ``as_of``.

    A key that returns after its removal opens when it closed last, unless its update time
    is later, so versions never overlap. ``closed``: history with the closed versions, if
    ``hist`` has the open ones only, as in a step of ``advance_history``.
    """
    newer = F.col(f"new.{updated_at}") > F.col(f"old.{updated_at}")
    past = hist if closed is None else closed
    gone = past.where(F.col("valid_to").isNotNull()).groupBy(F.col(key).alias("_gone"))
    gone = gone.agg(F.max("valid_to").alias("_closed"))
    known = cur.join(gone, cur[key].eqNullSafe(gone["_gone"]), "left").drop("_gone")
    return _advance(
        hist,
        known,
        key,
        changed=newer,
        opened_at=F.greatest(F.col(f"new.{updated_at}"), F.col("new._closed")),
        closed_at=F.coalesce(F.col(f"new.{updated_at}"), moment(as_of)),
    )


def scd2_check(
    hist: DataFrame,
    cur: DataFrame,
    key: str,
    columns: Sequence[str],
    as_of: dt.datetime | Column,
) -> DataFrame:
    """New version at ``as_of`` when any of ``columns`` differs; NULL equals NULL."""
    differs = F.lit(False)
    for column in columns:
        differs = differs | ~F.col(f"new.{column}").eqNullSafe(F.col(f"old.{column}"))
    return _advance(
        hist, cur, key, changed=differs, opened_at=moment(as_of), closed_at=moment(as_of)
    )


def create_history(cur: DataFrame, path: str, valid_from: Column) -> None:
    """History table of a first snapshot, see ``advance_history``."""
    first = start_history(cur, valid_from).withColumn("closed_in", F.lit("open"))
    first.write.mode("overwrite").partitionBy("closed_in").parquet(path)


def advance_history(
    spark: SparkSession,
    path: str,
    cur: DataFrame,
    run_id: str,
    step: Callable[[DataFrame, DataFrame], DataFrame],
) -> None:
    """Apply one snapshot to a stored history; ``step`` is one of the scd2 functions.

    The table has a folder of open versions and one folder per run with the versions
    it closed. Only the open folder is read and replaced, so a run costs as much as
    the current state, however long the history. Closed versions are stored before
    the open ones are replaced: a run that failed in between can be repeated under
    the same ``run_id``, and repeating a finished one changes nothing.
    """
    is_open = F.col("closed_in") == "open"
    history = read_history(spark, path)
    label = F.when(F.col("valid_to").isNull(), "open").otherwise(F.lit(run_id))
    with scratch_dir(spark, "history") as staged:
        advanced = step(history.where(is_open).drop("closed_in"), cur)
        advanced.withColumn("closed_in", label).write.partitionBy("closed_in").parquet(staged)
        advanced = spark.read.schema(history.schema).parquet(staged)
        overwrite_partitions(advanced.where(~is_open), path, "closed_in")
        if "open" in partition_values(spark, staged, "closed_in"):
            overwrite_partitions(advanced.where(is_open), path, "closed_in")
        else:
            drop_partitions(spark, path, "closed_in", ["open"])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A stored history; ``closed_in`` is text, whatever the run ids look like."""
    found = spark.read.parquet(path).schema
    kinds = [T.StructField("closed_in", T.StringType()) if f.name == "closed_in" else f for f in found]
    return spark.read.schema(T.StructType(kinds)).parquet(path)
