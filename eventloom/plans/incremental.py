"""Materializations: views, tables, incremental builds, summing aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from eventloom.functions.scalars import moment
from eventloom.operators.rows import newest
from eventloom.operators.versions import summing_merge
from eventloom.plans.marts import daily_purchase_revenue
from eventloom.session import scratch_dir
from eventloom.storage import (
    drop_partitions,
    exists,
    overwrite_partitions,
    partition_values,
)


def materialize_view(df: DataFrame, name: str) -> DataFrame:
    """A named view, computed anew at each read."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def materialize_table(df: DataFrame, path: str) -> DataFrame:
    """A stored result, replaced on every build."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _by_folder(df: DataFrame, partition: str) -> DataFrame:
    """Bring the rows of a folder together, so that not every task writes to all.

    Adaptive execution merges small folders into one task and splits large ones.
    """
    return df.hint("rebalance", partition)


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table as it was written: values of folders keep the declared types.

    Also a table without any file, which names no schema itself, can be read.
    """
    return spark.read.schema(schema).parquet(path)


def _in_type(spark: SparkSession, values: list[str], kind: DataType) -> list:
    """Texts of folder names as values of a column's type."""
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in frame.select(F.col("v").cast(kind)).collect()]


def incremental_append(
    spark: SparkSession,
    src: DataFrame,
    path: str,
    cursor: str,
    partition: str | None = None,
    full_refresh: bool = False,
) -> DataFrame:
    """Append source rows above the stored high-water mark of ``cursor``.

    ``partition`` names a column that grows with the cursor, such as its date. The
    table is then laid out by it, and the mark is looked up in the newest folder
    only; the source is cut at that folder as well. The mark is a constant in the
    filter and prunes the source scan. Rows that arrive late, below the mark, are
    missed: rebuild their days instead. A table without rows has no mark.
    """
    mode, new = "overwrite", src
    if not full_refresh and exists(spark, path):
        mode, stored = "append", _stored(spark, path, src.schema)
        if partition is not None:
            # one name per folder
            folders = _in_type(
                spark, partition_values(spark, path, partition), src.schema[partition].dataType
            )
            if folders:
                last = F.lit(max(folders)).cast(src.schema[partition].dataType)
                stored = stored.where(F.col(partition) == last)
                new = new.where(F.col(partition) >= last)
        mark = newest(stored, cursor)
        if mark is not None:
            new = new.where(F.col(cursor) > moment(mark))
    if partition is None:
        new.write.mode(mode).parquet(path)
    else:
        _by_folder(new, partition).write.mode(mode).partitionBy(partition).parquet(path)
    return _stored(spark, path, src.schema)


def incremental_rebuild(
    spark: SparkSession,
    src: DataFrame,
    path: str,
    model: Callable[[DataFrame], DataFrame],
    partition: str,
    since=None,
    full_refresh: bool = False,
) -> DataFrame:
    """Recompute the model's partitions from ``since`` on and replace exactly those.

    ``partition`` is a column of the source and of the model. A stored partition
    in the range for which the model gives no rows any more is removed.
    """
    first_build = full_refresh or since is None or not exists(spark, path)
    if first_build:
        schema = model(src).schema
        built = _by_folder(model(src), partition)
        built.write.mode("overwrite").partitionBy(partition).parquet(path)
        return _stored(spark, path, schema)
    rebuilt = model(src.where(F.col(partition) >= F.lit(since)))
    kind = rebuilt.schema[partition].dataType
    with scratch_dir(spark, "rebuild") as staged:
        # The model runs once; what it wrote tells which partitions it has, folder by folder.
        _by_folder(rebuilt, partition).write.partitionBy(partition).parquet(staged)
        written = set(partition_values(spark, staged, partition))
        stored = partition_values(spark, path, partition)
        bound = _in_type(spark, [str(since)], kind)[0]
        in_range = [v for v, typed in zip(stored, _in_type(spark, stored, kind)) if typed >= bound]
        if written:
            overwrite_partitions(_stored(spark, staged, rebuilt.schema), path, partition)
        drop_partitions(spark, path, partition, set(in_range) - written)
    return _stored(spark, path, rebuilt.schema)


REVENUE_KEYS = ("event_date", "platform")


def mv_apply(batch: DataFrame, target: str, batch_id: int) -> None:
    """Add the partial daily revenue of one insert block to the summing target.

    The block has its own folder, so applying it again replaces it.
    """
    daily_purchase_revenue(batch).write.mode("overwrite").parquet(
        f"{target}/blocks/batch_id={batch_id}"
    )


def _folded_through(spark: SparkSession, target: str) -> int | None:
    """Last block contained in the newest complete base folder."""
    if not exists(spark, f"{target}/base"):
        return None
    bases = [int(v) for v in partition_values(spark, f"{target}/base", "through")]
    done = [b for b in bases if exists(spark, f"{target}/base/through={b}/_SUCCESS")]
    return max(done, default=None)


def mv_read(spark: SparkSession, target: str, last: int | None = None) -> DataFrame:
    """Daily revenue over all blocks applied so far, or up to block ``last``."""
    rows = spark.read.parquet(f"{target}/blocks")
    if last is not None:
        rows = rows.where(F.col("batch_id") <= last)
    through = _folded_through(spark, target)
    if through is not None:
        base = spark.read.parquet(f"{target}/base/through={through}")
        rows = rows.where(F.col("batch_id") > through).drop("batch_id").unionByName(base)
    return summing_merge(rows, REVENUE_KEYS, ["revenue"])


def mv_fold(spark: SparkSession, target: str, through: int) -> None:
    """Merge the blocks up to ``through`` into one base, to keep folders few.

    Readers switch to the base once it is complete and then skip the blocks it
    contains, so a crash at any point counts nothing twice. ``through`` must be a
    block that will not be applied again; a base that holds it already stays as it is.
    """
    folded = _folded_through(spark, target)
    if folded is not None and through <= folded:
        return
    merged = mv_read(spark, target, last=through)
    merged.write.mode("overwrite").parquet(f"{target}/base/through={through}")
    bases = partition_values(spark, f"{target}/base", "through")
    drop_partitions(spark, f"{target}/base", "through", [b for b in bases if int(b) != through])
    blocks = partition_values(spark, f"{target}/blocks", "batch_id")
    # The newest folded block stays, so that the folder keeps a schema to read.
    drop_partitions(spark, f"{target}/blocks", "batch_id", [b for b in blocks if int(b) < through])
