"""Typed load of event files into the raw table, with a rejects table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.scalars import parse_time, to_money, to_uuid, to_unsigned
from eventloom.operators.rows import with_event_date
from eventloom.session import scratch_dir
from eventloom.sinks.files import cluster, with_month
from eventloom.storage import partition_values

# Raw table columns in order.
RAW_COLUMNS = (
    "event_date", "event_time", "user_id", "session_id",
    "event_name", "platform", "price", "props_json",
)


def type_raw_events(df: DataFrame) -> DataFrame:
    """Add ``typed`` (the raw row) and ``reasons`` (columns that did not convert).

    NULL in any column is a failed conversion as well: the raw table has no nullable
    columns.
    """
    typed = df.withColumn(
        "typed",
        F.struct(
            parse_time(F.col("event_time").cast("string")).alias("event_time"),
            to_unsigned(F.col("user_id")).alias("user_id"),
            to_uuid(F.col("session_id")).alias("session_id"),
            "event_name",
            "platform",
            to_money(F.col("price")).alias("price"),
            "props_json",
        ),
    )
    flags = F.array(
        *(F.when(F.col(f"typed.{c}").isNull(), F.lit(c)) for c in RAW_COLUMNS if c != "event_date")
    )
    return typed.withColumn("reasons", F.array_compact(flags))


def split_raw_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows in raw layout, rejected rows as read with their reasons)."""
    typed = type_raw_events(df)
    good = with_event_date(typed.where(F.size("reasons") == 0).select("typed.*"))
    bad = typed.where(F.size("reasons") > 0).select(
        *df.columns, F.array_join("reasons", ",").alias("reject_reason")
    )
    return good.select(*RAW_COLUMNS), bad


def load_raw_events(df: DataFrame, table: str, rejects: str, load_id: str) -> bool:
    """Add good rows to ``table`` (month partitions, cluster order) and the rest to
    ``rejects``; returns whether there were any rejects.

    The input is read and parsed once, into a staged copy with good and bad rows apart;
    sampling for the cluster order then runs over typed rows. Rows carry their ``load_id``,
    which names the folder that holds its months: loading under the same id again, after a failure
    or by mistake, replaces what it wrote.
    """
    spark = df.sparkSession
    bad = F.size("reasons") > 0
    checked = type_raw_events(df).select(
        "typed",
        F.when(bad, F.struct(*df.columns)).alias("source"),
        F.array_join("reasons", ",").alias("reject_reason"),
        bad.cast("int").alias("bad"),
    )
    with scratch_dir(spark, "load") as staged:
        checked.write.partitionBy("bad").parquet(staged)
        rows = spark.read.schema(checked.schema).parquet(staged)
        good = with_event_date(rows.where(F.col("bad") == 0).select("typed.*"))
        good = with_month(good.select(*RAW_COLUMNS))
        _replace_load(cluster(good), table, load_id, "month")
        any_rejects = "1" in partition_values(spark, staged, "bad")
        rejected = rows.where(F.col("bad") == 1).select("source.*", "reject_reason")
        _replace_load(rejected, rejects, load_id)
    return any_rejects


def _replace_load(rows: DataFrame, table: str, load_id: str, *inside: str) -> None:
    """Write the folder of one load anew."""
    writer = rows.write.mode("overwrite")
    if inside:
        writer = writer.partitionBy(*inside)
    writer.parquet(f"{table}/load_id={load_id}")


def read_loaded(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    """Rows of all loads; ``load_id`` is text."""
    found = T.StructType.fromDDL(schema) if schema else spark.read.parquet(table).schema
    kinds = [f for f in found if f.name != "load_id"] + [T.StructField("load_id", T.StringType())]
    return spark.read.schema(T.StructType(kinds)).parquet(table)
