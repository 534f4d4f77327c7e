"""Named sources, event files and the raw event relation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.scalars import to_money

# The tables of a source folder, one Parquet file or folder each. The
# declared schema spares the footer read that inferring it would take.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# The event message and event file layout.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("props_json", T.StringType()),
    ]
)

# The allowed event names and platforms.
EVENT_NAMES = ["page_view", "add_to_cart", "purchase"]
PLATFORMS = ["web", "ios", "android"]

# Type of a test event -> event name; other types keep their name.
EVENT_NAME_OF_TYPE = {"view": "page_view", "click": "add_to_cart"}


def sources(
    spark: SparkSession, folder: str, tables: Iterable[str] = SOURCE_SCHEMAS
) -> dict[str, DataFrame]:
    """Raw tables by name, each also registered as a temp view."""
    frames = {
        name: spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
        for name in tables
    }
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return frames


def platform_of(sequence) -> F.Column:
    """Platform from a running number."""
    return (
        F.when(sequence % 3 == 0, "web").when(sequence % 3 == 1, "ios").otherwise("android")
    )


def raw_events(events: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Test events (event_id, ts, user_id, event_type, value, props) as raw events.

    ``only`` keeps the named events. It is turned into a filter on ``event_type``,
    which reaches the Parquet scan; a filter on the mapped name would not.
    """
    type_of_name = {name: kind for kind, name in EVENT_NAME_OF_TYPE.items()}
    if only is not None:
        events = events.where(F.col("event_type").isin([type_of_name.get(n, n) for n in only]))
    name = F.col("event_type")
    for kind, renamed in EVENT_NAME_OF_TYPE.items():
        name = F.when(F.col("event_type") == kind, renamed).otherwise(name)
    return events.select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.to_date("ts").alias("event_date"),
        "user_id",
        F.sha2(F.col("event_id").cast("string"), 256).alias("session_id"),
        name.alias("event_name"),
        platform_of(F.col("event_id")).alias("platform"),
        to_money(F.col("value")).alias("price"),
        F.col("props").alias("props_json"),
    )


def as_event_file(raw: DataFrame) -> DataFrame:
    """Raw events in the file layout: text time, double price, no derived columns."""
    return raw.select(
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        "user_id",
        "session_id",
        "event_name",
        "platform",
        F.col("price").cast("double").alias("price"),
        "props_json",
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files typed for aggregation; unreadable times and prices become NULL."""
    return (
        spark.read.schema(EVENT_SCHEMA)
        .parquet(path)
        .withColumns(
            {
                "event_time": F.col("event_time").try_cast("timestamp"),
                "price": to_money(F.col("price")),
            }
        )
        .withColumn("event_date", F.to_date("event_time"))
    )


def read_events_day(spark: SparkSession, base: str, day: dt.date | str) -> DataFrame:
    """One day of a lake laid out as ``date=YYYY-MM-DD`` folders.

    Only that folder is listed; basePath keeps ``date`` as a column.
    """
    return spark.read.option("basePath", base).parquet(f"{base}/date={day}")
