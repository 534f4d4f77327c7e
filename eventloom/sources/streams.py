"""Event streams: counter source, Kafka topic, JSON decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.events import EVENT_SCHEMA, platform_of

# Properties, user ids and prices below a bound of a numbered event.
RATE_PROPS = '{"nrt":"rate"}'
USERS, PRICES = 100_000, 500


def events_from_sequence(df: DataFrame, seed: int = 7) -> DataFrame:
    """(timestamp, value) rows as events; works on batch and stream input."""
    value = F.col("value")
    name = (
        F.when(value % 10 == 0, "purchase")
        .when(value % 10 == 1, "add_to_cart")
        .otherwise("page_view")
    )
    return df.select(
        F.col("timestamp").alias("event_time"),
        (value % USERS).cast("long").alias("user_id"),
        F.sha2(value.cast("string"), 256).alias("session_id"),
        name.alias("event_name"),
        platform_of(value).alias("platform"),
        F.when(name == "purchase", F.rand(seed) * PRICES).otherwise(0.0).alias("price"),
        F.lit(RATE_PROPS).alias("props_json"),
    )


def rate_events(spark: SparkSession, rows_per_second: int = 50) -> DataFrame:
    """Endless self-made event stream, for runs without outside systems."""
    counter = (
        spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    )
    return events_from_sequence(counter)


def kafka_events(
    spark: SparkSession,
    bootstrap: str,
    topic: str,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """Events of a Kafka topic (needs Spark's Kafka connector on the class path).

    ``max_offsets_per_trigger`` bounds a micro-batch when catching up.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    if max_offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return decode_events(reader.load())


def decode_events(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages (text or bytes) as event columns plus ``bad_message``.

    A field that does not convert is NULL. ``bad_message`` holds the whole text
    when no field could be read, else NULL.
    """
    text = F.col(value).cast("string")
    fields = [f"v.{f.name}" for f in EVENT_SCHEMA]
    empty = F.coalesce(*(F.col(f).cast("string") for f in fields)).isNull()
    return (
        df.select(F.from_json(text, EVENT_SCHEMA).alias("v"), text.alias("message"))
        .withColumn("bad_message", F.when(empty, F.coalesce("message", F.lit(""))))
        .select("v.*", "bad_message")
        .withColumn("event_time", F.col("event_time").try_cast("timestamp"))
    )
