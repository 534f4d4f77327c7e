"""Minute revenue as batch query and as stream; streaming ingest.

Streams read the same event files, run until the input is used up, and their stored
result is compared with the batch form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators.rows import newest
from eventloom.registry.base import query, raw, table, with_ev
from eventloom.session import new_dir
from eventloom.sinks.streams import ingest_events, read_versions, versioned_sink
from eventloom.sources.events import SOURCE_SCHEMAS, as_event_file, raw_events
from eventloom.sources.streams import decode_events
from eventloom.streaming import nrt
from eventloom.streaming import totals as minutes

_MINUTES = with_ev("""
SELECT time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start,
       time_bucket(INTERVAL 1 MINUTE, event_time) + INTERVAL 1 MINUTE AS window_end, platform,
       CAST(COALESCE(SUM(price) FILTER (event_name = 'purchase'), 0) AS DECIMAL(18,2)) AS revenue_1m,
       CAST(COUNT(*) FILTER (event_name = 'purchase') AS BIGINT) AS purchases_1m,
       CAST(COUNT(DISTINCT user_id) FILTER (event_name = 'purchase') AS BIGINT) AS buyers_1m
FROM ev GROUP BY ALL""")

UNTIL_DONE = {"availableNow": True}


def event_stream(spark, sf_dir):
    """The folder's events as a stream of raw events with a watermark-able time."""
    # As a pattern the path may name a file or a folder of files.
    reader = spark.readStream.schema(SOURCE_SCHEMAS["events"])
    files = reader.parquet(f"{sf_dir}/events.parque[t]")
    return raw_events(files).withColumn("event_time", F.col("event_time").cast("timestamp"))


@query(_MINUTES)
def nrt_revenue_1m(spark, sf_dir):
    return nrt.nrt_revenue_1m(raw(spark, sf_dir)).drop("updated_at")


@query(_MINUTES)
def nrt_revenue_stream(spark, sf_dir):
    path = new_dir(spark, "nrt")
    nrt.nrt_stream(
        event_stream(spark, sf_dir), f"{path}/table", f"{path}/checkpoint", UNTIL_DONE
    ).awaitTermination()
    return nrt.nrt_read(spark, f"{path}/table").drop("updated_at")


@query(with_ev("""
SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, platform,
       CAST(COALESCE(SUM(price) FILTER (event_name = 'purchase'), 0) AS DECIMAL(18,2))
         AS revenue_1m,
       CAST(COUNT(*) FILTER (event_name = 'purchase') AS BIGINT) AS purchases_1m,
       TRUE AS buyers_are_close
FROM (SELECT *, time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start FROM ev) e
GROUP BY ALL"""))
def nrt_revenue_approx_stream(spark, sf_dir):
    """Buyers by sketch: each group's estimate lies within a tenth, or one, of the truth."""
    path = new_dir(spark, "nrt-approx")
    updates = nrt.nrt_revenue_1m(event_stream(spark, sf_dir), exact=False, rsd=0.02)
    versioned_sink(updates, f"{path}/table", f"{path}/checkpoint", UNTIL_DONE).awaitTermination()
    found = read_versions(spark, f"{path}/table", nrt.TOTAL_KEYS).drop("updated_at")
    events = raw(spark, sf_dir).withColumn("event_time", F.col("event_time").cast("timestamp"))
    exact = nrt.nrt_revenue_1m(events).select(*nrt.TOTAL_KEYS, F.col("buyers_1m").alias("buyers"))
    both = found.join(exact, list(nrt.TOTAL_KEYS), "left")
    close = F.abs(F.col("buyers_1m") - F.col("buyers")) <= F.greatest(F.lit(1), F.col("buyers") / 10)
    return both.withColumn("buyers_are_close", close).drop("buyers_1m", "buyers")


def _parts(spark, sf_dir):
    """Four quarters of the events, by their ids and so by their times."""
    events = table(spark, sf_dir, "events")
    quarter = F.floor(F.col("event_id") * 4 / (newest(events, "event_id") + 1))
    return [events.where(quarter == n) for n in range(4)]


@query(_MINUTES)
def nrt_restarted_stream(spark, sf_dir):
    """Events arrive in four portions; the stream ends after each and goes on from there."""
    path = new_dir(spark, "nrt-restart")
    for part in _parts(spark, sf_dir):
        _arrive_and_run(spark, path, part)
    return nrt.nrt_read(spark, f"{path}/table").drop("updated_at")


@query(with_ev("""
SELECT time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start,
       time_bucket(INTERVAL 1 MINUTE, event_time) + INTERVAL 1 MINUTE AS window_end, platform,
       CAST(COALESCE(SUM(price) FILTER (event_name = 'purchase'), 0) AS DECIMAL(18,2))
         AS revenue_1m,
       CAST(COUNT(*) FILTER (event_name = 'purchase') AS BIGINT) AS purchases_1m,
       CAST(COUNT(DISTINCT user_id) FILTER (event_name = 'purchase') AS BIGINT) AS buyers_1m
FROM ev WHERE floor(event_id * 4 / ((SELECT MAX(event_id) FROM ev) + 1)) >= 2 GROUP BY ALL"""))
def nrt_late_rows(spark, sf_dir):
    """The third and fourth quarter, then the first: it comes after the watermark and is
    left out."""
    path = new_dir(spark, "nrt-late")
    parts = _parts(spark, sf_dir)
    for n in (2, 3, 0):
        _arrive_and_run(spark, path, parts[n])
    return nrt.nrt_read(spark, f"{path}/table").drop("updated_at")


def _arrive_and_run(spark, path, part):
    """One more portion of files, and a run of the stream until they are used up."""
    part.write.mode("append").parquet(f"{path}/in")
    files = spark.readStream.schema(SOURCE_SCHEMAS["events"]).parquet(f"{path}/in")
    stream = raw_events(files).withColumn("event_time", F.col("event_time").cast("timestamp"))
    nrt.nrt_stream(stream, f"{path}/table", f"{path}/checkpoint", UNTIL_DONE).awaitTermination()


def _feed_totals(spark, path, part, **settings):
    """As above, with the operator that hands on totals."""
    part.write.mode("append").parquet(f"{path}/in")
    files = spark.readStream.schema(SOURCE_SCHEMAS["events"]).parquet(f"{path}/in")
    stream = raw_events(files).withColumn("event_time", F.col("event_time").cast("timestamp"))
    minutes.totals_stream(stream, path, f"{path}/checkpoint", UNTIL_DONE, **settings).awaitTermination()


@query(_MINUTES)
def nrt_totals_stream(spark, sf_dir):
    """Totals as the stateful operator hands them on, in two portions with a restart between."""
    path = new_dir(spark, "totals")
    parts = _parts(spark, sf_dir)
    _feed_totals(spark, path, parts[0].unionByName(parts[1]))
    _feed_totals(spark, path, parts[2].unionByName(parts[3]))
    return minutes.read_totals(spark, path).drop("updated_at")


_KEPT_AND_LATE = """
WITH e AS (
  SELECT ev.*, event_time < (SELECT MAX(event_time) FROM ev) - INTERVAL 12 MINUTE
               AND floor(event_id * 4 / ((SELECT MAX(event_id) FROM ev) + 1)) < 2 AS late
  FROM ev)
SELECT 'minute' AS kind, time_bucket(INTERVAL 1 MINUTE, event_time) AS at, platform,
       CAST(NULL AS BIGINT) AS event_id,
       CAST(COALESCE(SUM(price) FILTER (event_name = 'purchase'), 0) AS DECIMAL(18,2)) AS money,
       CAST(COUNT(DISTINCT user_id) FILTER (event_name = 'purchase') AS BIGINT) AS buyers
FROM e WHERE NOT late GROUP BY 2, 3
UNION ALL
SELECT 'late', event_time, platform, event_id, CAST(price AS DECIMAL(18,2)), NULL FROM e WHERE late"""


@query(with_ev(_KEPT_AND_LATE))
def nrt_kept_and_late(spark, sf_dir):
    """The later half, then the earlier one: it comes late and goes to a table of its own.

    Buyers of a minute are dealt to three operators.
    """
    path = new_dir(spark, "late")
    parts = _parts(spark, sf_dir)
    _feed_totals(spark, path, parts[2].unionByName(parts[3]), parts=3)
    _feed_totals(spark, path, parts[0], parts=3)
    _feed_totals(spark, path, parts[1], parts=3)
    kept = minutes.read_totals(spark, path).select(
        F.lit("minute").alias("kind"), F.col("window_start").alias("at"), "platform",
        F.lit(None).cast("long").alias("event_id"), F.col("revenue_1m").alias("money"),
        F.col("buyers_1m").alias("buyers"),
    )
    late = minutes.read_late(spark, path).select(
        F.lit("late").alias("kind"), F.col("event_time").alias("at"), "platform", "event_id",
        F.col("price").cast("decimal(18,2)").alias("money"), F.lit(None).cast("long").alias("buyers"),
    )
    return kept.unionByName(late)


@query(with_ev("""
SELECT date_trunc('second', event_time) AS event_time, user_id, session_id, event_name,
       platform, CAST(price AS DOUBLE) AS price, props_json
FROM ev WHERE event_name <> 'error'"""))
def ingested_events(spark, sf_dir):
    """JSON messages as a topic delivers them; errors are broken and go to rejects."""
    path = new_dir(spark, "ingest")
    events = as_event_file(event_stream(spark, sf_dir))
    message = F.to_json(F.struct(*events.columns))
    value = F.when(F.col("event_name") == "error", "{bad").otherwise(message).cast("binary")
    messages = events.select(value.alias("value"))
    ingest_events(
        decode_events(messages), path, f"{path}/checkpoint", UNTIL_DONE
    ).awaitTermination()
    return spark.read.parquet(f"{path}/events").drop("batch_id")
