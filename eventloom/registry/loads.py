"""Sources, typed loads and file sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.scalars import UUID_LAYOUT, uuid_from_digest
from eventloom.operators.rows import newest
from eventloom.registry.base import query, raw, table, with_ev
from eventloom.session import new_dir
from eventloom.sinks.files import (
    write_batched,
    write_daily_lake,
    write_lines,
    write_parquet,
    write_raw_events,
)
from eventloom.sources.events import (
    SOURCE_SCHEMAS,
    as_event_file,
    read_events,
    read_events_day,
    sources,
)
from eventloom.sources.load import load_raw_events, read_loaded
from eventloom.sources.seeds import load_seed
from eventloom.sources.streams import decode_events, events_from_sequence


@query("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS n_rows FROM {t}"
    for t in SOURCE_SCHEMAS
))
def named_sources(spark, sf_dir):
    counts = [
        frame.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, frame in sources(spark, sf_dir).items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


@query(with_ev("""
SELECT date_trunc('second', event_time) AS event_time, event_date, user_id, session_id,
       event_name, platform, CAST(price AS DECIMAL(12,2)) AS price, props_json
FROM ev"""))
def read_event_files(spark, sf_dir):
    path = new_dir(spark, "event-file")
    write_parquet(as_event_file(raw(spark, sf_dir)), path)
    return read_events(spark, path)


@query(with_ev("""
SELECT event_date AS date, event_name, platform, CAST(COUNT(*) AS BIGINT) AS events
FROM ev WHERE event_date = (SELECT MAX(event_date) FROM ev) GROUP BY ALL"""))
def event_lake_day(spark, sf_dir):
    base = new_dir(spark, "lake")
    events = raw(spark, sf_dir)
    write_daily_lake(events, base)
    day = read_events_day(spark, base, newest(events, "event_date"))
    return day.groupBy("date", "event_name", "platform").agg(F.count("*").alias("events"))


def _messy_event_file(spark, sf_dir):
    """Event file with text columns in which whole event types do not convert.

    Signups carry a text price, errors a bare digest as session and a negative
    user; all other rows are clean.
    """
    events = raw(spark, sf_dir)
    kind = F.col("event_name")
    return events.select(
        "event_id",
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_time"),
        F.when(kind == "error", -F.col("user_id") - 1)
        .otherwise(F.col("user_id"))
        .cast("string")
        .alias("user_id"),
        F.when(kind == "error", F.col("session_id"))
        .otherwise(uuid_from_digest(F.col("session_id")))
        .alias("session_id"),
        "event_name",
        "platform",
        F.when(kind == "signup", "abc").otherwise(F.col("price").cast("string")).alias("price"),
        "props_json",
    )


_UUID = " || '-' || ".join(
    f"substr(session_id, {start}, {length})"
    for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
)


@query(with_ev(f"""
SELECT event_date, date_trunc('millisecond', event_time) AS event_time, user_id,
       {_UUID} AS session_id, event_name, platform, CAST(price AS DECIMAL(12,2)) AS price, props_json,
       CAST(year(event_date) * 100 + month(event_date) AS INTEGER) AS month
FROM ev WHERE event_name NOT IN ('error', 'signup')"""))
def load_raw_table(spark, sf_dir):
    path = new_dir(spark, "load")
    load_raw_events(_messy_event_file(spark, sf_dir), f"{path}/events", f"{path}/rejects", "one")
    return read_loaded(spark, f"{path}/events").drop("load_id")


_REJECTS = f"""
SELECT event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S.%g') AS event_time,
       CAST(CASE event_name WHEN 'error' THEN -user_id - 1 ELSE user_id END AS VARCHAR) AS user_id,
       CASE event_name WHEN 'error' THEN session_id ELSE {_UUID} END AS session_id,
       event_name, platform,
       CASE event_name WHEN 'signup' THEN 'abc' ELSE CAST(price AS VARCHAR) END AS price,
       props_json,
       CASE event_name WHEN 'error' THEN 'user_id,session_id' ELSE 'price' END AS reject_reason
FROM ev WHERE event_name IN ('error', 'signup')"""


@query(with_ev(_REJECTS))
def load_rejects(spark, sf_dir):
    path = new_dir(spark, "load")
    load_raw_events(_messy_event_file(spark, sf_dir), f"{path}/events", f"{path}/rejects", "one")
    return read_loaded(spark, f"{path}/rejects").drop("load_id")


@query(with_ev("""
SELECT load_id, event_name, CAST(COUNT(*) AS BIGINT) AS n
FROM (SELECT unnest(['all', 'purchases']) AS load_id, event_name FROM ev) l
WHERE event_name NOT IN ('error', 'signup')
  AND (load_id = 'all' OR event_name = 'purchase') GROUP BY ALL"""))
def repeated_load(spark, sf_dir):
    """Two loads, the first one tried three times: what a repeat finds is replaced."""
    path = new_dir(spark, "load")
    events = _messy_event_file(spark, sf_dir)
    bought = events.where(F.col("event_name") == "purchase")
    for load_id, rows in (("all", bought), ("purchases", bought), ("all", events), ("all", events)):
        load_raw_events(rows, f"{path}/events", f"{path}/rejects", load_id)
    loaded = read_loaded(spark, f"{path}/events")
    return loaded.groupBy("load_id", "event_name").agg(F.count("*").alias("n"))


@query(with_ev("""
SELECT reject_reason, CAST(COUNT(*) AS BIGINT) AS n
FROM (SELECT CASE event_name WHEN 'error' THEN 'event_name' WHEN 'signup' THEN 'platform'
             ELSE 'props_json' END AS reject_reason
      FROM ev WHERE event_name IN ('error', 'signup', 'purchase')) GROUP BY ALL"""))
def load_rejects_nulls(spark, sf_dir):
    """Names, platforms and properties may not be NULL either."""
    path = new_dir(spark, "load")
    events = as_event_file(raw(spark, sf_dir))
    kind = F.col("event_name")
    events = events.withColumns(
        {
            "session_id": uuid_from_digest(F.col("session_id")),
            "event_name": F.when(kind != "error", kind),
            "platform": F.when(kind != "signup", F.col("platform")),
            "props_json": F.when(kind != "purchase", F.col("props_json")),
        }
    )
    load_raw_events(events, f"{path}/events", f"{path}/rejects", "one")
    rejects = read_loaded(spark, f"{path}/rejects")
    return rejects.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(with_ev("""
SELECT COUNT(*) AS rows, COUNT(*) AS sessions, TRUE AS all_uuids, TRUE AS one_time FROM ev"""))
def inserted_rows(spark, sf_dir):
    """Rows written with generated ids and the current time, as an INSERT would."""
    path = new_dir(spark, "insert")
    table(spark, sf_dir, "events").createOrReplaceTempView("insert_source")
    spark.sql("SELECT event_id, uuid() AS session_id, now() AS at FROM insert_source").write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.agg(
        F.count("*").alias("rows"),
        F.count_distinct("session_id").alias("sessions"),
        F.bool_and(F.col("session_id").rlike(UUID_LAYOUT)).alias("all_uuids"),
        (F.count_distinct("at") == 1).alias("one_time"),
    )


@query("""
SELECT COUNT(*) AS counted, COUNT(*) AS collected, MIN(event_id) AS first_id,
       CAST(SUM(event_id) AS BIGINT) AS reduced FROM events""")
def frame_actions(spark, sf_dir):
    """What the actions of a frame give: count, toLocalIterator, first, reduce by agg."""
    ids = table(spark, sf_dir, "events").select("event_id")
    # one row for each partition reaches the driver
    partials = ids.groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum("event_id"))
    parts = list(partials.toLocalIterator())
    row = (
        ids.count(),
        sum(r[1] for r in parts),
        ids.orderBy("event_id").first()[0],
        sum(r[2] for r in parts),
    )
    return spark.createDataFrame([row], "counted long, collected long, first_id long, reduced long")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def seed_load(spark, sf_dir):
    path = new_dir(spark, "seed")
    table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    return load_seed(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("""
SELECT ts AS event_time, event_id % 100000 AS user_id,
       sha256(CAST(event_id AS VARCHAR)) AS session_id,
       CASE event_id % 10 WHEN 0 THEN 'purchase' WHEN 1 THEN 'add_to_cart'
                          ELSE 'page_view' END AS event_name,
       CASE event_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'ios' ELSE 'android' END AS platform,
       event_id % 10 = 0 AS has_price, '{"nrt":"rate"}' AS props_json
FROM events""")
def sequence_events(spark, sf_dir):
    counter = table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_id").alias("value")
    )
    events = events_from_sequence(counter)
    return events.withColumn(
        "has_price", (F.col("event_name") == "purchase") & F.col("price").between(0, 500)
    ).drop("price")


@query(with_ev("""
SELECT CASE WHEN event_name IN ('error', 'signup') THEN NULL
            ELSE date_trunc('second', event_time) END AS event_time,
       CASE WHEN event_name = 'error' THEN NULL ELSE user_id END AS user_id,
       CASE WHEN event_name = 'error' THEN NULL ELSE session_id END AS session_id,
       CASE WHEN event_name = 'error' THEN NULL ELSE event_name END AS event_name,
       CASE WHEN event_name = 'error' THEN NULL ELSE platform END AS platform,
       CASE WHEN event_name = 'error' THEN NULL ELSE CAST(price AS DOUBLE) END AS price,
       CASE WHEN event_name = 'error' THEN NULL ELSE props_json END AS props_json,
       CASE WHEN event_name = 'error' THEN '{bad' ELSE NULL END AS bad_message
FROM ev"""))
def decode_messages(spark, sf_dir):
    """JSON messages as bytes; errors are broken JSON, signups have no valid time."""
    events = raw(spark, sf_dir)
    fields = as_event_file(events)
    time = F.when(F.col("event_name") == "signup", "zzz").otherwise(F.col("event_time"))
    fields = fields.withColumn("event_time", time)
    message = F.to_json(F.struct(*fields.columns))
    value = F.when(F.col("event_name") == "error", "{bad").otherwise(message).cast("binary")
    return decode_events(fields.select(value.alias("value")))


@query(with_ev("SELECT * FROM ev WHERE event_name = 'purchase'"))
def parquet_overwrite(spark, sf_dir):
    path = new_dir(spark, "overwrite")
    write_parquet(raw(spark, sf_dir), path)
    write_parquet(raw(spark, sf_dir, only=["purchase"]), path)
    return spark.read.parquet(path)


@query(with_ev("""
SELECT *, CAST(year(event_date) * 100 + month(event_date) AS INTEGER) AS month FROM ev"""))
def clustered_raw_table(spark, sf_dir):
    path = new_dir(spark, "raw")
    write_raw_events(raw(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("SELECT props AS line, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY props")
def text_lines(spark, sf_dir):
    path = new_dir(spark, "lines")
    write_lines(raw(spark, sf_dir), "props_json", path)
    lines = spark.read.text(path)
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT * FROM events")
def batched_files(spark, sf_dir):
    """Written as one piece for each user before, gathered into few files."""
    path = new_dir(spark, "batched")
    pieces = table(spark, sf_dir, "events").repartition("user_id")
    write_batched(pieces, path, target_rows=1_000_000)
    return spark.read.parquet(path)
