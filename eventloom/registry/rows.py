"""Projections, predicates, scalar functions, sorting, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.scalars import (
    month_number,
    parse_time,
    to_money,
    to_unsigned,
    to_uuid,
    uuid_from_digest,
)
from eventloom.operators.rows import (
    explode_items,
    key_by,
    map_partitions,
    newest,
    trailing,
    with_event_date,
)
from eventloom.plans.incremental import materialize_view
from eventloom.plans.marts import fct_daily_revenue, latest_mart_rows, stg_events
from eventloom.registry.base import query, raw, table, with_ev


@query(with_ev("""
SELECT event_time, event_date, user_id, session_id, event_name, platform,
       CAST(price AS DECIMAL(12,2)) AS price, props_json
FROM ev"""))
def staging_events(spark, sf_dir):
    return materialize_view(stg_events(raw(spark, sf_dir)), "stg_events")


@query("SELECT event_id AS id, user_id AS who, value * 2 AS doubled FROM events")
def computed_columns(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return (
        events.withColumnRenamed("event_id", "id")
        .withColumn("doubled", F.col("value") * 2)
        .select("id", F.col("user_id").alias("who"), "doubled")
    )


@query("""
SELECT event_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start,
       time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end,
       event_type AS kind, value AS amount
FROM events""")
def struct_expansion(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select(
        "event_id",
        F.window("ts", "1 minute").alias("w"),
        F.struct(F.col("event_type").alias("kind"), F.col("value").alias("amount")).alias("v"),
    )
    return nested.select(
        "event_id",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "v.*",
    )


@query("""
SELECT event_id,
       CASE WHEN event_type = 'click' THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END
         AS event_date
FROM events""")
def default_event_date(spark, sf_dir):
    """Clicks come with a date of their own, the other rows get the default."""
    events = table(spark, sf_dir, "events")
    given = events.select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type") == "click", F.date_add(F.to_date("ts"), 1)).alias("event_date"),
    )
    return with_event_date(given).select("event_id", "event_date")


@query("""
SELECT event_id, user_id, CAST(value AS DECIMAL(12,2)) AS value
FROM events WHERE event_type = 'purchase'""")
def purchases(spark, sf_dir):
    events = raw(spark, sf_dir, only=["purchase"])
    return events.where(F.col("event_name") == "purchase").select(
        "event_id", "user_id", F.col("price").alias("value")
    )


@query("""
SELECT event_id, ts AS event_time, user_id FROM events
WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 24 HOUR""")
def trailing_24h(spark, sf_dir):
    events = raw(spark, sf_dir)
    recent = trailing(events, "event_time", 24, as_of=newest(events, "event_time"))
    return recent.select("event_id", "event_time", "user_id")


@query("""
SELECT event_id, CASE WHEN value >= 100 THEN 'high' WHEN value >= 10 THEN 'middle'
                      WHEN value > 0 THEN 'low' ELSE 'none' END AS price_band
FROM events""")
def conditional_bands(spark, sf_dir):
    value = F.col("value")
    band = (
        F.when(value >= 100, "high").when(value >= 10, "middle").when(value > 0, "low")
    ).otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", band.alias("price_band"))


@query("""
WITH big AS (SELECT user_id, value FROM events WHERE value > 20)
SELECT user_id, CAST(COUNT(*) AS BIGINT) AS n FROM big GROUP BY user_id""")
def named_subquery(spark, sf_dir):
    table(spark, sf_dir, "events")
    return spark.sql("""
        WITH big AS (SELECT user_id, value FROM events WHERE value > 20)
        SELECT user_id, count(*) AS n FROM big GROUP BY user_id
    """)


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE value < 5")
def mapped_and_filtered(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("value") < 5)
    return events.select("event_id", F.upper("event_type").alias("kind"))


@query("""
SELECT token, CAST(COUNT(*) AS BIGINT) AS n
FROM (SELECT unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS token FROM documents)
WHERE token <> '' GROUP BY token""")
def document_tokens(spark, sf_dir):
    """Whole texts split into words, then counted with a map-side combine."""
    words = F.split("text", "[ \\t\\r\\n]+")
    tokens = explode_items(table(spark, sf_dir, "documents").select("text"), words, "token")
    return tokens.where(F.col("token") != "").groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT user_id AS key, event_id, event_type FROM events")
def keyed_rows(spark, sf_dir):
    pairs = key_by(table(spark, sf_dir, "events"), F.col("user_id"))
    return pairs.select("key", "row.event_id", "row.event_type")


@query("""
SELECT event_type, CAST(COUNT(*) AS BIGINT) AS events,
       CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM events GROUP BY event_type""")
def partition_totals(spark, sf_dir):
    """Partial counts of each partition, merged: what a grouped aggregate does."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("events"), F.sum(cents).alias("cents")
    )


@query("""
SELECT doc_id, strip_accents(text) AS plain FROM documents""")
def partition_plain_texts(spark, sf_dir):
    """Unicode normal forms, which SQL functions do not offer, batch by batch."""

    def plain(batches):
        import unicodedata

        import pyarrow as pa

        for batch in batches:
            split = (unicodedata.normalize("NFD", t or "") for t in batch.column(1).to_pylist())
            kept = ["".join(c for c in t if unicodedata.category(c) != "Mn") for t in split]
            yield pa.record_batch([batch.column(0), pa.array(kept)], ["doc_id", "plain"])

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_partitions(documents, plain, "doc_id bigint, plain string")


@query("""
SELECT event_id, CAST(ts AS DATE) AS event_date,
       CAST(year(ts) * 100 + month(ts) AS INTEGER) AS month,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_text,
       date_trunc('millisecond', ts) AS time_ms,
       ts + INTERVAL 36 HOUR AS later, CAST(ts AS DATE) - 7 AS week_before,
       ts - to_seconds(event_id) AS shifted
FROM events""")
def time_functions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ts = F.col("ts")
    return events.select(
        "event_id",
        F.to_date(ts).alias("event_date"),
        month_number(F.to_date(ts)).alias("month"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("time_text"),
        F.date_trunc("MILLISECOND", ts).cast("timestamp_ntz").alias("time_ms"),
        (ts + F.expr("INTERVAL 36 HOURS")).alias("later"),
        F.date_sub(F.to_date(ts), 7).alias("week_before"),
        (ts - F.make_dt_interval(secs=F.col("event_id"))).alias("shifted"),
    )


@query("""
SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('second', ts) AS unix_seconds,
       date_trunc('millisecond', ts) AS unix_millis, date_trunc('second', ts) AS dotted,
       date_trunc('day', ts) AS compact_day, CAST(NULL AS TIMESTAMP) AS unreadable
FROM events""")
def best_effort_times(spark, sf_dir):
    """Each time written in several layouts and read back without naming the layout."""
    events = table(spark, sf_dir, "events")
    ts = F.col("ts")
    instant = ts.cast("timestamp")
    written = {
        "iso": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "unix_seconds": F.unix_seconds(instant).cast("string"),
        "unix_millis": F.unix_millis(instant).cast("string"),
        "dotted": F.date_format(ts, "dd.MM.yyyy HH:mm:ss"),
        "compact_day": F.date_format(ts, "yyyyMMdd"),
        "unreadable": F.concat(F.lit("x"), F.date_format(ts, "HH:mm")),
    }
    return events.select("event_id", *(parse_time(v).alias(k) for k, v in written.items()))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id,
       CASE WHEN event_type = 'click' THEN NULL ELSE CAST(value AS DECIMAL(12,2)) END AS price,
       CAST(floor(value) AS BIGINT) AS whole, CAST(event_id AS VARCHAR) AS id_text
FROM events""")
def checked_casts(spark, sf_dir):
    kind = F.col("event_type")
    user = F.when(kind == "error", F.concat(F.lit("-"), (F.col("user_id") + 1).cast("string")))
    price = F.when(kind == "click", "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        to_unsigned(user.otherwise(F.col("user_id").cast("string"))).alias("user_id"),
        to_money(price).alias("price"),
        F.col("value").cast("bigint").alias("whole"),
        F.col("event_id").cast("string").alias("id_text"),
    )


_DIGEST = "sha256(concat_ws(':', CAST(event_id AS VARCHAR), event_type))"
_DIGEST_UUID = " || '-' || ".join(
    f"substr({_DIGEST}, {start}, {length})"
    for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
)


@query(f"""
SELECT event_id, {_DIGEST} AS digest, {_DIGEST_UUID} AS session_id,
       CAST(NULL AS VARCHAR) AS no_uuid,
       '{{"path":"/p/' || user_id || '","ab":"A"}}' AS props_json
FROM events""")
def text_functions(spark, sf_dir):
    digest = F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), "event_type"), 256)
    props = F.struct(
        F.concat(F.lit("/p/"), F.col("user_id").cast("string")).alias("path"),
        F.lit("A").alias("ab"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        digest.alias("digest"),
        to_uuid(F.upper(uuid_from_digest(digest))).alias("session_id"),
        to_uuid(digest).alias("no_uuid"),
        F.to_json(props).alias("props_json"),
    )


@query(with_ev("""
SELECT event_date, platform,
       CAST(COUNT(*) FILTER (event_name = 'purchase') AS BIGINT) AS purchases,
       CAST(COUNT(DISTINCT user_id) FILTER (event_name = 'purchase') AS BIGINT) AS buyers,
       CAST(COALESCE(SUM(price) FILTER (event_name = 'purchase'), 0) AS DECIMAL(18,2)) AS revenue
FROM ev GROUP BY ALL ORDER BY event_date DESC, platform LIMIT 20"""))
def newest_mart_rows(spark, sf_dir):
    fct = fct_daily_revenue(stg_events(raw(spark, sf_dir)))
    return latest_mart_rows(fct)


@query("SELECT user_id, value, event_id FROM events ORDER BY user_id, value DESC, event_id")
def mixed_order(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "value", "event_id")
    return events.orderBy("user_id", F.desc("value"), "event_id")


@query("SELECT event_id, value * -1 AS negated FROM events ORDER BY value * -1, event_id")
def sorted_by_expression(spark, sf_dir):
    negated = (F.col("value") * -1).alias("negated")
    events = table(spark, sf_dir, "events").select("event_id", negated)
    return events.orderBy("negated", "event_id")


@query("""
SELECT user_id, event_type FROM events WHERE event_type = 'purchase'
UNION ALL SELECT user_id, event_type FROM events WHERE value > 20""")
def union_bag(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    bought = events.where(F.col("event_type") == "purchase").drop("value")
    return bought.unionByName(events.where(F.col("value") > 20).drop("value"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


