"""Versioned, summing and signed tables; expiry, mutation, compaction, health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from eventloom.operators import tables as upkeep
from eventloom.operators.rows import newest
from eventloom.operators.versions import collapse, first_per_key, latest_version, summing_merge
from eventloom.plans.incremental import mv_apply, mv_fold, mv_read
from eventloom.plans.marts import daily_purchase_revenue
from eventloom.registry.base import query, raw, table, with_ev
from eventloom.session import new_dir
from eventloom.sinks.files import write_raw_events
from eventloom.storage import partition_values


@query(with_ev("""
SELECT user_id, platform, event_id, event_name, updated_at FROM (
  SELECT *, date_trunc('day', event_time) AS updated_at,
         row_number() OVER (PARTITION BY user_id, platform
                            ORDER BY date_trunc('day', event_time) DESC, event_id DESC) AS rn
  FROM ev) WHERE rn = 1"""))
def latest_versions(spark, sf_dir):
    """Coarse version times tie often; the later event wins."""
    versions = raw(spark, sf_dir).select(
        "user_id",
        "platform",
        "event_id",
        "event_name",
        F.date_trunc("DAY", "event_time").alias("updated_at"),
    )
    return latest_version(versions, ["user_id", "platform"], "updated_at", tie="event_id")


@query("""
SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn
  FROM events) WHERE rn = 1""")
def dearest_event_per_user(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return first_per_key(events, ["user_id"], [F.desc("value"), F.col("event_id")])


def _blocks(events):
    """Four insert blocks, by the quarter of the day."""
    quarter = F.floor(F.hour("event_time") / 6)
    return [events.where(quarter == block) for block in range(4)]


@query(with_ev("""
SELECT event_date, platform, CAST(SUM(price) AS DECIMAL(18,2)) AS revenue FROM ev
WHERE event_name = 'purchase' GROUP BY ALL HAVING SUM(price) <> 0"""))
def summing_table(spark, sf_dir):
    """Partial daily sums of four blocks appended to one table, merged on read."""
    path = new_dir(spark, "summing")
    for block in _blocks(raw(spark, sf_dir, only=["purchase"])):
        daily_purchase_revenue(block).write.mode("append").parquet(path)
    return summing_merge(spark.read.parquet(path), ["event_date", "platform"], ["revenue"])


@query(with_ev("""
SELECT event_date, platform, CAST(COUNT(*) AS BIGINT) AS rows,
       CAST(SUM(price) AS DECIMAL(33,2)) AS price
FROM ev WHERE event_name <> 'error' GROUP BY ALL"""))
def sign_collapsed(spark, sf_dir):
    """Every event once with +1; errors are cancelled by a second row with -1."""
    events = raw(spark, sf_dir).select("event_date", "platform", "price", "event_name")
    added = events.withColumn("sign", F.lit(1))
    cancelled = events.where(F.col("event_name") == "error").withColumn("sign", F.lit(-1))
    signed = added.unionByName(cancelled)
    return collapse(signed, ["event_date", "platform"], "sign", ["price"])


@query(with_ev("""
SELECT event_date, platform, CAST(SUM(price) AS DECIMAL(18,2)) AS revenue FROM ev
WHERE event_name = 'purchase' GROUP BY ALL HAVING SUM(price) <> 0"""))
def incremental_revenue_view(spark, sf_dir):
    """Blocks applied one by one, one of them twice, folded half-way."""
    target = new_dir(spark, "mv")
    blocks = _blocks(raw(spark, sf_dir, only=["purchase"]))
    for batch_id in (0, 1, 1, 2):
        mv_apply(blocks[batch_id], target, batch_id)
    mv_fold(spark, target, through=1)
    mv_apply(blocks[3], target, 3)
    return mv_read(spark, target)


def _raw_table(spark, sf_dir):
    """Raw table of all events in two months: the later half a month further on."""
    path = new_dir(spark, "raw")
    events = raw(spark, sf_dir)
    moved = F.when(F.dayofmonth("event_date") > 15, F.add_months("event_date", 1))
    events = events.withColumn("event_date", moved.otherwise(F.col("event_date")))
    write_raw_events(events, path)
    return path


_TWO_MONTHS = """
SELECT *, CAST(year(event_date) * 100 + month(event_date) AS INTEGER) AS month
FROM (SELECT * REPLACE (CASE WHEN day(event_date) > 15
                             THEN CAST(event_date + INTERVAL 1 MONTH AS DATE)
                             ELSE event_date END AS event_date) FROM ev)"""


@query(with_ev(f"""
WITH t AS ({_TWO_MONTHS})
SELECT * FROM t
WHERE event_date >= (SELECT MAX(event_date) FROM t) - 8"""))
def ttl_kept_rows(spark, sf_dir):
    """The first month goes as a folder, the second one is cut at the bound."""
    path = _raw_table(spark, sf_dir)
    last = newest(spark.read.parquet(path), "event_date")
    upkeep.apply_ttl(spark, path, days=20, as_of=last + dt.timedelta(days=12))
    return spark.read.parquet(path)


@query(with_ev(f"""
WITH t AS ({_TWO_MONTHS})
SELECT * REPLACE (CASE WHEN event_name = 'error' THEN 0 ELSE price END AS price)
FROM t WHERE NOT (event_name = 'signup' AND day(event_date) <= 15)"""))
def mutated_rows(spark, sf_dir):
    """Errors get price 0 in all months; the signups of early days are deleted."""
    path = _raw_table(spark, sf_dir)
    name = F.col("event_name")
    upkeep.mutate(spark, path, name == "error", {"price": F.lit(0)})
    upkeep.mutate(spark, path, (name == "signup") & (F.dayofmonth("event_date") <= 15))
    return spark.read.parquet(path)


@query(with_ev(f"""
WITH t AS ({_TWO_MONTHS})
SELECT * FROM t
WHERE month(event_date) > (SELECT MIN(month(event_date)) FROM t)"""))
def dropped_month(spark, sf_dir):
    path = _raw_table(spark, sf_dir)
    first = spark.read.parquet(path).agg(F.min("month")).first()[0]
    upkeep.drop_partition(spark, path, first)
    return spark.read.parquet(path)


@query(with_ev(f"""
WITH t AS ({_TWO_MONTHS})
SELECT * FROM t"""))
def compacted_rows(spark, sf_dir):
    """Every shuffle partition writes to both months at first."""
    path = new_dir(spark, "raw")
    scattered = spark.read.parquet(_raw_table(spark, sf_dir)).repartition("event_id")
    scattered.write.partitionBy("month").parquet(path)
    for month in partition_values(spark, path, "month"):
        upkeep.compact(spark, path, int(month))
    return spark.read.parquet(path)


@query(with_ev("""
SELECT CAST(year(event_date) * 100 + month(event_date) AS INTEGER) AS month,
       CAST(COUNT(*) AS BIGINT) AS rows, TRUE AS files_named, TRUE AS has_bytes
FROM ev GROUP BY 1"""))
def file_health(spark, sf_dir):
    """How many files there are depends on the run: they are compared with the listing."""
    path = new_dir(spark, "raw")
    write_raw_events(raw(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    report = upkeep.file_health(stored)
    files = report.agg(F.sum("files")).first()[0]
    named = F.lit(files == len(stored.inputFiles())).alias("files_named")
    return report.select("month", "rows", named, (F.col("bytes") > 0).alias("has_bytes"))


@query(with_ev("""
SELECT event_date, platform, CAST(SUM(price) AS DECIMAL(18,2)) AS revenue FROM ev
WHERE event_name = 'purchase' GROUP BY ALL HAVING SUM(price) <> 0"""))
def folded_back_and_forth(spark, sf_dir):
    """Folds in falling order: the newer base stays and nothing counts twice."""
    target = new_dir(spark, "mv")
    for batch_id, block in enumerate(_blocks(raw(spark, sf_dir, only=["purchase"]))):
        mv_apply(block, target, batch_id)
    for through in (2, 1, 0, 2):
        mv_fold(spark, target, through)
    return mv_read(spark, target)
