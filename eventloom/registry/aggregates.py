"""Aggregations, marts and ad-hoc reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.aggregates import (
    count_if,
    is_purchase,
    purchase_metrics,
    sum_if,
    sum_or_zero,
    uniq_exact,
    uniq_exact_if,
)
from eventloom.operators.groups import group_by_key, reduce_by_key
from eventloom.operators.rows import newest
from eventloom.plans import marts
from eventloom.registry.base import query, raw, table, with_ev
from eventloom.session import new_dir
from eventloom.sinks.files import write_parquet, write_raw_events
from eventloom.sources.events import as_event_file

_PURCHASE_COLUMNS = """
  CAST(COUNT(*) FILTER (event_name = 'purchase') AS BIGINT) AS purchases,
  CAST(COUNT(DISTINCT user_id) FILTER (event_name = 'purchase') AS BIGINT) AS buyers,
  CAST(COALESCE(SUM(price) FILTER (event_name = 'purchase'), 0) AS DECIMAL(18,2)) AS revenue"""


@query(with_ev(f"SELECT event_date, platform, {_PURCHASE_COLUMNS} FROM ev GROUP BY ALL"))
def fct_daily_revenue(spark, sf_dir):
    return marts.fct_daily_revenue(marts.stg_events(raw(spark, sf_dir)))


@query(with_ev(f"SELECT event_date, platform, {_PURCHASE_COLUMNS} FROM ev GROUP BY ALL"))
def daily_purchase_metrics(spark, sf_dir):
    return marts.daily_purchase_metrics(marts.stg_events(raw(spark, sf_dir)))


@query(with_ev(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS events, CAST(SUM(price) AS DECIMAL(22,2)) AS total,
       CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users, {_PURCHASE_COLUMNS}
FROM ev"""))
def event_totals(spark, sf_dir):
    return raw(spark, sf_dir).agg(
        F.count("*").alias("events"),
        sum_or_zero(F.col("price")).alias("total"),
        uniq_exact(F.col("user_id")).alias("users"),
        count_if(is_purchase()).alias("purchases"),
        uniq_exact_if(F.col("user_id"), is_purchase()).alias("buyers"),
        sum_if(F.col("price"), is_purchase()).cast("decimal(18,2)").alias("revenue"),
    )


@query(with_ev(f"SELECT user_id, {_PURCHASE_COLUMNS} FROM ev GROUP BY user_id"))
def metrics_by_user(spark, sf_dir):
    return raw(spark, sf_dir).groupBy("user_id").agg(*purchase_metrics())


@query(with_ev("""
SELECT event_date, event_name, platform, CAST(COUNT(*) AS BIGINT) AS events
FROM ev GROUP BY ALL"""))
def counts_by_keys(spark, sf_dir):
    keys = ("event_date", "event_name", "platform")
    return raw(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("events"))


@query(with_ev("""
SELECT event_date AS d, platform, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS dau
FROM ev WHERE event_time >= (SELECT MAX(event_time) FROM ev) - INTERVAL 24 HOUR
GROUP BY ALL"""))
def dau_24h(spark, sf_dir):
    events = raw(spark, sf_dir)
    return marts.dau(events, as_of=newest(events, "event_time"))


@query(with_ev("""
SELECT event_date, event_name, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users,
       CAST(COUNT(*) AS BIGINT) AS events, CAST(SUM(price) AS DECIMAL(18,2)) AS revenue
FROM ev WHERE event_date >= (SELECT MAX(event_date) FROM ev) - 7 GROUP BY ALL"""))
def event_breakdown_7d(spark, sf_dir):
    events = raw(spark, sf_dir)
    return marts.event_breakdown(events, as_of=newest(events, "event_time"))


@query(with_ev("""
SELECT platform, CAST(COUNT(*) AS BIGINT) AS c FROM ev
WHERE event_name = 'purchase' GROUP BY platform"""))
def purchases_by_platform(spark, sf_dir):
    return marts.purchases_by_platform(raw(spark, sf_dir, only=["purchase"]))


@query(with_ev("SELECT event_name, CAST(COUNT(*) AS BIGINT) AS c FROM ev GROUP BY event_name"))
def event_counts(spark, sf_dir):
    return marts.event_counts(raw(spark, sf_dir))


@query("""
SELECT user_id, CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total,
       MIN(ts) AS first_seen, MAX(ts) AS last_seen
FROM events GROUP BY user_id""")
def reduce_by_user(spark, sf_dir):
    return reduce_by_key(
        table(spark, sf_dir, "events"),
        "user_id",
        F.sum(F.col("value").cast("decimal(12,2)")).alias("total"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


@query("""
SELECT user_id, event_id // 1000000 AS bucket, CAST(COUNT(*) AS BIGINT) AS n,
       string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS event_ids
FROM events GROUP BY ALL""")
def grouped_event_ids(spark, sf_dir):
    """Each user's events as text, a row for each million of event ids."""
    events = table(spark, sf_dir, "events")
    grouped = group_by_key(events, "user_id", "event_id", F.expr("event_id DIV 1000000"))
    values = F.flatten(F.transform("runs", lambda r: F.array_repeat(r["event_id"], r["n"].cast("int"))))
    return grouped.select(
        "user_id",
        "bucket",
        F.size(values).cast("bigint").alias("n"),
        F.array_join(F.transform(values, lambda v: v.cast("string")), ",").alias("event_ids"),
    )


@query(with_ev("""
SELECT event_date, platform, CAST(SUM(price) AS DECIMAL(18,2)) AS revenue FROM ev
WHERE event_name = 'purchase' GROUP BY ALL"""))
def daily_purchase_revenue(spark, sf_dir):
    return marts.daily_purchase_revenue(raw(spark, sf_dir, only=["purchase"]))


def _by_months(spark, sf_dir):
    path = new_dir(spark, "raw")
    write_raw_events(raw(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(with_ev("""
SELECT event_date AS d, platform, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS dau
FROM ev WHERE event_time >= (SELECT MAX(event_time) FROM ev) - INTERVAL 24 HOUR
GROUP BY ALL"""))
def dau_of_month_table(spark, sf_dir):
    events = _by_months(spark, sf_dir)
    return marts.dau(events, as_of=newest(raw(spark, sf_dir), "event_time"))


@query(with_ev("""
SELECT event_date, event_name, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users,
       CAST(COUNT(*) AS BIGINT) AS events, CAST(SUM(price) AS DECIMAL(18,2)) AS revenue
FROM ev WHERE event_date >= (SELECT MAX(event_date) FROM ev) - 7 GROUP BY ALL"""))
def breakdown_of_month_table(spark, sf_dir):
    events = _by_months(spark, sf_dir)
    return marts.event_breakdown(events, as_of=newest(raw(spark, sf_dir), "event_time"))


@query(with_ev("""
SELECT event_date, platform, CAST(SUM(price) AS DECIMAL(18,2)) AS revenue FROM ev
WHERE event_name = 'purchase' GROUP BY ALL"""))
def revenue_of_double_prices(spark, sf_dir):
    """Event files carry prices as doubles; their sums are exact all the same."""
    path = new_dir(spark, "event-file")
    write_parquet(as_event_file(raw(spark, sf_dir)), path)
    events = spark.read.parquet(path)
    return marts.daily_purchase_revenue(events.withColumn("event_time", F.to_timestamp_ntz("event_time")))
