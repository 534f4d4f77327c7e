"""Distinct buyers of any range from stored daily or minute states."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.plans import uniques
from eventloom.plans.incremental import _by_folder
from eventloom.registry.base import query, raw, with_ev
from eventloom.session import new_dir


@query(with_ev("""
WITH days AS (SELECT DISTINCT event_date AS d FROM ev WHERE event_name = 'purchase')
SELECT d AS event_date, platform, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS buyers
FROM days JOIN ev ON event_date BETWEEN d - 6 AND d
WHERE event_name = 'purchase' GROUP BY ALL"""))
def trailing_week_buyers(spark, sf_dir):
    """Exact buyers of the week up to each day, from states written a day each."""
    path = new_dir(spark, "buyers")
    states = uniques.buyer_states(raw(spark, sf_dir))
    _by_folder(states, "event_date").write.partitionBy("event_date").parquet(path)
    return uniques.trailing_users(spark.read.schema(states.schema).parquet(path), 7)


@query(with_ev("""
SELECT platform, 'all' AS period, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS buyers
FROM ev WHERE event_name = 'purchase' GROUP BY ALL
UNION ALL
SELECT platform, 'first ten days', CAST(COUNT(DISTINCT user_id) AS BIGINT)
FROM ev WHERE event_name = 'purchase' AND event_date < (SELECT MIN(event_date) FROM ev) + 10 GROUP BY ALL"""))
def buyers_of_insert_blocks(spark, sf_dir):
    """Four insert blocks add their states, one of them twice: or does not count it again."""
    path = new_dir(spark, "buyers")
    events = raw(spark, sf_dir)
    quarter = F.floor(F.hour("event_time") / 6)
    for block in (0, 1, 1, 2, 3):
        uniques.buyer_states(events.where(quarter == block)).write.mode("append").parquet(path)
    states = spark.read.parquet(path)
    first = F.lit(events.agg(F.min("event_date")).first()[0])
    early = states.where(F.col("event_date") < F.date_add(first, 10))
    found = [
        uniques.count_users(part, ["platform"]).withColumn("period", F.lit(name))
        for name, part in (("all", states), ("first ten days", early))
    ]
    return found[0].unionByName(found[1])


@query(with_ev("""
SELECT date_trunc('hour', event_time) AS hour, platform, TRUE AS buyers_are_close
FROM ev GROUP BY ALL"""))
def hourly_buyers_of_minutes(spark, sf_dir):
    """Sketches of minutes, stored, united to hours: within a twentieth, or one, of the truth."""
    path = new_dir(spark, "sketches")
    events = raw(spark, sf_dir)
    minute = F.date_trunc("MINUTE", "event_time").alias("minute")
    uniques.buyer_sketches(events, [minute, "platform"]).write.parquet(path)
    hour = F.date_trunc("HOUR", "minute").alias("hour")
    found = uniques.estimate_users(spark.read.parquet(path), [hour, "platform"], "estimate")
    exact = events.groupBy(F.date_trunc("HOUR", "event_time").alias("hour"), "platform").agg(
        F.count_distinct(F.when(F.col("event_name") == "purchase", F.col("user_id"))).alias("buyers")
    )
    both = found.join(exact, ["hour", "platform"], "left")
    close = F.abs(F.col("estimate") - F.col("buyers")) <= F.greatest(F.lit(1), F.col("buyers") / 20)
    return both.select("hour", "platform", close.alias("buyers_are_close"))
