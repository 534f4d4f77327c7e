"""Joins of events with customers, nations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators.asof import as_of_join
from eventloom.operators.joins import any_join, enrich, lookup, orphans, preagg_join, salted_join
from eventloom.registry.base import query, table

_ENRICHED = """
SELECT e.event_id, e.user_id, c.c_mktsegment, c.c_nationkey
FROM events e {how} JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON e.user_id = c.c_custkey
"""


def _solvent(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    return customer.select("c_custkey", "c_mktsegment", "c_nationkey")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id")


@query(_ENRICHED.format(how="LEFT"))
def enrich_left(spark, sf_dir):
    return enrich(_events(spark, sf_dir), _solvent(spark, sf_dir), {"user_id": "c_custkey"})


@query(_ENRICHED.format(how="INNER"))
def enrich_inner_shuffled(spark, sf_dir):
    events, customers = _events(spark, sf_dir), _solvent(spark, sf_dir)
    return enrich(events, customers, {"user_id": "c_custkey"}, how="inner")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, s.s_name, n.n_name
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def broadcast_enrichment(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # The nations never grow with the data; whether to ship the suppliers is left to the engine.
    dim = enrich(suppliers, F.broadcast(nations), {"s_nationkey": "n_nationkey"}, "inner")
    joined = enrich(lines, dim, {"l_suppkey": "s_suppkey"}, "inner")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "n_name")


@query("""
SELECT c.c_custkey, o.o_orderkey, o.o_orderdate
FROM customer c LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders) o ON c.c_custkey = o.o_custkey AND o.rn = 1""")
def any_order_per_customer(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    order_by = [F.col("o_orderdate"), F.col("o_orderkey")]
    return any_join(customers, orders, {"c_custkey": "o_custkey"}, order_by)


@query("""
SELECT c.c_custkey, c.c_name, o.o_orderkey
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey""")
def all_orders_per_customer(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return enrich(customers, orders, {"c_custkey": "o_custkey"}, "inner")


@query("""
SELECT e.event_id, e.user_id, COALESCE(c.c_mktsegment, 'unknown') AS c_mktsegment
FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c
  ON e.user_id = c.c_custkey""")
def segment_lookup(spark, sf_dir):
    events, customers = _events(spark, sf_dir), _solvent(spark, sf_dir)
    return lookup(events, customers, "user_id", "c_custkey", "c_mktsegment", "unknown")


@query("""
SELECT e.user_id, e.n_events, e.total, c.c_mktsegment
FROM (SELECT user_id, CAST(COUNT(*) AS BIGINT) AS n_events,
             CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total
      FROM events GROUP BY user_id) e
LEFT JOIN customer c ON e.user_id = c.c_custkey""")
def preaggregated_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "value")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    aggs = [
        F.count("*").alias("n_events"),
        F.sum(F.col("value").cast("decimal(12,2)")).alias("total"),
    ]
    return preagg_join(events, {"user_id": "c_custkey"}, aggs, customers)


@query("""
SELECT user_id, CAST(COUNT(*) AS BIGINT) AS n_rows FROM events e
WHERE NOT EXISTS (SELECT 1 FROM customer c
                  WHERE c.c_custkey = e.user_id AND c.c_mktsegment = 'BUILDING')
GROUP BY user_id""")
def events_without_customer(spark, sf_dir):
    building = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return orphans(table(spark, sf_dir, "events"), "user_id", building, "c_custkey")


@query("""
SELECT l.l_returnflag, o.o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n_lines
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY ALL""")
def salted_order_lines(spark, sf_dir):
    """Two large sides; orders with many lines are spread over several tasks."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_returnflag"
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), "o_orderpriority"
    )
    joined = salted_join(lines, orders, ["orderkey"])
    return joined.groupBy("l_returnflag", "o_orderpriority").agg(F.count("*").alias("n_lines"))


_BOTH = """
SELECT COALESCE(e.user_id, c.c_custkey) AS user_id, e.event_id, c.c_mktsegment, c.c_nationkey
FROM (SELECT * FROM events WHERE event_type = 'error') e
{how} JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON e.user_id = c.c_custkey
"""


def _errors(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return events.select("user_id", "event_id")


@query(_BOTH.format(how="FULL"))
def enrich_full(spark, sf_dir):
    return enrich(_errors(spark, sf_dir), _solvent(spark, sf_dir), {"user_id": "c_custkey"}, "full")


@query(_BOTH.format(how="RIGHT"))
def enrich_right(spark, sf_dir):
    return enrich(_errors(spark, sf_dir), _solvent(spark, sf_dir), {"user_id": "c_custkey"}, "right")


@query(_BOTH.format(how="FULL"))
def salted_full_join(spark, sf_dir):
    """The same with the rows of busy users spread: whoever has over 20 errors."""
    customers = _solvent(spark, sf_dir).withColumnRenamed("c_custkey", "user_id")
    return salted_join(_errors(spark, sf_dir), customers, ["user_id"], "full", hot_rows=20)


@query("""
WITH v AS (
  SELECT c_custkey AS user_id, c_mktsegment || '/' || k AS segment,
         TIMESTAMP '2024-01-01' + to_days(CAST(7 * k + c_custkey % 5 AS INTEGER))
           + to_hours(CAST(c_nationkey AS INTEGER)) AS since,
         k
  FROM customer, (SELECT unnest(range(4)) AS k)
), u AS (
  SELECT *, CASE WHEN user_id % 3 = 0 THEN since + INTERVAL 5 DAY END AS until FROM v
), j AS (
  SELECT e.event_id, e.user_id, e.ts, u.segment, u.since, u.until,
         row_number() OVER (PARTITION BY e.event_id ORDER BY u.since DESC) AS rn
  FROM events e LEFT JOIN u ON u.user_id = e.user_id AND u.since <= e.ts
)
SELECT event_id, user_id, ts, CASE WHEN until IS NULL OR until > ts THEN segment END AS segment,
       CASE WHEN until IS NULL OR until > ts THEN since END AS since
FROM j WHERE rn = 1""")
def events_as_of_history(spark, sf_dir):
    """Events with the segment their customer had then; a third of the versions end early.

    Customers with over 50 rows are cut by days.
    """
    customers = table(spark, sf_dir, "customer")
    weeks = F.explode(F.array(*[F.lit(k) for k in range(4)]))
    start = F.expr(
        "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(7 * k + CAST(c_custkey % 5 AS INT), c_nationkey)"
    )
    versions = customers.withColumn("k", weeks).select(
        F.col("c_custkey").alias("user_id"),
        F.concat_ws("/", "c_mktsegment", "k").alias("segment"),
        start.alias("since"),
    )
    ends = F.when(F.col("user_id") % 3 == 0, F.col("since") + F.expr("INTERVAL 5 DAYS"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    joined = as_of_join(
        events, versions.withColumn("until", ends), ["user_id"], "ts", "since", "until", hot_rows=50
    )
    return joined.drop("until")
