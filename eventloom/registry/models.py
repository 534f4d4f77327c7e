"""Materializations, data tests, freshness, history, contracts, statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.scalars import moment
from eventloom.operators.rows import newest
from eventloom.plans import quality, snapshots
from eventloom.plans.incremental import (
    incremental_append,
    incremental_rebuild,
    materialize_table,
)
from eventloom.plans.marts import daily_purchase_revenue, fct_daily_revenue, stg_events
from eventloom.registry.base import query, raw, table, with_ev
from eventloom.session import new_dir
from eventloom.sources.events import EVENT_NAMES, PLATFORMS

_MART = """
SELECT event_date, platform,
       CAST(COUNT(*) FILTER (event_name = 'purchase') AS BIGINT) AS purchases,
       CAST(COUNT(DISTINCT user_id) FILTER (event_name = 'purchase') AS BIGINT) AS buyers,
       CAST(COALESCE(SUM(price) FILTER (event_name = 'purchase'), 0) AS DECIMAL(18,2)) AS revenue
FROM ev GROUP BY ALL"""


@query(with_ev(_MART))
def materialized_mart(spark, sf_dir):
    mart = fct_daily_revenue(stg_events(raw(spark, sf_dir)))
    return materialize_table(mart, new_dir(spark, "mart"))


@query(with_ev("SELECT * FROM ev"))
def incremental_append_only(spark, sf_dir):
    """First the earlier events, then all: only the newer ones are added."""
    path = new_dir(spark, "append")
    events = raw(spark, sf_dir)
    middle = newest(events, "event_time") - dt.timedelta(days=15)
    earlier = events.where(F.col("event_time") <= middle)
    for source in (earlier, events):
        stored = incremental_append(spark, source, path, "event_time", partition="event_date")
    return stored


@query(with_ev("SELECT *, day(event_date) AS part FROM ev"))
def append_after_nothing(spark, sf_dir):
    """An empty first build, then by the day's number, of one digit or two."""
    path = new_dir(spark, "append")
    events = raw(spark, sf_dir).withColumn("part", F.dayofmonth("event_date").cast("bigint"))
    early = events.where(F.col("part") <= 10)
    for source in (events.limit(0), early, early, events):
        stored = incremental_append(spark, source, path, "event_time", partition="part")
    return stored


@query(with_ev("""
SELECT strftime(event_time, '%d/%m %H:00') AS part, CAST(COUNT(*) AS BIGINT) AS events
FROM ev WHERE event_name <> 'error' GROUP BY ALL"""))
def rebuild_by_text(spark, sf_dir):
    """Partitions named by texts with / and :, all rebuilt without the errors."""
    path = new_dir(spark, "rebuild")
    events = raw(spark, sf_dir).withColumn("part", F.date_format("event_time", "dd/MM HH:00"))

    def model(df):
        return df.groupBy("part").agg(F.count("*").alias("events"))

    incremental_rebuild(spark, events, path, model, "part")
    kept = events.where(F.col("event_name") != "error")
    return incremental_rebuild(spark, kept, path, model, "part", since="0")


@query(with_ev("""
SELECT event_date, platform, CAST(SUM(price) AS DECIMAL(18,2)) AS revenue FROM ev
WHERE event_name = 'purchase' AND event_date < (SELECT MAX(event_date) FROM ev) GROUP BY ALL"""))
def rebuild_without_purchases(spark, sf_dir):
    """The last day has lost its purchases: a mart of purchases loses the day."""
    path = new_dir(spark, "rebuild")
    events = raw(spark, sf_dir)
    last = newest(events, "event_date")
    incremental_rebuild(spark, events, path, daily_purchase_revenue, "event_date")
    gone = (F.col("event_date") == last) & (F.col("event_name") == "purchase")
    since = last - dt.timedelta(days=2)
    return incremental_rebuild(
        spark, events.where(~gone), path, daily_purchase_revenue, "event_date", since=since
    )


@query(with_ev(_MART))
def incremental_rebuild_days(spark, sf_dir):
    """A mart built without the last days' purchases, then its last week rebuilt."""
    path = new_dir(spark, "rebuild")
    staged = stg_events(raw(spark, sf_dir))
    since = newest(staged, "event_date") - dt.timedelta(days=6)
    late = (F.col("event_date") >= since) & (F.col("event_name") == "purchase")
    day = "event_date"
    incremental_rebuild(spark, staged.where(~late), path, fct_daily_revenue, day)
    return incremental_rebuild(spark, staged, path, fct_daily_revenue, day, since=since)


@query(with_ev(_MART))
def full_refresh(spark, sf_dir):
    path = new_dir(spark, "refresh")
    staged = stg_events(raw(spark, sf_dir))
    cheap = staged.where(F.col("price") < 10)
    incremental_rebuild(spark, cheap, path, fct_daily_revenue, "event_date")
    return incremental_rebuild(
        spark, staged, path, fct_daily_revenue, "event_date", full_refresh=True
    )


def _with_gaps(spark, sf_dir):
    """Events whose user is missing on error rows."""
    user = F.when(F.col("event_name") != "error", F.col("user_id"))
    return raw(spark, sf_dir).withColumn("user_id", user)


@query(with_ev("SELECT event_id, event_name FROM ev WHERE event_name = 'error'"))
def not_null_failures(spark, sf_dir):
    return quality.not_null(_with_gaps(spark, sf_dir), "user_id").select("event_id", "event_name")


@query("""
SELECT l_orderkey, CAST(COUNT(*) AS BIGINT) AS n_rows FROM lineitem
GROUP BY l_orderkey HAVING COUNT(*) > 1""")
def duplicate_order_keys(spark, sf_dir):
    return quality.unique(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""
SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n_rows FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
GROUP BY o_custkey""")
def orphaned_orders(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return quality.relationships(table(spark, sf_dir, "orders"), "o_custkey", parents, "c_custkey")


@query(with_ev("""
SELECT event_id, event_name FROM ev
WHERE event_name NOT IN ('page_view', 'add_to_cart', 'purchase')"""))
def unexpected_event_names(spark, sf_dir):
    failing = quality.accepted_values(raw(spark, sf_dir), "event_name", EVENT_NAMES)
    return failing.select("event_id", "event_name")


def _checks(spark, sf_dir, events):
    building = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return [
        quality.not_null_check("event_time"),
        quality.not_null_check("user_id"),
        quality.not_null_check("event_name"),
        quality.accepted_values_check("event_name", EVENT_NAMES, severity="warn"),
        quality.accepted_values_check("platform", PLATFORMS),
        quality.RowCheck("price_not_negative", F.col("price") < 0),
        quality.unique_check(events, "event_id"),
        quality.relationships_check(events, "user_id", building, "c_custkey", severity="warn"),
        quality.RowCheck("no_costly_event", F.col("price") > 100, severity="warn"),
    ]


@query(with_ev("""
WITH gaps AS (SELECT * REPLACE (CASE WHEN event_name <> 'error' THEN user_id END AS user_id)
              FROM ev),
counts AS (
  SELECT 'not_null_event_time' AS test, COUNT(*) FILTER (event_time IS NULL) AS failures,
         'error' AS severity FROM gaps
  UNION ALL SELECT 'not_null_user_id', COUNT(*) FILTER (user_id IS NULL), 'error' FROM gaps
  UNION ALL SELECT 'not_null_event_name', COUNT(*) FILTER (event_name IS NULL), 'error' FROM gaps
  UNION ALL SELECT 'accepted_values_event_name', COUNT(*) FILTER
    (event_name NOT IN ('page_view', 'add_to_cart', 'purchase')), 'warn' FROM gaps
  UNION ALL SELECT 'accepted_values_platform', COUNT(*) FILTER
    (platform NOT IN ('web', 'ios', 'android')), 'error' FROM gaps
  UNION ALL SELECT 'price_not_negative', COUNT(*) FILTER (price < 0), 'error' FROM gaps
  UNION ALL SELECT 'unique_event_id', COUNT(*), 'error' FROM
    (SELECT event_id FROM gaps GROUP BY event_id HAVING COUNT(*) > 1)
  UNION ALL SELECT 'relationships_user_id', COUNT(*), 'warn' FROM gaps
    WHERE user_id IS NOT NULL AND user_id NOT IN
      (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  UNION ALL SELECT 'no_costly_event', COUNT(*) FILTER (price > 100), 'warn' FROM gaps)
SELECT test, CAST(failures AS BIGINT) AS failures, severity,
       CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END
         AS status
FROM counts"""))
def check_summary(spark, sf_dir):
    events = _with_gaps(spark, sf_dir)
    return quality.run_checks(events, _checks(spark, sf_dir, events))


@query(with_ev("""
WITH gaps AS (SELECT * REPLACE (CASE WHEN event_name <> 'error' THEN user_id END AS user_id)
              FROM ev)
SELECT test, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(weight) AS BIGINT) AS failures FROM (
  SELECT 'not_null_user_id' AS test, 1 AS weight FROM gaps WHERE user_id IS NULL
  UNION ALL SELECT 'accepted_values_event_name', 1 FROM gaps
  WHERE event_name NOT IN ('page_view', 'add_to_cart', 'purchase')
  UNION ALL SELECT 'no_costly_event', 1 FROM gaps WHERE price > 100
  UNION ALL SELECT 'unique_event_id', COUNT(*) FROM gaps GROUP BY event_id HAVING COUNT(*) > 1
  UNION ALL SELECT 'relationships_user_id', COUNT(*) FROM gaps
  WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  GROUP BY user_id) GROUP BY test"""))
def stored_failures(spark, sf_dir):
    """Stored rows of every check; those of query checks carry their number of failures."""
    path = new_dir(spark, "failures")
    events = _with_gaps(spark, sf_dir)
    checks = _checks(spark, sf_dir, events)
    quality.run_checks(events, checks, failures_path=path)
    found = spark.read.parquet(f"{path}/rows").select("test", F.lit(1).alias("weight"))
    for check in checks:
        if isinstance(check, quality.QueryCheck):
            weight = F.col(check.weight) if check.weight else F.lit(1)
            rows = spark.read.schema(check.failing.schema).parquet(f"{path}/{check.name}")
            found = found.unionByName(rows.select(F.lit(check.name).alias("test"), weight.alias("weight")))
    return found.groupBy("test").agg(
        F.count("*").alias("n"), F.sum("weight").cast("bigint").alias("failures")
    )


@query("""
SELECT 'events' AS source, MAX(ts) AS newest, CAST(5400 AS DOUBLE) AS age_seconds,
       'warn' AS status FROM events
UNION ALL SELECT 'purchases', MAX(ts) FILTER (event_type = 'purchase'),
       round(epoch(MAX(ts)) - epoch(MAX(ts) FILTER (event_type = 'purchase')) + 5400, 6),
       CASE WHEN epoch(MAX(ts)) - epoch(MAX(ts) FILTER (event_type = 'purchase')) + 5400
                 > 86400 THEN 'error' ELSE 'warn' END FROM events""")
def source_freshness(spark, sf_dir):
    """Seen an hour and a half after the newest event."""
    events = table(spark, sf_dir, "events")
    as_of = newest(events, "ts") + dt.timedelta(minutes=90)
    limits = dt.timedelta(hours=1), dt.timedelta(days=1)
    bought = events.where(F.col("event_type") == "purchase")
    reports = [
        quality.freshness(frame, "ts", as_of, *limits).select(F.lit(name).alias("source"), "*")
        for name, frame in (("events", events), ("purchases", bought))
    ]
    both = reports[0].unionByName(reports[1])
    return both.withColumn("age_seconds", F.round("age_seconds", 6))


_FIRST, _SECOND = dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)


def _customers(spark, sf_dir):
    """(state 1, state 2): balances of one segment grow, one segment leaves, suppliers join."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), "c_mktsegment"
    )
    segment = F.col("c_mktsegment")
    grown = F.when(segment == "BUILDING", F.col("balance") + 100).otherwise(F.col("balance"))
    kept = customer.where(segment != "MACHINERY").withColumn("balance", grown)
    joined = table(spark, sf_dir, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("id"),
        F.col("s_acctbal").alias("balance"),
        F.lit("SUPPLIER").alias("c_mktsegment"),
    )
    return customer, kept.unionByName(joined)


def _history_sql(changed: str, old_start: str, new_start: str) -> str:
    return f"""
WITH old AS (SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment FROM customer),
new AS (SELECT id, CASE WHEN c_mktsegment = 'BUILDING' THEN balance + 100 ELSE balance END
               AS balance, c_mktsegment FROM old WHERE c_mktsegment <> 'MACHINERY'
        UNION ALL SELECT -s_suppkey - 1, s_acctbal, 'SUPPLIER' FROM supplier)
SELECT old.id, old.balance, old.c_mktsegment, {old_start} AS valid_from,
       CASE WHEN new.id IS NULL OR {changed} THEN TIMESTAMP '2024-03-01' END AS valid_to
FROM old LEFT JOIN new ON old.id = new.id
UNION ALL
SELECT new.id, new.balance, new.c_mktsegment, {new_start}, NULL
FROM new LEFT JOIN old ON old.id = new.id WHERE old.id IS NULL OR {changed}"""


@query(_history_sql(
    "new.balance IS DISTINCT FROM old.balance",
    "TIMESTAMP '2024-02-01'", "TIMESTAMP '2024-03-01'",
))
def history_by_check(spark, sf_dir):
    first, second = _customers(spark, sf_dir)
    history = materialize_table(
        snapshots.start_history(first, moment(_FIRST)), new_dir(spark, "history")
    )
    columns = ["balance", "c_mktsegment"]
    return snapshots.scd2_check(history, second, "id", columns, moment(_SECOND))


@query(_history_sql(
    "new.balance IS DISTINCT FROM old.balance",
    "TIMESTAMP '2024-02-01'", "TIMESTAMP '2024-03-01'",
))
def history_table(spark, sf_dir):
    """The same, kept as a table of which only the open versions are rewritten."""
    first, second = _customers(spark, sf_dir)
    path = new_dir(spark, "history-table")

    def step(hist, cur):
        return snapshots.scd2_check(hist, cur, "id", ["balance", "c_mktsegment"], moment(_SECOND))

    snapshots.create_history(first, path, moment(_FIRST))
    for _ in range(2):
        snapshots.advance_history(spark, path, second, "2024-03-01", step)
    return snapshots.read_history(spark, path).drop("closed_in")


@query(_history_sql(
    "new.c_mktsegment = 'BUILDING'", "TIMESTAMP '2024-02-01'",
    "CASE WHEN new.c_mktsegment IN ('BUILDING', 'SUPPLIER') THEN TIMESTAMP '2024-03-01' END",
))
def history_by_timestamp(spark, sf_dir):
    """Only the grown segment and the joined suppliers carry a newer update time."""
    first, second = _customers(spark, sf_dir)
    start, seen = moment(_FIRST), moment(_SECOND)
    updated = F.when(F.col("c_mktsegment").isin("BUILDING", "SUPPLIER"), seen).otherwise(start)
    history = materialize_table(
        snapshots.start_history(first.withColumn("updated_at", start), start),
        new_dir(spark, "history"),
    )
    advanced = snapshots.scd2_timestamp(
        history, second.withColumn("updated_at", updated), "id", "updated_at", seen
    )
    return advanced.drop("updated_at")


@query("""
SELECT * FROM (VALUES
  ('event_id', 'type', 'string', 'bigint', 0),
  ('value', 'type', 'decimal(3,2)', 'double', -1),
  ('props', 'undeclared', NULL, 'string', NULL),
  ('platform', 'missing', 'string', NULL, NULL)) t("column", problem, expected, actual, bad)
""".replace("SELECT *", """SELECT "column", problem, expected, actual,
  CAST(CASE WHEN bad = -1 THEN (SELECT COUNT(*) FROM events WHERE round(value, 2) >= 10)
       ELSE bad END AS BIGINT) AS bad_rows"""))
def contract_differences(spark, sf_dir):
    declared = T.StructType(
        [
            T.StructField("event_id", T.StringType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DecimalType(3, 2)),
            T.StructField("platform", T.StringType()),
        ]
    )
    return quality.check_contract(table(spark, sf_dir, "events"), declared)


def _stats_sql(name: str, kind: str, text: str = "CAST({0} AS VARCHAR)") -> str:
    low, high = (text.format(f"{f}({name})") for f in ("MIN", "MAX"))
    return (
        f"SELECT '{name}' AS \"column\", '{kind}' AS type, CAST(COUNT(*) AS BIGINT) AS rows, "
        f"CAST(COUNT(*) - COUNT({name}) AS BIGINT) AS nulls, "
        f"CAST(COUNT(DISTINCT {name}) AS BIGINT) AS distinct_values, "
        f"{low} AS min_value, {high} AS max_value FROM events"
    )


@query(" UNION ALL ".join([
    _stats_sql("event_id", "bigint"),
    # fractions of a second without trailing zeros
    _stats_sql("ts", "timestamp_ntz", "rtrim(rtrim(strftime({0}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"),
    _stats_sql("user_id", "bigint"),
    _stats_sql("event_type", "string"),
    _stats_sql("value", "double"),
    _stats_sql("props", "string"),
]))
def column_statistics(spark, sf_dir):
    return quality.profile(table(spark, sf_dir, "events"))


_GONE, _BACK = dt.datetime(2024, 2, 10), dt.datetime(2024, 2, 20)


@query("""
SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment, TIMESTAMP '2024-02-01' AS valid_from,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN TIMESTAMP '2024-02-10' END AS valid_to
FROM customer
UNION ALL
SELECT c_custkey, c_acctbal, c_mktsegment, TIMESTAMP '2024-02-10', NULL
FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def history_of_returning_keys(spark, sf_dir):
    """A segment leaves and comes back with its old update time: no versions overlap."""
    first, _ = _customers(spark, sf_dir)
    start = moment(_FIRST)
    first = first.withColumn("updated_at", start)
    history = snapshots.start_history(first, start)
    for state, seen in ((first.where("c_mktsegment <> 'MACHINERY'"), _GONE), (first, _BACK)):
        history = materialize_table(
            snapshots.scd2_timestamp(history, state, "id", "updated_at", moment(seen)),
            new_dir(spark, "history"),
        )
    return history.drop("updated_at")


@query("""
SELECT id, c_acctbal AS balance, c_mktsegment, valid_from, valid_to FROM (
  SELECT CASE WHEN c_custkey > 0 THEN c_custkey END AS id, c_acctbal, c_mktsegment FROM customer),
  (VALUES (TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-10'), (TIMESTAMP '2024-02-20', NULL))
    t(valid_from, valid_to)""")
def history_emptied_and_refilled(spark, sf_dir):
    """All keys leave and come back, one of them NULL; each run is repeated."""
    first, _ = _customers(spark, sf_dir)
    first = first.withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    path = new_dir(spark, "history-table")
    snapshots.create_history(first, path, moment(_FIRST))
    for state, seen in ((first.limit(0), _GONE), (first, _BACK)):
        def step(hist, cur, seen=seen):
            return snapshots.scd2_check(hist, cur, "id", ["balance", "c_mktsegment"], moment(seen))

        for _ in range(2):
            snapshots.advance_history(spark, path, state, f"{seen:%Y-%m-%d}", step)
    return snapshots.read_history(spark, path).drop("closed_in")
