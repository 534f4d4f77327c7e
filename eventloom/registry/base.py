"""Query registry: Spark callables next to the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import configure
from eventloom.sources.events import raw_events, sources

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The raw event relation for the oracle; the Spark form is raw_events().
EV = """ev AS (
  SELECT event_id, ts AS event_time, CAST(ts AS DATE) AS event_date, user_id,
         sha256(CAST(event_id AS VARCHAR)) AS session_id,
         CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
                         ELSE event_type END AS event_name,
         CASE event_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'ios' ELSE 'android' END AS platform,
         CAST(value AS DECIMAL(12,2)) AS price,
         props AS props_json
  FROM events)"""


def with_ev(sql: str) -> str:
    """Oracle SQL that reads ``ev``; further CTEs may follow directly."""
    sql = sql.strip()
    if sql.startswith("WITH "):
        return f"WITH {EV}, {sql.removeprefix('WITH ')}"
    return f"WITH {EV}\n{sql}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its oracle if SQL can say it."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(configure(spark), sf_dir))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Instants as local time, a type that compares across engines; all others as they are."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sources(spark, sf_dir, [name])[name]


def raw(spark: SparkSession, sf_dir: str, only=None) -> DataFrame:
    """All events of the folder as raw events."""
    return raw_events(table(spark, sf_dir, "events"), only)
