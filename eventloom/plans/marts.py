"""Staging and mart models: DataFrame in, DataFrame out, nothing computed here."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.aggregates import (
    count_if,
    is_purchase,
    purchase_metrics,
    sum_money,
    uniq_exact,
    uniq_exact_if,
)
from eventloom.operators.rows import month_filter, trailing, trailing_days

# Staging columns in order.
STAGING_COLUMNS = (
    "event_time", "event_date", "user_id", "session_id",
    "event_name", "platform", "price", "props_json",
)


def stg_events(raw: DataFrame) -> DataFrame:
    """Raw events with their date, in staging column order."""
    return raw.withColumn("event_date", F.to_date("event_time")).select(*STAGING_COLUMNS)


def fct_daily_revenue(stg: DataFrame) -> DataFrame:
    """Purchases, distinct buyers and revenue per day and platform.

    A day and platform without purchases stays with zeros. The exact distinct
    count shuffles by (day, platform, buyer) first, so the few, large groups are
    spread over the cluster; rows that are no purchase collapse before that.
    """
    return stg.groupBy("event_date", "platform").agg(
        count_if(is_purchase()).alias("purchases"),
        uniq_exact_if(F.col("user_id"), is_purchase()).alias("buyers"),
        sum_money(F.col("price"), is_purchase()).alias("revenue"),
    )


def daily_purchase_metrics(stg: DataFrame) -> DataFrame:
    """The daily mart through the shared purchase metrics; equals the above."""
    return stg.groupBy("event_date", "platform").agg(*purchase_metrics())


def daily_purchase_revenue(events: DataFrame) -> DataFrame:
    """Revenue per day and platform over purchase rows only; no row without purchases."""
    return (
        events.where(is_purchase())
        .groupBy(F.to_date("event_time").alias("event_date"), "platform")
        .agg(sum_money(F.col("price")).alias("revenue"))
    )


def _recent_months(events: DataFrame, days: int, as_of: dt.date | Column | None) -> DataFrame:
    return month_filter(events, days, as_of) if "month" in events.columns else events


def dau(
    events: DataFrame, as_of: dt.datetime | Column | None = None, hours: int = 24
) -> DataFrame:
    """Distinct users per day and platform over the trailing hours, newest day first.

    A table by months is cut at the first month concerned, so older folders are not listed.
    """
    recent = _recent_months(events, -(-hours // 24), as_of)
    return (
        trailing(recent, "event_time", hours, as_of)
        .groupBy(F.to_date("event_time").alias("d"), "platform")
        .agg(uniq_exact(F.col("user_id")).alias("dau"))
        .orderBy(F.desc("d"), "platform")
    )


def event_breakdown(
    events: DataFrame, as_of: dt.date | Column | None = None, days: int = 7
) -> DataFrame:
    """Users, events and revenue per day and event name over the trailing days.

    A table by months is cut as in ``dau``.
    """
    return (
        trailing_days(_recent_months(events, days, as_of), "event_date", days, as_of)
        .groupBy("event_date", "event_name")
        .agg(
            uniq_exact(F.col("user_id")).alias("users"),
            F.count("*").alias("events"),
            sum_money(F.col("price")).alias("revenue"),
        )
        .orderBy("event_date", "event_name")
    )


def purchases_by_platform(events: DataFrame) -> DataFrame:
    return (
        events.where(is_purchase())
        .groupBy("platform")
        .agg(F.count("*").alias("c"))
        .orderBy(F.desc("c"))
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_name").agg(F.count("*").alias("c")).orderBy(F.desc("c"))


def latest_mart_rows(fct: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` mart rows, newest day first (a top-k: each task keeps ``n``)."""
    return fct.orderBy(F.desc("event_date"), "platform").limit(n)
