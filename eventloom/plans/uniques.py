"""Distinct counts as stored partial states that add up: exact bitmaps, and sketches.

A plain count of distinct users cannot be added over days. Its states can: bitmaps of user
ids are united by or, sketches by their union. States of a day or minute are written once;
users of any longer range come from them, and no event is read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.aggregates import is_purchase

#: Bits of a bitmap: each covers that many consecutive ids.
BUCKET_BITS = 32_768
#: log2 of the registers of a sketch: 2^12 give an error of about 1.6 %.
SKETCH_BITS = 12


def buyer_states(events: DataFrame, by: Sequence[str] = ("event_date", "platform")) -> DataFrame:
    """(by, bucket, bits): the buyers of each group, as one bitmap for each 32,768 ids.

    Shuffles partial bitmaps, so a group with most of the events is united before it is sent.
    A bitmap has 4 KB, mostly zeros that files pack, so states pay where ids are dense.
    Rows without a user do not count; a group without buyers has no state.
    """
    user = F.col("user_id").cast("long")
    buyers = events.where(is_purchase() & user.isNotNull())
    return buyers.groupBy(*by, F.bitmap_bucket_number(user).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(user)).alias("bits")
    )


def united(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of coarser groups, by or; uniting states twice changes nothing."""
    return states.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_users(states: DataFrame, by: Sequence[str], name: str = "buyers") -> DataFrame:
    """(by, count) of distinct users of groups, from states of these or finer groups."""
    counted = united(states, by).withColumn("_n", F.bitmap_count("bits"))
    return counted.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(name))


def trailing_users(
    states: DataFrame, days: int, by: Sequence[str] = ("platform",), name: str = "buyers"
) -> DataFrame:
    """Distinct users of the ``days`` days up to each day that has a state, per group.

    A state goes to the days whose range it is in; days after the last one get none.
    """
    span = F.expr(f"explode(sequence(event_date, date_add(event_date, {days - 1})))")
    ends = states.select("event_date").distinct().withColumnRenamed("event_date", "_end")
    dealt = states.withColumn("_end", span).join(ends, "_end", "left_semi")
    return count_users(dealt, ["_end", *by], name).withColumnRenamed("_end", "event_date")


def buyer_sketches(events: DataFrame, by: Sequence[str | Column], bits: int = SKETCH_BITS) -> DataFrame:
    """(by, sketch): the buyers of each group as a sketch of fixed size; null without buyers."""
    user = F.when(is_purchase(), F.col("user_id").cast("long"))
    return events.groupBy(*by).agg(F.hll_sketch_agg(user, F.lit(bits)).alias("sketch"))


def estimate_users(sketches: DataFrame, by: Sequence[str | Column], name: str = "buyers") -> DataFrame:
    """(by, estimate) of distinct users of groups, from sketches of these or finer groups."""
    union = F.hll_union_agg("sketch", F.lit(True))
    estimate = F.coalesce(F.hll_sketch_estimate(union), F.lit(0))
    return sketches.groupBy(*by).agg(estimate.alias(name))
