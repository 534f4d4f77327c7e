"""Reading tables that keep several rows per key: versions, sums, signs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order_by``; NULL is a key like any other.

    The ``= 1`` filter becomes a group limit before the shuffle: each task sends
    at most one row per key, however many rows a key has.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def latest_version(
    df: DataFrame, keys: Sequence[str], version: str, tie: str | None = None
) -> DataFrame:
    """The row with the greatest version per key; among equals the greatest ``tie``."""
    order = [F.desc(version)] + ([F.desc(tie)] if tie else [])
    return first_per_key(df, keys, order)


def summing_merge(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per key with its measures summed; rows that sum to all zeros go.

    Sums keep the column type, as the table they are merged back into does.
    """
    types = dict(df.dtypes)
    merged = df.groupBy(*keys).agg(*(F.sum(m).cast(types[m]).alias(m) for m in measures))
    any_value = F.lit(False)
    for measure in measures:
        any_value = any_value | (F.coalesce(F.col(measure), F.lit(0)) != 0)
    return merged.where(any_value)


def collapse(
    df: DataFrame, keys: Sequence[str], sign: str, measures: Sequence[str] = ()
) -> DataFrame:
    """Cancel +1 rows against -1 rows; keys with a positive balance remain."""
    return (
        df.groupBy(*keys)
        .agg(
            F.sum(sign).alias("rows"),
            *(F.sum(F.col(sign) * F.col(m)).alias(m) for m in measures),
        )
        .where(F.col("rows") > 0)
    )
