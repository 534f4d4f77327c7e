"""Key-wise combination of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduce_by_key(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """One row per key; partial results are combined before the shuffle."""
    return df.groupBy(key).agg(*aggs)


def group_by_key(df: DataFrame, key: str, value: str, bucket: Column) -> DataFrame:
    """All values per key and bucket: (key, bucket, runs), runs being sorted (value, n).

    No row can hold every value of a long key, so the caller declares how a key is cut:
    ``bucket`` is an expression on the value, such as its million. The layout is the same
    at every size. Equal values are counted before the shuffle and stay a pair.
    """
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return (
        counted.groupBy(key, bucket.alias("bucket"))
        .agg(F.array_sort(F.collect_list(F.struct(value, "n"))).alias("runs"))
        .select(key, "bucket", "runs")
    )
