"""A layout for lookups by several columns: keys interleaved bit by bit from quantile ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.joins import comparable_columns

#: Bits of a rank: 256 quantiles of each column.
RANK_BITS = 8


def _number(df: DataFrame, name: str) -> Column:
    """Numbers, dates and times as a number in the same order; other types have none."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        column = F.unix_date(column)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        column = F.unix_micros(column.cast("timestamp"))
    elif not isinstance(kind, T.NumericType):
        raise TypeError(f"{name} is no number, date or time")
    return column.cast("double")


def with_interleaved(
    df: DataFrame, columns: Sequence[str], name: str = "_place", bits: int = RANK_BITS
) -> DataFrame:
    """Adds a key in which the ranks of the columns alternate bit by bit.

    Rows that lie close in every column lie close by the key, so files sorted by it cover a
    narrow range of each. Ranks are places among approximate quantiles, found by one pass over
    the columns; they even out columns whose values are not. Null has the highest rank. The
    driver holds 2^bits quantiles a column.
    """
    share = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(
        *[F.percentile_approx(_number(df, c), share, 10 * 2**bits).alias(f"q{i}") for i, c in enumerate(columns)]
    ).first()
    place = F.lit(0).cast("bigint")
    for i, column in enumerate(columns):
        value, rank = f"_value{i}", f"_rank{i}"
        inner = sorted({v for v in found[i] or [] if v == v})
        df = df.withColumn(value, _number(df, column))
        splits = [-float("inf"), *(inner or [0.0]), float("inf")]
        cut = Bucketizer(splits=splits, inputCol=value, outputCol=rank, handleInvalid="keep")
        # few different values have few quantiles: stretched, so that all columns use all bits
        stretched = F.floor(F.col(rank) * (2**bits / len(splits)))
        last = F.lit(2**bits - 1).cast("bigint")
        df = cut.transform(df).drop(value).withColumn(rank, F.coalesce(stretched, last))
        for bit in range(bits):
            one = F.shiftright(rank, bit).bitwiseAND(F.lit(1).cast("bigint"))
            place = place + one * F.lit(1 << (bit * len(columns) + i)).cast("bigint")
    ranks = [f"_rank{i}" for i in range(len(columns))]
    return df.withColumn(name, place).drop(*ranks)


def write_for_lookups(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    partition: str | None = None,
    files: int | None = None,
    bloom: Sequence[str] = (),
) -> None:
    """Write rows so that a lookup by any one of the columns opens few files and row groups.

    With two columns a lookup by either reads about the square root of all files, where a plain
    sort serves the first column only. Rows of one key go on by a hash of the row, so that a
    value that most rows share is written by several tasks. ``bloom`` names columns whose row
    groups get a Bloom filter where their values are too many for a dictionary, for single
    values that a range cannot exclude.
    """
    placed = with_interleaved(df, columns)
    front = [partition] if partition else []
    keys = [*front, "_place", F.xxhash64(*comparable_columns(df))]
    ranged = placed.repartitionByRange(files, *keys) if files else placed.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*front, "_place").drop("_place").write.mode("overwrite")
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
