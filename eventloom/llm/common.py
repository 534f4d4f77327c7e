"""Helpers the operators share: scratch tables, Arrow columns as bytes, word positions."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import new_dir

#: Text bytes that one numpy pass works on; a single longer text is its own pass.
BLOCK_BYTES = 1 << 20


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, no lineage, safe to reread."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(docs: DataFrame) -> DataFrame:
    """(document, own_id, own_key): rows as one column, so that their names clash with none."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(
        own.alias("document"),
        F.col("doc_id").cast("long").alias("own_id"),
        F.xxhash64("text").alias("own_key"),
    )


def same_text(marks: DataFrame) -> Column:
    """Condition that joins ``whole_rows`` with marks by doc_id and text_key."""
    same_id = F.col("own_id").eqNullSafe(marks["doc_id"])
    return same_id & (F.col("own_key") == marks["text_key"])


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column as binary, null as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Consecutive texts as (first row, end row, their bytes, offsets), ``most`` bytes or one text."""
    column = as_bytes(column)
    if not len(column):
        return
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    first, n = 0, len(column)
    while first < n:
        base = ends[first] - size[first]
        end = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
        part = column.slice(first, end - first)
        offsets = np.zeros(end - first + 1, dtype=np.int64)
        offsets[1:] = ends[first:end] - base
        yield first, end, b"".join(part.to_pylist()), offsets
        first = end


def by_text(fn, df: DataFrame, schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one record batch to record batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, ASCII letters after lower-casing, and every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(base: np.uint64, which: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if size > 4 * BLOCK_BYTES:
            return table
        _powers[which] = table
    return _powers[which]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[s:e]``; equal slices have equal hashes, whatever their place."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_R, 0, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_R_INVERSE, 1, n + 1)[starts])


def find_words(data: bytes, offsets: np.ndarray):
    """Words of lower-cased texts: (lower-cased bytes, start, end, hash, first word of each text).

    Texts touch each other in ``data``; no word crosses from one to the next. The last
    array has one more entry than texts.
    """
    low = LOWER[np.frombuffer(data, dtype=np.uint8)]
    n = len(low)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = WORD[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return low, starts, ends, range_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def total(df: DataFrame, *columns: str) -> list[int]:
    row = df.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in columns]).first()
    return [int(x) for x in row]


def finite(column: str) -> Column:
    """True where an array of numbers has neither null nor non-finite entries."""
    infinite = F.lit(float("inf"))
    return F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))


def in_one_task(fn: Callable[[pa.Table], Any], rows: DataFrame) -> Any:
    """``fn`` of all rows of a bounded table, run in a task: the driver gets its result alone.

    The result is plain data and arrays: classes of this package would bring along, by value,
    all that their methods use.
    """

    def run(batches):
        found = [b for b in batches if b.num_rows]
        if found:
            made = pickle.dumps(fn(pa.Table.from_batches(found)))
            del found
            free_memory()
            yield pa.record_batch([pa.array([made], pa.binary())], ["made"])

    one = rows.repartition(1).mapInArrow(run, "made binary").first()
    # without rows there may be no task
    return fn(rows.limit(0).toArrow()) if one is None else pickle.loads(one.made)


def free_memory(spark: SparkSession | None = None) -> None:
    """Give what is no longer used back to the system; with a session, its driver's heap too.

    Spark drops the shuffle files and broadcasts of finished jobs when the driver's heap is
    collected, which it leaves to chance: loops over jobs call this after each round.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)
    if spark is not None:
        spark._jvm.System.gc()
