"""Joins: enrichment, one-match joins, lookups, and salting for what the engine cannot split.

How a join runs is left to the engine: with runtime statistics it ships a side that turns
out small and splits skewed partitions of inner joins and of the kept side of outer ones.
``salted_join`` is for the rest, a hot key on the other side of a left join or on a side
whose rows are needed together afterwards. No function here runs a job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.versions import first_per_key

HOT_ROWS = 5_000_000
#: Tasks that rows with a null key are dealt to in a salted join.
NULL_PLACES = 1024

Keys = str | Sequence[str] | Mapping[str, str]


def _align(right: DataFrame, on: Keys) -> tuple[DataFrame, list[str]]:
    """Rename the right keys to the left names and list them."""
    if isinstance(on, str):
        return right, [on]
    if isinstance(on, Mapping):
        return right.withColumnsRenamed({r: l for l, r in on.items()}), list(on)
    return right, list(on)


def hot_keys(sides: Sequence[DataFrame], keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows on a side, and the number of tasks for each side.

    The columns are the keys and ``_tasks0``, ``_tasks1``, ..., null where the key is not hot
    on that side. Rows are counted per key before the one shuffle. Null keys are left out. The
    table is for map-side joins: there are at most rows / ``hot_rows`` keys, 200,000 of a
    trillion rows at the default, and 20 bytes and the key for each.
    """
    keys = list(keys)
    named = reduce(and_, (F.col(f"`{k}`").isNotNull() for k in keys))
    ones = [
        df.where(named).select(*keys, *[F.lit(int(i == j)).cast("bigint").alias(f"_n{j}") for j in range(len(sides))])
        for i, df in enumerate(sides)
    ]
    counts = reduce(DataFrame.union, ones).groupBy(*keys)
    counts = counts.agg(*[F.sum(f"_n{j}").alias(f"_n{j}") for j in range(len(sides))])
    tasks = [
        F.when(F.col(f"_n{j}") > hot_rows, F.ceil(F.col(f"_n{j}") / hot_rows).cast("int")).alias(f"_tasks{j}")
        for j in range(len(sides))
    ]
    hot = counts.select(*keys, *tasks).where(F.coalesce(*[f"_tasks{j}" for j in range(len(sides))]).isNotNull())
    return F.broadcast(hot)


def comparable_columns(df: DataFrame) -> list[Column]:
    """The columns in a form that can be hashed and grouped: maps as sorted entries."""
    return [
        F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        for f in df.schema
    ]


def _places(df: DataFrame, own: str, tasks: str, others: str, copied: str, keys: list[str]) -> DataFrame:
    """Gives each row its place among the ``tasks`` of its key, and a copy for each of ``others``.

    A place comes from the row's hash and the number of the task that reads it, so a task that
    runs again sends each row to the same place as before, and equal rows spread as well. Rows
    with a null key meet nothing and get any place.
    """
    row = F.xxhash64(*comparable_columns(df.drop(tasks, others))) + F.spark_partition_id()
    nameless = reduce(or_, (F.col(f"`{k}`").isNull() for k in keys))
    width = F.when(nameless, F.lit(NULL_PLACES)).otherwise(F.coalesce(tasks, F.lit(1)))
    copies = F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1)
    return df.withColumn(own, F.pmod(row, width).cast("int")).withColumn(copied, F.explode(copies))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shuffle join with the rows of hot keys of both sides spread out, for every join type.

    Rows of a key with more than ``hot_rows`` rows on one side are dealt to places there and
    copied to each place on the other; a key hot on both sides makes a grid. Hot keys are
    counted in one pass over the keys; then each side is read and shuffled once. In an outer
    join a copy without a match in its place is no unmatched row if its key is hot on the other
    side: it has its matches in other places.
    """
    keys = list(keys)
    rest = [c for c in left.columns if c not in keys]
    more = [c for c in right.columns if c not in keys]
    if how not in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        raise ValueError(f"unknown join type {how}")
    only_keys = how in ("left_semi", "left_anti")
    if only_keys:
        right = right.select(keys).distinct()
    hot = hot_keys([left] if only_keys else [left, right], keys, hot_rows)
    if only_keys:
        hot = hot.withColumn("_tasks1", F.lit(None).cast("int"))
    met = [*keys, "_salt", "_cell"]
    placed = _places(left.join(hot, keys, "left"), "_salt", "_tasks0", "_tasks1", "_cell", keys)
    dealt = _places(right.join(hot, keys, "left"), "_cell", "_tasks1", "_tasks0", "_salt", keys)
    if only_keys:
        return placed.join(dealt.select(met), met, how).select(*keys, *rest)
    placed = placed.drop("_tasks0").withColumnRenamed("_tasks1", "_elsewhere").withColumn("_left", F.lit(True))
    dealt = dealt.drop("_tasks1").withColumnRenamed("_tasks0", "_otherwise").withColumn("_right", F.lit(True))
    joined = placed.join(dealt, met, how)
    both = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    lone_left = F.col("_right").isNull() & F.col("_elsewhere").isNull()
    lone_right = F.col("_left").isNull() & F.col("_otherwise").isNull()
    return joined.where(both | lone_left | lone_right).select(*keys, *rest, *more)


def enrich(left: DataFrame, dim: DataFrame, on: Keys, how: str = "left") -> DataFrame:
    """Add dimension columns; every matching pair is kept, by any join type."""
    dim, keys = _align(dim, on)
    return left.join(dim, keys, how)


def any_join(
    left: DataFrame,
    right: DataFrame,
    on: Keys,
    order_by: Sequence[Column],
    how: str = "left",
) -> DataFrame:
    """Each left row meets at most one right row: the first of its key by ``order_by``."""
    right, keys = _align(right, on)
    return left.join(first_per_key(right, keys, order_by), keys, how)


def lookup(
    df: DataFrame, dim: DataFrame, key: str, dim_key: str, attribute: str, default
) -> DataFrame:
    """Add one attribute by key; keys the dictionary lacks get ``default``.

    A dictionary has one value per key; of several the smallest is taken.
    """
    dictionary = dim.groupBy(F.col(dim_key).alias(key)).agg(F.min(attribute).alias(attribute))
    joined = df.join(dictionary, key, "left")
    return joined.withColumn(attribute, F.coalesce(F.col(attribute), F.lit(default)))


def preagg_join(
    fact: DataFrame, on: Keys, aggs: Sequence[Column], dim: DataFrame, how: str = "left"
) -> DataFrame:
    """Aggregate the fact side to the join key first, then join one row per key."""
    dim, keys = _align(dim, on)
    return fact.groupBy(*keys).agg(*aggs).join(dim, keys, how)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Non-NULL child keys without a parent, with the number of child rows.

    Both sides are reduced to their distinct keys before the join, so a key holding a
    large share of the rows costs one row.
    """
    keys = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n_rows"))
    return keys.join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")
