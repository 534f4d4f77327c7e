"""Join of rows with the version that was valid at their time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.joins import HOT_ROWS, hot_keys

SLICE = "1 day"


def as_of_join(
    left: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    until: str | None = None,
    hot_rows: int = HOT_ROWS,
    slice_: str = SLICE,
) -> DataFrame:
    """Each left row with the columns of the version valid at its time, or nulls.

    A version is valid from ``since``, included, up to the next one of its key and, if
    ``until`` is named and not null, up to that, excluded. Both sides are put together and
    sorted once by key and time; the last version is carried on over the rows after it. There
    is no range condition, so no row meets a version that is not its own. Of versions with
    equal keys and ``since`` the greatest, column by column, counts.

    Keys with more than ``hot_rows`` rows on both sides together are cut by time into slices
    of ``slice_``, each sorted by itself; a slice begins with the newest version before it,
    found from one row per slice. Null keys and times match nothing; all left rows come back,
    with their own columns first. Columns of both sides must have different names, but for
    keys, and those of versions an order.
    """
    keys = list(keys)
    others = [c for c in versions.columns if c not in keys]
    named = [F.col(f"`{k}`").isNotNull() for k in keys]
    matchable = reduce(and_, named, F.col(at).isNotNull())
    known = versions.where(reduce(and_, named, F.col(since).isNotNull()))
    rows = left.where(matchable)

    hot = hot_keys([rows.select(keys).union(known.select(keys))], keys, hot_rows)
    length = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL '{slice_}')")

    def marked(df: DataFrame, time: str, kind: int, **columns: Column) -> DataFrame:
        """(keys, _slice, _at, _kind, more); the slice is null for keys that are not hot."""
        micros = F.unix_micros(F.col(time).cast("timestamp"))
        place = F.when(F.col("_tasks0").isNotNull(), F.floor(micros / length))
        more = [column.alias(name) for name, column in columns.items()]
        return df.join(hot, keys, "left").select(
            *keys, place.alias("_slice"), micros.alias("_at"), F.lit(kind).alias("_kind"), *more
        )

    asked = marked(rows, at, 1, _row=F.struct(*left.columns))
    given = marked(known, since, 0, _version=F.struct(*others))
    met = given.unionByName(_seeds(asked, given, keys)).unionByName(asked, allowMissingColumns=True)
    before = Window.partitionBy(*keys, "_slice").orderBy("_at", "_kind", "_version")
    carried = F.last("_version", ignorenulls=True).over(
        before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = met.withColumn("_found", carried).where("_kind = 1")
    if until is not None:
        ends = F.col(f"_found.{until}").cast("timestamp")
        valid = ends.isNull() | (F.unix_micros(ends) > F.col("_at"))
        found = found.withColumn("_found", F.when(valid, F.col("_found")))
    joined = found.select("_row.*", *[F.col(f"_found.`{c}`").alias(c) for c in others])
    return joined.unionByName(left.where(~matchable), allowMissingColumns=True)


def _seeds(asked: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """For each slice of a hot key that has rows, the newest version before the slice."""
    newest = F.max(F.struct("_at", "_version")).alias("_newest")
    cut = given.where("_slice IS NOT NULL").groupBy(*keys, "_slice").agg(newest)
    used = asked.where("_slice IS NOT NULL").select(*keys, "_slice", F.lit(True).alias("_used")).distinct()
    slices = cut.unionByName(used, allowMissingColumns=True).groupBy(*keys, "_slice").agg(
        F.max("_newest").alias("_newest"), F.max("_used").alias("_used")
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    seeds = slices.withColumn("_seed", F.last("_newest", ignorenulls=True).over(earlier))
    return seeds.where("_used AND _seed IS NOT NULL").select(
        *keys, "_slice", "_seed._at", F.lit(0).alias("_kind"), "_seed._version"
    )
