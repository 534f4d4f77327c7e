"""Minute totals from a stateful operator: changed totals and late rows both leave it.

State of a (minute, platform) is its running totals and, one small entry each, the buyers
seen. A micro-batch hands on the totals it changed, so nothing reads the stored table back.
Rows of a minute that the watermark has closed change nothing and come out as they are.
A timer at the end of the minute removes its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from eventloom.functions.aggregates import is_purchase
from eventloom.functions.scalars import to_money
from eventloom.sinks.streams import (
    fold_versions,
    foreach_batch_sink,
    read_versions,
    write_version,
)
from eventloom.streaming.nrt import TOTAL_KEYS, WATERMARK, with_watermark

MINUTE_MICROS = 60_000_000
PART_KEYS = (*TOTAL_KEYS, "part")


# Names and types of a row of totals as the operator hands it on.
_TOTALS = {
    "start_micros": "long", "window_platform": "string", "part": "int",
    "cents": "long", "purchases": "long", "buyers": "long",
}


class MinuteTotals(StatefulProcessor):
    """Running totals of one (minute, platform, part), keyed by the minute's start in micros.

    Rows hold the event's own columns as text, then cents and, for a purchase, the buyer.
    """

    def __init__(self, columns: int, size: int = MINUTE_MICROS):
        self.columns, self.size = columns, size
        self.names = ["late", *_TOTALS, *(f"c{i}" for i in range(columns))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.out = Row(*self.names)
        self.handle = handle
        self.totals = handle.getValueState("totals", "cents long, purchases long, buyers long")
        self.buyers = handle.getMapState("buyers", "buyer string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        end = (key[0] + self.size) // 1000
        if end <= timerValues.getCurrentWatermarkInMs():
            none = (None,) * len(_TOTALS)
            for row in rows:
                yield self.out(True, *none, *row[3 : 3 + self.columns])
            return
        known = self.totals.get()
        if known is None:
            self.handle.registerTimer(end)
        cents, purchases, buyers = before = tuple(known or (0, 0, 0))
        users = set()
        for row in rows:
            bought, price, user = row[3 + self.columns :]
            if bought:
                cents += price
                purchases += 1
                if user is not None and user not in users:
                    users.add(user)
                    if not self.buyers.containsKey((user,)):
                        self.buyers.updateValue((user,), (True,))
                        buyers += 1
        after = cents, purchases, buyers
        if known is None or after != before:
            self.totals.update(after)
            yield self.out(False, *key, *after, *(None,) * self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.totals.clear()
        self.buyers.clear()
        yield from ()

    def close(self) -> None:
        pass


def _as_text(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        column = F.unix_micros(column)
    return column.cast("string")


def _from_text(name: str, field: T.StructField) -> Column:
    column = F.col(name)
    if isinstance(field.dataType, T.TimestampType):
        return F.timestamp_micros(column.cast("long")).alias(field.name)
    return column.cast(field.dataType).alias(field.name)


def minute_totals(
    events: DataFrame, parts: int = 1, delay: str = WATERMARK, size: int = MINUTE_MICROS
) -> DataFrame:
    """Stream of changed totals (late is false) and of late rows (late is true, in event).

    A row is late if its minute ended at or before the watermark that the batches before it
    have set. Events without a time belong to no minute and are left out. With ``parts`` over
    1 the rows of a minute are dealt to so many operators by a hash of the user, for minutes
    that one task cannot hold; totals of the parts add up. Columns must be flat.
    """
    fields = events.schema.fields
    kinds = [f"c{i}" for i in range(len(fields))]
    micros = F.unix_micros("event_time")
    purchase = F.coalesce(is_purchase(), F.lit(False))
    cents = F.coalesce((to_money(F.col("price")) * 100).cast("long"), F.lit(0))
    # Text and whole numbers in place of times carry no watermark, so the engine drops no row
    # before the operator has seen it; the watermark itself goes on.
    rows = with_watermark(events, delay).where(F.col("event_time").isNotNull()).select(
        (micros - F.pmod(micros, F.lit(size))).alias("start_micros"),
        F.col("platform").alias("window_platform"),
        F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int").alias("part"),
        *[_as_text(f).alias(c) for f, c in zip(fields, kinds)],
        purchase.alias("is_bought"),
        cents.alias("cents"),
        F.col("user_id").cast("string").alias("buyer"),
    )
    schema = ", ".join(
        ["late boolean", *(f"{n} {t}" for n, t in _TOTALS.items()), *(f"{c} string" for c in kinds)]
    )
    keys = ["start_micros", "window_platform", "part"]
    found = rows.groupBy(*keys).transformWithState(
        MinuteTotals(len(fields), size), outputStructType=schema, outputMode="Update", timeMode="EventTime"
    )
    return found.select(
        "late",
        F.timestamp_micros("start_micros").alias("window_start"),
        F.timestamp_micros(F.col("start_micros") + size).alias("window_end"),
        "window_platform",
        "part",
        (F.col("cents").cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)").alias("revenue_1m"),
        F.col("purchases").alias("purchases_1m"),
        F.col("buyers").alias("buyers_1m"),
        F.struct(*[_from_text(c, f) for c, f in zip(kinds, fields)]).alias("event"),
    )


def totals_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    emit: Callable[[DataFrame, int], None] | None = None,
    parts: int = 1,
    files: int | None = None,
    fold_every: int | None = 32,
) -> StreamingQuery:
    """Changed totals as versions to ``path/table``, late rows to ``path/late``.

    ``emit`` gets the changed totals of each micro-batch as they leave the operator. The
    stored table is written only; every ``fold_every`` batches the newest versions are folded
    into one folder, so a batch opens as many files after a thousand batches as after ten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Totals and late rows share one run of the operator; lost blocks are computed again.
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            totals = batch.where(~F.col("late")).select(
                "window_start", "window_end", F.col("window_platform").alias("platform"), "part",
                "revenue_1m", "purchases_1m", "buyers_1m", F.current_timestamp().alias("updated_at"),
            )
            write_version(totals, f"{path}/table", batch_id, files)
            write_version(batch.where("late").select("event.*"), f"{path}/late", batch_id, files)
            if emit is not None:
                emit(totals, batch_id)
        finally:
            batch.unpersist()
        if fold_every and batch_id and batch_id % fold_every == 0:
            fold_versions(
                batch.sparkSession, f"{path}/table", PART_KEYS, batch_id - 1, batch_id - 1 - fold_every
            )

    return foreach_batch_sink(minute_totals(events, parts), write, checkpoint, trigger)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals of every minute and platform, from the latest versions of their parts."""
    latest = read_versions(spark, f"{path}/table", PART_KEYS)
    return latest.groupBy(*TOTAL_KEYS).agg(
        F.sum("revenue_1m").cast("decimal(18,2)").alias("revenue_1m"),
        F.sum("purchases_1m").alias("purchases_1m"),
        F.sum("buyers_1m").alias("buyers_1m"),
        F.max("updated_at").alias("updated_at"),
    )


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came after the watermark had closed their minute."""
    return spark.read.parquet(f"{path}/late").drop("batch_id")
