"""Totals that leave the stateful operator: batch equality, restart, late rows, expiry."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.registry.base import raw, table
from eventloom.session import new_dir
from eventloom.sources.events import SOURCE_SCHEMAS, raw_events
from eventloom.storage import partition_values, remove
from eventloom.streaming import nrt, totals

DONE = {"availableNow": True}
SF = "/root/testdata/sf0.001"
NAMES = [*nrt.TOTAL_KEYS, "revenue_1m", "purchases_1m", "buyers_1m"]


def add_file(folder, rows):
    rows.coalesce(1).write.mode("append").parquet(folder)


def ids(spark, first, last):
    return table(spark, SF, "events").where(F.col("event_id").between(first, last))


def run(spark, folder, out, **settings):
    files = (
        spark.readStream.schema(SOURCE_SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(folder)
    )
    stream = raw_events(files).withColumn("event_time", F.col("event_time").cast("timestamp"))
    query = totals.totals_stream(stream, out, f"{out}/checkpoint", DONE, **settings)
    query.awaitTermination()
    return query


def batch_form(events):
    events = events.withColumn("event_time", F.col("event_time").cast("timestamp"))
    return {tuple(r) for r in nrt.nrt_revenue_1m(events).select(*NAMES).collect()}


def as_set(df):
    return {tuple(r) for r in df.select(*NAMES).collect()}


def purchases(spark, *rows):
    """Purchases (minute, second, user, price) after noon."""
    made = [
        (i, dt.datetime(2024, 1, 1, 12, m, s), user, "purchase", price, "{}")
        for i, (m, s, user, price) in enumerate(rows)
    ]
    return spark.createDataFrame(made, SOURCE_SCHEMAS["events"])


@pytest.mark.parametrize("parts", [1, 3])
def test_emitted_totals_need_no_stored_table(spark, parts):
    """Earlier versions are taken away before each batch; what is handed on stays whole."""
    folder, out, emitted = new_dir(spark, "in"), new_dir(spark, "out"), {}

    def emit(batch, batch_id):
        for r in batch.collect():
            emitted[(*[r[k] for k in nrt.TOTAL_KEYS], r.part)] = r
        for old in partition_values(spark, f"{out}/table", "batch_id"):
            remove(spark, f"{out}/table/batch_id={old}")

    # the same minutes again and again, with old and new buyers
    for n in range(4):
        add_file(folder, purchases(spark, *[(i % 3, n, i % (5 + n), 1.25) for i in range(12)]))
        run(spark, folder, out, parts=parts, emit=emit)
    everything = spark.read.schema(SOURCE_SCHEMAS["events"]).parquet(folder)
    found = {}
    for (*key, _), r in emitted.items():
        got = found.setdefault(tuple(key), [0, 0, 0])
        for i, name in enumerate(("revenue_1m", "purchases_1m", "buyers_1m")):
            got[i] += r[name]
    assert {(*k, *v) for k, v in found.items()} == batch_form(raw_events(everything))


def test_restart_keeps_the_state(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    for first in (0, 250, 500, 750):
        add_file(folder, ids(spark, first, first + 249))
        run(spark, folder, out)
    assert as_set(totals.read_totals(spark, out)) == batch_form(raw(spark, SF))
    assert totals.read_late(spark, out).count() == 0


def test_kept_and_late_are_all_rows(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    for first, last in ((300, 399), (900, 999), (100, 199), (200, 299)):
        add_file(folder, ids(spark, first, last))
    run(spark, folder, out)
    late = totals.read_late(spark, out)
    want = raw_events(ids(spark, 100, 299)).select(*late.columns)
    want = want.withColumn("event_time", F.col("event_time").cast("timestamp"))
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, want.collect()))
    assert late.schema["price"].dataType.simpleString() == "decimal(12,2)"
    kept = raw_events(ids(spark, 300, 399).unionByName(ids(spark, 900, 999)))
    assert as_set(totals.read_totals(spark, out)) == batch_form(kept)


def test_late_rows_of_an_open_minute_count(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    add_file(folder, purchases(spark, (20, 30, 1, 1.0)))
    add_file(folder, purchases(spark, (10, 10, 1, 1.0), (9, 59, 1, 1.0)))
    run(spark, folder, out)
    minutes = {r.window_start.minute for r in totals.read_totals(spark, out).collect()}
    # the watermark is 12:10:30: 12:10 is open, 12:09 has ended
    assert minutes == {20, 10}
    assert [r.event_time.minute for r in totals.read_late(spark, out).collect()] == [9]


def test_state_of_closed_minutes_goes(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    for n in range(4):
        add_file(folder, purchases(spark, *[(15 * n, s, s % 7, 1.0) for s in range(30)]))
    run(spark, folder, out)
    state = spark.read.format("statestore").option("path", f"{out}/checkpoint")
    open_ = state.option("stateVarName", "totals").load()
    assert {r.key.start_micros // 60_000_000 % 60 for r in open_.collect()} == {45}
    buyers = state.option("stateVarName", "buyers").load()
    assert buyers.count() == 21  # seven buyers for each platform
    assert totals.read_totals(spark, out).agg(F.sum("purchases_1m")).first()[0] == 120


def test_odd_rows(spark):
    """Null users, prices, platforms and names; rows without a time belong to no minute."""
    noon = dt.datetime(2024, 1, 1, 12, 0, 1)
    rows = [(noon, None, "purchase", "web", 1.5), (noon, 7, "purchase", None, None), (noon, 7, None, "web", 2.0),
            (noon, 2**60 + 1, "purchase", "web", 2.5), (None, 1, "purchase", "web", 9.0)]
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    schema = "event_time timestamp, user_id bigint, event_name string, platform string, price double"
    events = spark.createDataFrame(rows, schema)
    add_file(folder, events)
    old = [(noon - dt.timedelta(hours=1), 2**60 + 1, None, "web", 0.1)]
    for late in (events.limit(0), spark.createDataFrame(old, schema)):
        stream = spark.readStream.schema(schema).parquet(folder)
        totals.totals_stream(stream, out, f"{out}/checkpoint", DONE).awaitTermination()
        add_file(folder, late)
    stream = spark.readStream.schema(schema).parquet(folder)
    totals.totals_stream(stream, out, f"{out}/checkpoint", DONE).awaitTermination()
    want = nrt.nrt_revenue_1m(events.where("event_time IS NOT NULL")).select(*NAMES).collect()
    assert as_set(totals.read_totals(spark, out)) == {tuple(r) for r in want}
    assert [tuple(r) for r in totals.read_late(spark, out).collect()] == old


def test_versions_are_folded(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    for n in range(7):
        add_file(folder, purchases(spark, (n, 0, n, 1.0), (0, n, n, 1.0)))
    run(spark, folder, out, fold_every=3, files=1)
    assert len(partition_values(spark, f"{out}/table", "batch_id")) < 7
    events = raw_events(spark.read.schema(SOURCE_SCHEMAS["events"]).parquet(folder))
    assert as_set(totals.read_totals(spark, out)) == batch_form(events)
