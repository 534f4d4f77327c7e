"""Watermarks, late rows, restarts, replays, decoding, ingest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.registry.base import raw, table
from eventloom.session import new_dir
from eventloom.sinks.streams import (
    console_sink,
    fold_versions,
    foreach_batch_sink,
    ingest_events,
    read_versions,
    versioned_sink,
    write_version,
)
from eventloom.sources.events import SOURCE_SCHEMAS, as_event_file, raw_events
from eventloom.sources.streams import decode_events, rate_events
from eventloom.storage import partition_values
from eventloom.streaming import nrt

DONE = {"availableNow": True}
SF = "/root/testdata/sf0.01"


def add_file(spark, folder, rows):
    """Append exactly one file."""
    rows.coalesce(1).write.mode("append").parquet(folder)


def id_range(spark, first, last):
    return table(spark, SF, "events").where(F.col("event_id").between(first, last))


def stream_of(spark, folder):
    """One file per micro-batch, oldest first."""
    files = (
        spark.readStream.schema(SOURCE_SCHEMAS["events"])
        .option("maxFilesPerTrigger", 1)
        .parquet(folder)
    )
    return raw_events(files).withColumn("event_time", F.col("event_time").cast("timestamp"))


def run(spark, folder, out, **kwargs):
    nrt.nrt_stream(
        stream_of(spark, folder), f"{out}/table", f"{out}/checkpoint", DONE, **kwargs
    ).awaitTermination()
    return nrt.nrt_read(spark, f"{out}/table")


def as_set(df):
    return {tuple(r) for r in df.drop("updated_at").collect()}


def test_stream_in_three_batches_equals_batch_form(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    for first, last in ((0, 3399), (3400, 6799), (6800, 9999)):
        add_file(spark, folder, id_range(spark, first, last))
    got = as_set(run(spark, folder, out, files=2))
    events = raw(spark, SF).withColumn("event_time", F.col("event_time").cast("timestamp"))
    want = as_set(nrt.nrt_revenue_1m(events).select(*nrt.nrt_read(spark, f"{out}/table").columns))
    assert len(want) == 9996
    assert got == want


def test_late_files_are_dropped(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    for first, last in ((3000, 3099), (9000, 9099), (100, 199), (200, 299)):
        add_file(spark, folder, id_range(spark, first, last))
    got = run(spark, folder, out).drop("updated_at")
    kept = id_range(spark, 3000, 3099).unionByName(id_range(spark, 9000, 9099))
    events = raw_events(kept).withColumn("event_time", F.col("event_time").cast("timestamp"))
    want = nrt.nrt_revenue_1m(events).select(*got.columns)
    assert as_set(got) == as_set(want)


def one_event(spark, *times):
    rows = [(i, dt.datetime(2024, 1, 1, *t), 1, "purchase", 1.0, "{}") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, SOURCE_SCHEMAS["events"])


@pytest.mark.parametrize("middle, total", [(True, 3), (False, 3)])
def test_late_boundary(spark, middle, total):
    """Late rows of open windows count; closed windows drop one batch later."""
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    add_file(spark, folder, one_event(spark, (12, 20, 30)))
    if middle:
        add_file(spark, folder, one_event(spark, (12, 20, 40)))
    add_file(spark, folder, one_event(spark, (12, 10, 10), (12, 9, 59)))
    got = run(spark, folder, out)
    assert got.agg(F.sum("purchases_1m")).first()[0] == total
    windows = {r["window_start"].minute for r in got.collect()}
    assert windows == ({20, 10} if middle else {20, 10, 9})


def test_restart_reads_only_new_files(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    add_file(spark, folder, id_range(spark, 0, 99))
    run(spark, folder, out)
    before = set(partition_values(spark, f"{out}/table", "batch_id"))
    add_file(spark, folder, id_range(spark, 100, 199))
    got = run(spark, folder, out)
    new = set(partition_values(spark, f"{out}/table", "batch_id")) - before
    assert before and new
    events = raw_events(id_range(spark, 0, 199))
    events = events.withColumn("event_time", F.col("event_time").cast("timestamp"))
    assert as_set(got) == as_set(nrt.nrt_revenue_1m(events).select(*got.columns))


def test_emitted_totals_and_folding(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    for first, last in ((0, 199), (150, 349)):
        add_file(spark, folder, id_range(spark, first, last))
    emitted = []
    got = as_set(
        run(spark, folder, out, emit=lambda df, n: emitted.append((n, df.drop("updated_at").collect())))
    )
    last = {}
    for _, rows in sorted(emitted, key=lambda e: e[0]):
        for row in rows:
            last[tuple(row[c] for c in nrt.TOTAL_KEYS)] = tuple(row)
    assert set(last.values()) == got
    newest = max(int(b) for b in partition_values(spark, f"{out}/table", "batch_id"))
    fold_versions(spark, f"{out}/table", nrt.BUYER_KEYS, into=newest)
    assert partition_values(spark, f"{out}/table", "batch_id") == [str(newest)]
    assert as_set(nrt.nrt_read(spark, f"{out}/table")) == got


def test_replayed_batch_replaces_itself(spark):
    path = new_dir(spark, "versions")
    rows = spark.createDataFrame([("k", 1, 10)], "key string, updated_at int, v int")
    for _ in range(2):
        write_version(rows, path, 1)
    write_version(rows.withColumn("v", F.lit(11)), path, 2)
    assert spark.read.parquet(path).count() == 2
    assert read_versions(spark, path, ["key"]).collect()[0]["v"] == 11


def test_folding_a_range_leaves_other_batches(spark):
    path = new_dir(spark, "versions")
    for batch_id in range(5):
        rows = [("k", batch_id, batch_id), (f"k{batch_id}", batch_id, batch_id)]
        write_version(spark.createDataFrame(rows, "key string, updated_at int, v int"), path, batch_id)
    want = sorted(map(tuple, read_versions(spark, path, ["key"]).collect()))
    fold_versions(spark, path, ["key"], into=1)
    fold_versions(spark, path, ["key"], into=3, after=1)
    assert partition_values(spark, path, "batch_id") == ["1", "3", "4"]
    assert spark.read.parquet(path).count() == 3 + 3 + 2
    assert sorted(map(tuple, read_versions(spark, path, ["key"]).collect())) == want


def test_exact_buyers_are_refused_in_one_streaming_aggregate(spark):
    folder = new_dir(spark, "in")
    add_file(spark, folder, id_range(spark, 0, 9))
    with pytest.raises(ValueError):
        nrt.nrt_revenue_1m(stream_of(spark, folder))


def test_approximate_buyers_on_a_stream(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    add_file(spark, folder, table(spark, SF, "events"))
    updates = nrt.nrt_revenue_1m(stream_of(spark, folder), exact=False)
    versioned_sink(updates, f"{out}/t", f"{out}/c", DONE).awaitTermination()
    got = read_versions(spark, f"{out}/t", nrt.TOTAL_KEYS).agg(
        F.sum("purchases_1m"), F.sum("buyers_1m"), F.count("*")
    )
    purchases, buyers, groups = got.first()
    assert (purchases, groups) == (1981, 9996)
    assert abs(buyers - 1981) < 40


MESSAGES = [
    '{"event_time":"2024-01-01 10:00:00","user_id":5,"session_id":"s","event_name":"purchase",'
    '"platform":"web","price":1.5,"props_json":"{}"}',
    "{bad",
    '{"user_id":"x","platform":"web"}',
    '{"event_time":"zzz","user_id":6,"platform":"ios"}',
]


def test_decode_messages(spark):
    df = spark.createDataFrame([(m.encode(),) for m in MESSAGES] + [(None,)], "value binary")
    rows = decode_events(df).collect()
    assert rows[0]["event_time"] == dt.datetime(2024, 1, 1, 10)
    assert rows[0]["price"] == 1.5 and rows[0]["bad_message"] is None
    assert rows[1]["bad_message"] == "{bad"
    assert rows[2]["user_id"] is None and rows[2]["platform"] == "web"
    assert rows[2]["bad_message"] is None
    assert rows[3]["event_time"] is None and rows[3]["user_id"] == 6
    assert rows[4]["bad_message"] == ""


def test_ingest_keeps_running_over_bad_messages(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    spark.createDataFrame([(m,) for m in MESSAGES], "value string").coalesce(1).write.text(folder)
    stream = decode_events(spark.readStream.text(folder))
    for _ in range(2):
        ingest_events(stream, out, f"{out}/checkpoint", DONE).awaitTermination()
    assert spark.read.parquet(f"{out}/events").count() == 3
    assert [r["bad_message"] for r in spark.read.parquet(f"{out}/rejects").collect()] == ["{bad"]


def test_rate_source_to_console_and_batch_code(spark):
    seen = []
    out = new_dir(spark, "rate")
    query = foreach_batch_sink(
        rate_events(spark, rows_per_second=20),
        lambda batch, n: seen.extend(batch.select("event_name", "price").collect()),
        f"{out}/c1",
        {"processingTime": "1 second"},
        mode="append",
    )
    query.awaitTermination(6)
    query.stop()
    assert seen
    assert all((r["price"] > 0) <= (r["event_name"] == "purchase") for r in seen)
    revenue = nrt.nrt_revenue_1m(rate_events(spark, 20), exact=False)
    query = console_sink(revenue, f"{out}/c2", {"processingTime": "1 second"})
    for _ in range(20):
        query.awaitTermination(1)
        if query.lastProgress and query.lastProgress["numInputRows"]:
            break
    progress = query.lastProgress
    query.stop()
    assert "ConsoleTable" in progress["sink"]["description"]
    assert progress["numInputRows"] > 0


def test_revenue_of_unrounded_prices_is_rounded_once(spark):
    """Many buyers with fractions of a cent: the total equals the batch form."""
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    rows = [
        (i, dt.datetime(2024, 1, 1, 12, 0, i % 60), i, "purchase", 0.004, "{}") for i in range(0, 300, 3)
    ]
    events = spark.createDataFrame(rows, SOURCE_SCHEMAS["events"])
    sequence = events.select(
        F.col("ts").cast("timestamp").alias("event_time"), "user_id",
        F.col("event_type").alias("event_name"), F.lit("web").alias("platform"),
        F.col("value").alias("price"),
    )
    sequence.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(sequence.schema).parquet(folder)
    nrt.nrt_stream(stream, f"{out}/t", f"{out}/c", DONE).awaitTermination()
    got = nrt.nrt_read(spark, f"{out}/t").first()
    assert (str(got["revenue_1m"]), got["buyers_1m"]) == ("0.40", 100)
    assert str(nrt.nrt_revenue_1m(sequence).first()["revenue_1m"]) == "0.40"


def test_folders_stay_few_over_many_batches(spark):
    folder, out = new_dir(spark, "in"), new_dir(spark, "out")
    for first in range(0, 3000, 100):
        add_file(spark, folder, id_range(spark, first, first + 99))
    got = as_set(run(spark, folder, out, files=1, fold_every=5))
    assert len(partition_values(spark, f"{out}/table", "batch_id")) <= 30 // 5 + 6
    events = raw_events(id_range(spark, 0, 2999))
    events = events.withColumn("event_time", F.col("event_time").cast("timestamp"))
    columns = nrt.nrt_read(spark, f"{out}/table").columns
    assert got == as_set(nrt.nrt_revenue_1m(events).select(*columns))
