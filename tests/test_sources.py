"""Typed load, seeds, lake folders, file sinks."""

import datetime as dt
from unittest import mock

import pytest
from pyspark.sql import functions as F

from eventloom.functions.scalars import parse_time, uuid_from_digest
from eventloom.registry.base import raw, table
from eventloom.session import new_dir, scratch_dir, shared_dir
from eventloom.sinks.files import (
    write_batched,
    write_daily_lake,
    write_lines,
    write_parquet,
    write_raw_events,
)
from eventloom.sinks.jdbc import write_jdbc
from eventloom.sources.events import (
    EVENT_NAMES,
    PLATFORMS,
    as_event_file,
    read_events,
    read_events_day,
)
from eventloom.sources.load import load_raw_events, read_loaded, split_raw_events
from eventloom.sources.seeds import load_seed
from eventloom.sources.streams import kafka_events
from eventloom.storage import exists


def files_of(spark, path):
    return spark.read.parquet(path).select(F.col("_metadata.file_path")).distinct().count()


def loadable(spark, folder="/root/testdata/sf0.001"):
    """The folder's events as an event file of which every row loads."""
    file = as_event_file(raw(spark, folder))
    return file.withColumn("session_id", uuid_from_digest(F.col("session_id")))


def test_event_files_load_without_rejects(spark):
    out = new_dir(spark, "load")
    write_parquet(loadable(spark), f"{out}/file")
    events = spark.read.parquet(f"{out}/file")
    assert load_raw_events(events, f"{out}/events", f"{out}/rejects", "one") is False
    loaded = read_loaded(spark, f"{out}/events")
    assert loaded.count() == 1000
    assert dict(loaded.dtypes)["price"] == "decimal(12,2)"
    typed = read_events(spark, f"{out}/file")
    assert dict(typed.dtypes)["event_time"] == "timestamp"
    assert typed.where(F.col("event_date").isNull()).count() == 0


def test_a_load_is_repeatable(spark):
    out = new_dir(spark, "load")
    events = loadable(spark)
    bad = events.limit(3).withColumn("event_name", F.lit(None).cast("string"))
    for load_id, rows in (("1", events), ("02", events.limit(10)), ("1", events.unionByName(bad))):
        load_raw_events(rows, f"{out}/events", f"{out}/rejects", load_id)
    counts = read_loaded(spark, f"{out}/events").groupBy("load_id").count().collect()
    assert {tuple(r) for r in counts} == {("1", 1000), ("02", 10)}
    rejects = read_loaded(spark, f"{out}/rejects")
    assert [r["reject_reason"] for r in rejects.collect()] == ["event_name"] * 3


def test_typed_load_rejects_name_their_columns(spark):
    good = ("2024-01-01 10:00:00.1239", "5", "0" * 8 + "-0000-0000-0000-" + "A" * 12, "1.5")
    cases = [
        good,
        (*good[:1], "-1", *good[2:]),
        (*good[:1], "text", *good[2:]),
        (*good[:2], "f" * 64, good[3]),
        (*good[:3], "abc"),
        ("zzz", *good[1:]),
        ("zzz", "-5", "no", None),
    ]
    rows = [(*c, "purchase", "web", "{}") for c in cases] + [(*good, None, None, None)]
    columns = "event_time string, user_id string, session_id string, price string, "
    columns += "event_name string, platform string, props_json string"
    accepted, rejected = split_raw_events(spark.createDataFrame(rows, columns))
    (row,) = accepted.collect()
    assert row["event_time"] == dt.datetime(2024, 1, 1, 10, 0, 0, 123000)
    assert row["event_date"] == dt.date(2024, 1, 1) and row["user_id"] == 5
    assert row["session_id"].endswith("a" * 12) and str(row["price"]) == "1.50"
    assert [r["reject_reason"] for r in rejected.collect()] == [
        "user_id", "user_id", "session_id", "price", "event_time",
        "event_time,user_id,session_id,price", "event_name,platform,props_json",
    ]


def test_load_of_bad_rows_only_and_of_nothing(spark):
    out = new_dir(spark, "load")
    rows = [("zzz", "1", "s", "1", "purchase", "web", "{}")]
    columns = "event_time string, user_id string, session_id string, price string, "
    df = spark.createDataFrame(rows, columns + "event_name string, platform string, props_json string")
    assert not load_raw_events(df.limit(0), f"{out}/events", f"{out}/rejects", "a")
    assert load_raw_events(df, f"{out}/events", f"{out}/rejects", "b")
    (reject,) = read_loaded(spark, f"{out}/rejects").drop("load_id").collect()
    assert tuple(reject)[:7] == rows[0] and reject["reject_reason"] == "event_time,session_id"


def test_time_layouts(spark):
    moment = dt.datetime(2024, 1, 2, 3, 4, 5)
    texts = {
        "2024-01-02 03:04:05": moment,
        "2024-01-02T03:04:05Z": moment,
        "2024-01-02T04:04:05+01:00": moment,
        "2024/01/02 03:04:05": moment,
        "02.01.2024 03:04:05": moment,
        "20240102030405": moment,
        "1704164645": moment,
        "1704164645678": moment.replace(microsecond=678000),
        "2024-01-02 03:04:05.678901": moment.replace(microsecond=678000),
        "20240102": dt.datetime(2024, 1, 2),
        "2024-01-02": dt.datetime(2024, 1, 2),
        "123": None,
        "2024-13-40": None,
        "99999999": None,
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", parse_time(F.col("t")).alias("v")).collect()}
    assert got == texts


def test_day_folder_keeps_its_date(spark, sf_dir):
    base = new_dir(spark, "lake")
    write_daily_lake(raw(spark, sf_dir), base)
    day = read_events_day(spark, base, "2024-01-15")
    assert day.select("date").distinct().collect()[0][0] == dt.date(2024, 1, 15)
    assert len(day.inputFiles()) < len(spark.read.parquet(base).inputFiles())


def test_seed_with_bad_line_fails(spark):
    path = new_dir(spark, "seed")
    lines = spark.createDataFrame([("code,n",), ("a,1",), ("b,x",)], "value string")
    lines.coalesce(1).write.text(path)
    with pytest.raises(Exception, match="MALFORMED|bad|Malformed"):
        load_seed(spark, path, "code string, n int").collect()


def test_raw_table_layout(spark):
    path = new_dir(spark, "raw")
    write_raw_events(raw(spark, "/root/testdata/sf0.01"), path, files=5)
    stored = spark.read.parquet(path)
    assert stored.select("month").distinct().collect()[0][0] == 202401
    assert files_of(spark, path) == 5
    # Files cover separate date ranges: days overlap at most at their ends.
    spans = (
        stored.groupBy(F.col("_metadata.file_path").alias("f"))
        .agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi"))
        .orderBy("lo", "hi")
        .collect()
    )
    assert all(a["hi"] <= b["lo"] for a, b in zip(spans, spans[1:]))


def test_hot_user_is_spread_over_files(spark):
    path = new_dir(spark, "raw")
    events = raw(spark, "/root/testdata/sf0.01").withColumn("user_id", F.lit(1))
    events = events.withColumn("event_name", F.lit("purchase"))
    events = events.withColumn("event_date", F.to_date(F.lit("2024-01-01")))
    write_raw_events(events, path, files=4)
    sizes = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 4000


def test_batched_and_line_files(spark, sf_dir):
    path = new_dir(spark, "files")
    events = table(spark, sf_dir, "events").repartition(20)
    write_batched(events, f"{path}/b", target_rows=400)
    sizes = spark.read.parquet(f"{path}/b").groupBy(F.col("_metadata.file_path")).count().collect()
    assert max(r["count"] for r in sizes) == 400 and len(sizes) == 3
    write_lines(events, "event_id", f"{path}/t")
    assert spark.read.text(f"{path}/t").count() == events.count()


def test_overwrite_is_snappy(spark, sf_dir):
    path = new_dir(spark, "p")
    for n in (10, 5):
        write_parquet(table(spark, sf_dir, "events").limit(n), path)
    assert spark.read.parquet(path).count() == 5
    assert all(".snappy." in f for f in spark.read.parquet(path).inputFiles())


def test_jdbc_writer_settings():
    """No database may be started here: only the options handed to Spark are checked."""
    df = mock.MagicMock()
    writer = df.write.format.return_value
    for method in ("options", "option", "mode"):
        getattr(writer, method).return_value = writer
    write_jdbc(df, "jdbc:x://h/db", "revenue_1m_nrt", {"user": "u"}, connections=4)
    df.write.format.assert_called_once_with("jdbc")
    writer.options.assert_called_once_with(user="u")
    assert dict(c.args for c in writer.option.call_args_list) == {
        "url": "jdbc:x://h/db", "dbtable": "revenue_1m_nrt", "numPartitions": 4,
        "batchsize": 10_000,
    }
    writer.mode.assert_called_once_with("append")
    writer.save.assert_called_once_with()


def test_kafka_reader_settings():
    """The connector is not installed here: the reader options are checked, and
    decode_events on files."""
    spark = mock.MagicMock()
    reader = spark.readStream.format.return_value
    reader.option.return_value = reader
    with mock.patch("eventloom.sources.streams.decode_events") as decode:
        kafka_events(spark, "broker:9092", "events", max_offsets_per_trigger=5)
    spark.readStream.format.assert_called_once_with("kafka")
    assert dict(c.args for c in reader.option.call_args_list) == {
        "kafka.bootstrap.servers": "broker:9092", "subscribe": "events",
        "startingOffsets": "latest", "maxOffsetsPerTrigger": 5,
    }
    decode.assert_called_once_with(reader.load.return_value)


def test_literal_rows_append(spark):
    out = new_dir(spark, "insert")
    # A uuid() column keeps its values when a DataFrame runs again: one insert, one query.
    insert = """
        SELECT current_timestamp() AS event_time, uuid() AS session_id, * FROM VALUES
          (41, 'add_to_cart', 'ios', 12.5, '{"step":2}'),
          (42, 'purchase', 'android', 7.25, '{"step":3}'),
          (43, 'page_view', 'web', 0, '{"step":1}')
          AS t(user_id, event_name, platform, price, props_json)
    """
    for load_id in ("first", "second"):
        rows = spark.sql(insert)
        assert not load_raw_events(rows, f"{out}/events", f"{out}/rejects", load_id)
    stored = read_loaded(spark, f"{out}/events")
    assert stored.count() == 6 and stored.select("session_id").distinct().count() == 6
    assert str(stored.agg(F.sum("price")).first()[0]) == "39.50"


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    unset = mock.MagicMock()
    unset.conf.get.side_effect = lambda key, *default: (
        "hdfs:/wh/" if key == "spark.sql.warehouse.dir" else default[0]
    )
    assert shared_dir(unset) == "hdfs:/wh"


def test_scratch_goes_also_on_failure(spark):
    with pytest.raises(ZeroDivisionError), scratch_dir(spark, "gone") as path:
        spark.range(3).write.parquet(path)
        1 / 0
    assert not exists(spark, path)


def test_domains():
    assert EVENT_NAMES == ["page_view", "add_to_cart", "purchase"]
    assert PLATFORMS == ["web", "ios", "android"]
