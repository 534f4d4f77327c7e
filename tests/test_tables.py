"""Expiry, mutation, compaction, health; versions, sums, signs; incremental builds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.operators import tables as upkeep
from eventloom.operators.versions import collapse, latest_version, summing_merge
from eventloom.plans import incremental
from eventloom.plans.marts import daily_purchase_revenue, fct_daily_revenue, stg_events
from eventloom.registry.base import raw
from eventloom.session import new_dir
from eventloom.sinks.files import write_raw_events
from eventloom.storage import exists, overwrite_partitions, partition_values

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def raw_table(spark):
    """Raw table over three months."""
    path = new_dir(spark, "raw")
    events = raw(spark, SF)
    shift = F.floor(F.dayofmonth("event_date") / 11).cast("int")
    events = events.withColumn("event_date", F.expr("add_months(event_date, 1)"))
    events = events.withColumn("event_date", F.add_months("event_date", shift))
    write_raw_events(events, path, files=12)
    return path


def modified(spark, path, month):
    return {
        r[0]
        for r in spark.read.parquet(path)
        .where(F.col("month") == month)
        .select("_metadata.file_path")
        .distinct()
        .collect()
    }


def test_ttl_removes_months_and_cuts_the_bound_month(spark, raw_table):
    as_of = dt.date(2024, 3, 20) + dt.timedelta(days=30)
    before = modified(spark, raw_table, 202404)
    upkeep.apply_ttl(spark, raw_table, 30, as_of)
    kept = spark.read.parquet(raw_table)
    assert kept.agg(F.min("event_date")).first()[0] >= dt.date(2024, 3, 20)
    assert "202402" not in partition_values(spark, raw_table, "month")
    assert modified(spark, raw_table, 202404) == before
    again = rows(kept)
    upkeep.apply_ttl(spark, raw_table, 30, as_of)
    assert rows(spark.read.parquet(raw_table)) == again


def test_update_touches_matching_months_only(spark, raw_table):
    before = rows(spark.read.parquet(raw_table))
    untouched = modified(spark, raw_table, 202402)
    hit = (F.col("event_name") == "error") & (F.col("event_date") >= "2024-03-01")
    months = upkeep.mutate(spark, raw_table, hit, {"price": F.lit(0)})
    assert months == [202403, 202404]
    assert modified(spark, raw_table, 202402) == untouched
    after = spark.read.parquet(raw_table)
    assert after.count() == len(before)
    assert after.where(hit & (F.col("price") != 0)).count() == 0
    assert dict(after.dtypes)["price"] == "decimal(12,2)"


def test_delete_and_null_predicates(spark, raw_table):
    total = spark.read.parquet(raw_table).count()
    nothing = F.lit(None).cast("boolean")
    assert upkeep.mutate(spark, raw_table, nothing) == []
    month = spark.read.parquet(raw_table).where("month = 202403").count()
    assert upkeep.mutate(spark, raw_table, F.col("month") == 202403) == [202403]
    assert spark.read.parquet(raw_table).count() == total - month
    assert partition_values(spark, raw_table, "month") == ["202402", "202404"]
    upkeep.drop_partition(spark, raw_table, 202402)
    assert partition_values(spark, raw_table, "month") == ["202404"]


def test_compaction_keeps_rows_in_fewer_sorted_files(spark):
    path = new_dir(spark, "raw")
    write_raw_events(raw(spark, SF), path, files=50)
    before = rows(spark.read.parquet(path))
    upkeep.compact(spark, path, 202401, target_files=3)
    after = spark.read.parquet(path)
    health = upkeep.file_health(after).first()
    assert health["files"] <= 3 and health["rows"] == len(before) and health["bytes"] > 0
    assert rows(after) == before
    upkeep.compact(spark, path, 202401, target_files=3)
    assert rows(spark.read.parquet(path)) == before


def test_dynamic_overwrite_may_read_what_it_replaces(spark):
    path = new_dir(spark, "t")
    spark.range(100).withColumn("month", F.col("id") % 2).write.partitionBy("month").parquet(path)
    grown = spark.read.parquet(path).where("month = 1").withColumn("id", F.col("id") + 1000)
    overwrite_partitions(grown, path, "month")
    got = spark.read.parquet(path)
    assert got.count() == 100
    assert got.where("month = 1").agg(F.min("id")).first()[0] == 1001
    assert got.where("month = 0").agg(F.max("id")).first()[0] == 98


def test_equal_versions_fall_to_the_last_batch(spark):
    versions = spark.createDataFrame(
        [("a", 1, 1, 10), ("a", 1, 2, 20), ("b", 2, 1, 30), ("b", 1, 2, 40), (None, 1, 1, 50)],
        "k string, updated_at int, batch_id int, v int",
    )
    latest = latest_version(versions, ["k"], "updated_at", "batch_id")
    assert {r["k"]: r["v"] for r in latest.collect()} == {"a": 20, "b": 30, None: 50}
    assert rows(latest_version(latest, ["k"], "updated_at", "batch_id")) == rows(latest)
    text = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_summing_merge_drops_zero_rows_and_is_idempotent(spark):
    df = spark.createDataFrame(
        [("a", 5, 1.5), ("a", -5, -1.5), ("b", 2, 0.0), ("c", None, None)], "k string, x int, y double"
    )
    merged = summing_merge(df, ["k"], ["x", "y"])
    assert [tuple(r) for r in merged.collect()] == [("b", 2, 0.0)]
    assert merged.dtypes == df.dtypes
    assert rows(summing_merge(merged, ["k"], ["x", "y"])) == rows(merged)


def test_signs_cancel(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", -1, 5), ("b", 1, 7), ("b", 1, 8), ("b", -1, 7)],
                               "k string, sign int, v int")
    assert [tuple(r) for r in collapse(df, ["k"], "sign", ["v"]).collect()] == [("b", 1, 8)]


def test_mv_blocks_folding_and_replay(spark):
    events = raw(spark, SF)
    target = new_dir(spark, "mv")
    want = rows(daily_purchase_revenue(events))
    quarter = F.floor(F.hour("event_time") / 6)
    for batch_id in range(4):
        incremental.mv_apply(events.where(quarter == batch_id), target, batch_id)
    assert rows(incremental.mv_read(spark, target).select("event_date", "platform", "revenue")) == want
    for through in (1, 1, 2):
        incremental.mv_fold(spark, target, through)
        got = incremental.mv_read(spark, target).select("event_date", "platform", "revenue")
        assert rows(got) == want
    assert partition_values(spark, f"{target}/base", "through") == ["2"]
    assert partition_values(spark, f"{target}/blocks", "batch_id") == ["2", "3"]


def test_incomplete_fold_is_ignored(spark):
    events = raw(spark, SF)
    target = new_dir(spark, "mv")
    incremental.mv_apply(events, target, 0)
    want = rows(incremental.mv_read(spark, target))
    daily_purchase_revenue(events).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{target}/base/through=0")
    assert not exists(spark, f"{target}/base/through=0/_SUCCESS")
    assert rows(incremental.mv_read(spark, target)) == want


def test_append_only_misses_late_rows_and_rebuild_finds_them(spark):
    staged = stg_events(raw(spark, SF))
    cut = dt.date(2024, 1, 20)
    late = (F.col("event_date") == dt.date(2024, 1, 10)) & (F.col("event_name") == "purchase")
    early = staged.where((F.col("event_date") < cut) & ~late)
    appended = new_dir(spark, "append")
    incremental.incremental_append(spark, early, appended, "event_time")
    got = incremental.incremental_append(spark, staged, appended, "event_time")
    assert got.count() == staged.where(~late).count()
    again = incremental.incremental_append(spark, staged, appended, "event_time")
    assert again.count() == got.count()
    assert again.agg(F.max("event_time")).first() == staged.agg(F.max("event_time")).first()
    refreshed = incremental.incremental_append(
        spark, staged, appended, "event_time", full_refresh=True
    )
    assert refreshed.count() == staged.count()

    by_day = new_dir(spark, "append")
    for source in (early, staged, staged):
        got = incremental.incremental_append(
            spark, source, by_day, "event_time", partition="event_date"
        )
    assert got.count() == staged.where(~late).count()

    built = new_dir(spark, "rebuild")
    incremental.incremental_rebuild(spark, early, built, fct_daily_revenue, "event_date")
    mart = incremental.incremental_rebuild(
        spark, staged, built, fct_daily_revenue, "event_date", since=dt.date(2024, 1, 10)
    )
    columns = ["event_date", "platform", "purchases", "buyers", "revenue"]
    assert rows(mart.select(columns)) == rows(fct_daily_revenue(staged).select(columns))


def test_rebuild_removes_days_that_became_empty(spark):
    staged = stg_events(raw(spark, SF))
    built = new_dir(spark, "rebuild")
    incremental.incremental_rebuild(spark, staged, built, fct_daily_revenue, "event_date")
    gone = staged.where(F.col("event_date") != dt.date(2024, 1, 25))
    mart = incremental.incremental_rebuild(
        spark, gone, built, fct_daily_revenue, "event_date", since=dt.date(2024, 1, 24)
    )
    assert mart.count() == 90 - 3


def test_null_months_are_updated_and_removed(spark):
    path = new_dir(spark, "raw")
    events = raw(spark, SF).where("event_id < 200")
    undated = F.when(F.col("event_name") != "error", F.col("event_date"))
    write_raw_events(events.withColumn("event_date", undated), path)
    errors = F.col("event_name") == "error"
    assert upkeep.mutate(spark, path, errors, {"price": F.lit(1)}) == [None]
    assert spark.read.parquet(path).where(errors & (F.col("price") == 1)).count() > 10
    assert partition_values(spark, path, "month") == ["202401"]
    assert upkeep.mutate(spark, path, errors) == [None]
    assert spark.read.parquet(path).where("month IS NULL").count() == 0
    assert spark.read.parquet(path).count() == events.where(~errors).count()


def test_rebuild_leaves_undated_rows_and_compares_numbers(spark):
    path = new_dir(spark, "rebuild")
    source = spark.createDataFrame([(None, 1), (9, 1), (10, 1), (11, 1)], "part int, v int")

    def model(df):
        return df.groupBy("part").agg(F.sum("v").alias("v"))

    incremental.incremental_rebuild(spark, source, path, model, "part")
    smaller = source.where("part IS NULL OR part < 11")
    got = incremental.incremental_rebuild(spark, smaller, path, model, "part", since=10)
    assert {r["part"] for r in got.collect()} == {None, 9, 10}


def test_files_follow_the_advisory_size(spark):
    """The same rule at every size: ranges are merged up to the advisory partition size."""
    counts = []
    for size in ("64m", "64k"):
        names = ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize")
        settings = {f"spark.sql.adaptive.{name}": size for name in names}
        settings["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "false"
        for key, value in settings.items():
            spark.conf.set(key, value)
        try:
            path = new_dir(spark, "raw")
            write_raw_events(raw(spark, SF), path)
            counts.append(len(spark.read.parquet(path).inputFiles()))
        finally:
            for key in settings:
                spark.conf.unset(key)
    assert counts[0] == 1 < counts[1]


def test_fold_never_counts_twice(spark):
    """Folding up to an older block than the base already holds changes nothing."""
    target = new_dir(spark, "mv")
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), "web", "purchase", "1.00")],
        "event_time timestamp_ntz, platform string, event_name string, price string",
    ).withColumn("price", F.col("price").cast("decimal(12,2)"))
    for batch_id in range(6):
        incremental.mv_apply(rows, target, batch_id)
    for through in (5, 3, 5, 0):
        incremental.mv_fold(spark, target, through)
        assert str(incremental.mv_read(spark, target).first()["revenue"]) == "6.00"


def test_rebuild_with_odd_folder_names(spark):
    path = new_dir(spark, "rebuild")
    source = spark.createDataFrame(
        [("a:b", 1), ("b/c", 2), ("007", 3), ("%2F", 4)], "part string, v int"
    )

    def model(df):
        return df.groupBy("part").agg(F.sum("v").alias("v"))

    incremental.incremental_rebuild(spark, source, path, model, "part")
    got = incremental.incremental_rebuild(spark, source, path, model, "part", since="a")
    kept = {(r["part"], r["v"]) for r in got.collect()}
    assert kept == {("a:b", 1), ("b/c", 2), ("007", 3), ("%2F", 4)}
    fewer = source.where("part <> 'a:b'")
    got = incremental.incremental_rebuild(spark, fewer, path, model, "part", since="a")
    assert {r["part"] for r in got.collect()} == {"b/c", "007", "%2F"}


def test_rebuild_by_time(spark):
    path = new_dir(spark, "rebuild")
    times = [dt.datetime(2024, 1, d, 10, 30) for d in (1, 2, 3)]
    source = spark.createDataFrame([(t, 1) for t in times], "part timestamp_ntz, v int")

    def model(df):
        return df.groupBy("part").agg(F.sum("v").alias("v"))

    incremental.incremental_rebuild(spark, source, path, model, "part")
    less = source.where(F.col("part") != F.lit(times[2]).cast("timestamp_ntz"))
    got = incremental.incremental_rebuild(spark, less, path, model, "part", since=times[1])
    assert sorted(r["part"] for r in got.collect()) == times[:2]


def test_append_by_number_and_after_nothing(spark):
    path = new_dir(spark, "append")
    source = spark.createDataFrame([(9, 1), (10, 2), (10, 3)], "part int, at int")
    empty = incremental.incremental_append(spark, source.limit(0), path, "at", partition="part")
    assert empty.count() == 0
    for rows in (source.where("at < 3"), source, source):
        got = incremental.incremental_append(spark, rows, path, "at", partition="part")
    assert sorted(tuple(r) for r in got.select("part", "at").collect()) == [(9, 1), (10, 2), (10, 3)]
