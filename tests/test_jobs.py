"""The runnable jobs end to end."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions.scalars import uuid_from_digest
from eventloom.jobs import build_marts, nrt_revenue
from eventloom.registry.base import raw
from eventloom.session import new_dir
from eventloom.sinks.files import write_parquet
from eventloom.sources.events import as_event_file
from eventloom.sources.load import read_loaded
from eventloom.streaming.nrt import nrt_read


def test_load_and_build(spark, sf_dir, capsys):
    out = new_dir(spark, "job")
    named = raw(spark, sf_dir, only=["page_view", "add_to_cart", "purchase"])
    file = as_event_file(named).withColumn("session_id", uuid_from_digest(F.col("session_id")))
    write_parquet(file, f"{out}/file")
    for _ in range(2):
        build_marts.main(["--events", f"{out}/file", "--warehouse", f"{out}/wh", "--load", "one"])
    assert read_loaded(spark, f"{out}/wh/events").count() == file.count()
    mart = spark.read.parquet(f"{out}/wh/fct_daily_revenue")
    bought = file.where("event_name = 'purchase'").count()
    assert mart.agg(F.sum("purchases")).first()[0] == bought > 0
    shown = capsys.readouterr().out
    assert "accepted_values_platform" in shown and "|fail " not in shown


def test_failing_check_ends_the_job(spark, sf_dir):
    out = new_dir(spark, "job")
    file = as_event_file(raw(spark, sf_dir)).withColumn("session_id", F.expr("uuid()"))
    write_parquet(file, f"{out}/file")
    with pytest.raises(SystemExit, match="accepted_values_event_name"):
        build_marts.main(["--events", f"{out}/file", "--warehouse", f"{out}/wh", "--load", "1"])


def test_nrt_job_from_rate_to_table(spark):
    out = new_dir(spark, "job")
    args = nrt_revenue.parse(
        ["--sink", "table", "--table", f"{out}/t", "--checkpoint", f"{out}/c",
         "--trigger", "1 second", "--rows-per-second", "100"]
    )
    query = nrt_revenue.start(spark, args)
    for _ in range(30):
        query.awaitTermination(1)
        if query.lastProgress and query.lastProgress["batchId"] >= 2:
            break
    query.stop()
    totals = nrt_read(spark, f"{out}/t")
    assert totals.columns == [
        "window_start", "window_end", "platform", "revenue_1m", "purchases_1m", "buyers_1m",
        "updated_at",
    ]
    assert totals.agg(F.sum("purchases_1m")).first()[0] > 0


def test_nrt_job_needs_its_targets():
    with pytest.raises(SystemExit):
        nrt_revenue.parse(["--sink", "table", "--checkpoint", "c"])
    with pytest.raises(SystemExit):
        nrt_revenue.parse(["--sink", "jdbc", "--checkpoint", "c", "--table", "t"])
