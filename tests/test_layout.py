"""The interleaved layout: row groups that lookups by user and by day have to read."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from eventloom.registry.base import raw
from eventloom.sinks.files import write_raw_events
from eventloom.sinks.layout import with_interleaved, write_for_lookups
from eventloom.storage import data_files

SF = "/root/testdata/sf0.1"


def row_groups(path, column, value):
    """(row groups whose range holds the value, all row groups)."""
    hits = total = 0
    for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(file).metadata
        place = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
        for group in range(meta.num_row_groups):
            stats = meta.row_group(group).column(place).statistics
            total += 1
            hits += stats.min <= value <= stats.max
    return hits, total


def test_both_lookups_read_few_row_groups(spark, tmp_path):
    events = raw(spark, SF)
    plain, woven = str(tmp_path / "plain"), str(tmp_path / "woven")
    write_raw_events(events, plain, files=64)
    write_for_lookups(events, woven, ["event_date", "user_id"], files=64, bloom=["user_id"])
    for user in (3, 700, 1400):
        assert row_groups(plain, "user_id", user)[0] > 40
        hits, total = row_groups(woven, "user_id", user)
        assert total >= 60 and hits <= total / 4
    for day in (dt.date(2024, 1, 1), dt.date(2024, 1, 15)):
        hits, total = row_groups(woven, "event_date", day)
        assert hits <= total / 4
    stored = spark.read.parquet(woven)
    assert stored.columns == events.columns and stored.count() == events.count()
    assert stored.where("user_id = 700").count() == events.where("user_id = 700").count()
    # a column of single values, which no dictionary holds: its Bloom filters make files larger
    more = str(tmp_path / "more")
    write_for_lookups(events, more, ["event_date", "user_id"], files=64, bloom=["event_id"])
    assert sum(s for _, s in data_files(spark, more)) > 1.01 * sum(s for _, s in data_files(spark, woven))


def test_hot_value_is_spread(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("IF(id % 3 = 0, 7, id) AS a", "id % 97 AS b", "id AS c")
    path = str(tmp_path / "hot")
    write_for_lookups(rows, path, ["a", "b"], files=16)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/*.parquet")]
    assert max(sizes) < 4 * sum(sizes) / 16


def test_odd_columns(spark):
    rows = [(None, None, 1.5), (dt.date(2024, 1, 1), dt.datetime(2024, 1, 1), float("nan")), (None, None, None)]
    df = spark.createDataFrame(rows, "d date, t timestamp_ntz, x double")
    placed = with_interleaved(df, ["d", "t", "x"], bits=3)
    assert placed.count() == 3 and placed.where("_place IS NULL OR _place < 0 OR _place >= 512").isEmpty()
    assert with_interleaved(df.limit(0), ["d"]).isEmpty()
    with pytest.raises(TypeError):
        with_interleaved(df.withColumn("s", F.lit("x")), ["s"])


def test_pieces_are_narrow_in_every_column(spark):
    """Columns of few and of many values, one of them skewed."""
    rows = spark.range(8192).selectExpr("id % 20 AS a", "pow(id * 31 % 8192, 3) AS b", "xxhash64(id) AS c")
    ordered = with_interleaved(rows, ["a", "b", "c"]).orderBy("_place").collect()
    ranks = {x: {v: i for i, v in enumerate(sorted({r[x] for r in ordered}))} for x in "abc"}
    shares = []
    for at in range(0, 8192, 512):  # a place in the middle of the curve may jump; most do not
        own = [{ranks[x][r[x]] for r in ordered[at : at + 512]} for x in "abc"]
        shares.append([(max(o) - min(o) + 1) / len(ranks[x]) for o, x in zip(own, "abc")])
    means = [sum(column) / 16 for column in zip(*shares)]
    assert max(means) < 0.7 and sum(a * b * c for a, b, c in shares) / 16 < 0.2
