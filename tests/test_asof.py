"""The join as of a time against a plain reading, with and without cut keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators.asof import as_of_join

ROWS = "k string, j int, t timestamp_ntz, n int"
VERSIONS = "k string, j int, since timestamp_ntz, until timestamp_ntz, v int"
START = dt.datetime(2024, 1, 1)


def slow(rows, versions):
    out = []
    for k, j, t, n in rows:
        own = [v for v in versions if None not in (k, j, t, v[2]) and v[:2] == (k, j) and v[2] <= t]
        # of equal starts the greatest, null before any value
        best = max(own, key=lambda v: (v[2], *((x is not None, x or START) for x in (v[3],)), v[4]), default=None)
        if best is None or (best[3] is not None and best[3] <= t):
            out.append((k, j, t, n, None, None, None))
        else:
            out.append((k, j, t, n, *best[2:]))
    return sorted(out, key=repr)


def made(seed, size):
    rng = random.Random(seed)

    def key():
        return ("hot", 1) if rng.random() < 0.5 else (rng.choice(["a", "b", None]), rng.choice([1, 2, None]))

    def moment(none=0.05):
        return None if rng.random() < none else START + dt.timedelta(hours=rng.randrange(200))

    rows = [(*key(), moment(), n) for n in range(size)]
    versions = []
    for v in range(size // 3):
        since = moment()
        long_ = dt.timedelta(hours=rng.randrange(1, 60))
        versions.append((*key(), since, since + long_ if since and rng.random() < 0.4 else None, v))
    return rows + rows[:20], versions


@pytest.mark.parametrize("hot_rows", [5_000_000, 40])
@pytest.mark.parametrize("slice_", ["1 day", "7 hours"])
def test_plain_reading(spark, hot_rows, slice_):
    rows, versions = made(1, 400)
    left, right = spark.createDataFrame(rows, ROWS), spark.createDataFrame(versions, VERSIONS)
    got = as_of_join(left, right, ["k", "j"], "t", "since", "until", hot_rows, slice_)
    assert got.columns == ["k", "j", "t", "n", "since", "until", "v"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow(rows, versions)


def test_other_types_of_keys_and_times(spark):
    rows, versions = made(2, 200)
    left = spark.createDataFrame(rows, ROWS).withColumn("t", F.col("t").cast("timestamp"))
    right = spark.createDataFrame(versions, VERSIONS).withColumn("j", F.col("j").cast("bigint"))
    got = as_of_join(left, right, ["k", "j"], "t", "since", "until", 30)
    want = [(*r[:2], None if r[2] is None else r[2].replace(tzinfo=None), *r[3:]) for r in slow(rows, versions)]
    found = got.withColumn("t", F.col("t").cast("timestamp_ntz")).collect()
    assert sorted(map(tuple, found), key=repr) == want


def test_empty_sides(spark):
    rows, versions = made(3, 60)
    left, right = spark.createDataFrame(rows, ROWS), spark.createDataFrame(versions, VERSIONS)
    none = as_of_join(left, right.limit(0), ["k", "j"], "t", "since", hot_rows=5)
    assert none.count() == len(rows) and none.where("v IS NOT NULL").isEmpty()
    assert as_of_join(left.limit(0), right, ["k", "j"], "t", "since").isEmpty()


def test_rows_of_a_hot_key_are_cut(spark):
    """Ten days of one key: no sorted group holds more than one of them."""
    left = spark.range(2400).selectExpr(
        "CAST(id % 1 AS STRING) AS k", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, CAST(6 * id AS INT)) AS t"
    )
    right = left.where("minute(t) = 0").select("k", F.col("t").alias("since"), F.hour("t").alias("v"))
    got = as_of_join(left, right, ["k"], "t", "since", hot_rows=1000)
    assert got.where("v <> hour(t) OR v IS NULL").isEmpty()
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in text and "Cartesian" not in text
    assert "Window" in text and "_slice" in text
