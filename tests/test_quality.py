"""Checks, contracts, freshness, statistics, history."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.plans import quality, snapshots
from eventloom.plans.marts import fct_daily_revenue, stg_events
from eventloom.registry.base import raw
from eventloom.session import new_dir
from eventloom.sources.events import EVENT_NAMES, PLATFORMS

SF = "/root/testdata/sf0.01"


def test_declared_checks_of_the_three_layers(spark):
    source = raw(spark, SF)
    staged = stg_events(source)
    mart = fct_daily_revenue(staged)
    named = [quality.not_null_check(c) for c in ("event_time", "user_id", "event_name")]
    layers = [
        (source, [*named, quality.accepted_values_check("event_name", EVENT_NAMES)]),
        (staged, named),
        (
            mart,
            [
                quality.not_null_check("event_date"),
                quality.not_null_check("platform"),
                quality.accepted_values_check("platform", PLATFORMS),
            ],
        ),
    ]
    results = [
        {r["test"]: (r["failures"], r["status"]) for r in quality.run_checks(*layer).collect()}
        for layer in layers
    ]
    assert results[0].pop("accepted_values_event_name") == (4031, "fail")
    assert sum(map(len, results)) == 9
    assert all(v == (0, "pass") for r in results for v in r.values())


def test_checks_on_empty_input(spark):
    empty = raw(spark, SF).where(F.lit(False))
    checks = [
        quality.not_null_check("user_id"),
        quality.unique_check(empty, "event_id"),
        quality.relationships_check(empty, "user_id", spark.range(0).toDF("pk"), "pk"),
    ]
    summary = quality.run_checks(empty, checks, new_dir(spark, "failures")).collect()
    assert {(r["failures"], r["status"]) for r in summary} == {(0, "pass")}


def test_null_values_pass_all_but_not_null(spark):
    df = spark.createDataFrame([(None,), ("a",), ("a",), ("z",)], "k string")
    assert quality.not_null(df, "k").count() == 1
    assert quality.unique(df, "k").collect() == [("a", 2)]
    assert quality.accepted_values(df, "k", ["a"]).collect() == [("z",)]
    parents = spark.createDataFrame([("a",), (None,)], "pk string")
    assert quality.relationships(df, "k", parents, "pk").collect() == [("z", 1)]


def test_failures_are_stored_per_check(spark):
    path = new_dir(spark, "failures")
    events = raw(spark, SF)
    doubled = events.unionByName(events.where("event_id < 3"))
    checks = [
        quality.RowCheck("cheap", F.col("price") < 1, "warn"),
        quality.unique_check(doubled, "event_id"),
    ]
    summary = {r["test"]: r for r in quality.run_checks(doubled, checks, path).collect()}
    assert summary["cheap"]["status"] == "warn"
    stored = spark.read.parquet(f"{path}/rows")
    assert stored.where("test = 'cheap'").count() == summary["cheap"]["failures"]
    assert summary["unique_event_id"]["failures"] == 3
    assert spark.read.parquet(f"{path}/unique_event_id").count() == 3


@pytest.mark.parametrize("age, status", [(30, "pass"), (90, "warn"), (3000, "error")])
def test_freshness(spark, age, status):
    newest = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(newest,)], "ts timestamp")
    as_of = newest + dt.timedelta(minutes=age)
    limits = dt.timedelta(hours=1), dt.timedelta(days=1)
    row = quality.freshness(df, "ts", as_of, *limits).first()
    assert (row["status"], row["age_seconds"]) == (status, age * 60)
    assert quality.freshness(df.limit(0), "ts", as_of, *limits).first()["status"] == "error"


def test_contract(spark):
    df = spark.createDataFrame([("1", 2, "x"), ("y", 3, "x"), (None, 4, "x")], "a string, b int, c string")
    schema = T.StructType(
        [T.StructField("a", T.LongType()), T.StructField("b", T.IntegerType()),
         T.StructField("d", T.DateType())]
    )
    assert {(r["column"], r["problem"], r["bad_rows"]) for r in quality.check_contract(df, schema).collect()} == {
        ("a", "type", 1), ("c", "undeclared", None), ("d", "missing", None)
    }
    assert quality.check_contract(df, df.schema).count() == 0
    assert quality.require_contract(df, df.schema) is df
    with pytest.raises(ValueError, match="a: type; c: undeclared; d: missing"):
        quality.require_contract(df, schema)


def test_profile_counts_nulls_and_estimates(spark):
    df = spark.createDataFrame([(1, "b"), (1, None), (3, "a")], "n int, t string")
    rows = {r["column"]: r for r in quality.profile(df).collect()}
    assert rows["n"]["distinct_values"] == 2 and rows["n"]["max_value"] == "3"
    assert rows["t"]["nulls"] == 1 and rows["t"]["min_value"] == "a"
    near = {r["column"]: r["distinct_values"] for r in quality.profile(raw(spark, SF), exact=False).collect()}
    assert abs(near["event_id"] - 10_000) < 1000 and near["platform"] == 3


T0, T1, T2 = (dt.datetime(2024, m, 1) for m in (1, 2, 3))


def state(spark, rows):
    return spark.createDataFrame(rows, "id int, v string, updated_at timestamp")


def history(df):
    return sorted(
        (tuple(r) for r in df.select("id", "v", "valid_from", "valid_to").collect()),
        key=lambda r: (r[0] or 0, r[2]),
    )


def check_invariants(df, live):
    rows = history(df)
    open_keys = [r[0] for r in rows if r[3] is None]
    assert sorted(open_keys) == sorted(live)
    for a, b in zip(rows, rows[1:]):
        if a[0] == b[0]:
            assert a[3] is not None and a[3] <= b[2]


def test_history_by_timestamp(spark):
    hist = snapshots.start_history(
        state(spark, [(1, "a", T0), (2, "b", T0), (3, "c", T0)]), F.col("updated_at")
    )
    # 1 changes, 2 changes without a newer time, 3 is removed, 4 is new.
    second = state(spark, [(1, "a2", T1), (2, "b2", T0), (4, "d", T1)])
    hist = snapshots.scd2_timestamp(hist, second, "id", "updated_at", T1)
    assert history(hist) == [
        (1, "a", T0, T1), (1, "a2", T1, None), (2, "b", T0, None), (3, "c", T0, T1), (4, "d", T1, None)
    ]
    # 3 comes back.
    third = state(spark, [(1, "a2", T1), (2, "b", T0), (3, "c2", T2), (4, "d", T1)])
    hist = snapshots.scd2_timestamp(hist, third, "id", "updated_at", T2)
    assert history(hist)[3:5] == [(3, "c", T0, T1), (3, "c2", T2, None)]
    check_invariants(hist, [1, 2, 3, 4])


def test_history_by_check_is_null_safe_and_idempotent(spark):
    hist = snapshots.start_history(state(spark, [(1, None, T0), (2, "b", T0)]), F.lit(T0))
    second = state(spark, [(1, None, T1), (2, None, T1)])
    once = snapshots.scd2_check(hist, second, "id", ["v"], T1)
    assert history(once) == [(1, None, T0, None), (2, "b", T0, T1), (2, None, T1, None)]
    twice = snapshots.scd2_check(once, second, "id", ["v"], T2)
    assert history(twice) == history(once)
    check_invariants(twice, [1, 2])


def test_stored_history_is_repeatable(spark):
    path = new_dir(spark, "history")
    snapshots.create_history(state(spark, [(1, "a", T0), (2, "b", T0), (3, "c", T0)]), path, F.lit(T0))

    def advance(rows, run_id, as_of):
        def step(hist, cur):
            return snapshots.scd2_check(hist, cur, "id", ["v"], as_of)

        snapshots.advance_history(spark, path, state(spark, rows), run_id, step)
        return history(spark.read.parquet(path))

    second = [(1, "a2", T1), (2, "b", T1), (4, "d", T1)]
    want = [(1, "a", T0, T1), (1, "a2", T1, None), (2, "b", T0, None), (3, "c", T0, T1), (4, "d", T1, None)]
    assert advance(second, "r1", T1) == want
    assert advance(second, "r1", T1) == want
    third = [(1, "a2", T2), (2, "b3", T2), (4, "d", T2)]
    rows = advance(third, "r2", T2)
    assert len(rows) == 6 and (2, "b", T0, T2) in rows and (2, "b3", T2, None) in rows
    check_invariants(spark.read.parquet(path), [1, 2, 4])
    assert {r[3] for r in advance([], "r3", T2)} == {T1, T2}
    rows = advance([(9, "z", T2)], "r4", T2)
    check_invariants(spark.read.parquet(path), [9])
    assert {r[0] for r in spark.read.parquet(path).select("closed_in").distinct().collect()} == {
        "open", "r1", "r2", "r3"
    }


def test_null_key_stays_open(spark):
    hist = snapshots.start_history(state(spark, [(None, "a", T0), (2, "b", T0)]), F.lit(T0))
    again = snapshots.scd2_check(hist, state(spark, [(None, "a", T0), (2, "b", T0)]), "id", ["v"], T1)
    assert history(again) == history(hist)


def test_two_rows_of_a_key_are_refused(spark):
    hist = snapshots.start_history(state(spark, [(1, "a", T0)]), F.lit(T0))
    twice = snapshots.scd2_check(hist, state(spark, [(1, "a", T0), (1, "b", T0)]), "id", ["v"], T1)
    with pytest.raises(Exception, match="two rows of one key: 1"):
        twice.collect()


def test_returning_key_does_not_overlap(spark):
    hist = snapshots.start_history(state(spark, [(1, "a", T0), (2, "b", T0)]), F.lit(T0))
    hist = snapshots.scd2_timestamp(hist, state(spark, [(2, "b", T0)]), "id", "updated_at", T1)
    both = state(spark, [(1, "a", T0), (2, "b", T0)])
    hist = snapshots.scd2_timestamp(hist, both, "id", "updated_at", T2)
    assert history(hist) == [(1, "a", T0, T1), (1, "a", T1, None), (2, "b", T0, None)]


def test_emptied_history_fills_again(spark):
    path = new_dir(spark, "history")
    snapshots.create_history(state(spark, [(1, "a", T0)]), path, F.lit(T0))
    for run, rows, at in (("2024-01-02", [], T1), ("2024-01-03", [(1, "a", T0)], T2)):
        def step(hist, cur, at=at):
            return snapshots.scd2_check(hist, cur, "id", ["v"], at)

        snapshots.advance_history(spark, path, state(spark, rows), run, step)
    got = snapshots.read_history(spark, path)
    assert history(got) == [(1, "a", T0, T1), (1, "a", T2, None)]
    assert {r["closed_in"] for r in got.collect()} == {"2024-01-02", "open"}
