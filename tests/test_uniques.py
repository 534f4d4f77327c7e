"""Stored states of distinct counts against plain counts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from eventloom.plans import uniques
from eventloom.session import new_dir

SCHEMA = "event_date date, platform string, user_id long, event_name string"
FIRST = dt.date(2024, 1, 1)


def made(seed=1, size=600):
    rng = random.Random(seed)
    users = [rng.choice([1, 5, 32767, 32768, 70_000, 2**40, 0, -3]) + rng.randrange(4) for _ in range(30)]
    return [
        (
            FIRST + dt.timedelta(days=rng.choice([0, 1, 2, 4, 9])),
            rng.choice(["web", "ios", None]),
            rng.choice([*users, None]),
            rng.choice(["purchase", "purchase", "page_view", None]),
        )
        for _ in range(size)
    ]


def slow(rows, group, wanted=lambda r: True):
    found = {}
    for r in rows:
        if r[3] == "purchase" and r[2] is not None and wanted(r):
            found.setdefault(group(r), set()).add(r[2])
    return {k: len(v) for k, v in found.items()}


def test_states_of_days_give_any_range(spark):
    rows = made()
    states = uniques.buyer_states(spark.createDataFrame(rows, SCHEMA))
    got = uniques.count_users(states.where(F.col("event_date") > FIRST), ["platform"])
    assert {r.platform: r.buyers for r in got.collect()} == slow(rows, lambda r: r[1], lambda r: r[0] > FIRST)
    # states of states, united twice
    days = uniques.united(states.unionByName(states), ["event_date"])
    got = uniques.count_users(days, ["event_date"])
    assert {r.event_date: r.buyers for r in got.collect()} == slow(rows, lambda r: r[0])


def test_trailing_days(spark):
    rows = made(2)
    states = uniques.buyer_states(spark.createDataFrame(rows, SCHEMA))
    got = uniques.trailing_users(states, 3, ["platform"])
    ends = {r[0] for r in rows}
    want = {}
    for end in ends:
        last = slow(rows, lambda r: r[1], lambda r, end=end: 0 <= (end - r[0]).days < 3)
        want |= {(end, p): n for p, n in last.items()}
    assert {(r.event_date, r.platform): r.buyers for r in got.collect()} == want


def test_counts_read_no_event(spark):
    path = new_dir(spark, "buyers")
    events = spark.createDataFrame(made(3), SCHEMA)
    uniques.buyer_states(events).write.parquet(path)
    counted = uniques.count_users(spark.read.parquet(path), ["platform"])
    assert all(f.startswith(f"file://{path}") for f in counted.inputFiles())
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "user_id" not in plan and plan.count("Scan parquet") == 1


def test_sketches_unite(spark):
    events = spark.range(60_000).selectExpr(
        "id % 60 AS minute", "(id * 7919) % 20000 AS user_id", "IF(id % 5 = 0, 'page_view', 'purchase') AS event_name"
    )
    minutes = uniques.buyer_sketches(events, ["minute"])
    hour = uniques.estimate_users(minutes, [F.lit(1).alias("hour")])
    exact = events.where("event_name = 'purchase'").select("user_id").distinct().count()
    assert abs(hour.first()["buyers"] - exact) < 0.05 * exact


def test_no_buyers(spark):
    events = spark.createDataFrame([(FIRST, "web", 1, "page_view"), (FIRST, "web", None, "purchase")], SCHEMA)
    assert uniques.buyer_states(events).isEmpty()
    sketches = uniques.buyer_sketches(events, ["platform"])
    assert [tuple(r) for r in uniques.estimate_users(sketches, ["platform"]).collect()] == [("web", 0)]
    assert uniques.trailing_users(uniques.buyer_states(events.limit(0)), 7).isEmpty()
