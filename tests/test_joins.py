"""Joins of every type at both plans, salting of hot keys, one match, lookups, grouping."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators import joins
from eventloom.operators.groups import group_by_key
from eventloom.registry.base import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has user 7."""
    events = table(spark, "/root/testdata/sf0.01", "events")
    user = F.when(F.col("event_id") < 3334, 7).otherwise(F.col("user_id"))
    return events.select("event_id", user.cast("bigint").alias("user_id"))


@pytest.fixture(scope="module")
def users(spark):
    """Several rows per user, also for the hot one; some users are missing."""
    return spark.range(0, 400).select(
        (F.col("id") % 100).alias("user_id"), F.col("id").alias("attribute")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, users, how):
    hot = joins.hot_keys([skewed, users], ["user_id"], 500).collect()
    assert [tuple(r) for r in hot] == [(7, 7, None)]
    got = joins.salted_join(skewed, users, ["user_id"], how, hot_rows=500)
    want = skewed.join(users, "user_id", how)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_salted_join_keeps_null_keys(spark, users):
    left = spark.createDataFrame([(None, i) for i in range(50)] + [(1, 99)], "user_id long, v int")
    got = joins.salted_join(left, users, ["user_id"], "left", hot_rows=10)
    assert got.count() == 50 + 4


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_of_the_right_side(spark, skewed, users, how):
    got = joins.salted_join(users, skewed, ["user_id"], how, hot_rows=500)
    want = users.join(skewed, "user_id", how)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_key_hot_on_both_sides(spark, skewed, how):
    """7 has 3334 rows left and 60 right; thresholds of 20 make it a grid."""
    right = spark.range(0, 90).select(
        F.when(F.col("id") < 60, 7).otherwise(F.col("id")).alias("user_id"),
        F.col("id").alias("attribute"),
    )
    got = joins.salted_join(skewed, right, ["user_id"], how, hot_rows=20)
    want = skewed.join(right, "user_id", how)
    assert rows(got.na.fill(-1)) == rows(want.na.fill(-1))
    assert "_cell" in plan(got) and "_salt" in plan(got)


def test_no_hot_keys(spark, skewed, users):
    assert joins.hot_keys([skewed, users], ["user_id"], 5000).isEmpty()
    assert joins.hot_keys([skewed.limit(0)], ["user_id"], 1).isEmpty()
    got = joins.salted_join(skewed, users, ["user_id"], "full", hot_rows=5000)
    assert rows(got.na.fill(-1)) == rows(skewed.join(users, "user_id", "full").na.fill(-1))


def test_salted_join_with_other_key_types(spark, skewed, users):
    narrow = users.withColumn("user_id", F.col("user_id").cast("int"))
    got = joins.salted_join(skewed, narrow, ["user_id"], "inner", hot_rows=500)
    want = skewed.join(narrow, "user_id")
    assert rows(got) == rows(want) and got.dtypes == want.dtypes


def test_salted_join_on_two_keys(spark, skewed, users):
    left = skewed.withColumn("part", F.lit("p"))
    right = users.withColumn("part", F.when(F.col("attribute") % 2 == 0, "p").otherwise("q"))
    got = joins.salted_join(left, right, ["user_id", "part"], "left", hot_rows=500)
    assert rows(got) == rows(left.join(right, ["user_id", "part"], "left"))


def test_salts_spread_the_hot_key(spark, skewed, users):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = joins.salted_join(skewed, users, ["user_id"], "inner", hot_rows=500)
        assert "_salt" in plan(joined) and "SortMergeJoin" in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_salted_join_reads_and_shuffles_each_side_once(spark, tmp_path, skewed, users, how):
    """Twice with the count of keys, which reads no other column; hot keys are counted once."""
    sides = []
    for name, df in (("left", skewed), ("right", users)):
        df.write.parquet(str(tmp_path / name))
        sides.append(spark.read.parquet(str(tmp_path / name)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = joins.salted_join(*sides, ["user_id"], how, hot_rows=500)
        text = plan(joined)
        counted = 1 if how in ("left_semi", "left_anti") else 2  # sides whose keys are counted
        distinct = 2 - counted  # the right side's keys, brought together first
        assert text.count("Scan parquet") <= 2 * (2 + counted)  # the hot keys stand in the plan twice
        assert text.count("Exchange hashpartitioning") - distinct <= 2 + 2
        joined.collect()
        text = plan(joined)
        assert "ReusedExchange" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["left", "right", "full", "left_anti"])
def test_null_keys_of_a_salted_join_are_spread(spark, how):
    left = spark.range(3000).selectExpr("IF(id % 3 = 0, id % 5, NULL) AS k", "id AS a")
    right = spark.range(40).selectExpr("IF(id % 4 = 0, id % 7, NULL) AS k", "id AS b")
    got = joins.salted_join(left, right, ["k"], how, hot_rows=20)
    assert rows(got.na.fill(-1)) == rows(left.join(right, "k", how).na.fill(-1))


@pytest.mark.parametrize("how", ["right", "full"])
@pytest.mark.parametrize("hot_rows", [20, 500])
def test_right_and_full_joins(spark, skewed, users, how, hot_rows):
    some = skewed.where("user_id <> 3")
    got = joins.salted_join(some, users, ["user_id"], how, hot_rows=hot_rows)
    want = some.join(users, "user_id", how)
    assert got.columns == want.columns
    assert rows(got.na.fill(-1)) == rows(want.na.fill(-1))


def test_equal_rows_of_a_hot_key_are_spread(spark, users):
    """Also with a column that cannot be hashed as it is."""
    same = spark.range(0, 1000).select(
        F.lit(7).cast("bigint").alias("user_id"), F.create_map(F.lit("k"), F.lit(1)).alias("m")
    )
    hot = joins.hot_keys([same, users], ["user_id"], 125)
    placed = joins._places(same.join(hot, "user_id"), "_salt", "_tasks0", "_tasks1", "_cell", ["user_id"])
    places = {r["_salt"]: r["count"] for r in placed.groupBy("_salt").count().collect()}
    assert places == dict.fromkeys(range(8), 125)  # eight tasks read them
    got = joins.salted_join(same, users, ["user_id"], "inner", hot_rows=125)
    assert got.groupBy("attribute").count().select("count").distinct().collect() == [(1000,)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize("join", ["enrich", "any_join", "preagg_join"])
def test_small_and_large_plan_agree(spark, skewed, users, join, how):
    def joined():
        if join == "enrich":
            return joins.enrich(skewed, users, "user_id", how)
        if join == "any_join":
            return joins.any_join(skewed, users, "user_id", [F.col("attribute")], how)
        return joins.preagg_join(skewed, "user_id", [F.count("*").alias("n")], users, how)

    small = joined()
    assert "BroadcastExchange" in plan(small) or how == "full"
    want = rows(small.na.fill(-1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        large = joined()
        assert "BroadcastExchange" not in plan(large)
        assert rows(large.na.fill(-1)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_building_a_join_runs_no_job(spark, skewed, users):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        joins.enrich(skewed, users, "user_id")
        joins.any_join(skewed, users, "user_id", [F.col("attribute")])
        joins.lookup(skewed, users, "user_id", "user_id", "attribute", -1)
        joins.preagg_join(skewed, "user_id", [F.count("*").alias("n")], users)
        joins.salted_join(skewed, users, ["user_id"], "full")
        assert not tracker.getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_any_join_matches_at_most_once(spark, skewed, users):
    got = joins.any_join(skewed, users, "user_id", [F.desc("attribute")])
    assert got.count() == skewed.count()
    assert got.where("user_id = 7").select("attribute").distinct().collect() == [(307,)]


def test_lookup_default_and_duplicate_keys(spark, skewed, users):
    got = joins.lookup(skewed, users, "user_id", "user_id", "attribute", -1)
    assert got.count() == skewed.count()
    assert got.where("user_id >= 100 and attribute <> -1").count() == 0
    assert got.where("user_id = 7 and attribute <> 7").count() == 0


def test_orphans_reduce_the_child_before_the_join(spark, skewed):
    parents = spark.range(0, 100).withColumnRenamed("id", "pk")
    found = joins.orphans(skewed, "user_id", parents, "pk")
    assert found.agg(F.sum("n_rows")).first()[0] == skewed.where("user_id >= 100").count()


def test_group_by_key_cuts_keys_by_the_declared_bucket(spark, skewed):
    grouped = group_by_key(skewed, "user_id", "event_id", F.expr("event_id DIV 400"))
    hot = grouped.where("user_id = 7").collect()
    assert len(hot) > 5 and max(len(r["runs"]) for r in hot) <= 400
    assert all(list(r["runs"]) == sorted(r["runs"]) for r in hot)
    assert all(v["event_id"] // 400 == r["bucket"] for r in hot for v in r["runs"])
    back = grouped.select("user_id", F.explode("runs.event_id").alias("event_id"))
    assert rows(back) == rows(skewed.select("user_id", "event_id"))


def test_group_by_key_with_one_value_repeated(spark):
    same = spark.range(0, 1000).select(F.lit("k").alias("key"), F.lit(5).alias("v"))
    got = group_by_key(same, "key", "v", F.lit(0)).collect()
    assert [(r["key"], r["bucket"], [tuple(x) for x in r["runs"]]) for r in got] == [("k", 0, [(5, 1000)])]


def test_group_by_key_null_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", None)], "key string, v int")
    found = group_by_key(df, "key", "v", F.expr("v DIV 10")).collect()
    got = {r["key"]: (r["bucket"], [x["v"] for x in r["runs"]]) for r in found}
    assert got == {None: (0, [1, 2]), "a": (None, [None])}
