"""Random small inputs against plain Python."""

import datetime as dt
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.operators.groups import group_by_key
from eventloom.operators.joins import any_join, salted_join
from eventloom.operators.versions import collapse, latest_version, summing_merge
from eventloom.plans import marts, snapshots
from eventloom.streaming.nrt import nrt_revenue_1m

JOINS = ["inner", "left", "right", "full", "left_semi", "left_anti"]
few = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
keys = st.one_of(st.none(), st.integers(0, 3))
pairs = st.lists(st.tuples(keys, st.integers(-5, 5)), min_size=1, max_size=60)


def counted(df):
    return Counter(tuple(r) for r in df.collect())


@few
@given(left=pairs, right=pairs, how=st.sampled_from(JOINS))
def test_salted_join(spark, left, right, how):
    a = spark.createDataFrame(left, "k int, a int")
    b = spark.createDataFrame(right, "k int, b int")
    assert counted(salted_join(a, b, ["k"], how, hot_rows=3)) == counted(a.join(b, "k", how))


@few
@given(left=pairs, right=pairs)
def test_any_join(spark, left, right):
    a = spark.createDataFrame(left, "k int, a int")
    b = spark.createDataFrame(right, "k int, b int")
    least = {}
    for k, v in right:
        if k is not None:
            least[k] = min(least.get(k, v), v)
    want = Counter((k, v, least.get(k)) for k, v in left)
    assert counted(any_join(a, b, "k", [F.col("b")])) == want


@few
@given(rows=pairs, width=st.integers(1, 20))
def test_group_by_key(spark, rows, width):
    frame = spark.createDataFrame(rows, "k int, v int")
    got = defaultdict(list)
    for r in group_by_key(frame, "k", "v", F.floor(F.col("v") / width)).collect():
        assert list(r["runs"]) == sorted(r["runs"])
        assert all(x["v"] // width == r["bucket"] for x in r["runs"])
        got[r["k"]] += [x["v"] for x in r["runs"] for _ in range(x["n"])]
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@few
@given(rows=st.lists(st.tuples(keys, st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=40))
def test_latest_version(spark, rows):
    rows = [(k, v, i) for i, (k, v, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k int, version int, tie int")
    best = {}
    for row in rows:
        best[row[0]] = max(best.get(row[0], row), row, key=lambda r: r[1:])
    assert counted(latest_version(df, ["k"], "version", "tie")) == Counter(best.values())


@few
@given(rows=pairs)
def test_merges(spark, rows):
    df = spark.createDataFrame(rows, "k int, v int")
    sums = Counter()
    for k, v in rows:
        sums[k] += v
    want = Counter({(k, v): 1 for k, v in sums.items() if v})
    assert counted(summing_merge(df, ["k"], ["v"])) == want
    signed = df.withColumn("sign", F.when(F.col("v") >= 0, 1).otherwise(-1))
    balance = Counter()
    for k, v in rows:
        balance[k] += 1 if v >= 0 else -1
    got = {r["k"]: r["rows"] for r in collapse(signed, ["k"], "sign").collect()}
    assert got == {k: n for k, n in balance.items() if n > 0}


states = st.lists(
    st.dictionaries(st.integers(0, 4), st.one_of(st.none(), st.sampled_from("ab")), max_size=5),
    min_size=2,
    max_size=4,
)


@few
@given(states=states)
def test_history_by_check(spark, states):
    """After each step the versions valid at any past moment are the state then."""
    moments = [dt.datetime(2024, 1, 1 + i) for i in range(len(states))]

    def frame(state):
        return spark.createDataFrame(list(state.items()), "id int, v string")

    hist = snapshots.start_history(frame(states[0]), snapshots.moment(moments[0]))
    for state, as_of in zip(states[1:], moments[1:]):
        hist = snapshots.scd2_check(hist, frame(state), "id", ["v"], as_of)
    rows = hist.collect()
    for state, as_of in zip(states, moments):
        valid = [
            (r["id"], r["v"])
            for r in rows
            if r["valid_from"] <= as_of and (r["valid_to"] is None or as_of < r["valid_to"])
        ]
        assert Counter(valid) == Counter(state.items())


events = st.lists(
    st.tuples(
        st.integers(0, 200),
        st.one_of(st.none(), st.integers(1, 4)),
        st.sampled_from(["purchase", "page_view"]),
        st.sampled_from(["web", None]),
        st.one_of(st.none(), st.integers(-500, 500)),
    ),
    max_size=40,
)


@few
@given(rows=events)
def test_revenue_marts(spark, rows):
    start = dt.datetime(2024, 1, 1, 23, 58)
    data = [(start + dt.timedelta(seconds=s), u, n, p, c) for s, u, n, p, c in rows]
    df = spark.createDataFrame(
        data, "event_time timestamp_ntz, user_id int, event_name string, platform string, cents int"
    ).withColumn("price", (F.col("cents") / 100).cast("decimal(12,2)"))
    df = df.withColumn("event_date", F.to_date("event_time"))

    def want(group_of):
        groups = defaultdict(lambda: [0, set(), 0])
        for t, user, name, platform, cents in data:
            group = groups[(group_of(t), platform)]
            if name == "purchase":
                group[0] += 1
                group[1] |= {user} - {None}
                group[2] += cents or 0
        return {k: (n, len(users), total) for k, (n, users, total) in groups.items()}

    daily = {
        (r["event_date"], r["platform"]): (r["purchases"], r["buyers"], int(r["revenue"] * 100))
        for r in marts.fct_daily_revenue(df).collect()
    }
    assert daily == want(lambda t: t.date())
    minutes = {
        (r["window_start"], r["platform"]): (
            r["purchases_1m"], r["buyers_1m"], int(r["revenue_1m"] * 100)
        )
        for r in nrt_revenue_1m(df).collect()
    }
    assert minutes == want(lambda t: t.replace(second=0))
