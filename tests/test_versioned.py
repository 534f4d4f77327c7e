"""Versions of tables: atomic changes, refused writers, expiry, copy-on-write, packing of files."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventloom.operators import versioned
from eventloom.operators.versioned import VersionConflict, VersionedTable, first_fit
from eventloom.session import new_dir
from eventloom.storage import child_names, data_files

SCHEMA = "id long, event_date date, name string, month int"


def rows(spark, first, last, files=1):
    """Ids in months of a hundred."""
    return spark.range(first, last, 1, files).selectExpr(
        "id", "DATE'2024-01-01' AS event_date", "CAST(id % 7 AS STRING) AS name", "CAST(id DIV 100 AS INT) AS month"
    )


@pytest.fixture
def table(spark):
    made = VersionedTable(spark, new_dir(spark, "versioned"))
    made.append(rows(spark, 0, 300))
    return made


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_stay_readable(spark, table):
    table.append(rows(spark, 250, 350))
    table.replace(rows(spark, 100, 110), drop=[0])
    assert table.versions() == [1, 2, 3]
    assert ids(table.read(1)) == list(range(300))
    assert ids(table.read(2)) == sorted([*range(300), *range(250, 350)])
    assert ids(table.read()) == sorted([*range(100, 110), *range(200, 300), *range(250, 350)])
    assert ids(table.read(2, [0])) == list(range(100))
    assert table.read().dtypes == [("id", "bigint"), ("event_date", "date"), ("name", "string"), ("month", "int")]
    assert table.read(1).groupBy("month").count().count() == 3


def test_a_failure_on_the_way_changes_nothing(spark, table, monkeypatch):
    """One month is written, the other fails; then the lists are written, the version fails."""
    broken = rows(spark, 0, 200).withColumn("name", F.expr("IF(id = 150, raise_error('no'), name)"))
    with pytest.raises(PySparkException):
        table.replace(broken)
    assert table.versions() == [1] and ids(table.read()) == list(range(300))

    def fail(spark, path, text, write=versioned.write_new):
        if "/versions/" in path:
            raise OSError("lost")
        return write(spark, path, text)

    monkeypatch.setattr(versioned, "write_new", fail)
    with pytest.raises(OSError):
        table.replace(rows(spark, 0, 150))
    monkeypatch.undo()
    assert table.versions() == [1] and ids(table.read()) == list(range(300))
    # what the failed writers left goes with the next expiry; nothing else does
    left = data_files(spark, f"{table.path}/data")
    table.expire(hours=0)
    assert len(data_files(spark, f"{table.path}/data")) == 3 < len(left)
    assert len(child_names(spark, f"{table.path}/files")) == 3
    assert ids(table.read()) == list(range(300))


def test_the_second_of_two_writers_is_refused(spark, table):
    other = VersionedTable(spark, table.path)
    base, files = other.current(), other.write_data(rows(spark, 300, 310))
    table.mutate(F.col("id") == 5)
    with pytest.raises(VersionConflict):
        other.commit(base, files, table._schema(base), "append")
    assert ids(other.read()) == [i for i in range(300) if i != 5]


def test_expiry_keeps_what_kept_versions_name(spark, table):
    table.mutate(F.col("id").isin(5, 205))
    table.append(rows(spark, 300, 310))
    assert table.expire(keep=2, hours=24) == [1]
    assert ids(table.read(2)) == [i for i in range(300) if i not in (5, 205)]
    table.expire(keep=1, hours=0)
    assert table.versions() == [3] and len(table.read().collect()) == 308
    named = {f for own in table.files().values() for f, _ in own}
    assert {f for f, _ in data_files(spark, f"{table.path}/data")} == named


def test_mutation_rewrites_files_with_hits_only(spark, table):
    table.append(rows(spark, 300, 400, files=4))
    before = table.files()
    done = table.mutate(F.col("id").isin(310, 350), {"name": F.lit("x")})
    after = table.files()
    assert done["files"] == 2 and {p: before[p] for p in "012"} == {p: after[p] for p in "012"}
    assert len(set(before["3"]) & set(after["3"])) == 2
    assert {r.id for r in table.read().where("name = 'x'").collect()} == {310, 350}
    # a condition that is null matches nothing; one that nothing matches makes no version
    number = table.current()
    assert table.mutate(F.lit(None).cast("boolean"))["files"] == 0
    assert table.mutate(F.col("id") < 0, {"name": F.lit("y")})["version"] == number == table.current()
    table.mutate(F.col("month") == 1)
    assert "1" not in table.files()
    with pytest.raises(ValueError):
        table.mutate(F.lit(True), {"month": F.lit(1)})


def test_compaction_leaves_large_files(spark, table):
    table.append(rows(spark, 0, 100, files=8).unionByName(rows(spark, 100, 120, files=5)))
    table.append(rows(spark, 900, 901))
    sizes = {f: s for own in table.files().values() for f, s in own}
    bound = table.files()["2"][0][1]
    before = table.files()
    done = table.compact(target_bytes=10 * bound, small_bytes=bound, sort=["id"])
    after = table.files()
    assert before["2"] == after["2"] and before["9"] == after["9"]
    gone = {f for own in before.values() for f, _ in own} - {f for own in after.values() for f, _ in own}
    assert done["bytes"] == sum(sizes[f] for f in gone) and all(sizes[f] < bound for f in gone)
    assert done["made"] == 2 and len(after["0"]) < len(before["0"])
    assert ids(table.read()) == sorted([*range(300), *range(100), *range(100, 120), 900])
    assert table.compact(target_bytes=10 * bound, small_bytes=1, sort=["id"])["files"] == 0


def test_empty_tables_and_null_partitions(spark):
    table = VersionedTable(spark, new_dir(spark, "versioned"))
    assert table.current() == 0
    table.append(spark.createDataFrame([], SCHEMA))
    assert table.read().columns == ["id", "event_date", "name", "month"] and table.read().count() == 0
    table.append(spark.createDataFrame([(1, None, None, None), (2, None, "a", 3)], SCHEMA))
    assert sorted((r.id, r.month) for r in table.read().collect()) == [(1, None), (2, 3)]
    table.mutate(F.col("id") == 1, {"name": F.lit("b")})
    assert {(r.id, r.month, r.name) for r in table.read().collect()} == {(1, None, "b"), (2, 3, "a")}
    with pytest.raises(ValueError):
        table.append(spark.range(3).withColumn("month", F.lit(1)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(20, 150))
def test_first_fit(sizes, target):
    files = [(f"f{i}", s) for i, s in enumerate(sizes)]
    bins = first_fit(files, target)
    assert sorted(f for b in bins for f in b) == sorted(files)
    assert all(sum(s for _, s in b) <= target or len(b) == 1 for b in bins)
    # at most one bin is filled to half or less, as two such would have become one
    assert sum(sum(s for _, s in b) <= target / 2 for b in bins) <= 1
