"""Data tests, check summaries, freshness, contracts and column statistics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.functions.scalars import moment
from eventloom.operators.joins import orphans


def not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows where the column is NULL."""
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Non-NULL values that occur more than once, with their number of rows."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def relationships(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Non-NULL child keys without a parent, with their number of child rows."""
    return orphans(child, fk, parent, pk)


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows with a non-NULL value outside the list."""
    return df.where(~F.col(column).isin(list(values)))


@dataclass(frozen=True)
class RowCheck:
    """A test of single rows: ``fails`` is true for a failing row."""

    name: str
    fails: Column
    severity: str = "error"


@dataclass(frozen=True)
class QueryCheck:
    """A test with its own query of failures.

    Each row counts as one failure, or as many as its column ``weight`` says.
    """

    name: str
    failing: DataFrame
    severity: str = "error"
    weight: str | None = None


def not_null_check(column: str, severity: str = "error") -> RowCheck:
    return RowCheck(f"not_null_{column}", F.col(column).isNull(), severity)


def accepted_values_check(column: str, values: Sequence, severity: str = "error") -> RowCheck:
    return RowCheck(f"accepted_values_{column}", ~F.col(column).isin(list(values)), severity)


def unique_check(df: DataFrame, column: str, severity: str = "error") -> QueryCheck:
    return QueryCheck(f"unique_{column}", unique(df, column), severity)


def relationships_check(
    child: DataFrame, fk: str, parent: DataFrame, pk: str, severity: str = "error"
) -> QueryCheck:
    failing = relationships(child, fk, parent, pk)
    return QueryCheck(f"relationships_{fk}", failing, severity, weight="n_rows")


def run_checks(
    df: DataFrame, checks: Sequence[RowCheck | QueryCheck], failures_path: str | None = None
) -> DataFrame:
    """One row per check: test, failures, severity, status (pass, warn or fail).

    All row checks share one pass over ``df``; each query check runs its own query.
    With ``failures_path`` the failing rows are stored, per check a folder.
    """
    row_checks = [c for c in checks if isinstance(c, RowCheck)]
    query_checks = [c for c in checks if isinstance(c, QueryCheck)]
    counts = []
    if row_checks:
        totals = df.agg(*(F.count_if(c.fails).alias(f"c{i}") for i, c in enumerate(row_checks)))
        entries = [
            F.struct(
                F.lit(c.name).alias("test"),
                F.col(f"c{i}").alias("failures"),
                F.lit(c.severity).alias("severity"),
            )
            for i, c in enumerate(row_checks)
        ]
        counts.append(totals.select(F.inline(F.array(*entries))))
    for c in query_checks:
        failures = F.sum(c.weight) if c.weight else F.count("*")
        counts.append(
            c.failing.agg(F.coalesce(failures, F.lit(0)).alias("failures")).select(
                F.lit(c.name).alias("test"), "failures", F.lit(c.severity).alias("severity")
            )
        )
    if failures_path is not None:
        store_failures(df, row_checks, query_checks, failures_path)
    status = F.when(F.col("failures") == 0, "pass").when(F.col("severity") == "warn", "warn")
    return reduce(DataFrame.unionByName, counts).withColumn("status", status.otherwise("fail"))


def store_failures(
    df: DataFrame,
    row_checks: Sequence[RowCheck],
    query_checks: Sequence[QueryCheck],
    path: str,
) -> None:
    """Failing rows as Parquet: ``path/rows/test=...`` and ``path/<query check>``."""
    if row_checks:
        failed = F.array_compact(F.array(*(F.when(c.fails, F.lit(c.name)) for c in row_checks)))
        (
            df.select("*", F.explode(failed).alias("test"))
            .write.mode("overwrite")
            .partitionBy("test")
            .parquet(f"{path}/rows")
        )
    for c in query_checks:
        c.failing.write.mode("overwrite").parquet(f"{path}/{c.name}")


def freshness(
    df: DataFrame,
    column: str,
    as_of: dt.datetime | Column,
    warn: dt.timedelta,
    error: dt.timedelta,
) -> DataFrame:
    """Age of the newest row against two limits; an empty source is an error."""
    newest = df.agg(F.max(column).alias("newest"))
    seen, last = moment(as_of).cast("timestamp"), F.col("newest").cast("timestamp")
    age = F.unix_micros(seen) - F.unix_micros(last)

    def older_than(limit: dt.timedelta) -> Column:
        return F.col("age_seconds") > limit.total_seconds()

    status = (
        F.when(F.col("newest").isNull() | older_than(error), "error")
        .when(older_than(warn), "warn")
        .otherwise("pass")
    )
    return newest.withColumn("age_seconds", age / 1_000_000).withColumn("status", status)


def check_contract(df: DataFrame, schema: StructType) -> DataFrame:
    """Differences between the declared and the actual columns, one row each.

    For a column of another type ``bad_rows`` counts the values that would not
    convert; a change of type without bad rows is still a difference.
    """
    spark = df.sparkSession
    declared = {f.name: f.dataType.simpleString() for f in schema}
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = []
    retyped = [n for n in declared if n in actual and declared[n] != actual[n]]
    bad = {}
    if retyped:
        lost = [
            F.count_if(F.col(n).isNotNull() & F.col(n).try_cast(declared[n]).isNull()).alias(n)
            for n in retyped
        ]
        bad = df.agg(*lost).first().asDict()
    for name in sorted(declared.keys() | actual.keys()):
        if name not in actual:
            rows.append((name, "missing", declared[name], None, None))
        elif name not in declared:
            rows.append((name, "undeclared", None, actual[name], None))
        elif name in retyped:
            rows.append((name, "type", declared[name], actual[name], bad[name]))
    return spark.createDataFrame(
        rows, "column string, problem string, expected string, actual string, bad_rows bigint"
    )


def require_contract(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` itself if it keeps the contract, else an error: a gate before a write."""
    differences = check_contract(df, schema).collect()
    if differences:
        raise ValueError("; ".join(f"{d['column']}: {d['problem']}" for d in differences))
    return df


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: type, rows, nulls, distinct values, least and greatest as text.

    Exact distinct counts copy each row once per column into the shuffle; on very
    large tables ``exact=False`` counts by sketch in one pass.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count("*").alias("rows")]
    for i, (name, _) in enumerate(df.dtypes):
        aggs += [
            F.count(name).alias(f"filled{i}"),
            distinct(F.col(name)).alias(f"distinct{i}"),
            F.min(name).cast("string").alias(f"min{i}"),
            F.max(name).cast("string").alias(f"max{i}"),
        ]
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.col("rows"),
            (F.col("rows") - F.col(f"filled{i}")).alias("nulls"),
            F.col(f"distinct{i}").alias("distinct_values"),
            F.col(f"min{i}").alias("min_value"),
            F.col(f"max{i}").alias("max_value"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))
