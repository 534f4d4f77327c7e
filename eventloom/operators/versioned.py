"""Parquet tables whose content a version names, file by file.

A version is a small file that points, for each partition, to a list of data files. It is
written once, last, under the next free number: until then nobody sees what a writer has
written, and of two writers that start from the same version one is refused. So any number
of partitions changes at once, a failure on the way leaves the table as it was, and earlier
versions stay readable until they expire. Data files never change.

    path/versions/<n>.json   partition -> list of files, schema, what was done
    path/files/<id>.json     files of one partition with their sizes
    path/data/commit=<id>/<partition>=<value>/...

A commit writes the lists of the partitions it touches and one version file; a reader of some
partitions opens their lists only. The driver holds about a hundred bytes for a data file.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.sinks.files import CLUSTER_KEYS
from eventloom.storage import (
    child_names,
    data_files,
    modified_at,
    move,
    read_text,
    remove,
    write_new,
)

File = tuple[str, int]  # path inside the data folder, bytes


class VersionConflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class VersionedTable:
    """A table of files by one partition column, see the module."""

    def __init__(self, spark: SparkSession, path: str, partition: str = "month"):
        self.spark, self.path, self.partition = spark, path, partition

    # Versions

    def versions(self) -> list[int]:
        names = child_names(self.spark, f"{self.path}/versions")
        return sorted(int(n.removesuffix(".json")) for n in names if n[0] != "_")

    def current(self) -> int:
        """Number of the newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def _version(self, number: int) -> dict:
        if not number:
            return {"partitions": {}, "schema": None}
        return json.loads(read_text(self.spark, self._version_file(number)))

    def _version_file(self, number: int) -> str:
        return f"{self.path}/versions/{number:012}.json"

    def files(self, version: int | None = None, partitions: Iterable | None = None) -> dict[str, list[File]]:
        """Data files by partition value, as text."""
        lists = self._version(self.current() if version is None else version)["partitions"]
        wanted = lists if partitions is None else {str(p) for p in partitions} & set(lists)
        return {
            p: [tuple(f) for f in json.loads(read_text(self.spark, f"{self.path}/files/{lists[p]}.json"))]
            for p in sorted(wanted)
        }

    def read(self, version: int | None = None, partitions: Iterable | None = None) -> DataFrame:
        """Rows of a version, the newest by default; of some partitions only, if named."""
        number = self.current() if version is None else version
        found = self.files(number, partitions)
        return self._rows([f for files in found.values() for f in files], self._schema(number))

    def _schema(self, number: int) -> StructType:
        return StructType.fromJson(self._version(number)["schema"])

    def _rows(self, files: Sequence[File], schema: StructType, name: str | None = None) -> DataFrame:
        """Rows of data files; ``name`` adds the path of each row's file inside the data folder."""
        if not files:
            empty = self.spark.createDataFrame([], schema)
            return empty if name is None else empty.withColumn(name, F.lit(""))
        base = f"{self.path}/data"
        rows = self.spark.read.schema(schema).option("basePath", base)
        rows = rows.parquet(*(f"{base}/{f}" for f, _ in files))
        columns = [F.col(f"`{f.name}`") for f in schema]
        if name is not None:
            columns.append(F.regexp_extract("_metadata.file_path", "/data/(commit=[^/]*/.*)$", 1).alias(name))
        return rows.select(*columns)

    def commit(self, base: int, changes: Mapping[str, Sequence[File]], schema: StructType, done: str) -> int:
        """Make the version after ``base``: partitions in ``changes`` have these files, or go."""
        lists = dict(self._version(base)["partitions"])
        for value, files in changes.items():
            lists.pop(value, None)
            if files:
                lists[value] = uuid.uuid4().hex
                write_new(self.spark, f"{self.path}/files/{lists[value]}.json", json.dumps(sorted(files)))
        version = {"partitions": lists, "schema": schema.jsonValue(), "done": done, "at": time.time()}
        if not write_new(self.spark, self._version_file(base + 1), json.dumps(version)):
            raise VersionConflict(f"version {base + 1} of {self.path} is there already: {done} is refused")
        return base + 1

    def write_data(self, rows: DataFrame) -> dict[str, list[File]]:
        """Write rows as new files that no version names yet; their files by partition."""
        folder = f"commit={uuid.uuid4().hex}"
        rows.write.partitionBy(self.partition).parquet(f"{self.path}/data/{folder}")
        return self._written(folder)

    def _written(self, folder: str) -> dict[str, list[File]]:
        found: dict[str, list[File]] = {}
        for name, size in data_files(self.spark, f"{self.path}/data/{folder}"):
            value = name.split("/", 1)[0].split("=", 1)[1]
            found.setdefault(value, []).append((f"{folder}/{name}", size))
        return found

    # Changes; each is one version

    def append(self, rows: DataFrame) -> int:
        base = self.current()
        old = self.files(base)
        new = self.write_data(rows)
        changes = {p: old.get(p, []) + files for p, files in new.items()}
        return self.commit(base, changes, self._widened(base, rows), "append")

    def replace(self, rows: DataFrame, drop: Iterable = ()) -> int:
        """Put the rows in place of the partitions they have, and drop others, all at once."""
        base = self.current()
        new = self.write_data(rows)
        changes = {str(p): [] for p in drop} | new
        return self.commit(base, changes, self._widened(base, rows), "replace")

    def drop(self, partitions: Iterable) -> int:
        base = self.current()
        return self.commit(base, {str(p): [] for p in partitions}, self._schema(base), "drop")

    def _widened(self, base: int, rows: DataFrame) -> StructType:
        """The table's schema; rows must have the same columns."""
        if not base:
            return StructType([f for f in rows.schema if f.name != self.partition] + [rows.schema[self.partition]])
        schema = self._schema(base)
        if {f.name: f.dataType for f in schema} != {f.name: f.dataType for f in rows.schema}:
            raise ValueError(f"columns differ: {rows.schema.simpleString()}, table {schema.simpleString()}")
        return schema

    def mutate(self, predicate: Column, set_exprs: Mapping[str, Column] | None = None) -> dict[str, int]:
        """Update the matching rows with ``set_exprs``, or delete them without it.

        Files without a matching row stay as they are; the others are written anew, copy on
        write. Rows where the predicate is NULL stay. The partition column must not be set.
        Returns the number of files and bytes written anew.
        """
        if set_exprs and self.partition in set_exprs:
            raise ValueError(f"{self.partition} is the partition column")
        base = self.current()
        schema, stored = self._schema(base), self.files(base)
        hit = F.coalesce(predicate, F.lit(False))
        files = [f for p in stored.values() for f in p]
        # one row per file with matches, so the result is bounded by the number of files
        found = self._rows(files, schema, "_file").where(hit).select("_file").distinct().collect()
        hits = {r[0] for r in found}
        touched = {p: [f for f in own if f[0] in hits] for p, own in stored.items()}
        touched = {p: own for p, own in touched.items() if own}
        if not touched:
            return {"files": 0, "bytes": 0, "version": base}
        rows = self._rows([f for own in touched.values() for f in own], schema)
        if set_exprs:
            rows = rows.withColumns(
                {
                    name: F.when(hit, value).otherwise(F.col(name)).cast(schema[name].dataType)
                    for name, value in set_exprs.items()
                }
            )
        else:
            rows = rows.where(~hit)
        new = self.write_data(rows)
        changes = {
            p: [f for f in stored[p] if f[0] not in hits] + new.get(p, []) for p in touched
        }
        version = self.commit(base, changes, schema, "mutate")
        rewritten = [size for own in touched.values() for _, size in own]
        return {"files": len(rewritten), "bytes": sum(rewritten), "version": version}

    def compact(
        self, target_bytes: int = 128 << 20, small_bytes: int | None = None, sort: Sequence[str] = CLUSTER_KEYS
    ) -> dict[str, int]:
        """Merge files under ``small_bytes`` (half the target) into files of about the target.

        Larger files stay where they are and are not read. Small files of a partition are
        packed first-fit by size; what shares a new file is read and written by one task, in
        the order of ``sort``. Returns the number of files and bytes merged and made.
        """
        base = self.current()
        schema, stored = self._schema(base), self.files(base)
        small = target_bytes // 2 if small_bytes is None else small_bytes
        bins: list[tuple[str, list[File]]] = []
        for value, files in stored.items():
            packed = first_fit([f for f in files if f[1] < small], target_bytes)
            bins += [(value, own) for own in packed if len(own) > 1]
        if not bins:
            return {"files": 0, "bytes": 0, "made": 0, "version": base}
        merged = {f for _, own in bins for f in own}
        new = self._merge(bins, schema, sort)
        changes = {
            p: [f for f in stored[p] if f not in merged] + new.get(p, []) for p in {p for p, _ in bins}
        }
        version = self.commit(base, changes, schema, "compact")
        made = sum(len(own) for own in new.values())
        return {"files": len(merged), "bytes": sum(s for _, s in merged), "made": made, "version": version}

    def _merge(self, bins, schema: StructType, sort: Sequence[str]) -> dict[str, list[File]]:
        """One new file for each bin."""
        spark = self.spark
        places = [(f, i) for i, (_, own) in enumerate(bins) for f, _ in own]
        places = spark.createDataFrame(places, "_file string, _bin int")
        rows = self._rows([f for _, own in bins for f in own], schema, "_file")
        rows = rows.join(places, "_file").drop("_file")
        folder = f"commit={uuid.uuid4().hex}"
        (
            rows.repartition(len(bins), "_bin")
            .sortWithinPartitions("_bin", *sort)
            .write.partitionBy(self.partition, "_bin")
            .parquet(f"{self.path}/data/{folder}")
        )
        # the bin's folder kept the bins of a task apart; a table has one level of folders only
        for name, _ in data_files(spark, f"{self.path}/data/{folder}"):
            value, bin_, file = name.split("/")
            move(spark, f"{self.path}/data/{folder}/{name}",
                 f"{self.path}/data/{folder}/{value}/{bin_.removeprefix('_')}-{file}")
        return self._written(folder)

    def expire(self, keep: int = 1, hours: float = 24) -> list[int]:
        """Forget all but the newest versions, and remove files that none of these names.

        Files younger than ``hours`` stay: a writer may be about to commit them.
        """
        versions = self.versions()
        gone, kept = versions[:-keep], versions[-keep:]
        lists, named = set(), set()
        for number in kept:
            lists |= set(self._version(number)["partitions"].values())
            named |= {f for own in self.files(number).values() for f, _ in own}
        for number in gone:
            remove(self.spark, self._version_file(number))
        bound = time.time() - hours * 3600
        for name in child_names(self.spark, f"{self.path}/files"):
            path = f"{self.path}/files/{name}"
            if name.removesuffix(".json") not in lists and modified_at(self.spark, path) <= bound:
                remove(self.spark, path)
        for folder in child_names(self.spark, f"{self.path}/data"):
            path = f"{self.path}/data/{folder}"
            if modified_at(self.spark, path) > bound:
                continue
            files = [f for f, _ in data_files(self.spark, path)]
            if not any(f"{folder}/{f}" in named for f in files):
                remove(self.spark, path)
                continue
            for file in files:
                if f"{folder}/{file}" not in named:
                    remove(self.spark, f"{path}/{file}")
        return gone


def first_fit(files: Sequence[File], target: int) -> list[list[File]]:
    """Files in bins of ``target`` bytes at most, larger files first, each in the first that fits."""
    bins: list[list[File]] = []
    room: list[int] = []
    open_ = 0  # bins before this one are full for every file still to come
    least = min((size for _, size in files), default=0)
    for file in sorted(files, key=lambda f: (-f[1], f[0])):
        while open_ < len(bins) and room[open_] < least:
            open_ += 1
        for i in range(open_, len(bins)):
            if room[i] >= file[1]:
                bins[i].append(file)
                room[i] -= file[1]
                break
        else:
            bins.append([file])
            room.append(target - file[1])
    return bins


def rebuild_since(
    table: VersionedTable, src: DataFrame, model: Callable[[DataFrame], DataFrame], since
) -> int:
    """Recompute the model's partitions from ``since`` on; they change in one version.

    The partition column is one of the source and of the model. A stored partition in the
    range for which the model gives no rows any more goes.
    """
    spark, column = table.spark, table.partition
    base = table.current()
    rows = model(src if since is None else src.where(F.col(column) >= F.lit(since)))
    rows = rows.hint("rebalance", column)
    stored = spark.createDataFrame([(v,) for v in table.files(base)], "v string")
    typed = F.col("v").cast(rows.schema[column].dataType)
    in_range = stored if since is None else stored.where(typed >= F.lit(since))
    return table.replace(rows, [r.v for r in in_range.collect()])
