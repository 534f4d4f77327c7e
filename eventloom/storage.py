"""Directory-level operations on partitioned tables (metadata only, no data)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Fixed value: the folder name of a NULL partition value.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _open(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _open(spark, path)
    return fs.exists(jpath)


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = _open(spark, path)
    fs.delete(jpath, True)


def partition_values(spark: SparkSession, table: str, column: str) -> list[str]:
    """Non-NULL values of a top-level partition column, read from folder names.

    Folder names are escaped; these are the values themselves, as text.
    """
    fs, jpath = _open(spark, table)
    names = [status.getPath().getName() for status in fs.listStatus(jpath)]
    values = [n.split("=", 1)[1] for n in names if n.startswith(f"{column}=")]
    utility = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return sorted(utility.unescapePathName(v) for v in values if v != NULL_FOLDER)


def drop_partitions(spark: SparkSession, table: str, column: str, values: Iterable) -> None:
    """Remove the folders of the values, given as text as ``partition_values`` gives them."""
    utility = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for value in values:
        folder = NULL_FOLDER if value is None else utility.escapePathName(str(value))
        remove(spark, f"{table}/{column}={folder}")


def overwrite_partitions(df: DataFrame, table: str, column: str) -> None:
    """Replace exactly the partitions present in ``df``.

    Dynamic overwrite writes all files to a staging folder and swaps partitions
    at job commit, so ``df`` may read the partitions it replaces. With plain
    Parquet the swap is per partition: a driver crash in the middle of the commit
    leaves earlier partitions new and later ones old, and rerunning repairs it.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(table)
    )


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    fs, jpath = _open(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


def data_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path inside the folder, bytes) of all data files under it."""
    fs, jpath = _open(spark, folder)
    if not fs.exists(jpath):
        return []
    root = fs.makeQualified(jpath).toUri()
    found, files = [], fs.listFiles(jpath, True)
    while files.hasNext():
        status = files.next()
        if not status.getPath().getName().startswith(("_", ".")):
            name = root.relativize(status.getPath().toUri()).getPath()
            found.append((name, status.getLen()))
    return sorted(found)


def modified_at(spark: SparkSession, path: str) -> float:
    """Time of the last change in seconds since 1970."""
    fs, jpath = _open(spark, path)
    return fs.getFileStatus(jpath).getModificationTime() / 1000


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a file another name; fails if there is one of that name."""
    jvm = spark._jvm
    no_options = spark.sparkContext._gateway.new_array(
        getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0
    )
    fs, jsource = _open(spark, source)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(jsource).toUri(), spark._jsc.hadoopConfiguration()
    )
    context.rename(fs.makeQualified(jsource), fs.makeQualified(_open(spark, target)[1]), no_options)


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that nobody sees half done; false if it is there already."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/_{uuid.uuid4().hex}-{name}"
    fs, jdraft = _open(spark, draft)
    stream = fs.create(jdraft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        move(spark, draft, path)
    except Py4JJavaError as error:
        fs.delete(jdraft, False)
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _open(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
