"""Reference tables kept as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_seed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header row, read with declared types; a bad line is an error."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")
