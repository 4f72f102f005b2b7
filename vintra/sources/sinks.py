"""Idempotent sinks: rows are appended only if their key is new, in one commit a call."""

from pyspark.sql import DataFrame, SparkSession

from vintra.sources.merge import MergedTable


def append_absent(spark: SparkSession, path: str, incoming: DataFrame, key: list[str], partition_by: str | None = None) -> int:
    """Appends the rows whose key isn't there; the number appended, as the write counted them. Makes the table if there is none. Read it by MergedTable."""
    return MergedTable(spark, path, key, partition_by).insert(incoming).inserted


def report(df: DataFrame, path: str) -> None:
    """A small result as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)
