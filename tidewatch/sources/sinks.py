"""Snapshots and append-only outputs as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_version(rows: DataFrame, path: str, version: int, *, sort_by: str | None = None) -> DataFrame:
    """Write one immutable version and read it back; writing a version again replaces it, so a retry is harmless.

    With `sort_by` each file is sorted, without a shuffle, so that range filters on it skip row groups.
    """
    target = f"{path}/version={version:09d}"
    (rows.sortWithinPartitions(sort_by) if sort_by else rows).write.mode("overwrite").parquet(target)
    return rows.sparkSession.read.schema(rows.schema).parquet(target)


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version:09d}")


def sink_captured(rows: DataFrame, *, path: str, version: int) -> DataFrame:
    """The snapshot of folded statements."""
    return write_version(rows, path, version, sort_by="captured_at")


def sink_diagnosis(rows: DataFrame, *, path: str, version: int) -> DataFrame:
    """The snapshot of diagnosis tasks."""
    return write_version(rows, path, version, sort_by="created_at")


def sink_tasks(tasks: DataFrame, *, path: str, version: int) -> DataFrame:
    """One batch of tasks to be diagnosed."""
    return write_version(tasks, path, version)


def sink_audit(audit: DataFrame, *, path: str, version: int) -> DataFrame:
    """One batch of audit rows."""
    return write_version(audit, path, version)


def schema_align(old: DataFrame, *, schema: T.StructType) -> DataFrame:
    """An older snapshot in the current schema: missing columns are NULL, further columns stay at the end."""
    return old.sparkSession.createDataFrame([], schema).unionByName(old, allowMissingColumns=True)
