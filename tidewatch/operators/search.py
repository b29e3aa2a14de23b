"""Searches, pages, top lists and record views."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as X


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def is_diagnosed() -> Column:
    return F.col("diagnosis_report").isNotNull() & (F.col("diagnosis_report") != "N/A")


def match_captured(captured: DataFrame, *, project=None, instance=None, database=None, severity=None, start=None,
                   end=None, min_sec=None, max_sec=None, diagnosed=None, keyword=None) -> DataFrame:
    """Filter statements; a filter that is None or empty is off."""
    wanted = []
    for column, value in (("project_code", project), ("instance_id", instance), ("database_name", database),
                          ("severity", severity)):
        if value:
            wanted.append(F.col(column) == value)
    if start:
        wanted.append(F.col("captured_at") >= F.lit(start).cast(captured.schema["captured_at"].dataType))
    if end:
        wanted.append(F.col("captured_at") <= F.lit(end).cast(captured.schema["captured_at"].dataType))
    if min_sec is not None:
        wanted.append(F.col("query_time_sec") >= min_sec)
    if max_sec is not None:
        wanted.append(F.col("query_time_sec") <= max_sec)
    if diagnosed is not None:
        wanted.append(is_diagnosed() if diagnosed else ~is_diagnosed())
    if keyword:
        wanted.append(X.contains_text(F.col("sql_text"), keyword))
    return captured.filter(_all(wanted))


def search_captured(captured: DataFrame, *, page=1, size=20, tie="event_id", after: tuple | None = None, **filters) -> DataFrame:
    """One page of matching statements, newest first: the page of that number, or the one behind the row `after` (see `page_after`)."""
    if after is not None:
        return page_after(match_captured(captured, **filters), ts="captured_at", tie=tie, after=after, size=size)
    return page_of(match_captured(captured, **filters), order=[F.desc("captured_at"), F.desc(tie)], page=page, size=size)


def match_history(diagnoses: DataFrame, *, project=None, instance=None, start=None, end=None, source=None,
                  status=None, keyword=None) -> DataFrame:
    """Filter diagnosis tasks; a filter that is None or empty is off."""
    wanted = []
    for column, value in (("project_code", project), ("instance_id", instance), ("source", source)):
        if value:
            wanted.append(F.col(column) == value)
    kind = diagnoses.schema["created_at"].dataType
    if start:
        wanted.append(F.col("created_at") >= F.lit(start).cast(kind))
    if end:
        wanted.append(F.col("created_at") <= F.lit(end).cast(kind))
    if status:
        wanted.append(F.upper("status") == status.upper())
    if keyword:
        wanted.append(
            X.contains_text(F.col("original_sql"), keyword) | X.contains_text(F.col("clean_sql"), keyword)
        )
    return diagnoses.filter(_all(wanted))


def search_history(diagnoses: DataFrame, *, page=1, size=20, after: tuple | None = None, **filters) -> DataFrame:
    """One page of matching tasks, newest first: the page of that number, or the one behind the row `after` (see `page_after`)."""
    found = match_history(diagnoses, **filters)
    if after is not None:
        return page_after(found, ts="created_at", tie="task_id", after=after, size=size)
    return page_of(found, order=[F.desc("created_at"), F.desc("task_id")], page=page, size=size)


def history_status_filter(diagnoses: DataFrame, *, status: str) -> DataFrame:
    return match_history(diagnoses, status=status)


def page_of(rows: DataFrame, *, order, page=1, size=20) -> DataFrame:
    """Page `page` (from one) of `size` rows in `order`; end the order with a unique column."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(rows: DataFrame, *, ts: str, tie: str, after: tuple | None = None, size=20, window="1 hour") -> DataFrame:
    """The `size` rows that follow the row `after` = (time, id), the last one of the page before, newest first; rows without a time come last.

    Unlike an offset, this reads only what lies around the page: rows of a stretch of time that ends at `after` are looked at, and the
    stretch grows eightfold until it holds a page. Both its ends are plain comparisons that reach the scan, so that files and row groups
    sorted by time (as `sinks` writes them) are skipped. The ten-thousandth page costs what the second one does.
    """
    order = [F.desc_nulls_last(ts), F.desc(tie)]
    if after is None:
        return rows.orderBy(*order).limit(size)
    at, last = after
    if at is None:
        return rows.filter(F.col(ts).isNull() & (F.col(tie) < F.lit(last))).orderBy(*order).limit(size)
    kind = rows.schema[ts].dataType
    end = pd.Timestamp(at)
    behind = (F.col(ts) <= F.lit(str(end)).cast(kind)) & ((F.col(ts) < F.lit(str(end)).cast(kind)) | (F.col(tie) < F.lit(last)))
    reach = pd.Timedelta(window)
    while reach < pd.Timedelta(days=36_500):
        found = rows.filter((F.col(ts) > F.lit(str(end - reach)).cast(kind)) & behind).orderBy(*order).limit(size)
        if found.count() == size:
            return found
        reach *= 8
    return rows.filter(behind | F.col(ts).isNull()).orderBy(*order).limit(size)


def recent_n(captured: DataFrame, *, n=10, instance=None, project=None, tie="event_id") -> DataFrame:
    found = match_captured(captured, instance=instance, project=project)
    return found.orderBy(F.desc("captured_at"), F.desc(tie)).limit(n)


def top_frequent(captured: DataFrame, *, n=5, project=None) -> DataFrame:
    return match_captured(captured, project=project).orderBy(F.desc("occurrence_count"), "fingerprint").limit(n)


def prj_history_summary(diagnoses: DataFrame, *, cut=100) -> DataFrame:
    """List view of tasks: the cleaned text where there is one, cut to `cut` characters."""
    return diagnoses.select(
        "task_id", "project_code", "instance_id",
        X.preview(F.coalesce("clean_sql", "original_sql"), cut).alias("sql_preview"),
        "original_sql", "clean_sql", "status", "source", "fingerprint", "duration_ms", "tool_call_count", "created_at",
    )


def prj_record_view(captured: DataFrame, *, id_column="event_id") -> DataFrame:
    return captured.select(
        F.col(id_column).alias("id"), "sql_text", "database_name", "query_time_sec", "instance_id", "project_code",
        F.col("occurrence_count").alias("occurrence"), "severity", "diagnosis_report",
        F.coalesce(is_diagnosed(), F.lit(False)).alias("diagnosed"), "captured_at",
    )
