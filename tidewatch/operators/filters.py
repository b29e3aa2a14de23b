"""Filters, projections and snapshot deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions import text as X


def flt_noise(events: DataFrame) -> DataFrame:
    return events.filter(~X.is_noise(F.col("sql_text")))


def flt_system_schema(events: DataFrame, *, column="database_name", own_schemas=()) -> DataFrame:
    """Keep user schemas; rows without a schema go too, as NOT IN does."""
    return events.filter(~F.col(column).isin(*K.SYSTEM_SCHEMAS, *own_schemas))


def flt_threshold(events: DataFrame, *, min_sec=0.5, min_rows=0, strict=False) -> DataFrame:
    seconds, rows = F.col("query_time_sec"), F.col("rows_examined")
    slow = seconds > min_sec if strict else seconds >= min_sec
    return events.filter(slow & (rows >= min_rows))


def flt_enabled_source(events: DataFrame, enabled: DataFrame) -> DataFrame:
    """Events of the (instance, source) pairs that are switched on."""
    return events.join(enabled, ["instance_id", "source"], "left_semi")


def http_reject_reason(sql: Column, max_len: int | None) -> Column:
    reason = F.when(sql.isNull() | sql.rlike(r"^\s*$"), "sql is required")
    return reason if max_len is None else reason.when(F.length(sql) > max_len, F.lit(f"sql exceeds max {max_len}"))


def flt_http_valid(events: DataFrame, *, max_len: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason). Statements may have any length unless `max_len` is given."""
    judged = events.withColumn("reject_reason", http_reject_reason(F.col("sql_text"), max_len))
    return (
        judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        judged.filter(F.col("reject_reason").isNotNull()),
    )


def flt_write_guard(statements: DataFrame) -> DataFrame:
    return statements.withColumn("is_write", X.has_write_word(F.col("sql_text")))


def flt_safe_identifier(tables: DataFrame, *, column="table_name") -> DataFrame:
    """Table names of letters, digits and underscores, after backticks are removed."""
    clean = F.trim(F.replace(F.col(column), F.lit("`"), F.lit("")))
    return tables.withColumn(column, clean).filter(F.col(column).rlike("^[A-Za-z0-9_]+$"))


def flt_known_variables(counters: DataFrame, *, names=K.KNOWN_VARIABLES) -> DataFrame:
    return counters.filter(F.lower(F.trim("variable_name")).isin(*names))


def flt_lock_waits(transactions: DataFrame, *, as_of: Column, min_age_sec=5) -> DataFrame:
    """Transactions that wait for a lock or are older than `min_age_sec` at `as_of`."""
    waited = transactions.withColumn(
        "wait_seconds", F.timestamp_diff("SECOND", F.col("trx_started"), as_of)
    )
    return waited.filter((F.col("trx_state") == "LOCK WAIT") | (F.col("wait_seconds") > min_age_sec))


def flt_stale_tasks(diagnoses: DataFrame, *, as_of: Column, stale_sec=180) -> DataFrame:
    """The table with RUNNING tasks not updated for `stale_sec` seconds marked as failed."""
    stale = (F.upper("status") == "RUNNING") & (
        F.col("updated_at") < F.timestamp_add("SECOND", F.lit(-stale_sec), as_of)
    )
    return diagnoses.withColumns({
        "error_message": F.when(stale, K.STALE_MESSAGE).otherwise(F.col("error_message")),
        "status": F.when(stale, "FAILED").otherwise(F.col("status")),
        "updated_at": F.when(stale, as_of).otherwise(F.col("updated_at")),
    })


def lookup_by_key(rows: DataFrame, keys: DataFrame, *, key) -> DataFrame:
    """Rows whose key is listed; the key table may be of any size."""
    return rows.join(keys, [key] if isinstance(key, str) else list(key), "left_semi")


def lookup_session(diagnoses: DataFrame, *, session_id: str, n: int) -> DataFrame:
    """The newest `n` tasks of one session."""
    mine = diagnoses.filter(F.col("session_id") == session_id)
    return mine.orderBy(F.desc("created_at"), F.desc("task_id")).limit(n)


def del_rows(rows: DataFrame, keys: DataFrame, *, key) -> DataFrame:
    """The next snapshot, without the listed keys."""
    return rows.join(keys, [key] if isinstance(key, str) else list(key), "left_anti")


def del_project(rows: DataFrame, *, project=None) -> DataFrame:
    """The next snapshot without one project, or empty when none is named."""
    if not project:
        return rows.filter(F.lit(False))
    return rows.filter(~F.col("project_code").eqNullSafe(project))


def del_retention(diagnoses: DataFrame, *, as_of: Column, days=90) -> DataFrame:
    """The next snapshot without tasks older than `days`."""
    oldest = F.timestamp_add("DAY", F.lit(-days), as_of)
    return diagnoses.filter(F.col("created_at").isNull() | (F.col("created_at") >= oldest))
