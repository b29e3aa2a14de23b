"""Capture sources. Each returns rows of the one event shape in `schemas.EVENT`, as far as the source knows them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch import schemas
from tidewatch.functions.text import blank_to_null

BLOCK_START = "\n# Time:"
_HEADER = r"^(?:(?:(?:use|USE)\s+[^\n;]+|SET timestamp=\d+(?:\.\d+)?)\s*;[ \t]*(?:\n|$)|[ \t]*\n)*+"


def slow_log_blocks(lines: DataFrame) -> DataFrame:
    """Text rows read with `lineSep=BLOCK_START` -> one parsed row per block, header blocks included.

    Needs the columns value, file_path and file_block_start, and file_id where a log is known by more than its path, in file order
    within a block start. Only whole `use name;` and
    `SET timestamp=...;` lines ahead of the statement belong to the header; the same words later are part of the statement
    (`USE INDEX` on a line of its own). Times keep their fraction and their offset.
    """
    body = F.split("value", r"\r?\n")
    text = F.array_join(F.filter(F.slice(body, F.lit(2), F.size(body)), lambda l: ~l.startswith("#")), "\n")
    header = F.regexp_extract(text, _HEADER, 0)
    statement = F.regexp_replace(text, _HEADER, "")
    is_report = F.contains("value", F.lit("# Query_time:"))  # other blocks, such as what a server writes at its start, hold no statement
    used = F.regexp_extract_all(F.when(is_report, header).otherwise(text), F.lit(r"(?m)^(?:use|USE)\s+`?([^\n;`]+?)`?\s*;"), F.lit(1))
    start = F.regexp_extract("value", r"^(?:# Time:)? ?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)", 1)

    def metric(name, pattern):
        return blank_to_null(F.regexp_extract("value", rf"(?m)^# Query_time:.*?{name}: ({pattern})", 1))

    return lines.select(
        "file_path", F.col("file_id" if "file_id" in lines.columns else "file_path").alias("file_id"), "file_block_start",
        F.monotonically_increasing_id().alias("block_no"),
        blank_to_null(start).try_cast("timestamp").alias("captured_at"), is_report.alias("is_report"),
        F.coalesce(blank_to_null(F.regexp_extract("value", r"(?m)^# Query_time: (\d+\.?\d*)", 1)).cast("double"), F.lit(0.0)).alias("query_time_sec"),
        F.coalesce(metric("Lock_time", r"\d+\.?\d*").cast("double"), F.lit(0.0)).alias("lock_time_sec"),
        F.coalesce(metric("Rows_sent", r"\d+").cast("bigint"), F.lit(0)).alias("rows_sent"),
        F.coalesce(metric("Rows_examined", r"\d+").cast("bigint"), F.lit(0)).alias("rows_examined"),
        F.get(F.reverse(used), F.lit(0)).alias("used_db"),
        F.btrim(statement, F.lit(" \t\r\n")).alias("sql_text"), "value",
    )


def win_sticky_db(blocks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Add `sticky_db`: the last schema chosen by `use` before the block in the same file.

    A file is read in splits, so each split is handled on its own and only its last choice moves on to the next one. `known` (file_id,
    used_db) has the choice with which the blocks of a file start, where they are not its first.
    """
    in_split = Window.partitionBy("file_id", "file_block_start").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file_id").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        blocks.groupBy("file_id", "file_block_start")
        .agg(F.max_by("used_db", F.when(F.col("used_db").isNotNull(), F.col("block_no"))).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    )
    if known is not None:
        splits = splits.join(known.select("file_id", F.col("used_db").alias("_known")), "file_id", "left")
        splits = splits.withColumn("_carried", F.coalesce("_carried", "_known")).drop("_known")
    return (
        blocks.withColumn("_local", F.last("used_db", ignorenulls=True).over(in_split))
        .join(splits, ["file_id", "file_block_start"])
        .withColumn("sticky_db", F.coalesce("_local", "_carried")).drop("_local", "_carried")
    )


def last_used_db(blocks: DataFrame) -> DataFrame:
    """(file_id, used_db): the choice in force behind the last of the blocks, for files that have one."""
    place = F.when(F.col("used_db").isNotNull(), F.struct("file_block_start", "block_no"))
    return blocks.groupBy("file_id").agg(F.max_by("used_db", place).alias("used_db")).where("used_db is not null")


def slow_log_events(
    lines: DataFrame, *, instance_id: str | None, min_sec=0.5, min_rows=0, strict=False, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of slow-log text. A `use` line counts for its own block too, unless `strict`; see `win_sticky_db` for `known`.

    Rejects are blocks that report a query without a readable time or without a statement, whole and with the reason.
    """
    blocks = win_sticky_db(slow_log_blocks(lines), known)
    database = F.col("sticky_db") if strict else F.coalesce("used_db", "sticky_db")
    reason = F.when(F.col("captured_at").isNull(), "no readable time").when(F.col("sql_text") == "", "no statement")
    events = blocks.filter(
        reason.isNull() & (F.col("query_time_sec") >= min_sec) & (F.col("rows_examined") >= min_rows)
    ).select(
        F.lit("slow_log_file").alias("source"), F.col("file_path").alias("source_detail"), "captured_at",
        F.lit(instance_id).cast("string").alias("instance_id"), database.alias("database_name"), "sql_text",
        "query_time_sec", "lock_time_sec", "rows_examined", "rows_sent",
    )
    return events, blocks.filter(F.col("is_report") & reason.isNotNull()).select("file_path", "value", reason.alias("reject_reason"))


def with_file_position(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col("_metadata.file_path").alias("file_path"),
                        F.col("_metadata.file_block_start").alias("file_block_start"))


def src_slow_log(
    spark: SparkSession, path: str, *, instance_id: str | None, min_sec=0.5, min_rows=0, strict=False
) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of the slow-log files below `path`; files are split, so one large file is read in parallel."""
    lines = spark.read.option("lineSep", BLOCK_START).text(path)
    return slow_log_events(
        with_file_position(lines), instance_id=instance_id, min_sec=min_sec, min_rows=min_rows, strict=strict
    )


def history_filter(history: DataFrame, *, min_sec=0.5, own_schemas=()) -> DataFrame:
    """Statement-history rows worth keeping. Times come in picoseconds and are compared as they are, so that the bound
    reaches the scan."""
    wanted = (
        ~F.col("current_schema").isin(*K.SYSTEM_SCHEMAS, *own_schemas) & F.col("sql_text").isNotNull()
        & F.col("digest_text").isNotNull() & (F.col("timer_wait") > F.lit(math.floor(min_sec * 1e12)).cast("bigint"))
    )
    for pattern in K.HISTORY_EXCLUDED_LIKE:
        wanted = wanted & ~F.col("sql_text").ilike(pattern)
    return history.filter(wanted)


ANCHOR = "instance_id string, anchor bigint, anchor_event bigint"


def history_events(rows: DataFrame) -> DataFrame:
    """Statement-history rows in the event shape."""
    return rows.select(
        "event_id", F.lit("slow_log_table").alias("source"),
        F.concat(F.lit("history@"), "instance_id").alias("source_detail"), "captured_at", "instance_id",
        F.col("current_schema").alias("database_name"), "sql_text", (F.col("timer_wait") / 1e12).alias("query_time_sec"),
        F.lit(0.0).alias("lock_time_sec"), "rows_examined", "rows_sent", "timer_start",
    )


def src_statement_history(
    history: DataFrame, anchors: DataFrame, *, min_sec=0.5, cap: int | None = None, own_schemas=(), start="earliest"
) -> tuple[DataFrame, DataFrame]:
    """(events after their instance's anchor, next anchors).

    An anchor (schema `ANCHOR`) is the start and id of the last row taken; both decide, so rows that share a start are not lost. A poll takes all
    rows, or with `cap` the oldest per instance, and the rest comes with the next poll. Instances without an anchor
    start from their oldest row, or with start="latest" take nothing yet and are anchored at their newest.
    """
    rows = history_filter(history, min_sec=min_sec, own_schemas=own_schemas)
    rows = rows.join(anchors.select("instance_id", "anchor", "anchor_event", F.lit(True).alias("_known")), "instance_id", "left")
    after = (F.col("timer_start") > F.col("anchor")) | ((F.col("timer_start") == F.col("anchor")) & (F.col("event_id") > F.col("anchor_event")))
    fresh = F.col("anchor").isNull() if start == "earliest" else F.lit(False)
    place = F.struct("timer_start", "event_id")
    taken = rows.filter(fresh | after)
    if cap is not None:
        oldest = Window.partitionBy("instance_id").orderBy("timer_start", "event_id")
        taken = taken.withColumn("_rank", F.row_number().over(oldest)).filter(F.col("_rank") <= cap).drop("_rank")
    passed = taken if start == "earliest" else taken.unionByName(rows.filter(F.col("_known").isNull()))
    moved = passed.groupBy("instance_id").agg(F.max(place).alias("_new"))
    following = anchors.join(moved, "instance_id", "full").select(
        "instance_id", F.coalesce("_new.timer_start", "anchor").alias("anchor"), F.coalesce("_new.event_id", "anchor_event").alias("anchor_event")
    )
    return history_events(taken), following


def history_from_jdbc(spark: SparkSession, *, url: str, table: str, properties: dict, cuts: list[int]) -> DataFrame:
    """A statement-history table over JDBC, read in one partition per range of timer_start between the sorted `cuts`."""
    ranges = [
        f"timer_start < {cuts[0]} OR timer_start IS NULL",
        *[f"timer_start >= {a} AND timer_start < {b}" for a, b in zip(cuts, cuts[1:])],
        f"timer_start >= {cuts[-1]}",
    ]
    return spark.read.jdbc(url, table, predicates=ranges, properties=properties)


def _parsed(messages: DataFrame, message: Column) -> DataFrame:
    """Add the parsed message as `m`. As a generated row it is parsed once; a plain column would be parsed again
    for every filter and field that uses it."""
    return messages.select("*", F.explode_outer(F.array(message)).alias("m"))


def src_http_events(messages: DataFrame, *, body="body", received_at: Column | None = None) -> DataFrame:
    """JSON reports: milliseconds become seconds, the default database is `unknown`."""
    parsed = _parsed(messages, F.from_json(body, schemas.HTTP_BODY))
    return parsed.select(
        *[c for c in ("event_id",) if c in messages.columns], F.lit("http_endpoint").alias("source"),
        *([received_at.alias("captured_at")] if received_at is not None else []),
        F.col("m.instanceId").alias("instance_id"), F.coalesce("m.database", F.lit("unknown")).alias("database_name"),
        F.col("m.sql").alias("sql_text"), F.coalesce(F.col("m.durationMs") / 1000.0, F.lit(0.0)).alias("query_time_sec"),
        F.lit(0.0).alias("lock_time_sec"), F.coalesce("m.rowsExamined", F.lit(0)).alias("rows_examined"),
        F.lit(0).cast("bigint").alias("rows_sent"),
    )


def src_http_events_v2(messages: DataFrame, *, body="body", received_at: Column | None = None) -> DataFrame:
    """The second JSON layout, with the sending application."""
    m = F.from_json(body, schemas.HTTP_BODY_V2)
    zero = F.lit(0).cast("bigint")
    return _parsed(messages, m).select(
        *[c for c in ("event_id", "instance_id", "project_code") if c in messages.columns],
        F.lit("http_capture").alias("source"),
        F.concat(F.lit("HTTP:"), F.coalesce("m.applicationName", F.lit("unknown"))).alias("source_detail"),
        *([received_at.alias("captured_at")] if received_at is not None else []),
        F.col("m.sqlText").alias("sql_text"), F.coalesce("m.queryTimeSec", F.lit(0.0)).alias("query_time_sec"),
        F.coalesce("m.lockTimeSec", F.lit(0.0)).alias("lock_time_sec"),
        F.coalesce("m.rowsExamined", zero).alias("rows_examined"), F.coalesce("m.rowsSent", zero).alias("rows_sent"),
        F.col("m.applicationName").alias("application_name"), F.col("m.traceId").alias("trace_id"),
    )


def _seconds(text: Column) -> Column:
    clock = r"^(\d+):(\d{2}):(\d{2})(\.\d+)?$"
    part = [F.regexp_extract(text, clock, g) for g in (1, 2, 3, 4)]
    return F.when(
        text.rlike(clock),
        part[0].try_cast("double") * 3600 + part[1].try_cast("double") * 60 + F.concat(part[2], part[3]).try_cast("double"),
    ).otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)))


def _whole(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast("bigint"), F.lit(0))


def src_slow_log_rows(rows: DataFrame) -> DataFrame:
    """Rows of a log table, whose numbers and times come as text: what is no number counts as zero, a clock time is a
    duration, and a bad start time is NULL, so that the row can be set aside."""
    text = {c: F.col(c).cast("string") for c in ("query_time", "lock_time", "rows_examined", "rows_sent", "start_time")}
    return rows.select(
        *[c for c in ("event_id",) if c in rows.columns], F.lit("slow_log_table").alias("source"),
        F.concat(F.lit("slow_log@"), "instance_id").alias("source_detail"), "instance_id", "project_code",
        text["start_time"].try_cast("timestamp_ntz").alias("captured_at"), F.col("db").alias("database_name"), "sql_text",
        _seconds(text["query_time"]).alias("query_time_sec"), _seconds(text["lock_time"]).alias("lock_time_sec"),
        _whole(text["rows_examined"]).alias("rows_examined"), _whole(text["rows_sent"]).alias("rows_sent"),
    )


def split_rejects(events: DataFrame, *, need_time=True) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of any source: a row without a readable time or without a statement is set aside, whole and with the reason."""
    no_text = F.col("sql_text").isNull() | F.col("sql_text").rlike(r"^\s*$")
    reason = F.when(no_text, "no statement")
    if need_time:
        reason = F.when(F.col("captured_at").isNull(), "no readable time").otherwise(reason)
    judged = events.withColumn("reject_reason", reason)
    return judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"), judged.filter(F.col("reject_reason").isNotNull())


def src_manual(statements: DataFrame) -> DataFrame:
    """Statements entered by hand: no metrics."""
    none = {"query_time_sec": "double", "lock_time_sec": "double", "rows_examined": "bigint", "rows_sent": "bigint"}
    return statements.select(
        *[c for c in ("event_id", "captured_at") if c in statements.columns], F.lit("manual").alias("source"),
        F.lit("user-input").alias("source_detail"), "instance_id", "project_code", "sql_text",
        *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
    )


def src_results(messages: DataFrame, *, body="body") -> tuple[DataFrame, DataFrame]:
    """(results, rejected messages): broken JSON and messages without a task id are rejected."""
    message = F.from_json(body, schemas.RESULT_BODY + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = _parsed(messages, message)
    good = F.col("m._corrupt").isNull() & F.col("m.taskId").isNotNull()
    rows = parsed.filter(good).select(
        *[c for c in messages.columns if c != body], F.col("m.taskId").alias("task_id"), F.upper("m.status").alias("status"),
        F.col("m.report").alias("report"), F.col("m.error").alias("error_message"),
        F.col("m.durationMs").alias("duration_ms"), F.col("m.toolCallCount").alias("tool_call_count"),
        F.col("m.fingerprint").alias("fingerprint"), F.col("m.instanceId").alias("instance_id"),
        F.col("m.projectCode").alias("project_code"), F.col("m.source").alias("source"),
    )
    return rows, parsed.filter(~F.coalesce(good, F.lit(False))).drop("m")


def dim_instances(projects: DataFrame) -> DataFrame:
    """Instance -> the first project that lists it; `projects` has position, project_code and instance_ids."""
    listed = projects.select("position", "project_code", F.explode("instance_ids").alias("instance_id"))
    return listed.groupBy("instance_id").agg(F.min_by("project_code", "position").alias("project_code"))
