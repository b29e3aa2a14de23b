"""Life cycle of diagnosis tasks: project look-up, report cache, results, guards and traces."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch import schemas
from tidewatch.functions.text import blank_to_null
from tidewatch.operators.ordered import carry, number_chunk, position, previous, running_total, time_chunk


def join_project(events: DataFrame, instances: DataFrame) -> DataFrame:
    """Fill a missing project from the instance; `instances` has one row per instance."""
    projects = instances.select("instance_id", F.col("project_code").alias("_project"))
    filled = events.join(projects, "instance_id", "left")
    return filled.withColumn("project_code", F.coalesce(blank_to_null(F.col("project_code")), "_project")).select(events.columns)


def union_sources(*events: DataFrame) -> DataFrame:
    """All capture sources as one event table; columns a source lacks are NULL."""
    first, *rest = events
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def round_cap(events: DataFrame, *, cap=50, tie="event_id") -> tuple[DataFrame, DataFrame]:
    """(events of this round, events left for the next ones): the oldest `cap` per instance and round go first.

    The rank filter is pushed below the shuffle, so a busy instance sends at most `cap` rows per input task.
    """
    oldest = Window.partitionBy("instance_id", "round").orderBy("captured_at", tie)
    now = events.withColumn("_rank", F.row_number().over(oldest)).filter(F.col("_rank") <= cap).drop("_rank")
    return now, events.join(now.select(tie), tie, "left_anti")


# --- report cache ---

def build_report_cache(results: DataFrame, plan_keys: DataFrame, *, order=("created_at", "task_id"), history=False) -> DataFrame:
    """(fingerprint, plan_key, report, created_at) of completed tasks; only the latest unless `history`."""
    done = results.filter(
        (F.upper("status") == "COMPLETED") & (F.col("report") != "") & (F.col("fingerprint") != "")
        & (F.col("instance_id") != "")
    )
    keyed = done.join(plan_keys, "fingerprint").filter(F.col("plan_key").isNotNull())
    if history:
        return keyed.select("fingerprint", "plan_key", "report", "created_at")
    return keyed.groupBy("fingerprint", "plan_key").agg(
        F.max_by("report", F.struct(*order)).alias("report"), F.max("created_at").alias("created_at")
    )


def join_report_cache(events: DataFrame, plan_keys: DataFrame, cache: DataFrame, *, ttl_days=7, tie="event_id") -> DataFrame:
    """Add `cached_report`: the latest report of the same fingerprint and plan, at most `ttl_days` old, never for P0.

    Events and reports are merged on one time line per key and the last report is carried forward, so no
    event meets more than one report.
    """
    keyed = events.join(plan_keys, "fingerprint", "left").withColumn("_at", F.col("captured_at")).withColumn("_kind", F.lit(1))
    kind = events.schema["captured_at"].dataType
    reports = (
        cache.filter(F.col("created_at").isNotNull())
        .groupBy("fingerprint", "plan_key", F.col("created_at").cast(kind).alias("_at")).agg(F.max("report").alias("report"))
        .select("fingerprint", "plan_key", "_at", F.lit(0).alias("_kind"), F.struct(F.col("_at").alias("at"), "report").alias("_report"))
    )
    # What can have no report is dealt out evenly instead of standing on one time line.
    eligible = F.col("plan_key").isNotNull() & F.coalesce(F.col("severity") != "P0", F.lit(False))
    keyed = keyed.withColumn("_slot", F.when(eligible, F.lit(-1)).otherwise(F.pmod(F.xxhash64(tie), F.lit(4096))))
    line = keyed.unionByName(reports.withColumn("_slot", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    seen = carry(
        line, keys=["fingerprint", "plan_key", "_slot"], order=["_at", "_kind", tie], chunk=time_chunk("_at"),
        value=F.col("_report"), out="_latest",
    ).filter(F.col("_kind") == 1)
    fresh = (F.col("captured_at") < F.timestamp_add("DAY", F.lit(ttl_days), F.col("_latest.at"))) & (F.col("_slot") == -1)
    return seen.withColumn("cached_report", F.when(fresh, F.col("_latest.report"))).select(
        *events.columns, "plan_key", "cached_report"
    )


def rebuild_fp_reports(diagnoses: DataFrame, cache: DataFrame, *, as_of: Column, minutes=30) -> DataFrame:
    """(fingerprint, report) of recent completed tasks whose fingerprint has no cached report."""
    recent = _completed_since(diagnoses, as_of, minutes).filter(
        F.col("fingerprint").isNotNull() & F.col("report").isNotNull()
    )
    return (
        recent.join(cache.select("fingerprint").distinct(), "fingerprint", "left_anti").groupBy("fingerprint")
        .agg(F.max_by("report", F.struct("created_at", "task_id")).alias("report"))
    )


def _completed_since(diagnoses: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    since = F.timestamp_add("MINUTE", F.lit(-minutes), as_of)
    return diagnoses.filter((F.upper("status") == "COMPLETED") & (F.col("created_at") > since))


def latest_diagnosis(diagnoses: DataFrame, *, as_of: Column, minutes: int) -> DataFrame:
    """The newest completed task per fingerprint among those of the last `minutes`."""
    recent = _completed_since(diagnoses, as_of, minutes)
    newest = F.max_by(F.struct(*diagnoses.columns), F.struct("created_at", "task_id"))
    return recent.groupBy("fingerprint").agg(newest.alias("_row")).select("_row.*")


# --- tasks and results ---

def latest_results(results: DataFrame, *, order="seq") -> DataFrame:
    """One result per task: the one that came last."""
    return (
        results.groupBy("task_id").agg(F.max_by(F.struct(*results.columns), order).alias("_row")).select("_row.*")
    )


def new_tasks(events: DataFrame, *, tie="event_id") -> DataFrame:
    """One task per event without a cached report; the id is derived, so that a repeated run gives the same tasks."""
    fresh = events.filter(F.col("cached_report").isNull()) if "cached_report" in events.columns else events
    return fresh.select(
        F.md5(F.concat_ws(":", "fingerprint", F.col(tie).cast("string"))).alias("task_id"),
        F.lit("").alias("session_id"), F.coalesce("instance_id", F.lit("")).alias("instance_id"),
        F.coalesce("project_code", F.lit("")).alias("project_code"), F.col("context").alias("enriched_prompt"),
        "fingerprint", "source", F.col("captured_at").alias("created_at"),
    )


def anti_finished_tasks(tasks: DataFrame, status: DataFrame) -> DataFrame:
    """Tasks that are neither completed nor failed yet."""
    finished = status.filter(F.upper("status").isin("COMPLETED", "FAILED")).select("task_id")
    return tasks.join(finished, "task_id", "left_anti")


def join_results(results: DataFrame, diagnoses: DataFrame, captured: DataFrame, *, as_of: Column) -> DataFrame:
    """The next diagnosis snapshot: results update known tasks and add unknown ones.

    `results` has one row per task. Blank identity fields keep the old value; a new task takes its text from the captured
    statement of the same fingerprint.
    """
    statements = captured.select("fingerprint", F.col("sql_text").alias("_sql"))
    incoming = results.join(statements, "fingerprint", "left").select("task_id", F.struct(
        "instance_id", "project_code", F.coalesce("source", F.lit("auto")).alias("source"), "fingerprint", "report",
        F.upper(F.coalesce("status", F.lit("FAILED"))).alias("status"), "error_message", "duration_ms",
        "tool_call_count", F.coalesce("_sql", F.lit("")).alias("sql"),
    ).alias("r"))
    kinds = {f.name: f.dataType for f in diagnoses.schema}
    both = diagnoses.withColumn("_known", F.lit(True)).join(incoming, "task_id", "full")
    hit, new = F.col("r").isNotNull(), F.col("_known").isNull()
    now = as_of.cast(kinds["updated_at"])

    def identity(c):
        return F.coalesce(blank_to_null(F.col(f"r.{c}")), F.col(c), F.when(new, F.coalesce(F.col(f"r.{c}"), F.lit(""))))

    values = {
        "session_id": F.when(new, F.col("task_id")).otherwise(F.col("session_id")),
        **{c: identity(c) for c in ("instance_id", "project_code", "source", "fingerprint")},
        **{c: F.when(new, F.col("r.sql")).otherwise(F.col(c)) for c in ("original_sql", "clean_sql")},
        **{c: F.coalesce(F.col(f"r.{c}"), F.col(c)) for c in
           ("report", "status", "error_message", "duration_ms", "tool_call_count")},
        "created_at": F.when(new, now).otherwise(F.col("created_at")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return both.select("task_id", *[
        (values[c] if c in values else F.col(c)).cast(kinds[c]).alias(c) for c in diagnoses.columns if c != "task_id"
    ])


def write_back_reports(captured: DataFrame, results: DataFrame, *, order="seq") -> DataFrame:
    """Put the latest report of each fingerprint into the captured statements; nothing else changes."""
    latest = (
        results.filter((F.col("fingerprint") != "") & F.col("report").isNotNull()).groupBy("fingerprint")
        .agg(F.max_by("report", order).alias("_report"))
    )
    both = captured.join(latest, "fingerprint", "left")
    return both.withColumn("diagnosis_report", F.coalesce("_report", "diagnosis_report")).select(captured.columns)


def result_content() -> Column:
    """The text stored for a finished task: its report, or what went wrong."""
    return F.when(F.lower("status") == "completed", F.coalesce("report", F.lit(""))).otherwise(
        F.concat(F.lit(K.FAILED_PREFIX), F.coalesce("error_message", F.lit(K.UNKNOWN_ERROR)))
    )


def reconcile_missing(results: DataFrame, diagnoses: DataFrame, *, as_of: Column, minutes=30) -> DataFrame:
    """Records to repair: a result exists, but the record is not among the recently completed ones."""
    done = _completed_since(diagnoses, as_of, minutes).select("task_id")
    content = results.join(done, "task_id", "left_anti").select("task_id", result_content().alias("_report"))
    fixed = diagnoses.join(content, "task_id")
    return fixed.withColumns({
        "report": F.col("_report"), "status": F.lit("COMPLETED"),
        "updated_at": as_of.cast(diagnoses.schema["updated_at"].dataType),
    }).select(diagnoses.columns)


def task_backlog(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Waiting tasks per instance and source."""
    waiting = tasks.join(results.select("task_id"), "task_id", "left_anti")
    return waiting.groupBy("instance_id", "source").agg(F.count(F.lit(1)).alias("waiting"))


def task_status(tasks: DataFrame, results: DataFrame, *, order="seq") -> DataFrame:
    """Latest state per asked task; `not_found` without any result."""
    latest = results.groupBy("task_id").agg(
        F.max_by(F.struct("status", "report", "error_message"), order).alias("_last")
    )
    status = F.lower("_last.status")
    return tasks.select("task_id").join(latest, "task_id", "left").select(
        "task_id", F.coalesce(status, F.lit("not_found")).alias("status"),
        F.when(status == "completed", F.col("_last.report")).alias("report"),
        F.when(status == "failed", F.col("_last.error_message")).alias("error"),
    )


def drain_fallback(tasks: DataFrame, fallback: DataFrame, *, body="body", order="seq") -> DataFrame:
    """Tasks of the main and the backup queue, one per id, the main queue and older messages first.

    `tasks` has the columns below; `fallback` holds JSON messages, and those without the required fields are skipped.
    """
    columns = ("task_id", "session_id", "instance_id", "project_code", "enriched_prompt", "fingerprint", "source")
    message = F.from_json(F.col(body), schemas.TASK_BODY)
    parsed = fallback.select(message.alias("m"), F.col(order).alias("_seq")).select(
        F.col("m.taskId").alias("task_id"), F.coalesce("m.sessionId", F.lit("")).alias("session_id"),
        F.col("m.instanceId").alias("instance_id"), F.coalesce("m.projectCode", F.lit("")).alias("project_code"),
        F.col("m.enrichedPrompt").alias("enriched_prompt"), F.coalesce("m.fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("m.source", F.lit("manual")).alias("source"), F.lit(1).alias("_queue"), "_seq",
    ).filter(F.col("task_id").isNotNull() & F.col("instance_id").isNotNull() & F.col("enriched_prompt").isNotNull())
    main = tasks.select(*columns, F.lit(0).alias("_queue"), F.col(order).alias("_seq"))
    return (
        main.unionByName(parsed).groupBy("task_id")
        .agg(F.min_by(F.struct(*columns[1:]), F.struct("_queue", "_seq")).alias("_task"))
        .select("task_id", "_task.*")
    )


def retry_tasks(diagnoses: DataFrame, *, attempt=1) -> DataFrame:
    """New tasks for failed ones; records without a statement are refused."""
    failed = diagnoses.filter((F.upper("status") == "FAILED") & ~F.coalesce("original_sql", F.lit("")).rlike(r"^\s*$"))
    return failed.select(
        F.md5(F.concat(F.col("task_id"), F.lit(f":retry:{attempt}"))).alias("task_id"),
        F.col("task_id").alias("retry_of"), "instance_id", "project_code",
        F.concat(F.lit(K.RETRY_HEADER), "original_sql").alias("enriched_prompt"), "fingerprint", "source",
    )


# --- traces ---

def task_metrics(trace: DataFrame, *, cut=200) -> DataFrame:
    """Calls, errors and elapsed time per task; a trace row has task_id, step, kind, detail and happened_at. The last error is cut to `cut` characters."""
    error = F.when(F.col("kind") == "tool_error", F.substring("detail", 1, cut))
    return trace.groupBy("task_id").agg(
        F.count_if(F.col("kind") == "llm_start").alias("llm_calls"),
        F.count_if(F.col("kind") == "tool_start").alias("tool_calls"),
        F.count(error).alias("error_count"),
        F.max_by(error, F.when(error.isNotNull(), F.col("step"))).alias("last_error"),
        F.timestamp_diff("MILLISECOND", F.min("happened_at"), F.max("happened_at")).alias("elapsed_ms"),
    )


def task_errors(trace: DataFrame, *, cut=200) -> DataFrame:
    """One row per tool error, cut to `cut` characters."""
    return trace.filter(F.col("kind") == "tool_error").select(
        "task_id", "step", F.substring("detail", 1, cut).alias("error")
    )


def repeat_guard(trace: DataFrame, *, run=3) -> DataFrame:
    """The first call per task that is the `run`-th identical (tool, args) call in a row."""
    calls = trace.select("task_id", "step", "tool", "args")
    chunk, order = number_chunk("step"), ["step"]
    calls = previous(calls, keys=["task_id"], order=order, chunk=chunk, columns=["tool", "args"], out="_before")
    same = F.col("_before.tool").eqNullSafe(F.col("tool")) & F.col("_before.args").eqNullSafe(F.col("args"))
    calls = calls.withColumn("_starts", F.col("_before").isNull() | ~same).drop("_before")
    calls = position(calls, keys=["task_id"], order=order, chunk=chunk, out="_pos")
    calls = carry(calls, keys=["task_id"], order=order, chunk=chunk, value=F.when(F.col("_starts"), F.col("_pos")), out="_from")
    tripped = calls.filter(F.col("_pos") - F.col("_from") + 1 >= run)
    return tripped.groupBy("task_id").agg(
        F.min("step").alias("step"), F.min_by("tool", "step").alias("tool"), F.min_by("args", "step").alias("args")
    )


def budget_guard(trace: DataFrame, *, budget: int) -> DataFrame:
    """The first step per task at which the tokens used exceed the budget."""
    used = running_total(
        trace.select("task_id", "step", "total_tokens"), keys=["task_id"], order=["step"], chunk=number_chunk("step"),
        value=F.coalesce(F.col("total_tokens").cast("bigint"), F.lit(0)), out="used",
    )
    return used.filter(F.col("used") > budget).groupBy("task_id").agg(
        F.min("step").alias("step"), F.min_by("used", "step").alias("used")
    )


def progress_steps(trace: DataFrame, *, labels=None, cut=200) -> DataFrame:
    """Steps numbered from one per task, with readable tool names and details cut to `cut` characters."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable((labels or K.TOOL_LABELS).items())])
    steps = position(trace, keys=["task_id"], order=["step"], chunk=number_chunk("step"), out="_no")
    return steps.select(
        "task_id", F.col("_no").alias("step_no"), F.coalesce(names[F.col("tool")], "tool").alias("tool"), "status",
        F.substring(F.coalesce("detail", F.lit("")), 1, cut).alias("detail"), "happened_at",
    )
