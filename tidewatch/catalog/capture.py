"""Queries: sources, sinks, filters, searches."""

from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.catalog.common import captured, orders_as_of
from tidewatch.catalog.registry import query
from tidewatch.catalog.views import NORMAL, SEVERITY
from tidewatch.operators import filters, folds, search, statements, tasks
from tidewatch.session import shared_folder
from tidewatch.sources import readers, sinks

# --- sources ---


def slow_log(v) -> str:
    return v.prepared("slow-log", lambda folder: write_slow_log(v, folder))


def write_slow_log(v, folder: str, until=None) -> str:
    """Slow-log files, one per instance and day, written by Spark from the statement events; with `until`, as they are at that moment."""
    events = v.stmt_events if until is None else v.stmt_events.where(F.col("captured_at") < until)
    block = F.concat(
        F.lit("# Time: "), F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z\n# User@Host: app[app] @ host\n"),
        F.format_string(
            "# Query_time: %.6f  Lock_time: %.6f Rows_sent: %d  Rows_examined: %d\n", "query_time_sec", "lock_time_sec",
            "rows_sent", "rows_examined",
        ),
        F.when(F.col("database_name").isNotNull() & (F.col("k") % 2 == 0), F.concat(F.lit("use "), "database_name", F.lit(";\n"))).otherwise(""),
        F.lit("SET timestamp=1704103200;\n"), F.replace("sql_text", F.lit(" WHERE "), F.lit("\nWHERE ")), F.lit(";"),
    )
    lines = events.select(
        block.alias("value"), "instance_id", F.to_date("captured_at").alias("day"), "captured_at", "event_id"
    )
    (lines.repartition("instance_id", "day").sortWithinPartitions("instance_id", "day", "captured_at", "event_id")
     .select("value", "instance_id", "day").write.mode("overwrite").partitionBy("instance_id", "day").text(folder))
    return folder


_LOG_ORACLE = """with logged as (
  select *, case when database_name is not null and k % 2 = 0 then database_name end as used from stmt_events),
sticky as (
  select *, last_value(used ignore nulls) over (partition by instance_id, cast(captured_at as date) order by captured_at, event_id
    rows between unbounded preceding and 1 preceding) as carried from logged)
select {columns} from sticky {where}"""


@query("src_slow_log", _LOG_ORACLE.format(
    columns="""captured_at, coalesce(used, carried) as database_name,
  replace(sql_text, ' WHERE ', chr(10) || 'WHERE ') || ';' as sql_text, round(query_time_sec, 5) as query_time_sec,
  round(lock_time_sec, 5) as lock_time_sec, rows_examined, rows_sent, 'slow_log_file' as source""",
    where="where round(query_time_sec, 6) >= 0.5"), prepare=slow_log)
def _(v):
    events, _ = readers.src_slow_log(v.spark, slow_log(v), instance_id=None)
    return events.select(
        "captured_at", "database_name", "sql_text", F.round("query_time_sec", 5).alias("query_time_sec"),
        F.round("lock_time_sec", 5).alias("lock_time_sec"), "rows_examined", "rows_sent", "source",
    )


@query("win_sticky_db", _LOG_ORACLE.format(
    columns="captured_at, used as used_db, carried as sticky_db, rows_examined", where=""), prepare=slow_log)
def _(v):
    lines = v.spark.read.option("lineSep", readers.BLOCK_START).text(slow_log(v))
    blocks = readers.win_sticky_db(readers.slow_log_blocks(readers.with_file_position(lines)))
    return blocks.select("captured_at", "used_db", "sticky_db", "rows_examined")


_HISTORY_WHERE = """current_schema not in ('information_schema','mysql','performance_schema','sys') and digest_text is not null
  and not sql_text ilike 'SET %' and not sql_text ilike 'SHOW %' and not sql_text ilike 'SELECT @@%'
  and not sql_text ilike '%ApplicationName%' and timer_wait / 1e12 > 0.5"""


@query("src_statement_history", f"""with kept as (
  select * from history_rows where {_HISTORY_WHERE} and timer_start > 100000)
select event_id, instance_id, current_schema as database_name, sql_text, timer_wait / 1e12 as query_time_sec, rows_examined, timer_start
from kept""")
def _(v):
    anchors = v.history_rows.select("instance_id").distinct().withColumns({
        "anchor": F.lit(100_000).cast("bigint"), "anchor_event": F.lit(0).cast("bigint")})
    events, _ = readers.src_statement_history(v.history_rows, anchors)
    return events.select("event_id", "instance_id", "database_name", "sql_text", "query_time_sec", "rows_examined", "timer_start")


@query("src_http_events", """select event_id, 'http_endpoint' as source, ts as captured_at, body->>'$.instanceId' as instance_id,
  coalesce(body->>'$.database', 'unknown') as database_name, body->>'$.sql' as sql_text,
  cast(body->>'$.durationMs' as double) / 1000 as query_time_sec, 0.0::double as lock_time_sec,
  cast(body->>'$.rowsExamined' as bigint) as rows_examined, cast(0 as bigint) as rows_sent from http_json""")
def _(v):
    return readers.src_http_events(v.http_json, received_at=F.col("ts"))


@query("src_http_events_v2", """select event_id, instance_id, project_code, 'http_capture' as source,
  'HTTP:' || coalesce(body->>'$.applicationName', 'unknown') as source_detail, body->>'$.sqlText' as sql_text,
  cast(body->>'$.queryTimeSec' as double) as query_time_sec, 0.0::double as lock_time_sec, cast(0 as bigint) as rows_examined,
  cast(body->>'$.rowsSent' as bigint) as rows_sent, body->>'$.applicationName' as application_name, body->>'$.traceId' as trace_id
from http_json_v2""")
def _(v):
    return readers.src_http_events_v2(v.http_json_v2)


@query("src_slow_log_rows", """select event_id, 'slow_log_table' as source, 'slow_log@' || instance_id as source_detail, instance_id, project_code,
  try_cast(start_time as timestamp) as captured_at, db as database_name, sql_text,
  case when query_time = '00:01:30.25' then 90.25 else coalesce(try_cast(query_time as double), 0) end::double as query_time_sec,
  coalesce(try_cast(lock_time as double), 0)::double as lock_time_sec,
  case when regexp_full_match(rows_examined, '[0-9]+') then cast(rows_examined as bigint) else 0 end as rows_examined,
  cast(rows_sent as bigint) as rows_sent from log_rows""")
def _(v):
    return readers.src_slow_log_rows(v.log_rows)


@query("src_slow_log_rows_rejects", """select event_id, 'no readable time' as reject_reason from log_rows where try_cast(start_time as timestamp) is null""")
def _(v):
    _, rejects = readers.split_rejects(readers.src_slow_log_rows(v.log_rows))
    return rejects.select("event_id", "reject_reason")


@query("src_manual", """select event_id, captured_at, 'manual' as source, 'user-input' as source_detail, instance_id, project_code, sql_text,
  cast(null as double) as query_time_sec, cast(null as double) as lock_time_sec, cast(null as bigint) as rows_examined,
  cast(null as bigint) as rows_sent from stmt_events""")
def _(v):
    return readers.src_manual(v.stmt_events)


@query("src_results", """select seq, task_id, status, report, error_message, duration_ms, fingerprint, instance_id from result_rows""")
def _(v):
    rows, _ = readers.src_results(v.results_json)
    return rows.select("seq", "task_id", "status", "report", "error_message", "duration_ms", "fingerprint", "instance_id")


@query("src_results_rejects", """select seq, body from results_json where not json_valid(body)
  or (case when json_valid(body) then body->>'$.taskId' end) is null""")
def _(v):
    return readers.src_results(v.results_json)[1].select("seq", "body")


@query("dim_instances", """select concat('inst-', cast(l_suppkey as varchar)) as instance_id, concat('proj-', cast(min(l_orderkey) as varchar)) as project_code
from lineitem group by l_suppkey""")
def _(v):
    instance = F.concat(F.lit("inst-"), F.col("l_suppkey").cast("string"))
    projects = v.lineitem.groupBy(F.col("l_orderkey").alias("position")).agg(F.collect_set(instance).alias("instance_ids"))
    return readers.dim_instances(projects.withColumn("project_code", F.concat(F.lit("proj-"), F.col("position").cast("string"))))


# --- sinks ---

_CAPTURED = """fingerprint, sql_text, database_name, instance_id, project_code, query_time_sec, lock_time_sec, rows_examined,
  rows_sent, source, occurrence_count, diagnosis_report, severity, captured_at"""

#: The sequential fold as DuckDB computes it, list by list.
FOLD = """select fingerprint, arg_min(sql_text, event_id) as sql_text, arg_min(coalesce(database_name, '-'), event_id) as database_name,
  arg_min(instance_id, event_id) as instance_id, arg_min(coalesce(project_code, '-'), event_id) as project_code,
  round(list_reduce(list(query_time_sec order by captured_at, event_id), lambda a, b: (a + b) / 2) + 0.00000013, 6) as query_time_sec,
  round(list_reduce(list(lock_time_sec order by captured_at, event_id), lambda a, b: (a + b) / 2) + 0.00000013, 6) as lock_time_sec,
  max(rows_examined) as rows_examined, arg_min(rows_sent, event_id) as rows_sent, arg_min(source, event_id) as source,
  count(*) as occurrence_count, arg_max(diagnosis_report, event_id) filter (diagnosis_report is not null) as diagnosis_report,
  arg_max(severity, event_id) as severity, min(captured_at) as captured_at
from {source} group by fingerprint"""


def fold_columns(folded):
    return folded.withColumns({
        # halves of decimals often end exactly between two roundings; a small shift moves them off that point
        "query_time_sec": F.round(F.col("query_time_sec") + 0.00000013, 6),
        "lock_time_sec": F.round(F.col("lock_time_sec") + 0.00000013, 6),
        "database_name": F.coalesce("database_name", F.lit("-")), "project_code": F.coalesce("project_code", F.lit("-")),
    })


@query("sink_captured", FOLD.format(source="captured"))
def _(v):
    folded = folds.agg_upsert_captured(None, captured(v))
    return fold_columns(sinks.sink_captured(folded, path=shared_folder(v.spark, "captured"), version=0))


@query("sink_diagnosis", "select * from diagnosis_record")
def _(v):
    return sinks.sink_diagnosis(v.diagnosis_record, path=shared_folder(v.spark, "diagnosis"), version=0)


@query("sink_audit", """select 'a-' || statement_id as task_id, 's' as session_id, 'inst-1' as instance_id, length(sql_text) as sql_len,
  true as masked, '[users]' as tables, statement_id as duration_ms, 'COMPLETED' as status from literal_statements""")
def _(v):
    done = v.literal_statements.select(
        F.concat(F.lit("a-"), F.col("statement_id").cast("string")).alias("task_id"), F.lit("s").alias("session_id"),
        F.lit("inst-1").alias("instance_id"), "sql_text", F.col("statement_id").alias("duration_ms"), F.lit("COMPLETED").alias("status"),
    )
    return sinks.sink_audit(statements.audit_rows(done), path=shared_folder(v.spark, "audit"), version=0)


@query("schema_align", """select task_id, session_id, cast(null as varchar) as project_code, status, cast(null as bigint) as duration_ms,
  original_sql from diagnosis_record""")
def _(v):
    old = v.diagnosis_record.select("task_id", "session_id", "status", "original_sql")
    wanted = [schemas.DIAGNOSIS[c] for c in ("task_id", "session_id", "project_code", "status", "duration_ms", "original_sql")]
    return sinks.schema_align(old, schema=type(schemas.DIAGNOSIS)(wanted))


# --- filters ---

_PREFIXES = ("SET ", "SHOW ", "QUIT", "CONNECT", "ADMIN", "XA ", "PING", "INIT DB", "BEGIN", "COMMIT", "ROLLBACK")
_NOISE_SQL = "length(sql_text) >= 10 and " + " and ".join(
    [f"not starts_with(upper(trim(sql_text)), '{p}')" for p in _PREFIXES]
    + [f"not contains(upper(sql_text), '{p}')" for p in
       ("SELECT @@", "SELECT 1", "SELECT SLEEP(", "SHOW VARIABLES", "SHOW GLOBAL STATUS", "INFORMATION_SCHEMA", "MYSQL.")]
) + " and (starts_with(upper(trim(sql_text)), 'SELECT') or starts_with(upper(trim(sql_text)), 'WITH'))"


@query("flt_noise", f"select event_id, sql_text from stmt_events where {_NOISE_SQL}")
def _(v):
    return filters.flt_noise(v.stmt_events).select("event_id", "sql_text")


@query("flt_system_schema", """select event_id, current_schema from history_rows
  where current_schema not in ('information_schema','mysql','performance_schema','sys')""")
def _(v):
    return filters.flt_system_schema(v.history_rows, column="current_schema").select("event_id", "current_schema")


@query("flt_threshold", """select event_id, query_time_sec, rows_examined, 'at least' as kind from stmt_events where query_time_sec >= 0.5 and rows_examined >= 100
union all select event_id, query_time_sec, rows_examined, 'above' from stmt_events where query_time_sec > 0.5""")
def _(v):
    def cut(kind, **limits):
        return filters.flt_threshold(v.stmt_events, **limits).select(
            "event_id", "query_time_sec", "rows_examined", F.lit(kind).alias("kind"))

    return cut("at least", min_rows=100).unionByName(cut("above", strict=True))


@query("flt_enabled_source", """select event_id, instance_id, source from stmt_events where (instance_id, source) in
  (select concat('inst-', cast(n_nationkey % 5 as varchar)), case n_regionkey when 0 then 'slow_log_file' when 1 then 'http_endpoint' else 'slow_log_table' end
   from nation where n_nationkey <= n_regionkey * 7)""")
def _(v):
    source = F.when(F.col("n_regionkey") == 0, "slow_log_file").when(F.col("n_regionkey") == 1, "http_endpoint").otherwise("slow_log_table")
    enabled = v.nation.filter(F.col("n_nationkey") <= F.col("n_regionkey") * 7).select(
        F.concat(F.lit("inst-"), (F.col("n_nationkey") % 5).cast("string")).alias("instance_id"), source.alias("source")
    )
    return filters.flt_enabled_source(v.stmt_events, enabled).select("event_id", "instance_id", "source")


@query("flt_http_valid", """select event_id, body->>'$.sql' as sql_text, case when trim(body->>'$.sql') = '' then 'sql is required'
  when length(body->>'$.sql') > 15 then 'sql exceeds max 15' end as reject_reason from http_json""")
def _(v):
    good, bad = filters.flt_http_valid(readers.src_http_events(v.http_json), max_len=15)
    return good.unionByName(bad, allowMissingColumns=True).select("event_id", "sql_text", "reject_reason")


@query("flt_write_guard", """select statement_id, regexp_matches(sql_text, '\\b(update|delete|drop|insert|truncate|alter)\\b', 'i') as is_write
from mixed_statements""")
def _(v):
    return filters.flt_write_guard(v.mixed_statements).select("statement_id", "is_write")


@query("flt_safe_identifier", """select trim(replace(p_name, '`', '')) as table_name, p_partkey from
  (select p_partkey, case p_size % 3 when 0 then '`' || replace(p_name, ' ', '_') || '`' else p_name end as p_name from part)
where regexp_full_match(trim(replace(p_name, '`', '')), '[A-Za-z0-9_]+')""")
def _(v):
    quoted = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("`"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("`"))).otherwise(F.col("p_name"))
    return filters.flt_safe_identifier(v.part.select(quoted.alias("table_name"), "p_partkey"))


@query("flt_known_variables", "select instance_id, variable_name, value from status_counters where lower(trim(variable_name)) in ('max_connections')")
def _(v):
    return filters.flt_known_variables(v.status_counters)


@query("flt_lock_waits", """select trx_id, trx_state, date_diff('second', trx_started, snapshot_at) as wait_seconds from trx_snapshot
where trx_state = 'LOCK WAIT' or date_diff('second', trx_started, snapshot_at) > 5""")
def _(v):
    return filters.flt_lock_waits(v.trx_snapshot, as_of=F.col("snapshot_at")).select("trx_id", "trx_state", "wait_seconds")


@query("flt_stale_tasks", """select task_id, case when stale then 'FAILED' else status end as status,
  case when stale then '诊断超时（Agent可能异常退出）' else error_message end as error_message,
  case when stale then timestamp '2001-08-02' else updated_at end as updated_at
from (select *, status = 'RUNNING' and updated_at < timestamp '2001-08-02' - interval 180 day as stale from diagnosis_record)""")
def _(v):
    return filters.flt_stale_tasks(v.diagnosis_record, as_of=orders_as_of(), stale_sec=180 * 86_400).select(
        "task_id", "status", "error_message", "updated_at")


@query("lookup_by_key", """select task_id, status from diagnosis_record where task_id in (select concat('t-', cast(c_custkey * 7 as varchar)) from customer)""")
def _(v):
    keys = v.customer.select(F.concat(F.lit("t-"), (F.col("c_custkey") * 7).cast("string")).alias("task_id"))
    return filters.lookup_by_key(v.diagnosis_record, keys, key="task_id").select("task_id", "status")


@query("lookup_session", "select task_id, created_at from diagnosis_record where session_id = 's-7' order by created_at desc, task_id desc limit 5")
def _(v):
    return filters.lookup_session(v.diagnosis_record, session_id="s-7", n=5).select("task_id", "created_at")


@query("del_rows", """select task_id, status from diagnosis_record where task_id not in (select concat('t-', cast(c_custkey * 7 as varchar)) from customer)""")
def _(v):
    keys = v.customer.select(F.concat(F.lit("t-"), (F.col("c_custkey") * 7).cast("string")).alias("task_id"))
    return filters.del_rows(v.diagnosis_record, keys, key="task_id").select("task_id", "status")


@query("del_project", "select task_id, project_code from diagnosis_record where project_code <> 'proj-a'")
def _(v):
    return filters.del_project(v.diagnosis_record, project="proj-a").select("task_id", "project_code")


@query("del_retention", "select task_id, created_at from diagnosis_record where created_at >= timestamp '2001-08-02' - interval 365 day")
def _(v):
    return filters.del_retention(v.diagnosis_record, as_of=orders_as_of(), days=365).select("task_id", "created_at")


# --- searches ---

_FOUND = "event_id, captured_at, sql_text, severity, project_code"
_SEARCH = """captured where project_code = 'proj-b' and source is not null and severity = 'P1' and captured_at >= timestamp '2024-01-05'
  and captured_at <= timestamp '2024-01-28' and query_time_sec >= 0.1 and query_time_sec <= 9.5
  and (diagnosis_report is null or diagnosis_report = 'N/A') and contains(lower(sql_text), 'from orders')"""
_SEARCH_FILTERS = dict(project="proj-b", severity="P1", start="2024-01-05 00:00:00", end="2024-01-28 00:00:00", min_sec=0.1, max_sec=9.5,
                       diagnosed=False, keyword="FROM orders")


@query("search_captured", f"select {_FOUND} from {_SEARCH} order by captured_at desc, event_id desc limit 20 offset 20")
def _(v):
    return search.search_captured(captured(v), page=2, **_SEARCH_FILTERS).select(*_FOUND.split(", "))


@query("search_captured_total", f"select count(*) as total from {_SEARCH}")
def _(v):
    return search.match_captured(captured(v), **_SEARCH_FILTERS).agg(F.count(F.lit(1)).alias("total"))


_HISTORY = """diagnosis_record where project_code = 'proj-a' and created_at >= timestamp '1996-01-01' and created_at <= timestamp '2000-12-31'
  and source = 'manual' and (contains(lower(original_sql), '1') or contains(lower(clean_sql), '1'))"""
_HISTORY_FILTERS = dict(project="proj-a", start="1996-01-01 00:00:00", end="2000-12-31 00:00:00", source="manual", keyword="1")


@query("search_history", f"select task_id, created_at, source from {_HISTORY} order by created_at desc, task_id desc limit 20")
def _(v):
    return search.search_history(v.diagnosis_record, **_HISTORY_FILTERS).select("task_id", "created_at", "source")


@query("search_history_total", f"select count(*) as total from {_HISTORY}")
def _(v):
    return search.match_history(v.diagnosis_record, **_HISTORY_FILTERS).agg(F.count(F.lit(1)).alias("total"))


@query("history_status_filter", "select task_id, status from diagnosis_record where status = 'FAILED'")
def _(v):
    return search.history_status_filter(v.diagnosis_record, status="failed").select("task_id", "status")


@query("prj_history_summary", """select task_id, project_code, instance_id, case when length(coalesce(clean_sql, original_sql)) > 100
  then substr(coalesce(clean_sql, original_sql), 1, 100) || '...' else coalesce(clean_sql, original_sql) end as sql_preview,
  original_sql, clean_sql, status, source, fingerprint, duration_ms, tool_call_count, created_at from diagnosis_record""")
def _(v):
    return search.prj_history_summary(v.diagnosis_record)


@query("prj_record_view", """select event_id as id, sql_text, database_name, query_time_sec, instance_id, project_code, rows_sent as occurrence, severity,
  diagnosis_report, diagnosis_report is not null and diagnosis_report <> 'N/A' as diagnosed, captured_at from captured""")
def _(v):
    return search.prj_record_view(captured(v).withColumn("occurrence_count", F.col("rows_sent")))


@query("recent_n", """select event_id, captured_at from captured where instance_id = 'inst-2' and project_code = 'proj-b'
order by captured_at desc, event_id desc limit 10""")
def _(v):
    return search.recent_n(captured(v), n=10, instance="inst-2", project="proj-b").select("event_id", "captured_at")


@query("top_frequent", """select fingerprint, count(*) as occurrence_count from captured group by fingerprint
order by occurrence_count desc, fingerprint limit 5""")
def _(v):
    return search.top_frequent(folds.agg_upsert_captured(None, captured(v)), n=5).select("fingerprint", "occurrence_count")


@query("page", "select event_id, captured_at from captured order by captured_at desc, event_id desc limit 50 offset 100")
def _(v):
    return search.page_of(captured(v), order=[F.desc("captured_at"), F.desc("event_id")], page=3, size=50).select("event_id", "captured_at")


@query("page_seek", "select event_id, captured_at from captured order by captured_at desc, event_id desc limit 50 offset 100")
def _(v):
    order = [F.desc("captured_at"), F.desc("event_id")]
    last = search.page_of(captured(v), order=order, page=100, size=1).first()
    found = search.page_after(captured(v), ts="captured_at", tie="event_id", after=(last["captured_at"], last["event_id"]), size=50)
    return found.select("event_id", "captured_at")


@query("union_sources", """select event_id, source, sql_text, query_time_sec, trace_id from (
  select event_id, 'http_endpoint' as source, body->>'$.sql' as sql_text, cast(body->>'$.durationMs' as double) / 1000 as query_time_sec, null as trace_id from http_json
  union all select event_id, 'http_capture', body->>'$.sqlText', cast(body->>'$.queryTimeSec' as double), body->>'$.traceId' from http_json_v2
  union all select event_id, 'manual', sql_text, null, null from stmt_events)""")
def _(v):
    all_events = tasks.union_sources(
        readers.src_http_events(v.http_json), readers.src_http_events_v2(v.http_json_v2), readers.src_manual(v.stmt_events)
    )
    return all_events.select("event_id", "source", "sql_text", "query_time_sec", "trace_id")


# --- statement functions ---


@query("fn_normalize_sql", f"select event_id, {NORMAL} as normalized from stmt_events")
def _(v):
    return statements.fn_normalize_sql(v.stmt_events).select("event_id", "normalized")


@query("fn_fingerprint", f"select event_id, md5(instance_id || ':' || {NORMAL}) as fingerprint from stmt_events")
def _(v):
    return statements.fn_fingerprint(v.stmt_events).select("event_id", "fingerprint")


@query("fn_fingerprint_global", f"select event_id, md5({NORMAL}) as fingerprint_global from stmt_events")
def _(v):
    return statements.fn_fingerprint_global(v.stmt_events).select("event_id", "fingerprint_global")


@query("fn_severity", f"select event_id, {SEVERITY} as severity from stmt_events")
def _(v):
    return statements.fn_severity(v.stmt_events).select("event_id", "severity")


@query("fn_strip_comments", """select statement_id, trim(regexp_replace(regexp_replace(regexp_replace(sql_text, '/\\*.*?\\*/', '', 'gs'),
  '--[^\\n]*', '', 'g'), '\\s+', ' ', 'g')) as stripped from mixed_statements""")
def _(v):
    return statements.fn_strip_comments(v.mixed_statements).select("statement_id", "stripped")


@query("mask_statements", """select statement_id, 'SELECT * FROM users WHERE phone = ''' || substr(phone, 1, 3) || '****' || right(phone, 4)
  || ''' AND `id_card`=''' || substr(card, 1, 3) || '***********' || right(card, 4) || ''' AND email = ''' || substr(mail, 1, 2) || '***@mail.example'
  || ''' AND password = ''***'' AND status = ''done''' as masked_sql, 4 as masked_count, true as masked from literal_statements""")
def _(v):
    # A small file of long work: its rows go to all tasks, not to one for each of its few row groups.
    rows = v.literal_statements.repartition("statement_id")
    return statements.mask_statements(rows).select("statement_id", "masked_sql", "masked_count", "masked")


@query("classify_statements", """select statement_id, case statement_id % 8 when 0 then 'select' when 1 then 'multi' when 3 then 'empty'
  when 4 then 'select' when 6 then 'select' when 7 then 'select' else 'other' end as statement_class,
  statement_id % 8 in (0, 4, 6, 7) as is_safe, case statement_id % 8 when 1 then '安全拦截：禁止执行多条拼接的 SQL 语句' when 3 then '安全拦截：SQL 不能为空'
    when 2 then '安全拦截：系统仅支持 SELECT 查询语句的分析，禁止包含 DML/DDL 等写操作' when 5 then '安全拦截：系统仅支持 SELECT 查询语句的分析，禁止包含 DML/DDL 等写操作' end as refusal
from mixed_statements""")
def _(v):
    return statements.classify_statements(v.mixed_statements).select("statement_id", "statement_class", "is_safe", "refusal")


@query("referenced_tables", """select statement_id, unnest(case statement_id % 8 when 0 then ['t' || statement_id] when 1 then ['t' || statement_id]
  when 4 then ['base' || statement_id, 'dim', 'fact'] when 6 then ['orders', 'users'] when 7 then ['a1', 'a2'] else [] end) as table_name from mixed_statements""")
def _(v):
    return statements.referenced_tables(v.mixed_statements)


@query("bind_parameters", """select thread, line_no, case when o_orderkey % 10 = 1
  then 'SELECT * FROM orders WHERE o_orderkey = ? AND status = ? AND d > ?'
  else 'SELECT * FROM orders WHERE o_orderkey = ' || o_orderkey || ' AND status = ''' || o_orderstatus || ''' AND d > '
    || case when o_orderkey % 3 = 0 then 'null' else '''2024-01-01 00:00:00''' end end
  || case when o_orderkey % 5 = 0 then ' AND z = ?' else '' end as sql_text from log_lines where line_no % 2 = 0""")
def _(v):
    return statements.bind_parameters(v.log_lines)


@query("tables_array", "select task_id, 'orders' as first_table, 2 as table_count, '[orders, users]' as table_names from diagnosis_record")
def _(v):
    arrays = statements.tables_text(statements.tables_array(v.diagnosis_record))
    return arrays.select("task_id", F.col("tables")[0].alias("first_table"), F.size("tables").alias("table_count"), "table_names")
