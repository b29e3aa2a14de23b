"""Queries: streaming jobs over files that Spark derives from the given tables, run until all input is read."""

from pyspark.sql import functions as F

from tidewatch.catalog.analysis import _CHAIN, ALERT, CONTEXT, NEW, RULES_SQL
from tidewatch.catalog.capture import _HISTORY_WHERE, _LOG_ORACLE, FOLD, fold_columns, write_slow_log
from tidewatch.catalog.common import captured, moment
from tidewatch.catalog.registry import query
from tidewatch.catalog.views import NORMAL, SEVERITY
from tidewatch.session import shared_folder
from tidewatch.streaming import jobs


def _stream_of(v, frame, purpose):
    """Write a frame as files and read them as a stream."""
    folder = v.prepared(purpose, lambda path: frame.write.parquet(path))
    return v.spark.readStream.schema(frame.schema).parquet(folder)


def _statements(v):
    return _stream_of(v, v.stmt_events, "statement-events")


def _outputs(spark, name):
    root = shared_folder(spark, name)
    return {part: f"{root}/{part}" for part in ("out", "state", "checkpoint", "snapshot")}


@query("stream_slow_log", _LOG_ORACLE.format(
    columns="""captured_at, coalesce(used, carried) as database_name, replace(sql_text, ' WHERE ', chr(10) || 'WHERE ') || ';' as sql_text, rows_examined, rows_sent""",
    where="where round(query_time_sec, 6) >= 0.5 and captured_at >= timestamp '2024-01-10 00:00:01'"))
def _(v):
    paths = _outputs(v.spark, "stream-slow-log")
    since = moment("2024-01-10 00:00:00")
    folder = shared_folder(v.spark, "slow-log")
    for until in (moment("2024-01-15 12:00:00"), None):  # the logs have grown, and have other file names, when the job runs again
        write_slow_log(v, folder, until)
        jobs.stream_slow_log(
            v.spark, folder=f"{folder}/*/*/*", out=paths["out"], checkpoint=paths["checkpoint"], instance_id="all", since=since, quiet_seconds=0
        ).awaitTermination()
    return v.spark.read.parquet(paths["out"]).select("captured_at", "database_name", "sql_text", "rows_examined", "rows_sent")


@query("stream_history_anchor", f"""select event_id, instance_id, timer_start from history_rows where {_HISTORY_WHERE}""")
def _(v):
    paths = _outputs(v.spark, "stream-history")
    folder = shared_folder(v.spark, "history-snapshots")
    rows = v.history_rows
    for _ in range(2):  # the second snapshot repeats the rows of the first, as a server's history table does
        rows.write.mode("append").parquet(folder)
        source = v.spark.readStream.schema(rows.schema).parquet(folder)
        jobs.stream_history_anchor(source, out=paths["out"], seen=paths["state"], checkpoint=paths["checkpoint"]).awaitTermination()
    return v.spark.read.parquet(paths["out"]).select("event_id", "instance_id", "timer_start")


@query("stream_http", """select event_id, body->>'$.instanceId' as instance_id, body->>'$.sql' as sql_text, cast(body->>'$.durationMs' as double) / 1000 as query_time_sec
from http_json where trim(body->>'$.sql') <> ''""")
def _(v):
    paths = _outputs(v.spark, "stream-http")
    folder = shared_folder(v.spark, "http-bodies")
    v.http_json.select("body").write.text(folder)
    jobs.stream_http(v.spark, folder=folder, out=paths["out"], checkpoint=paths["checkpoint"]).awaitTermination()
    return v.spark.read.parquet(paths["out"]).select("event_id", "instance_id", "sql_text", "query_time_sec")


@query("stream_cooldown", _CHAIN.format(where="true", period="30 minute"))
def _(v):
    paths = _outputs(v.spark, "stream-cooldown")
    events = _stream_of(v, captured(v), "captured-events")
    jobs.stream_cooldown(events, out=paths["out"], state=paths["state"], checkpoint=paths["checkpoint"]).awaitTermination()
    return v.spark.read.parquet(paths["out"]).select("event_id", "fingerprint", "captured_at")


@query("stream_alerts", _CHAIN.format(where="severity = 'P0'", period="24 hour").replace("select k.event_id, k.fingerprint, k.captured_at", f"select k.event_id, k.fingerprint, k.captured_at, {ALERT}{NEW} as alert"))
def _(v):
    paths = _outputs(v.spark, "stream-alerts")
    events = _statements(v)
    jobs.stream_alerts(events, out=paths["out"], state=paths["state"], checkpoint=paths["checkpoint"]).awaitTermination()
    return v.spark.read.parquet(paths["out"]).select("event_id", "fingerprint", "captured_at", "alert")


@query("stream_upsert", FOLD.format(source="captured"))
def _(v):
    paths = _outputs(v.spark, "stream-upsert")
    jobs.stream_upsert(_stream_of(v, captured(v), "captured-events"), path=paths["snapshot"], checkpoint=paths["checkpoint"]).awaitTermination()
    return fold_columns(jobs.read_captured(v.spark, paths["snapshot"]))


# Reports of half the fingerprints, one for each fiftieth event, as versions of a slowly changing table.
_CACHE = """keys as (select distinct fingerprint, 'p' || substr(fingerprint, 1, 1) as plan_key from captured where substr(fingerprint, 1, 1) < '8'),
versions as (
  select c.fingerprint, y.plan_key, c.captured_at as created_at, max('cached ' || cast(c.event_id as varchar)) as report
  from captured c join keys y on c.fingerprint = y.fingerprint where c.event_id % 50 = 0 group by all),
k as (
  select c.* exclude (diagnosis_report), case when c.severity <> 'P0' and c.captured_at < r.created_at + interval 7 day then r.report end as cached_report,
    coalesce(cached_report, c.diagnosis_report) as diagnosis_report
  from (select x.*, y.plan_key from captured x left join keys y on x.fingerprint = y.fingerprint where length(sql_text) >= 10 and not starts_with(sql_text, 'SHOW ')) c
  asof left join versions r on c.fingerprint = r.fingerprint and c.plan_key = r.plan_key and c.captured_at >= r.created_at)"""
_ACCEPTED = """chain as (
  select fingerprint, min(captured_at) as at from k group by fingerprint
  union all select c.fingerprint, min(k.captured_at) from chain c join k on k.fingerprint = c.fingerprint and k.captured_at >= c.at + interval 30 minute group by c.fingerprint),
accepted as (select k.* from k join chain c on k.fingerprint = c.fingerprint and k.captured_at = c.at)"""


def _plan_keys(v):
    keys = captured(v).select("fingerprint", F.concat(F.lit("p"), F.substring("fingerprint", 1, 1)).alias("plan_key"))
    return keys.where(F.substring("fingerprint", 1, 1) < "8").distinct()


def _reports(v):
    reports = captured(v).where("event_id % 50 = 0").join(_plan_keys(v), "fingerprint")
    return reports.select("fingerprint", "plan_key", F.concat(F.lit("cached "), F.col("event_id").cast("string")).alias("report"),
                          F.col("captured_at").alias("created_at"))


def _run_capture(v, name):
    paths = _outputs(v.spark, name)
    jobs.stream_capture(
        _statements(v), v.dim_instance, out=paths["out"], state=paths["state"],
        snapshot=paths["snapshot"], checkpoint=paths["checkpoint"], plan_keys=_plan_keys(v), reports=lambda: _reports(v),
    ).awaitTermination()
    return paths


@query("stream_capture", f"""{RULES_SQL},
{_CACHE},
{_ACCEPTED}
select md5(a.fingerprint || ':' || cast(a.event_id as varchar)) as task_id, a.fingerprint, coalesce(a.project_code, '') as project_code, {CONTEXT} as enriched_prompt
from accepted a left join texts t on a.event_id = t.event_id where a.cached_report is null""", prepare=_statements)
def _(v):
    out = _run_capture(v, "stream-capture")["out"]
    return v.spark.read.parquet(out).select("task_id", "fingerprint", "project_code", "enriched_prompt")


@query("stream_capture_snapshot", f"with {_CACHE}\n{FOLD.format(source='k')}")
def _(v):
    return fold_columns(jobs.read_captured(v.spark, _run_capture(v, "stream-capture-snapshot")["snapshot"]))


@query("stream_capture_alerts", f"""with {_CACHE},
{_ACCEPTED},
told as (
  select * from k where severity = 'P0'
  union all select * from k where cached_report is not null and event_id not in (select event_id from accepted)),
bell as (
  select fingerprint, min(captured_at) as at from told group by fingerprint
  union all select b.fingerprint, min(k.captured_at) from bell b join told k on k.fingerprint = b.fingerprint and k.captured_at >= b.at + interval 24 hour group by b.fingerprint)
select t.event_id, t.fingerprint, t.captured_at, {ALERT}coalesce('已有诊断(缓存):' || chr(10) || t.cached_report, {NEW}) as alert
from told t join bell b on t.fingerprint = b.fingerprint and t.captured_at = b.at""")
def _(v):
    out = _run_capture(v, "stream-capture-alerts")["out"]
    return v.spark.read.parquet(f"{out}-alerts").select("event_id", "fingerprint", "captured_at", "alert")


_HTTP = f"""k as (
  select h.*, d.project_code, md5(h.instance_id || ':' || {NORMAL}) as fingerprint, {SEVERITY} as severity from (
    select event_id, ts as captured_at, body->>'$.instanceId' as instance_id, coalesce(body->>'$.database', 'unknown') as database_name,
      body->>'$.sql' as sql_text, cast(body->>'$.durationMs' as double) / 1000 as query_time_sec, 0.0::double as lock_time_sec,
      cast(body->>'$.rowsExamined' as bigint) as rows_examined, cast(0 as bigint) as rows_sent, 'http_endpoint' as source, cast(null as varchar) as diagnosis_report
    from http_json where trim(body->>'$.sql') <> '') h left join dim_instance d on h.instance_id = d.instance_id
  where h.instance_id <> 'inst-2')"""


def _run_http(v, name):
    paths, folder = _outputs(v.spark, name), shared_folder(v.spark, "http-bodies")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    v.http_json.select(F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"received_at":"'), at, F.lit('"}'))).write.text(folder)
    on = v.http_json.select(F.get_json_object("body", "$.instanceId").alias("instance_id"), F.lit("http_endpoint").alias("source")).distinct()
    jobs.stream_http_capture(
        v.spark, folder=folder, instances=v.dim_instance, enabled=on.where("instance_id <> 'inst-2'"), alerts=False, **paths).awaitTermination()
    return paths


@query("stream_http_capture", f"""with {_HTTP},
{_ACCEPTED}
select md5(fingerprint || ':' || cast(event_id as varchar)) as task_id, instance_id, fingerprint, coalesce(project_code, '') as project_code, captured_at as created_at from accepted""")
def _(v):
    return v.spark.read.parquet(_run_http(v, "stream-http-capture")["out"]).select("task_id", "instance_id", "fingerprint", "project_code", "created_at")


@query("stream_http_snapshot", f"with {_HTTP}\n{FOLD.format(source='k')}")
def _(v):
    return fold_columns(jobs.read_captured(v.spark, _run_http(v, "stream-http-snapshot")["snapshot"]))


@query("stream_http_rejects", """select event_id, 'sql is required' as reject_reason from http_json where trim(body->>'$.sql') = ''""")
def _(v):
    paths = _outputs(v.spark, "stream-http-rejects")
    folder = shared_folder(v.spark, "http-bodies")
    v.http_json.select("body").write.text(folder)
    jobs.stream_http(v.spark, folder=folder, out=paths["out"], checkpoint=paths["checkpoint"]).awaitTermination()
    return v.spark.read.parquet(f"{paths['out']}-rejects").select("event_id", "reject_reason")
