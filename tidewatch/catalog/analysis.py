"""Queries: rules, knowledge, plans, folds, cool-down, reports, task life cycle, audits."""

from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.catalog.capture import FOLD, fold_columns
from tidewatch.catalog.common import captured, events_as_of, orders_as_of
from tidewatch.catalog.registry import query
from tidewatch.operators import cooldown, folds, knowledge, metadata, reports, rules, tasks
from tidewatch.plans import explain_tree
from tidewatch.session import shared_folder
from tidewatch.sources import readers, sinks

# --- rules ---


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULE_ROWS = ", ".join(
    f"({n}, {_quoted(i)}, {_quoted(c)}, {_quoted(t)}, {_quoted(s)})" for n, (i, c, t, _, s) in enumerate(K.RULES, 1)
)
_TEXT_RULES = """r.rule_id = 'E001' and contains(u, 'SELECT *') or r.rule_id = 'E002' and regexp_matches(u, 'WHERE.*(DATE\\(|YEAR\\(|MONTH\\(|DATE_FORMAT\\()')
    or r.rule_id = 'E003' and contains(u, 'LIKE ''%') or r.rule_id = 'E004' and contains(u, 'ORDER BY RAND()')
    or r.rule_id = 'E005' and regexp_matches(u, 'LIMIT\\s+[0-9]{5,}') or r.rule_id = 'E107' and contains(u, 'CROSS JOIN')
    or r.rule_id = 'E202' and contains(u, 'UPDATE') and not contains(u, 'WHERE')"""
RULES_SQL = f"""with rules as (select * from (values {_RULE_ROWS}) t(rule_no, rule_id, category, title, suggestion)),
s as (select *, upper(sql_text) as u from stmt_events),
hits as (select s.*, r.* from s join rules r on {_TEXT_RULES}),
texts as (
  select event_id, chr(10) || '【企业知识库匹配规则】' || chr(10) || string_agg('**规则 #' || rule_id || '** [' || category || ']: ' || title
    || chr(10) || '> ' || suggestion || chr(10) || chr(10), '' order by rule_no) as report from hits group by event_id)"""


@query("join_rules", RULES_SQL + "\nselect event_id, rule_no, rule_id, title from hits")
def _(v):
    return rules.join_rules(v.stmt_events).select("event_id", "rule_no", "rule_id", "title")


@query("rules_report", RULES_SQL + "\nselect s.event_id, coalesce(t.report, '') as rules_report from s left join texts t on s.event_id = t.event_id")
def _(v):
    return rules.rules_report(v.stmt_events).select("event_id", "rules_report")


_FIXED = "cast(round(cast(cast(query_time_sec as varchar) as decimal(38, 20)), {0}) as decimal(18, {0}))"


CONTEXT = f"""'【自动采集信息】' || chr(10) || '- 耗时: ' || {_FIXED.format(2)} || ' 秒' || chr(10) || '- 扫描: ' || rows_examined || ' 行' || chr(10)
  || '- 来源: ' || source || chr(10) || '- 库: ' || coalesce(database_name, 'unknown') || chr(10) || chr(10) || '【待分析SQL】' || chr(10) || sql_text
  || coalesce(chr(10) || t.report, '')"""


@query("build_context", f"{RULES_SQL}\nselect s.event_id, {CONTEXT} as context from s left join texts t on s.event_id = t.event_id")
def _(v):
    return rules.build_context(v.stmt_events).select("event_id", "context")


@query("sink_tasks", f"""{RULES_SQL}
select md5(e.fingerprint || ':' || cast(e.event_id as varchar)) as task_id, '' as session_id, e.instance_id, coalesce(e.project_code, '') as project_code,
  {CONTEXT} as enriched_prompt, e.fingerprint, e.source, e.captured_at as created_at from captured e left join texts t on e.event_id = t.event_id""")
def _(v):
    made = tasks.new_tasks(rules.build_context(captured(v)))
    return sinks.sink_tasks(made, path=shared_folder(v.spark, "tasks"), version=0)


_MARK = "case severity when 'P0' then '🔴' when 'P1' then '🟡' else '🟢' end"


ALERT = f"""{_MARK} || ' 慢查询告警' || chr(10) || '库: ' || coalesce(database_name, 'unknown') || chr(10) || '耗时: ' || {_FIXED.format(1)}
  || 's | 扫描: ' || rows_examined || '行' || chr(10) || 'SQL: ' || case when length(sql_text) > 100 then substr(sql_text, 1, 100) || '...' else sql_text end
  || chr(10) || chr(10) || """
NEW = f"""{_MARK} || ' [' || case severity when 'P0' then '严重' when 'P1' then '警告' else '关注' end || '] 新发现慢查询'"""


@query("alert_text", f"select event_id, {ALERT}{NEW} as alert from captured")
def _(v):
    return rules.alert_text(captured(v)).select("event_id", "alert")


_PLAN_ROWS = """with nodes as (
  select p_partkey as plan_id, lower(substr(p_brand, 1, 5)) as table_name, case when p_size % 3 = 0 then 'ALL' else 'ref' end as access_type,
    case when p_size % 3 = 0 then null else 'idx_a' end as key, p_size % 3 = 0 as key_is_null, cast(p_size * 200 as bigint) as rows,
    cast(p_size * 2 as double) as filtered, case p_size % 4 when 0 then 'Using filesort' when 1 then 'Using temporary' else '' end as extra from part),
steps as (
  select plan_id, case when plan_id % 3 = 2 then 2 else 1 end as step, table_name, access_type, key, key_is_null, rows, filtered, extra from nodes
  union all select plan_id, 2, 'u', 'eq_ref', 'PRIMARY', false, null, null, null from nodes where plan_id % 3 = 0
  union all select plan_id, 1, 'd', 'ALL', null, true, null, 100.0, null from nodes where plan_id % 3 = 2)"""


@query("plan_tables", _PLAN_ROWS + """
select *, '$.query_block.' || case plan_id % 3 when 0 then 'nested_loop[' || (step - 1) || '].table' when 1 then 'ordering_operation.grouping_operation.table'
  else 'table' || case when step = 2 then '.materialized_from_subquery.query_block.table' else '' end end as path from steps""")
def _(v):
    return explain_tree.plan_tables(v.plans)


@query("plan_key", _PLAN_ROWS + """
select plan_id, access_type || '|' || coalesce(key, '') || '|' || coalesce(extra, '') as plan_key from steps where step = 1""")
def _(v):
    return explain_tree.plan_key(v.plans)


@query("join_rules_with_plan", _PLAN_ROWS + f""",
rules as (select * from (values {_RULE_ROWS}) t(rule_no, rule_id, category, title, suggestion)),
s as (select *, upper(sql_text) as u from planned_statements),
on_plan as (
  select distinct plan_id, r.rule_id from steps t join rules r on r.rule_id in ('E101', 'E201') and coalesce(rows, 0) > (case r.rule_id when 'E101' then 1000 else 5000 end)
      and (r.rule_id = 'E201' or access_type = 'ALL') or r.rule_id = 'E102' and key_is_null or r.rule_id = 'E103' and contains(extra, 'Using filesort')
    or r.rule_id = 'E104' and contains(extra, 'Using temporary') or r.rule_id = 'E105' and coalesce(filtered, 0) < 20 or r.rule_id = 'E106' and access_type = 'ALL'),
hits as (
  select s.plan_id, r.rule_id from s join rules r on {_TEXT_RULES}
  union all select s.plan_id, p.rule_id from s join on_plan p on s.plan_id = p.plan_id and (p.rule_id in ('E101', 'E103', 'E104', 'E105')
    or p.rule_id = 'E102' and regexp_matches(u, 'WHERE\\s+\\w+\\s*=\\s*''[0-9]+''') or p.rule_id = 'E106' and contains(u, 'JOIN') or p.rule_id = 'E201' and contains(u, 'DELETE')))
select plan_id, rule_id from hits""")
def _(v):
    plans = explain_tree.with_accesses(v.plans)
    return rules.join_rules_with_plan(v.planned_statements, plans).select("plan_id", "rule_id")


def _supplier_rules(v):
    """One rule per supplier: its table, for some also a text that must not be there, or a pattern."""
    def condition(key, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    no = F.col("s_suppkey")
    needed = F.array_compact(F.array(
        condition("sql_contains", F.concat(F.lit("from t"), no.cast("string"), F.lit(" x"))),
        F.when(no % 3 == 0, condition("sql_not_contains", F.lit("x.a = '1'"))), F.when(no % 4 == 0, condition("sql_pattern", F.lit(r"x\.a = \d"))),
    ))
    return v.supplier.select(
        no.cast("int").alias("rule_no"), F.concat(F.lit("S"), no.cast("string")).alias("rule_id"), F.lit("c").alias("category"),
        F.col("s_name").alias("title"), F.lit("s").alias("suggestion"), needed.alias("conditions"))


@query("join_rule_rows", """with s as (select *, upper(sql_text) as u from table_statements)
select s.statement_id, cast(r.s_suppkey as int) as rule_no, 'S' || r.s_suppkey as rule_id, r.s_name as title
from s join supplier r on contains(u, 'FROM T' || r.s_suppkey || ' X') and (r.s_suppkey % 3 <> 0 or not contains(u, concat('X.A = ', chr(39), '1', chr(39))))
  and (r.s_suppkey % 4 <> 0 or regexp_matches(u, 'X[.]A = [0-9]'))""")
def _(v):
    return rules.join_rules(v.table_statements, _supplier_rules(v)).select("statement_id", "rule_no", "rule_id", "title")


@query("compare_plans", _PLAN_ROWS + """,
after as (select plan_id, 1 as step, table_name, rows // 10 as rows from nodes)
select coalesce(b.plan_id, a.plan_id) as plan_id, coalesce(b.step, a.step) as step, b.access_type as before_access_type, b.rows as before_rows,
  case when a.plan_id is not null then 'ref' end as after_access_type, a.rows as after_rows, true as changed
from steps b full join after a on a.plan_id = b.plan_id and a.step = b.step where b.rows is null or a.rows is null or b.rows <> a.rows""")
def _(v):
    both = explain_tree.compare_plans(v.plans, v.plans_after)
    return both.select("plan_id", "step", "before_access_type", "before_rows", "after_access_type", "after_rows", "changed")


# --- knowledge ---

_KNOWLEDGE = """with stmts as (select distinct sql_text from stmt_events),
terms as (
  select sql_text, lower(unnest(list_concat(
    case when sql_text like '%JOIN users%' then ['orders', 'users'] when sql_text ilike '%from orders%' then ['orders']
      when sql_text like '%FROM users%' then ['users'] when sql_text like '%FROM items%' then ['items'] else [] end,
    list_filter(['JOIN', 'LEFT JOIN', 'ORDER BY', 'GROUP BY', 'LIMIT', 'DISTINCT', 'UNION', 'HAVING'], lambda w: contains(upper(sql_text), w))))) as term from stmts),
hits as (
  select distinct t.sql_text, d.id, d.category, d.title, d.content, case d.category when '军规' then 1 when '事故复盘' then 2 when '业务规则' then 3 else 99 end as priority
  from terms t join rag_document d on d.enabled and contains(lower(d.tags), t.term)),
numbered as (select *, row_number() over (partition by sql_text order by priority, id) as rn from hits),
texts as (
  select sql_text, '【企业知识库匹配规则】' || chr(10) || string_agg('**规则' || rn || '** [' || category || ']: ' || title || chr(10) || '> ' || content
    || chr(10) || chr(10), '' order by rn) as knowledge, count(*) as documents_found from numbered group by sql_text)"""


@query("join_knowledge", _KNOWLEDGE + """
select s.event_id, coalesce(knowledge, '') as knowledge, coalesce(documents_found, 0) as documents_found from stmt_events s left join texts t on s.sql_text = t.sql_text""")
def _(v):
    return knowledge.join_knowledge(v.stmt_events.select("event_id", "sql_text"), v.rag_document).drop("sql_text")


@query("knowledge_rows", _KNOWLEDGE + """
select h.sql_text, h.id, h.priority from hits h""")
def _(v):
    terms = knowledge.statement_terms(v.stmt_events)
    rows = knowledge.knowledge_rows(terms.groupBy("term_set").agg(F.count(F.lit(1)).alias("texts")), v.rag_document)
    return terms.join(rows, "term_set").select("sql_text", "id", "priority")


@query("build_manual_context", _KNOWLEDGE + """
select s.event_id, case when knowledge is null then '' else knowledge || chr(10) || chr(10) end || '【待分析SQL】' || chr(10)
  || regexp_replace(s.sql_text, '(u.phone = ''138)[0-9]+([0-9]{4}'')', '\\1****\\2') || chr(10) || chr(10) || '请按需调用工具获取DDL和执行计划进行诊断。' as context
from stmt_events s left join texts t on s.sql_text = t.sql_text""")
def _(v):
    return knowledge.build_manual_context(v.stmt_events.select("event_id", "sql_text"), v.rag_document).select("event_id", "context")


@query("list_documents", """select id, category, title, 'category' as by_what from document_base where enabled and category = '军规'
union all select id, category, title, 'tag' from document_base where enabled and contains(lower(tags), 'en,')
union all select id, category, title, 'all' from document_base where enabled""")
def _(v):
    def listed(kind, **filters):
        return knowledge.list_documents(v.document_base, **filters).select("id", "category", "title", F.lit(kind).alias("by_what"))

    return listed("category", category="军规").unionByName(listed("tag", tag="EN,")).unionByName(listed("all"))


@query("upsert_documents", """select coalesce(d.id, c.id) as id, case when action is null then d.title else c.title end as title,
  case when action is null then d.content else c.content end as content, case when action is null then d.category else coalesce(c.category, '业务规则') end as category,
  case when action is null then d.tags else coalesce(c.tags, '') end as tags, case when action is null then d.enabled else coalesce(c.enabled, true) end as enabled
from document_base d full join document_changes c on d.id = c.id
where action is null or (action = 'update' and d.id is not null) or (action = 'insert' and d.id is null)""")
def _(v):
    return knowledge.upsert_documents(v.document_base, v.document_changes)


# --- folds ---


@query("agg_upsert_captured", FOLD.format(source="captured"))
def _(v):
    events = captured(v)
    early = F.col("captured_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    state = folds.agg_upsert_captured(None, events.filter(early))
    return fold_columns(folds.agg_upsert_captured(state, events.filter(~early)))


@query("agg_upsert_diagnosis", """with all_rows as (
  select task_id, instance_id, status, report, error_message, duration_ms, updated_at, created_at,
    {'kind': 0, 'at': timestamp '1900-01-01', 'seq': cast(0 as bigint)} as o from diagnosis_record
  union all select task_id, instance_id, status, report, error_message, duration_ms, updated_at, created_at, {'kind': 1, 'at': updated_at, 'seq': seq} from diagnosis_changes),
folded as (
  select task_id, arg_min({'instance_id': instance_id, 'created_at': created_at}, o) as f,
    arg_max({'status': status, 'report': report, 'error_message': error_message, 'duration_ms': duration_ms, 'updated_at': updated_at}, o) as l
  from all_rows group by task_id)
select task_id, f.instance_id as instance_id, f.created_at as created_at, l.status as status, l.report as report, l.error_message as error_message,
  l.duration_ms as duration_ms, l.updated_at as updated_at from folded""")
def _(v):
    return folds.agg_upsert_diagnosis(v.diagnosis_record, v.diagnosis_changes)


_CHAIN = """with k as (select * from captured where {where}),
chain as (
  select fingerprint, min(captured_at) as at from k group by fingerprint
  union all select c.fingerprint, min(k.captured_at) from chain c join k on k.fingerprint = c.fingerprint and k.captured_at >= c.at + interval {period} group by c.fingerprint)
select k.event_id, k.fingerprint, k.captured_at from k join chain c on k.fingerprint = c.fingerprint and k.captured_at = c.at"""


@query("cooldown_dedup", _CHAIN.format(where="true", period="30 minute"))
def _(v):
    return cooldown.cooldown_dedup(captured(v)).select("event_id", "fingerprint", "captured_at")


@query("alert_dedup", _CHAIN.format(where="severity = 'P0'", period="24 hour"))
def _(v):
    return cooldown.alert_dedup(captured(v)).select("event_id", "fingerprint", "captured_at")


@query("quota_flag", """with chain as (
  select user_id, min(ts) as opened from events group by user_id
  union all select c.user_id, min(e.ts) from chain c join events e on e.user_id = c.user_id and e.ts >= c.opened + interval 1 day group by c.user_id),
placed as (select e.event_id, e.user_id, e.ts, c.opened from events e asof join chain c on e.user_id = c.user_id and e.ts >= c.opened)
select event_id, row_number() over (partition by user_id, opened order by ts, event_id) > 3 as refused from placed""")
def _(v):
    flagged = cooldown.quota_flag(v.events, key="user_id", ts="ts", tie="event_id", limit=3, period="1 day")
    return flagged.select("event_id", "refused")


@query("round_cap", """with r as (
  select event_id, row_number() over (partition by instance_id, cast(captured_at as date) order by captured_at, event_id) <= 50 as taken from stmt_events)
select event_id, taken from r""")
def _(v):
    events = v.stmt_events.withColumn("round", F.to_date("captured_at"))
    now, later = tasks.round_cap(events)
    return now.select("event_id", F.lit(True).alias("taken")).unionByName(later.select("event_id", F.lit(False).alias("taken")))


# --- reports ---

_AGG = """fingerprint, min(sql_text) as sample_sql, count(*) as cnt, round(avg(query_time_sec), 6) as avg_time, round(max(query_time_sec), 6) as max_time,
  min(severity) as top_severity, max(diagnosis_report) as has_report, max(instance_id) as instance_id, max(project_code) as project_code"""


@query("agg_fingerprint", f"select {_AGG} from captured group by fingerprint order by cnt desc, avg(query_time_sec) desc, fingerprint limit 50")
def _(v):
    return reports.agg_fingerprint(captured(v), digits=6)


@query("count_by_source", "select source, count(*) as cnt from captured where project_code = 'proj-a' group by source")
def _(v):
    return reports.count_by_source(captured(v), project="proj-a")


@query("count_today_total_p0", """select count(*) filter (captured_at >= timestamp '2024-01-30') as today_count, count(*) as total_count,
  count(*) filter (severity = 'P0') as p0_count from captured""")
def _(v):
    return reports.count_today_total_p0(captured(v), as_of=F.lit("2024-01-30 18:00:00").cast("timestamp_ntz"))


@query("count_diagnoses", """select count(*) as diagnosis_count, count(*) filter (status in ('PENDING', 'RUNNING')) as pending_count,
  count(*) filter (status in ('COMPLETED', 'FAILED') and report is not null) as finished_count from diagnosis_record where project_code = 'proj-a'""")
def _(v):
    return reports.count_diagnoses(v.diagnosis_record, project="proj-a")


_FOLDED = FOLD.format(source="captured")


@query("dash_stats", f"""with f as ({_FOLDED}),
frequent as (select fingerprint, occurrence_count from f order by occurrence_count desc, fingerprint limit 5)
select metric, item, cast(value as bigint) as value from (
  select 'today' as metric, '' as item, count(*) filter (captured_at >= timestamp '2024-01-15') as value from f
  union all select 'total', '', count(*) from f union all select 'p0', '', count(*) filter (severity = 'P0') from f
  union all select 'diagnoses', '', count(*) from diagnosis_record union all select 'pending', '', count(*) from diagnosis_record where status = 'RUNNING'
  union all select 'source', source, count(*) from f group by source union all select 'top', fingerprint, occurrence_count from frequent)""")
def _(v):
    folded = folds.agg_upsert_captured(None, captured(v))
    return reports.dash_stats(folded, v.diagnosis_record, as_of=F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


@query("daily_trend", """select cast(captured_at as date) as day, count(*) as cnt from captured where captured_at >= timestamp '2024-01-24' group by 1""")
def _(v):
    return reports.daily_trend(captured(v), as_of=events_as_of(), days=7)


@query("top_statements", """select sql_text, count(*) as times, round(avg(query_time_sec), 6) as avg_time, round(max(query_time_sec), 6) as max_time, round(avg(rows_examined), 4) as avg_rows
from stmt_events where database_name not in ('information_schema','mysql','performance_schema','sys') group by sql_text order by times desc, sql_text limit 20""")
def _(v):
    top = reports.top_statements(v.stmt_events)
    return top.select("sql_text", "times", F.round("avg_time", 6).alias("avg_time"), F.round("max_time", 6).alias("max_time"), F.round("avg_rows", 4).alias("avg_rows"))


@query("capture_stats", """select instance_id, cast(coalesce(sum(collected), 0) as bigint) as total_collected, max(polled_at) as last_collect_at,
  list(error order by polled_at desc, seq desc)[1] as last_error, greatest(60 - date_sub('second', max(polled_at), timestamp '2024-01-31') % 60, 0) as next_poll_sec from capture_log group by instance_id""")
def _(v):
    return reports.capture_stats(v.capture_log, as_of=events_as_of())


@query("connections_by_command", "select instance_id, coalesce(command, 'Unknown') as command, count(*) as connections from process_list group by 1, 2")
def _(v):
    return reports.connections_by_command(v.process_list)


@query("buffer_hit_rate", """with c as (
  select instance_id, max(value) filter (variable_name = 'Innodb_buffer_pool_reads') as disk_reads, max(value) filter (variable_name = 'Innodb_buffer_pool_read_requests') as requests
  from status_counters group by instance_id)
select instance_id, disk_reads, requests, case when requests <> 0 then round((1 - disk_reads / requests) * 100, 6) end as hit_rate,
  case when requests <> 0 then (1 - disk_reads / requests) * 100 < 95 end as below_target from c""")
def _(v):
    return reports.buffer_hit_rate(v.status_counters).withColumn("hit_rate", F.round("hit_rate", 6))


# --- tasks ---


@query("join_project", """select e.event_id, coalesce(nullif(e.project_code, ''), d.project_code) as project_code from stmt_events e
left join dim_instance d on e.instance_id = d.instance_id""")
def _(v):
    return tasks.join_project(v.stmt_events, v.dim_instance).select("event_id", "project_code")


_PLAN_KEYS = """keys as (select md5(cast(s_suppkey % 40 as varchar)) as fingerprint, 'k' || min(s_suppkey % 2) as plan_key from supplier group by s_suppkey % 40)"""


def _plan_keys(v):
    slot = F.col("s_suppkey") % 40
    return v.supplier.groupBy(slot.alias("slot")).agg(F.min(F.col("s_suppkey") % 2).alias("low")).select(
        F.md5(F.col("slot").cast("string")).alias("fingerprint"), F.concat(F.lit("k"), F.col("low").cast("string")).alias("plan_key")
    )


def _latest(v):
    return tasks.latest_results(readers.src_results(v.results_json)[0])


_LATEST = "latest as (select * from result_rows qualify row_number() over (partition by task_id order by seq desc) = 1)"


@query("join_report_cache", f"""with {_PLAN_KEYS},
ev as (
  select o_orderkey as event_id, o_orderdate as captured_at, md5(cast(o_custkey % 40 as varchar)) as fingerprint,
    case o_orderpriority when '1-URGENT' then 'P0' else 'P1' end as severity from orders),
keyed as (select ev.*, keys.plan_key from ev left join keys on ev.fingerprint = keys.fingerprint),
cache as (select fingerprint, plan_key, created_at, max(report) as report from report_cache group by all)
select e.event_id, e.plan_key, case when e.severity <> 'P0' and e.captured_at < c.created_at + interval 7 day then c.report end as cached_report
from keyed e asof left join cache c on e.fingerprint = c.fingerprint and e.plan_key = c.plan_key and e.captured_at >= c.created_at""")
def _(v):
    events = v.orders.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("captured_at"),
        F.md5((F.col("o_custkey") % 40).cast("string")).alias("fingerprint"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "P0").otherwise("P1").alias("severity"),
    )
    return tasks.join_report_cache(events, _plan_keys(v), v.report_cache).select("event_id", "plan_key", "cached_report")


@query("build_report_cache", f"""with {_PLAN_KEYS},
done as (select r.*, keys.plan_key from result_rows r join keys on r.fingerprint = keys.fingerprint where status = 'COMPLETED' and report <> '' and instance_id <> '')
select fingerprint, plan_key, list(report order by created_at desc, seq desc)[1] as report, max(created_at) as created_at from done group by fingerprint, plan_key""")
def _(v):
    results, _ = readers.src_results(v.results_json)
    return tasks.build_report_cache(results, _plan_keys(v), order=("created_at", "seq"))


@query("anti_finished_tasks", "select task_id from waiting_tasks where task_id not in (select task_id from diagnosis_record where status in ('COMPLETED', 'FAILED'))")
def _(v):
    return tasks.anti_finished_tasks(v.waiting_tasks, v.diagnosis_record).select("task_id")


_STATEMENTS = "known as (select md5(cast(s_suppkey % 40 as varchar)) as fingerprint, min('SELECT ' || s_name) as sql_text, 'old' as diagnosis_report from supplier group by s_suppkey % 40)"


def _known(v):
    return v.supplier.groupBy(F.md5((F.col("s_suppkey") % 40).cast("string")).alias("fingerprint")).agg(
        F.min(F.concat(F.lit("SELECT "), "s_name")).alias("sql_text"), F.lit("old").alias("diagnosis_report"))


@query("join_results", f"""with {_LATEST},
{_STATEMENTS},
r as (select l.*, coalesce(k.sql_text, '') as sql from latest l left join known k on l.fingerprint = k.fingerprint)
select coalesce(d.task_id, r.task_id) as task_id, case when d.task_id is null then r.task_id else d.session_id end as session_id,
  coalesce(nullif(r.instance_id, ''), d.instance_id, r.instance_id) as instance_id, coalesce(d.project_code, '') as project_code,
  case when d.task_id is null then r.sql else d.original_sql end as original_sql, coalesce(r.report, d.report) as report, coalesce(r.status, d.status) as status,
  coalesce(r.error_message, d.error_message) as error_message, coalesce(r.duration_ms, d.duration_ms) as duration_ms,
  case when r.task_id is null then d.source else 'auto' end as source, coalesce(r.fingerprint, d.fingerprint) as fingerprint,
  case when d.task_id is null then timestamp '2001-08-02' else d.created_at end as created_at, case when r.task_id is null then d.updated_at else timestamp '2001-08-02' end as updated_at
from diagnosis_record d full join r on d.task_id = r.task_id""")
def _(v):
    joined = tasks.join_results(_latest(v), v.diagnosis_record, _known(v), as_of=orders_as_of())
    return joined.drop("clean_sql", "table_names", "tool_call_count")


@query("write_back_reports", f"""with {_STATEMENTS},
latest as (select fingerprint, arg_max(report, seq) as report from result_rows where report is not null and fingerprint <> '' group by fingerprint)
select k.fingerprint, k.sql_text, coalesce(l.report, k.diagnosis_report) as diagnosis_report from known k left join latest l on k.fingerprint = l.fingerprint""")
def _(v):
    results, _ = readers.src_results(v.results_json)
    return tasks.write_back_reports(_known(v), results)


@query("reconcile_missing", f"""with {_LATEST},
missing as (select * from latest where task_id not in (select task_id from diagnosis_record where status = 'COMPLETED' and created_at > timestamp '2001-08-02' - interval 1000 day))
select d.task_id, case when m.status = 'COMPLETED' then coalesce(m.report, '') else '诊断失败: ' || coalesce(m.error_message, '未知错误') end as report,
  'COMPLETED' as status, timestamp '2001-08-02' as updated_at, d.created_at from diagnosis_record d join missing m on d.task_id = m.task_id""")
def _(v):
    fixed = tasks.reconcile_missing(_latest(v), v.diagnosis_record, as_of=orders_as_of(), minutes=1000 * 1440)
    return fixed.select("task_id", "report", "status", "updated_at", "created_at")


@query("rebuild_fp_reports", """with recent as (select * from diagnosis_record where status = 'COMPLETED' and report is not null and created_at > timestamp '2001-08-02' - interval 1000 day)
select fingerprint, list(report order by created_at desc, task_id desc)[1] as report from recent
where fingerprint not in (select md5(cast(s_suppkey % 3 as varchar)) from supplier) group by fingerprint""")
def _(v):
    cache = v.supplier.select(F.md5((F.col("s_suppkey") % 3).cast("string")).alias("fingerprint"))
    return tasks.rebuild_fp_reports(v.diagnosis_record, cache, as_of=orders_as_of(), minutes=1000 * 1440)


@query("latest_diagnosis", """select fingerprint, task_id, created_at, report from diagnosis_record where status = 'COMPLETED' and created_at > timestamp '2001-08-02' - interval 1000 day
qualify row_number() over (partition by fingerprint order by created_at desc, task_id desc) = 1""")
def _(v):
    newest = tasks.latest_diagnosis(v.diagnosis_record, as_of=orders_as_of(), minutes=1000 * 1440)
    return newest.select("fingerprint", "task_id", "created_at", "report")


@query("task_backlog", "select instance_id, source, count(*) as waiting from waiting_tasks where task_id not in (select task_id from result_rows) group by 1, 2")
def _(v):
    return tasks.task_backlog(v.waiting_tasks, readers.src_results(v.results_json)[0])


@query("task_status", f"""with {_LATEST}
select w.task_id, coalesce(lower(l.status), 'not_found') as status, case when l.status = 'COMPLETED' then l.report end as report,
  case when l.status = 'FAILED' then l.error_message end as error from waiting_tasks w left join latest l on w.task_id = l.task_id""")
def _(v):
    return tasks.task_status(v.waiting_tasks, readers.src_results(v.results_json)[0])


@query("drain_fallback", """with parsed as (select seq, body->>'$.taskId' as task_id, body->>'$.instanceId' as instance_id, body->>'$.enrichedPrompt' as enriched_prompt, body->>'$.source' as source from fallback_queue),
both_queues as (
  select task_id, instance_id, enriched_prompt, source, 0 as queue, seq from waiting_tasks
  union all select task_id, instance_id, enriched_prompt, source, 1, seq from parsed where task_id is not null)
select task_id, instance_id, enriched_prompt, source from both_queues qualify row_number() over (partition by task_id order by queue, seq) = 1""")
def _(v):
    return tasks.drain_fallback(v.waiting_tasks, v.fallback_queue).select("task_id", "instance_id", "enriched_prompt", "source")


@query("retry_tasks", """select md5(task_id || ':retry:1') as task_id, task_id as retry_of, instance_id, project_code,
  '【重试诊断】' || chr(10) || '【原始SQL】' || chr(10) || original_sql as enriched_prompt, fingerprint, source from diagnosis_record where status = 'FAILED'""")
def _(v):
    return tasks.retry_tasks(v.diagnosis_record)


@query("task_metrics", """select task_id, count(*) filter (kind = 'llm_start') as llm_calls, count(*) filter (kind = 'tool_start') as tool_calls,
  count(*) filter (kind = 'tool_error') as error_count, arg_max(substr(detail, 1, 200), step) filter (kind = 'tool_error') as last_error,
  date_diff('millisecond', min(happened_at), max(happened_at)) as elapsed_ms from tool_trace group by task_id""")
def _(v):
    return tasks.task_metrics(v.tool_trace)


@query("task_errors", "select task_id, step, substr(detail, 1, 200) as error from tool_trace where kind = 'tool_error'")
def _(v):
    return tasks.task_errors(v.tool_trace)


@query("repeat_guard", """with w as (
  select *, lag(tool || args, 1) over t = tool || args and lag(tool || args, 2) over t = tool || args as tripped from tool_trace window t as (partition by task_id order by step))
select task_id, min(step) as step, arg_min(tool, step) as tool, arg_min(args, step) as args from w where tripped group by task_id""")
def _(v):
    return tasks.repeat_guard(v.tool_trace)


@query("budget_guard", """with w as (select task_id, step, sum(total_tokens) over (partition by task_id order by step) as used from tool_trace)
select task_id, min(step) as step, cast(arg_min(used, step) as bigint) as used from w where used > 1000 group by task_id""")
def _(v):
    return tasks.budget_guard(v.tool_trace, budget=1000)


@query("progress_steps", """select task_id, row_number() over (partition by task_id order by step) as step_no,
  case tool when 'get_table_ddl' then '获取表结构' when 'get_execution_plan' then '执行计划分析' else tool end as tool, status, substr(detail, 1, 200) as detail from tool_trace""")
def _(v):
    return tasks.progress_steps(v.tool_trace).drop("happened_at")


# --- audits ---


@query("redundant_indexes", """with defs as (
  select instance_id, table_name, index_name, string_agg(column_name, ',' order by seq_in_index) as cols from index_columns group by all),
counted as (select *, count(*) over (partition by instance_id, table_name) as index_count from defs)
select s.instance_id, s.table_name, s.index_name, s.cols, s.index_count, l.index_name as covered_by, l.cols as covering_cols
from counted s join counted l on s.instance_id = l.instance_id and s.table_name = l.table_name and starts_with(l.cols, s.cols || ',')
where not contains(s.cols, ',') and s.index_count >= 3""")
def _(v):
    return metadata.redundant_indexes(v.index_columns)


@query("index_coverage", """with idx as (select instance_id, table_name, string_agg(distinct column_name, ',' order by column_name) as cols, list(distinct column_name) as have from index_columns group by all),
need as (
  select statement_id, instance_id, 't' || supp as table_name, ['a', 'b', 'd', 'id'] as used from table_statements
  union all select statement_id, instance_id, 't' || pk, ['e'] from table_statements)
select n.statement_id, n.instance_id, n.table_name, coalesce(i.cols, '') as indexed_columns,
  array_to_string(list_filter(n.used, lambda c: not list_contains(coalesce(i.have, []), c)), ',') as missing_columns
from need n left join idx i on n.instance_id = i.instance_id and n.table_name = i.table_name""")
def _(v):
    return metadata.index_coverage(v.table_statements, v.index_columns)


@query("type_mismatch", """with tests as (
  select statement_id, instance_id, 't' || supp as table_name, 'a' as column_name, case when ln % 2 = 0 then cast(ln as varchar) else '''' || ln || '''' end as literal from table_statements
  union all select statement_id, instance_id, 't' || supp, 'd', '''10''' from table_statements)
select t.statement_id, t.instance_id, t.table_name, t.column_name, c.data_type, t.literal,
  case when t.column_name = 'a' then 'text column compared with number' else 'number column compared with text' end as problem
from tests t join column_types c on t.instance_id = c.instance_id and t.table_name = c.table_name and t.column_name = c.column_name
where (t.column_name = 'a') = (not starts_with(t.literal, ''''))""")
def _(v):
    return metadata.type_mismatch(v.table_statements, v.column_types)


@query("row_estimate_audit", """with actual as (select l_partkey as statement_id, count(*) as actual_rows from lineitem group by 1)
select p_partkey as statement_id, p_size as estimated_rows, actual_rows, round(greatest(p_size, actual_rows) / greatest(least(p_size, actual_rows), 1), 6) as deviation,
  greatest(p_size, actual_rows) / greatest(least(p_size, actual_rows), 1) > 10 as outdated from part join actual on p_partkey = statement_id""")
def _(v):
    estimates = v.part.select(F.col("p_partkey").alias("statement_id"), F.col("p_size").alias("estimated_rows"))
    actuals = v.lineitem.groupBy(F.col("l_partkey").alias("statement_id")).agg(F.count(F.lit(1)).alias("actual_rows"))
    return metadata.row_estimate_audit(estimates, actuals).withColumn("deviation", F.round("deviation", 6))


@query("table_statistics", """select t.instance_id, t.table_name, t.table_rows, i.index_name, i.seq_in_index, i.column_name, i.cardinality
from table_sizes t left join index_columns i on t.instance_id = i.instance_id and t.table_name = i.table_name""")
def _(v):
    return metadata.table_statistics(v.table_sizes, v.index_columns)
