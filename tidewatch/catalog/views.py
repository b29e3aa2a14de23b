"""Statement telemetry derived from the given tables.

The same text runs in Spark SQL and in DuckDB; `$table` stands for a given table, `${each}values${as_}name(column)` for one row per value.
Every view uses its whole table.
DUCK_VIEWS are the parts of check queries that need DuckDB's own functions.
"""

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

SPARK_EACH = {"each": ", lateral explode(array(", "as_": ")) as "}
DUCK_EACH = {"each": ", (select unnest([", "as_": "])) as "}

VIEWS = {
    "stmt_events": """
select event_id, ts as captured_at, concat('inst-', cast(user_id % 5 as string)) as instance_id,
  case event_type when 'view' then 'slow_log_file' when 'purchase' then 'http_endpoint'
                  when 'signup' then 'manual' else 'slow_log_table' end as source,
  case when k % 3 = 0 then 'test_sql' when k % 3 = 1 then 'shop' end as database_name,
  case when k % 4 = 0 then 'proj-own' when k % 4 = 1 then '' end as project_code,
  value * 0.05 as query_time_sec, value * 0.001 as lock_time_sec,
  cast(k * k * k as bigint) as rows_examined, cast(k as bigint) as rows_sent,
  case k % 8
    when 0 then concat('SELECT * FROM orders WHERE o_custkey = ', cast(k % 10 as string))
    when 1 then 'select o_orderkey , o_totalprice from orders where year(o_orderdate) = 1998'
    when 2 then 'SELECT name FROM users WHERE name LIKE ''%abc%'''
    when 3 then 'SELECT id FROM items ORDER BY RAND() LIMIT 10'
    when 4 then 'SELECT id FROM orders LIMIT 100000, 20'
    when 5 then concat('SELECT o.id FROM orders o JOIN users u ON o.uid = u.id WHERE u.phone = ''138', lpad(cast(k as string), 8, '0'), '''')
    when 6 then 'SHOW GLOBAL STATUS'
    else 'SELECT a.id FROM orders a CROSS JOIN users b' end as sql_text,
  case when event_id % 4 = 0 then concat('report ', cast(event_id as string))
       when event_id % 4 = 1 then 'N/A' end as diagnosis_report, k
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from $events) e""",
    # inst-4 belongs to no project
    "dim_instance": """
select concat('inst-', cast(n_nationkey + case when n_nationkey < 4 then 0 else 1 end as string)) as instance_id,
  case when n_nationkey % 4 < 2 then 'proj-a' else 'proj-b' end as project_code
from $nation""",
    "http_json": """
select event_id, ts, concat('{"sql":"', case when event_id % 40 = 3 then '  ' else concat('SELECT ', cast(event_id % 7 as string), ' FROM t') end,
  '","durationMs":', cast(cast(floor(value * 100) as int) as string), ',"rowsExamined":', cast(user_id * 1000 as string),
  case when event_id % 3 = 0 then concat(',"database":"db', cast(event_id % 4 as string), '"') else '' end,
  ',"instanceId":"inst-', cast(user_id % 5 as string), '","event_id":', cast(event_id as string), '}') as body
from $events""",
    "http_json_v2": """
select event_id, concat('inst-', cast(user_id % 5 as string)) as instance_id, 'proj-a' as project_code,
  concat('{"sqlText":"SELECT * FROM users WHERE id = ', cast(user_id as string), '","queryTimeSec":', cast(cast(floor(value) as int) as string),
  '.5,"rowsSent":', cast(user_id as string),
  case when event_id % 2 = 0 then concat(',"applicationName":"app-', cast(event_id % 3 as string), '","traceId":"trace-', cast(event_id as string), '"') else '' end,
  '}') as body
from $events""",
    "log_rows": """
select event_id, concat('inst-', cast(user_id % 5 as string)) as instance_id, 'proj-a' as project_code,
  case when event_id % 9 = 0 then 'not a time' else '2024-01-05 10:00:00' end as start_time,
  case event_id % 4 when 0 then '00:01:30.25' when 1 then '2.5' when 2 then 'abc' else cast(user_id as string) end as query_time,
  case when event_id % 2 = 0 then '0.25' end as lock_time,
  case event_id % 3 when 0 then '12.5' when 1 then cast(user_id as string) else '' end as rows_examined,
  cast(user_id as string) as rows_sent, concat('db', cast(user_id % 3 as string)) as db,
  concat('SELECT * FROM t WHERE id = ', cast(user_id as string)) as sql_text
from $events""",
    "history_rows": """
select event_id, ts as captured_at, concat('inst-', cast(user_id % 5 as string)) as instance_id,
  case k % 6 when 0 then 'SET NAMES utf8' when 1 then 'show tables' when 2 then 'SELECT @@version'
    when 3 then concat('SELECT /* ApplicationName=app */ ', cast(k as string))
    else concat('SELECT c FROM t', cast(k % 7 as string), ' WHERE id = ', cast(k as string)) end as sql_text,
  case when k % 11 <> 0 then 'digest' end as digest_text,
  cast(floor(value * 100) as bigint) * 1000000000 as timer_wait, event_id * 1000 + 1 as timer_start,
  cast(k * 100 as bigint) as rows_examined, cast(k as bigint) as rows_sent,
  case k % 5 when 0 then 'mysql' when 1 then null else concat('db', cast(k % 3 as string)) end as current_schema
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from $events) e""",
    "diagnosis_record": """
select concat('t-', cast(o_orderkey as string)) as task_id, concat('s-', cast(o_custkey as string)) as session_id,
  concat('inst-', cast(o_custkey % 5 as string)) as instance_id,
  case when o_custkey % 5 < 2 then 'proj-a' else 'proj-b' end as project_code,
  concat('SELECT * FROM orders WHERE o_orderkey = ', cast(o_orderkey as string)) as original_sql,
  case when o_orderkey % 3 = 0 then concat('select ', repeat('c, ', 40), 'd from t') end as clean_sql,
  '[orders, users]' as table_names,
  case when o_orderstatus = 'F' then concat('report of ', o_orderpriority) end as report,
  case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'RUNNING' else 'FAILED' end as status,
  case when o_orderstatus = 'P' then 'agent error' end as error_message,
  cast(floor(o_totalprice) as bigint) as duration_ms, cast(o_orderkey % 9 as int) as tool_call_count,
  case o_orderkey % 3 when 0 then 'manual' when 1 then 'slow_log_table' else 'http_endpoint' end as source,
  md5(cast(o_custkey % 40 as string)) as fingerprint,
  o_orderdate as created_at, o_orderdate + interval 1 hour as updated_at
from $orders""",
    "results_json": """
select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as seq, l_shipdate as created_at,
  case when l_partkey % 50 = 0 then '{"broken"' when l_partkey % 50 = 1 then '{"status":"completed"}'
  else concat('{"taskId":"t-', cast(l_orderkey * 2 as string), '","status":"', case when l_returnflag = 'R' then 'failed' else 'completed' end,
  '"', case when l_returnflag = 'R' then ',"error":"no plan"' else concat(',"report":"r', cast(l_partkey % 11 as string), '"') end,
  ',"durationMs":', cast(l_partkey % 1000 as string), ',"instanceId":"', case when l_linenumber % 3 = 0 then '' else concat('inst-', cast(l_suppkey % 5 as string)) end,
  '","fingerprint":"', md5(cast(l_suppkey % 40 as string)), '"}') end as body
from $lineitem""",
    "rag_document": """
select item_id as id, concat('doc ', cast(item_id as string)) as title, text as content,
  case item_id % 4 when 0 then '军规' when 1 then '事故复盘' when 2 then '业务规则' else 'other' end as category,
  case item_id % 5 when 0 then 'orders,JOIN' when 1 then 'users' when 2 then 'ORDER BY' when 3 then 'items,LIMIT' else 'GROUP BY' end as tags,
  item_id % 7 <> 0 as enabled
from $benchmark""",
    "document_base": """
select doc_id as id, concat('doc ', cast(doc_id as string)) as title, text as content,
  case doc_id % 4 when 0 then '军规' when 1 then '事故复盘' when 2 then '业务规则' else 'other' end as category,
  concat(lang, ',', source) as tags, doc_id % 7 <> 0 as enabled
from $documents""",
    "document_changes": """
select doc_id * 3 as id, case quality when 1 then 'update' else case toxic when 1 then 'delete' else 'insert' end end as action,
  concat('new ', cast(doc_id as string)) as title, 'new text' as content,
  case when quality = 1 then 'other' end as category, case when toxic = 1 then 'x' end as tags,
  case when quality = 1 then toxic = 0 end as enabled
from $labels""",
    "tool_trace": """
select conv_id as task_id, turn as step, role,
  case role when 'user' then 'llm_start' when 'assistant' then 'tool_start' else 'tool_error' end as kind,
  case cast(floor(turn / 3) as int) when 0 then 'get_table_ddl' when 1 then 'get_execution_plan' else 'other_tool' end as tool,
  case when conv_id % 2 = 0 then 'same' else cast(turn as string) end as args, 'done' as status, text as detail,
  length(text) as total_tokens, cast('2024-01-01 00:00:00' as timestamp) + interval 1 second * cast(turn * turn as int) as happened_at
from $conversations""",
    "plans": """
select p_partkey as plan_id, concat('{"query_block":', case p_partkey % 3
  when 0 then concat('{"nested_loop":[{"table":', node, '},{"table":{"table_name":"u","access_type":"eq_ref","key":"PRIMARY"}}]}')
  when 1 then concat('{"ordering_operation":{"using_filesort":true,"grouping_operation":{"table":', node, '}}}')
  else concat('{"select_id":1,"table":{"table_name":"d","access_type":"ALL","key":null,"filtered":"100.00","materialized_from_subquery":{"query_block":{"table":', node, '}}}}')
  end, '}') as plan
from (select *, concat('{"table_name":"', lower(substr(p_brand, 1, 5)), '","access_type":"',
  case when p_size % 3 = 0 then 'ALL' else 'ref' end, '","key":', case when p_size % 3 = 0 then 'null' else '"idx_a"' end,
  ',"rows_examined_per_scan":', cast(p_size * 200 as string), ',"filtered":', cast(p_size * 2 as string), ',"Extra":"',
  case p_size % 4 when 0 then 'Using filesort' when 1 then 'Using temporary' else '' end, '"}') as node from $part) p""",
    "plans_after": """
select p_partkey as plan_id, concat('{"query_block":{"nested_loop":[{"table":{"table_name":"', lower(substr(p_brand, 1, 5)),
  '","access_type":"ref","key":"idx_a","rows_examined_per_scan":', cast(p_size * 20 as string), ',"filtered":', cast(p_size * 2 as string), ',"Extra":""}}]}}') as plan
from $part""",
    "planned_statements": """
select p_partkey as plan_id, case p_partkey % 5 when 0 then 'SELECT * FROM t JOIN u ON t.a = u.a' when 1 then 'DELETE FROM t WHERE a < 5'
  when 2 then 'SELECT a FROM t WHERE a = ''12''' when 3 then 'UPDATE t SET a = 1' else 'SELECT a FROM t WHERE a = 1 LIMIT 10' end as sql_text
from $part""",
    "index_columns": """
select concat('inst-', cast(s_suppkey % 5 as string)) as instance_id, concat('t', cast(s_suppkey as string)) as table_name,
  case i.no when 0 then 'PRIMARY' when 1 then 'idx_a' when 4 then 'idx_c' else 'idx_ab' end as index_name,
  case i.no when 0 then 'id' when 1 then case when s_suppkey % 4 = 0 then 'z' else 'a' end when 2 then 'a' when 3 then 'b' else 'c' end as column_name,
  case i.no when 3 then 2 else 1 end as seq_in_index, cast(s_suppkey * 10 as bigint) as cardinality
from $supplier${each}0, 1, 2, 3, 4${as_}i(no)""",
    "column_types": """
select concat('inst-', cast(s_suppkey % 5 as string)) as instance_id, concat('t', cast(s_suppkey as string)) as table_name, c.column_name,
  case c.column_name when 'id' then 'bigint' when 'a' then 'varchar(20)' when 'b' then 'int' when 'c' then 'text' else 'decimal(10,2)' end as data_type
from $supplier${each}'id', 'a', 'b', 'c', 'd'${as_}c(column_name)""",
    "table_sizes": """
select concat('inst-', cast(l_suppkey % 5 as string)) as instance_id, concat('t', cast(l_suppkey as string)) as table_name, count(*) as table_rows
from $lineitem group by l_suppkey""",
    "table_statements": """
select l_orderkey * 10 + l_linenumber as statement_id, concat('inst-', cast(l_suppkey % 5 as string)) as instance_id, l_suppkey as supp, l_linenumber as ln, l_partkey as pk,
  concat('SELECT x.a FROM t', cast(l_suppkey as string), ' x JOIN db.t', cast(l_partkey as string), ' y ON x.id = y.e WHERE x.a = ',
  case when l_linenumber % 2 = 0 then cast(l_linenumber as string) else concat('''', cast(l_linenumber as string), '''') end,
  ' AND x.d > ''10'' ORDER BY x.b') as sql_text
from $lineitem""",
    "literal_statements": """
select c_custkey as statement_id, concat('13', lpad(cast(c_custkey as string), 9, '0')) as phone, concat('310101', lpad(cast(c_custkey as string), 12, '0')) as card,
  concat('u', cast(c_custkey as string), '@mail.example') as mail, c_name as nm,
  concat('SELECT * FROM users WHERE phone = ''13', lpad(cast(c_custkey as string), 9, '0'), ''' AND `id_card`=''310101', lpad(cast(c_custkey as string), 12, '0'),
  ''' AND email = ''u', cast(c_custkey as string), '@mail.example'' AND password = ''', c_name, ''' AND status = ''done''') as sql_text
from $customer""",
    "mixed_statements": """
select c_custkey as statement_id, case c_custkey % 8
  when 0 then concat('SELECT a FROM t', cast(c_custkey as string), ' WHERE note = ''x; DROP TABLE y''')
  when 1 then concat('SELECT 1; DELETE FROM t', cast(c_custkey as string))
  when 2 then 'INSERT INTO t VALUES (1)' when 3 then '   '
  when 4 then concat('WITH c AS (SELECT id FROM base', cast(c_custkey as string), ') SELECT c.id FROM c, db.dim d, `fact` WHERE c.id = d.id')
  when 5 then concat('/* SELECT */ UPDATE t SET a = 1 -- ', c_name)
  when 6 then concat('SELECT o.id FROM orders o LEFT JOIN users u ON o.uid = u.id -- FROM ghost', cast(c_custkey as string))
  else '(SELECT id FROM a1) UNION (SELECT id FROM (SELECT id FROM a2) s);' end as sql_text
from $customer""",
    "log_lines": """
select o_orderkey * 2 + p.part as line_no, concat('worker-', cast(o_custkey % 20 as string)) as thread, o_orderkey, o_orderstatus,
  case when p.part = 0 then concat('==>  Preparing: SELECT * FROM orders WHERE o_orderkey = ? AND status = ? AND d > ?', case when o_orderkey % 5 = 0 then ' AND z = ?' else '' end)
  when o_orderkey % 10 = 1 then '<==      Total: 1'
  else concat('==> Parameters: ', cast(o_orderkey as string), '(Long), ', o_orderstatus, '(String), ', case when o_orderkey % 3 = 0 then 'null' else '2024-01-01 00:00:00(Timestamp)' end) end as line
from $orders${each}0, 1${as_}p(part)""",
    "trx_snapshot": """
select l_orderkey * 10 + l_linenumber as trx_id, case when l_returnflag = 'R' then 'LOCK WAIT' else 'RUNNING' end as trx_state,
  l_shipdate as trx_started, l_shipdate + interval 1 second * cast(l_quantity as int) as snapshot_at
from $lineitem""",
    "status_counters": """
select concat('inst-', cast(s_suppkey as string)) as instance_id, c.variable_name,
  case c.variable_name when 'Innodb_buffer_pool_reads' then s_suppkey * 7 else (s_suppkey % 10) * 1000 end as value
from $supplier${each}'Innodb_buffer_pool_reads', 'Innodb_buffer_pool_read_requests', ' Max_Connections ', 'uptime'${as_}c(variable_name)""",
    "process_list": """
select c_custkey as id, concat('inst-', cast(c_nationkey % 5 as string)) as instance_id,
  case c_mktsegment when 'BUILDING' then 'Sleep' when 'MACHINERY' then null else 'Query' end as command
from $customer""",
    "capture_log": """
select event_id as seq, ts as polled_at, concat('inst-', cast(user_id % 50 as string)) as instance_id,
  case when event_type <> 'error' then user_id end as collected, case when event_type = 'error' then concat('error ', cast(user_id as string)) end as error
from $events""",
    "diagnosis_changes": """
select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as seq, concat('t-', cast(l_orderkey * 2 as string)) as task_id, concat('inst-', cast(l_suppkey % 5 as string)) as instance_id,
  case when l_returnflag = 'R' then 'FAILED' else 'COMPLETED' end as status, case when l_returnflag <> 'R' then concat('r', cast(l_partkey as string)) end as report,
  case when l_returnflag = 'R' then 'no plan' end as error_message, cast(l_partkey as bigint) as duration_ms, l_shipdate as updated_at, l_shipdate as created_at
from $lineitem""",
    "fallback_queue": """
select c_custkey as seq, case c_custkey % 7 when 0 then '{"not":"valid"}' when 1 then '{}' else
  concat('{"taskId":"t-', cast(c_custkey * 3 as string), '","instanceId":"inst-', cast(c_nationkey % 5 as string), '","enrichedPrompt":"p', cast(c_custkey as string), '","source":"http_endpoint"}') end as body
from $customer""",
    "waiting_tasks": """
select concat('t-', cast(o_orderkey as string)) as task_id, concat('s-', cast(o_custkey as string)) as session_id,
  concat('inst-', cast(o_custkey % 5 as string)) as instance_id, 'proj-a' as project_code, concat('prompt ', cast(o_orderkey as string)) as enriched_prompt,
  md5(cast(o_custkey % 40 as string)) as fingerprint, case o_orderkey % 2 when 0 then 'manual' else 'slow_log_table' end as source, o_orderkey as seq
from $orders""",
    "report_cache": """
select md5(cast(l_suppkey % 40 as string)) as fingerprint, concat('k', cast(l_suppkey % 2 as string)) as plan_key,
  concat('cached ', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as report, l_shipdate as created_at
from $lineitem""",
}

_NORMAL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({0},'\s+',' ','g'))),"
    r"'\s*,\s*',',','g'),'\s*=\s*','=','g'),'\s*\(','(','g'),'\)\s*',')','g')"
)

SEVERITY = (
    "case when query_time_sec >= 10 or rows_examined >= 1000000 then 'P0' "
    "when query_time_sec >= 2 or rows_examined >= 100000 then 'P1' else 'P2' end"
)

NORMAL = _NORMAL.format("sql_text")

DUCK_VIEWS = {
    "captured": f"""
select e.* exclude (project_code), coalesce(nullif(e.project_code, ''), d.project_code) as project_code,
  md5(e.instance_id || ':' || {NORMAL}) as fingerprint, {SEVERITY} as severity
from stmt_events e left join dim_instance d on e.instance_id = d.instance_id""",
    "result_rows": """
select seq, created_at, body->>'$.taskId' as task_id, upper(body->>'$.status') as status, body->>'$.report' as report, body->>'$.error' as error_message,
  cast(body->>'$.durationMs' as bigint) as duration_ms, body->>'$.fingerprint' as fingerprint, body->>'$.instanceId' as instance_id
from (select * from results_json where json_valid(body)) j where (body->>'$.taskId') is not null""",
}
