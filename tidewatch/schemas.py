"""Row shapes of the tables the operators exchange."""

from pyspark.sql import types as T


def _struct(spec):
    return T.StructType([T.StructField(name, kind) for name, kind in spec])


_S, _L, _D, _I, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.TimestampType()

#: One captured statement; `captured_at` may also be TIMESTAMP_NTZ in existing tables.
EVENT = _struct([
    ("event_id", _L), ("source", _S), ("source_detail", _S), ("captured_at", _TS), ("instance_id", _S),
    ("project_code", _S), ("database_name", _S), ("sql_text", _S), ("query_time_sec", _D),
    ("lock_time_sec", _D), ("rows_examined", _L), ("rows_sent", _L), ("application_name", _S), ("trace_id", _S),
])

#: The folded table: one row per fingerprint.
CAPTURED = _struct([
    ("fingerprint", _S), ("sql_text", _S), ("database_name", _S), ("instance_id", _S), ("project_code", _S),
    ("query_time_sec", _D), ("lock_time_sec", _D), ("rows_examined", _L), ("rows_sent", _L), ("source", _S),
    ("occurrence_count", _L), ("diagnosis_report", _S), ("severity", _S), ("captured_at", _TS),
])

#: One row per diagnosis task.
DIAGNOSIS = _struct([
    ("task_id", _S), ("session_id", _S), ("instance_id", _S), ("project_code", _S), ("original_sql", _S),
    ("clean_sql", _S), ("table_names", _S), ("report", _S), ("status", _S), ("error_message", _S),
    ("duration_ms", _L), ("tool_call_count", _I), ("source", _S), ("fingerprint", _S),
    ("created_at", _TS), ("updated_at", _TS),
])

#: JSON body of an HTTP statement report.
HTTP_BODY = "sql string, durationMs double, rowsExamined bigint, instanceId string, database string"

#: JSON body of the second HTTP layout, with an application context.
HTTP_BODY_V2 = (
    "sqlText string, queryTimeSec double, lockTimeSec double, rowsExamined bigint, rowsSent bigint, "
    "traceId string, applicationName string"
)

#: JSON body of a finished task.
RESULT_BODY = (
    "taskId string, status string, report string, error string, durationMs bigint, toolCallCount int, "
    "fingerprint string, instanceId string, projectCode string, source string"
)

#: JSON body of a task waiting for diagnosis.
TASK_BODY = (
    "taskId string, sessionId string, instanceId string, projectCode string, enrichedPrompt string, "
    "fingerprint string, source string, timestamp string"
)
