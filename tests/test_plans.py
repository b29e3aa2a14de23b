"""Shapes of the plans that matter at scale."""

import json
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from __spark_entry__ import entry
from tidewatch.catalog.registry import QUERIES
from tidewatch.operators import cooldown, search, tasks
from tidewatch.plans import explain_tree
from tidewatch.plans.explain_tree import plan_key, plan_tables

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON = {
    "plan_tables", "plan_key", "join_rules_with_plan", "compare_plans", "cooldown_dedup", "alert_dedup", "quota_flag", "referenced_tables",
    "index_coverage", "type_mismatch", "join_knowledge", "knowledge_rows", "build_manual_context",
}
EAGER = {n for n in QUERIES if n.startswith(("stream_", "sink_"))} | {"src_slow_log", "win_sticky_db"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_python_only_where_meant_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    has_python = any(node in plan for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"))
    assert has_python == (name in PYTHON)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = str(tmp_path / "captured")
    spark.sql("select 1 event_id, 'p' project_code, 'i' instance_id, 'x' sql_text, 'P1' severity, 1.0D query_time_sec, 'wide' ballast, "
              "timestamp_ntz'2024-01-01 00:00:00' captured_at").write.parquet(path)
    found = search.search_captured(spark.read.parquet(path), project="p", severity="P1", start="2023-01-01 00:00:00", min_sec=0.5)
    plan = plan_of(found.select("event_id"))
    for pushed in ("EqualTo(project_code,p)", "EqualTo(severity,P1)", "GreaterThanOrEqual(query_time_sec,0.5)", "GreaterThanOrEqual(captured_at"):
        assert pushed in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "ballast" not in plan and "TakeOrderedAndProject" in plan


def test_seek_pages_are_the_pages_and_skip_what_is_older(spark, tmp_path):
    path = str(tmp_path / "captured")
    spark.sql("""select id event_id, 'x' sql_text, case when id % 50 <> 7 then timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id / 3 as int), 0) end
                 captured_at from range(600)""").sortWithinPartitions("captured_at").write.parquet(path)
    rows = spark.read.parquet(path)
    want = [r["event_id"] for r in rows.orderBy(F.desc_nulls_last("captured_at"), F.desc("event_id")).collect()]
    got, after = [], None
    while True:
        page = search.search_captured(rows, size=70, after=after) if after else search.page_after(rows, ts="captured_at", tie="event_id", size=70)
        found = page.collect()
        got += [r["event_id"] for r in found]
        if len(found) < 70:
            break
        after = (found[-1]["captured_at"], found[-1]["event_id"])
    assert got == want
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = plan_of(search.page_after(rows, ts="captured_at", tie="event_id", after=("2024-01-01 03:00:00", 500), size=20))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(captured_at,2024-01-01T02:00" in plan and "LessThanOrEqual(captured_at,2024-01-01T03:00" in plan and "TakeOrdered" in plan


def test_round_cap_limits_before_the_shuffle(spark):
    events = spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("instance_id"), (F.col("id") % 2).alias("round"), F.col("id").alias("captured_at"))
    plan = plan_of(tasks.round_cap(events)[0])
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and "Exchange" in plan[:plan.rindex("WindowGroupLimit")]


def test_plan_documents(spark):
    node = {"table_name": "a", "access_type": "ALL", "key": None, "rows_examined_per_scan": "200", "filtered": "10.5", "Extra": "Using filesort"}
    deep = {"query_block": {"table": node}}
    for _ in range(60):
        deep = {"query_block": {"ordering_operation": {"grouping_operation": [deep]}}}
    docs = [(1, '{"query_block":{}}'), (2, "not json"), (3, json.dumps(deep)), (4, None), (5, '{"query_block":{"table":{"table_name":"b"}}}')]
    df = spark.createDataFrame(docs, "plan_id bigint, plan string")
    rows = {r["plan_id"]: r for r in plan_tables(df).collect()}
    assert set(rows) == {3, 5}
    assert (rows[3]["rows"], rows[3]["filtered"], rows[3]["key_is_null"], rows[5]["key_is_null"]) == (200, 10.5, True, False)
    assert {r["plan_id"]: r["plan_key"] for r in plan_key(df).collect()} == {1: None, 2: None, 3: "ALL||Using filesort", 4: None, 5: "||"}


def test_plan_fields_of_other_types_are_null(spark):
    odd = {"table_name": "a", "access_type": ["x"], "key": 5, "Extra": ["x"], "rows_examined_per_scan": 1e30, "filtered": "nan"}
    docs = [(1, json.dumps({"query_block": {"table": odd}})), (2, json.dumps({"table_name": "b", "rows_examined_per_scan": "12.0", "filtered": 10**400, "key": True})),
            (3, json.dumps({"table_name": 7})), (4, "[" * 100_000)]
    got = {r["plan_id"]: tuple(r)[3:] for r in plan_tables(spark.createDataFrame(docs, "plan_id bigint, plan string")).collect()}
    assert got == {1: ("a", None, None, False, None, None, None), 2: ("b", None, None, False, 12, None, None)}


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("function", [cooldown._walk(1000), explain_tree.table_accesses])
def test_task_functions_travel_without_the_package(function):
    load = "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"
    subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(function), cwd="/", check=True, timeout=60)
