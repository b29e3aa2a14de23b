"""Streaming jobs over several micro-batches give what the batch operators give."""

import random
from datetime import datetime, timedelta

import pytest

from tidewatch.operators import cooldown, folds
from tidewatch.sources import readers, sinks
from tidewatch.streaming import jobs

SCHEMA = ("event_id bigint, fingerprint string, sql_text string, database_name string, instance_id string, project_code string, query_time_sec double, "
          "lock_time_sec double, rows_examined bigint, rows_sent bigint, source string, diagnosis_report string, severity string, captured_at timestamp_ntz")


def events(n=600):
    rng = random.Random(9)
    times = sorted(datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(3 * 86_400)) for _ in range(n))
    return [(i, rng.choice("aaab"), f"SELECT {i} FROM t", "d", "i", "p", rng.random() * 20, 0.1, 5, 1, "s", None, "P2", t) for i, t in enumerate(times)]


@pytest.fixture()
def batches(spark, tmp_path):
    """Feed the events in three parts, running the job after each."""
    rows = events()

    def run(start):
        folder = str(tmp_path / "in")
        for part in range(3):
            spark.createDataFrame(rows[part * 200:(part + 1) * 200], SCHEMA).write.mode("append").parquet(folder)
            start(spark.readStream.schema(SCHEMA).parquet(folder)).awaitTermination()

    return spark.createDataFrame(rows, SCHEMA), run, tmp_path


def test_cooldown(spark, batches):
    whole, run, tmp = batches
    run(lambda s: jobs.stream_cooldown(s, out=f"{tmp}/out", state=f"{tmp}/state", checkpoint=f"{tmp}/cp"))
    got = {r["event_id"] for r in spark.read.parquet(f"{tmp}/out").collect()}
    assert got == {r["event_id"] for r in cooldown.cooldown_dedup(whole).collect()}


def test_upsert(spark, batches):
    whole, run, tmp = batches
    run(lambda s: jobs.stream_upsert(s, path=f"{tmp}/snap", checkpoint=f"{tmp}/cp"))
    jobs.compact_captured(spark, f"{tmp}/snap", version=0)
    jobs.compact_captured(spark, f"{tmp}/snap", version=1, compacted=0)
    wanted = folds.agg_upsert_captured(None, whole).collect()
    for compacted in (None, 0, 1):
        got = {r["fingerprint"]: r for r in jobs.read_captured(spark, f"{tmp}/snap", compacted=compacted).collect()}
        for want in wanted:
            r = got[want["fingerprint"]]
            assert (r["occurrence_count"], r["sql_text"]) == (want["occurrence_count"], want["sql_text"])
            assert r["query_time_sec"] == pytest.approx(want["query_time_sec"], rel=1e-12)


def test_repeated_batch_changes_nothing(spark, batches):
    whole, _, tmp = batches
    first = jobs.cooldown_batch(whole, 0, state=f"{tmp}/s", keys=["fingerprint"], ts="captured_at", tie="event_id", period="30 minutes").count()
    again = jobs.cooldown_batch(whole, 0, state=f"{tmp}/s", keys=["fingerprint"], ts="captured_at", tie="event_id", period="30 minutes").count()
    assert first == again
    # all rows once more: none is accepted twice
    assert jobs.cooldown_batch(whole, 1, state=f"{tmp}/s", keys=["fingerprint"], ts="captured_at", tie="event_id", period="30 minutes").count() == 0


HISTORY = ("event_id bigint, instance_id string, sql_text string, digest_text string, timer_wait bigint, timer_start bigint, "
           "rows_examined bigint, rows_sent bigint, current_schema string, captured_at timestamp_ntz")


def history(spark, starts):
    rows = [(i, "i", f"SELECT {i}", "d", 10**12, start, 1, 1, "db", datetime(2024, 1, 1)) for i, start in starts]
    return spark.createDataFrame(rows, HISTORY)


@pytest.mark.parametrize("starts", [[(i, i + 1) for i in range(25)], [(i, 7 if i < 12 else 9) for i in range(25)]])
def test_history_cap_defers_and_never_loses(spark, starts):
    anchors, seen = spark.createDataFrame([("i", 0, 0)], readers.ANCHOR), []
    for _ in range(4):
        taken, anchors = readers.src_statement_history(history(spark, starts), anchors, cap=10)
        seen.append(sorted(r["event_id"] for r in taken.collect()))
        anchors = spark.createDataFrame(anchors.collect(), readers.ANCHOR)
    assert seen == [list(range(10)), list(range(10, 20)), list(range(20, 25)), []]


def test_history_may_start_at_the_present(spark):
    none = spark.createDataFrame([], readers.ANCHOR)
    taken, anchors = readers.src_statement_history(history(spark, [(1, 5), (2, 8)]), none, start="latest")
    assert taken.count() == 0 and [tuple(r) for r in anchors.collect()] == [("i", 8, 2)]
    anchors = spark.createDataFrame(anchors.collect(), readers.ANCHOR)
    taken, _ = readers.src_statement_history(history(spark, [(1, 5), (2, 8), (3, 8)]), anchors, start="latest")
    assert [r["event_id"] for r in taken.collect()] == [3]


def test_history_stream_takes_split_snapshots_and_early_starters(spark, tmp_path):
    folder = f"{tmp_path}/in"

    def run(starts):
        history(spark, starts).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.stream_history_anchor(source, out=f"{tmp_path}/out", seen=f"{tmp_path}/seen", checkpoint=f"{tmp_path}/cp").awaitTermination()

    run([(5, 50), (6, 60), (7, 70), (8, 80)])
    run([(1, 10), (2, 20), (8, 80)])  # started before what is known, ended after it
    run([(3, 30), (1, 10), (5, 50)])
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 5, 6, 7, 8]


def test_history_ids_expire_and_rows_come_once(spark, tmp_path):
    """A server shows its last 30 rows; one row is shown for ever, one is shown again after it was forgotten, one comes late."""
    folder, start, state = f"{tmp_path}/in", datetime(2024, 1, 1), []

    def row(i):
        return (i, "i", f"SELECT {i}", "d", 10**12, i + 1, 1, 1, "db", start + timedelta(minutes=i))

    for poll in range(8):
        shown = [0, *range(max(1, poll * 20 - 10), poll * 20 + 20)]
        shown += [5] if poll == 6 else [-3] if poll == 7 else []
        spark.createDataFrame([row(i) for i in shown], HISTORY).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.stream_history_anchor(source, out=f"{tmp_path}/out", seen=f"{tmp_path}/seen", checkpoint=f"{tmp_path}/cp", keep="30 minutes", polls=2).awaitTermination()
        state.append(sinks.read_version(spark, f"{tmp_path}/seen", poll).count())
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted([-3, *range(160)])
    assert max(state) <= 30 + 20 * 2 + 3


def test_cooldown_state_expires_and_the_stream_equals_one_batch(spark, tmp_path):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    schema = "event_id bigint, fingerprint string, captured_at timestamp_ntz"
    rows = [(i, f"k{rng.randrange(i // 8, i // 8 + 12)}", start + timedelta(minutes=i + rng.randrange(25))) for i in range(600)]
    sizes = []
    for batch in range(12):  # `cooldown_batch` as a restarted job calls it: only what is written carries over
        part = spark.createDataFrame(rows[batch * 50:(batch + 1) * 50], schema)
        jobs.cooldown_batch(part, batch, state=str(tmp_path), keys=["fingerprint"], ts="captured_at", tie="event_id", period="30 minutes", delay="10 minutes")
        sizes.append(sinks.read_version(spark, f"{tmp_path}/last", batch).count())
    assert max(sizes) <= 40 < len({r[1] for r in rows})
    whole = {r["event_id"] for r in cooldown.cooldown_dedup(spark.createDataFrame(rows, schema)).collect()}
    assert {r["event_id"] for r in jobs.settle_late(spark, str(tmp_path)).collect()} == whole


def test_rows_behind_a_fast_clock_find_what_was_accepted(spark, tmp_path):
    schema = "event_id bigint, fingerprint string, captured_at timestamp_ntz"
    args = dict(state=str(tmp_path), keys=["fingerprint"], ts="captured_at", tie="event_id", period="30 minutes")
    day = datetime(2024, 1, 1)
    jobs.cooldown_batch(spark.createDataFrame([(1, "a", day)], schema), 0, **args)
    jobs.cooldown_batch(spark.createDataFrame([(2, "fast", day + timedelta(days=1))], schema), 1, **args)
    assert [r["_part"] for r in sinks.read_version(spark, f"{tmp_path}/last", 1).collect()] == ['{"fingerprint":"fast"}']
    rows = [(3, "a", day + timedelta(minutes=29)), (4, "b", day), (5, "a", day + timedelta(minutes=31)), (6, "a", day - timedelta(minutes=1))]
    got = jobs.cooldown_batch(spark.createDataFrame(rows, schema), 2, **args)
    assert sorted(r["event_id"] for r in got.collect()) == [4, 5]
    assert [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [6]


def test_capture_uses_the_report_of_the_time(spark, tmp_path):
    at = datetime(2024, 1, 1)
    schema = SCHEMA.replace(", severity string", "")
    rows = [(i, None, "SELECT a FROM orders WHERE a = 1", "d", "i", "p", 3.0, 0.0, 5, 1, "s", None, at + timedelta(minutes=m)) for i, m in enumerate([0, 10, 40, 50, 24 * 60 * 8])]
    events = spark.createDataFrame(rows, schema).drop("fingerprint")
    mark = jobs.graded_events(events).first()["fingerprint"]
    keys = spark.createDataFrame([(mark, "k")], "fingerprint string, plan_key string")
    reports = spark.createDataFrame([(mark, "k", "old", at + timedelta(minutes=5)), (mark, "k", "new", at + timedelta(minutes=45))],
                                    "fingerprint string, plan_key string, report string, created_at timestamp_ntz")
    events.write.parquet(f"{tmp_path}/in")
    jobs.stream_capture(
        spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), spark.createDataFrame([("i", "p")], "instance_id string, project_code string"),
        out=f"{tmp_path}/out", state=f"{tmp_path}/state", snapshot=f"{tmp_path}/snap", checkpoint=f"{tmp_path}/cp", plan_keys=keys, reports=lambda: reports,
    ).awaitTermination()
    # the first event has no report yet, the third one has; the last one's is out of date
    assert sorted(str(r["created_at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["2024-01-01 00:00:00", "2024-01-09 00:00:00"]
    assert [r["diagnosis_report"] for r in jobs.read_captured(spark, f"{tmp_path}/snap").collect()] == ["new"]
    alerts = spark.read.parquet(f"{tmp_path}/out-alerts").collect()
    assert [(r["event_id"], "已有诊断(缓存):\nold" in r["alert"]) for r in alerts] == [(1, True)]


def test_http_capture_rejects_with_a_reason(spark, tmp_path):
    import json

    bodies = [{"sql": "SELECT a FROM t", "instanceId": "on", "durationMs": 11_000, "received_at": "2024-01-01T00:00:00"},
              {"sql": "SELECT a FROM t", "instanceId": "on", "durationMs": 1, "received_at": "2024-01-01T00:10:00"},
              {"sql": "SELECT b FROM t", "instanceId": "off", "received_at": "2024-01-01T00:00:00"}, {"sql": "SELECT c FROM t"}, {"sql": ""}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps(b) + "\n" for b in bodies))
    jobs.stream_http_capture(
        spark, folder=f"{tmp_path}/in", instances=spark.createDataFrame([("on", "p")], "instance_id string, project_code string"), out=f"{tmp_path}/out",
        state=f"{tmp_path}/state", snapshot=f"{tmp_path}/snap", checkpoint=f"{tmp_path}/cp",
        enabled=lambda: spark.createDataFrame([("on", "http_endpoint")], "instance_id string, source string"),
    ).awaitTermination()
    assert sorted((r["instance_id"], r["project_code"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("", ""), ("on", "p")]
    assert sorted(r["reject_reason"] for r in spark.read.parquet(f"{tmp_path}/out-rejects").collect()) == ["source not enabled", "sql is required"]
    assert sorted(r["occurrence_count"] for r in jobs.read_captured(spark, f"{tmp_path}/snap").collect()) == [1, 2]
    assert spark.read.parquet(f"{tmp_path}/out-alerts").count() == 1


def test_late_rows_and_fast_clocks_settle_as_in_one_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(600))) for i in range(300)]
    rows[20] = (20, "a", datetime(2024, 1, 2, 12))  # a clock a day ahead
    rows[30] = (30, "b", None)
    schema = "event_id bigint, fingerprint string, captured_at timestamp_ntz"
    args = dict(keys=["fingerprint"], ts="captured_at", tie="event_id", period="30 minutes")
    for batch in range(3):
        part = spark.createDataFrame(rows[batch * 100:(batch + 1) * 100], schema)
        jobs.cooldown_batch(part, batch, state=str(tmp_path), **args)
    accepted = {r["event_id"] for r in jobs.settle_late(spark, str(tmp_path)).collect()}
    assert accepted == {r["event_id"] for r in cooldown.cooldown_dedup(spark.createDataFrame(rows, schema)).collect()}


def test_a_fast_clock_leaves_other_keys_alone(spark, tmp_path):
    schema = "event_id bigint, fingerprint string, captured_at timestamp_ntz"
    args = dict(state=str(tmp_path), keys=["fingerprint"], ts="captured_at", tie="event_id", period="30 minutes")
    jobs.cooldown_batch(spark.createDataFrame([(0, "fast", datetime(2024, 1, 2))], schema), 0, **args)
    rows = [(i, f"k{i}", datetime(2024, 1, 1)) for i in range(1, 11)]
    assert jobs.cooldown_batch(spark.createDataFrame(rows, schema), 1, **args).count() == 10


def test_slow_log_statement_lines_times_and_rejects(spark, tmp_path):
    report = "# User@Host: a[a] @ h\n# Query_time: 1.5  Lock_time: 0.0 Rows_sent: 1  Rows_examined: 2\n"
    text = ("mysqld, Version: 8\n"
            f"# Time: 2024-01-10T10:00:00.123456+08:00\n{report}use `shop`;\nSET timestamp=1;\nSELECT a FROM t\nUSE INDEX (idx_a)\nWHERE b=1;\n"
            f"# Time: 2024-01-10T10:00:01Z\n{report}SET timestamp=2;\nSELECT 2;\n"
            f"# Time: 240110 10:00:02\n{report}SELECT 3;\n# Time: 2024-01-10T10:00:03Z\n{report}SET timestamp=4;\n")
    (tmp_path / "slow.log").write_text(text)
    events, rejects = readers.src_slow_log(spark, str(tmp_path), instance_id="i")
    got = [(str(r["captured_at"]), r["database_name"], r["sql_text"]) for r in events.selectExpr("cast(captured_at as string) captured_at", "database_name", "sql_text").orderBy("captured_at").collect()]
    assert got == [("2024-01-10 02:00:00.123456", "shop", "SELECT a FROM t\nUSE INDEX (idx_a)\nWHERE b=1;"), ("2024-01-10 10:00:01", "shop", "SELECT 2;")]
    assert sorted(r["reject_reason"] for r in rejects.collect()) == ["no readable time", "no statement"]


def test_http_stream_keeps_long_statements_and_rejects(spark, tmp_path):
    import json

    bodies = [{"sql": "SELECT " + "x" * 200_000, "event_id": 1}, {"sql": " ", "event_id": 2}, {"event_id": 3}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps(b) + "\n" for b in bodies))
    jobs.stream_http(spark, folder=f"{tmp_path}/in", out=f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp").awaitTermination()
    assert [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out-rejects").collect()) == [2, 3]


def test_requests_without_a_time_pass_the_quota(spark):
    rows = spark.createDataFrame([(i, "c", None) for i in range(5)], "event_id bigint, client string, ts timestamp_ntz")
    assert cooldown.quota_flag(rows, key="client", ts="ts", tie="event_id", limit=3).filter("refused").count() == 0
