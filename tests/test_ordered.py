"""Chunked order-dependent operators against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cooldown, folds, ordered, tasks
from tidewatch.session import settled

START = datetime(2024, 1, 1)


def naive_cooldown(rows, period):
    accepted, last = set(), {}
    for event_id, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or at - last[key] >= period:
            accepted.add(event_id)
            last[key] = at
    return accepted


def random_events(seed, n, span_minutes, keys):
    rng = random.Random(seed)
    # the first key is hot: it holds about a third of all rows
    return [
        (i, keys[0] if rng.random() < 1 / 3 else rng.choice(keys), START + timedelta(seconds=rng.randrange(span_minutes * 60)))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed, n, span, period", [
    (1, 3000, 60 * 24 * 3, "30 minutes"), (2, 3000, 60 * 24 * 40, "30 minutes"), (3, 2000, 20, "30 minutes"), (4, 4000, 60 * 48, "1 minute"),
    (5, 500, 60 * 24 * 365, "24 hours"),
])
@pytest.mark.parametrize("task_rows", [0, 400, 100_000])
def test_cooldown_equals_sequential(spark, seed, n, span, period, task_rows):
    rows = random_events(seed, n, span, [None, "a", "b", "c"])
    df = spark.createDataFrame(rows, "event_id bigint, fingerprint string, captured_at timestamp_ntz").repartition(5)
    got = {r["event_id"] for r in cooldown.cooldown_dedup(df, period=period, task_rows=task_rows).collect()}
    assert got == naive_cooldown(rows, timedelta(microseconds=cooldown.period_micros(period)))


def test_long_chains_with_gaps_bursts_and_exact_periods(spark):
    rng, minute = random.Random(17), timedelta(minutes=1)
    times = {
        "steady": [START + i * minute / 2 for i in range(300)], "exact": [START + i * minute for i in range(50)],
        "gap": [START, START + 1000 * minute, START + 1000 * minute + minute / 3, START + 1001 * minute + minute / 3],
        "burst": [START + timedelta(microseconds=rng.randrange(10**6)) for _ in range(200)] + [START + 40 * minute], "one": [START],
        "late": [START + 63 * minute + timedelta(seconds=rng.randrange(3000)) for _ in range(90)],
    }
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, ts in times.items() for t in ts)]
    df = spark.createDataFrame(rows, "event_id bigint, fingerprint string, captured_at timestamp_ntz")
    for period in ("1 minute", "7 seconds"):
        got = {r["event_id"] for r in cooldown.cooldown_dedup(df, period=period, task_rows=0).collect()}
        assert got == naive_cooldown(rows, timedelta(microseconds=cooldown.period_micros(period)))


def test_no_task_holds_a_large_key(spark, monkeypatch):
    """One key with an event a second over two days: chunks of ten seconds, and tables that halve from round to round."""
    df = spark.sql("select id event_id, 'k' fingerprint, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) captured_at from range(20000)")
    written = []

    def spy(rows, purpose):
        out = settled(rows, purpose)
        written.append((purpose, out.count()))
        return out

    monkeypatch.setattr(cooldown, "settled", spy)
    assert cooldown.cooldown_dedup(df, period="30 minutes", task_rows=1000).count() == 12
    tables = [n for purpose, n in written if purpose == "chain-spans"]
    assert tables[0] == 20_000 and all(later <= earlier * 2 / 3 + 2 for earlier, later in zip(tables, tables[1:])) and len(tables) == 5


def test_cooldown_walks_over_batch_borders(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = random_events(11, 800, 60 * 24 * 5, ["x", "y"])
        df = spark.createDataFrame(rows, "event_id bigint, fingerprint string, captured_at timestamp_ntz")
        got = {r["event_id"] for r in cooldown.cooldown_dedup(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == naive_cooldown(rows, timedelta(minutes=30))


def test_quota(spark):
    rows = random_events(21, 1500, 600, ["a", "b", None])
    df = spark.createDataFrame(rows, "event_id bigint, client string, ts timestamp_ntz")
    want, opened, used = {}, {}, {}
    for event_id, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in opened or at - opened[key] >= timedelta(minutes=5):
            opened[key], used[key] = at, 0
        used[key] += 1
        want[event_id] = used[key] > 4
    flagged = cooldown.quota_flag(df, key="client", ts="ts", tie="event_id", limit=4, period="5 minutes")
    assert {r["event_id"]: r["refused"] for r in flagged.collect()} == want
    assert not cooldown.quota_flag(df, key="client", ts="ts", tie="event_id", limit=0).filter("refused").count()


def test_running_total_carry_and_neighbours(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", None, "b", "a", "a"]), rng.choice([None, *[rng.randrange(10**6)] * 9]), rng.choice([None, 1, 2, 3])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, k string, at bigint, v bigint")
    args = dict(keys=["k"], order=["at", "id"], chunk=ordered.number_chunk("at", 50_000))
    out = ordered.running_total(df, value=F.col("v"), out="total", **args)
    out = ordered.position(out, out="pos", **args)
    out = ordered.carry(out, value=F.col("v"), out="latest", **args)
    out = ordered.previous(out, columns=["id", "v"], out="before", **args)
    out = ordered.following(out, columns=["id", "v"], out="after", **args)
    got = {r["id"]: (r["total"], r["pos"], r["latest"], r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in out.collect()}
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2], r[0]))
        total, latest = 0, None
        for n, (i, _, _, v) in enumerate(mine):
            total += v or 0
            latest = v if v is not None else latest
            before = (mine[n - 1][0], mine[n - 1][3]) if n else None
            after = (mine[n + 1][0], mine[n + 1][3]) if n + 1 < len(mine) else None
            assert got[i] == (total, n + 1, latest, before, after)


EVENT = ("event_id bigint, fingerprint string, sql_text string, database_name string, instance_id string, project_code string, query_time_sec double, "
         "lock_time_sec double, rows_examined bigint, rows_sent bigint, source string, diagnosis_report string, severity string, captured_at timestamp_ntz, duplicate boolean")


def fold_rows(seed, n):
    rng = random.Random(seed)
    return [
        (i, rng.choice("aaabc"), f"s{i}", None, "i", "p", rng.random() * 9, rng.random(), rng.randrange(1000), i, "src",
         rng.choice([None, f"r{i}"]), rng.choice(["P0", "P1", "P2"]), START + timedelta(minutes=rng.randrange(60 * 24 * 20)), rng.random() < 0.3)
        for i in range(n)
    ]


def sequential_fold(rows, mode):
    state = {}
    for r in sorted(rows, key=lambda r: (r[13], r[0])):
        if r[14] and mode == "skip":
            continue
        s = state.get(r[1])
        if s is None:
            if r[14] and mode == "count":
                continue
            state[r[1]] = dict(text=r[2], q=r[6], l=r[7], rows=r[8], n=1, report=r[11], sev=r[12])
        elif r[14] and mode == "count":
            s["n"] += 1
        else:
            s.update(q=(s["q"] + r[6]) / 2, l=(s["l"] + r[7]) / 2, rows=max(s["rows"], r[8]), n=s["n"] + 1, report=r[11] or s["report"], sev=r[12])
    return state


@pytest.mark.parametrize("mode", ["fold", "skip", "count"])
def test_upsert_equals_sequential_fold(spark, mode):
    rows = fold_rows(3, 900)
    for first in {r[1]: r for r in sorted(rows, key=lambda r: (r[13], r[0]), reverse=True)}.values():
        rows[first[0]] = first[:14] + (False,)  # a key's first event is never a duplicate
    cut = START + timedelta(days=9)
    early = folds.agg_upsert_captured(None, spark.createDataFrame([r for r in rows if r[13] < cut], EVENT), on_duplicate=mode)
    got = folds.agg_upsert_captured(early, spark.createDataFrame([r for r in rows if r[13] >= cut], EVENT), on_duplicate=mode)
    want = sequential_fold(rows, mode)
    found = {r["fingerprint"]: r for r in got.collect()}
    assert found.keys() == want.keys()
    for key, w in want.items():
        r = found[key]
        assert (r["sql_text"], r["rows_examined"], r["occurrence_count"], r["diagnosis_report"], r["severity"]) == (w["text"], w["rows"], w["n"], w["report"], w["sev"])
        assert r["query_time_sec"] == pytest.approx(w["q"], rel=1e-12) and r["lock_time_sec"] == pytest.approx(w["l"], rel=1e-12)


@pytest.mark.parametrize("chunk_rows", [1, 40, 10**6])
def test_balanced_chunks_fold_alike(spark, chunk_rows):
    rows = [r[:13] + (START + timedelta(seconds=r[0] % 3000, microseconds=r[0]),) + (False,) for r in fold_rows(4, 900)]
    events = spark.createDataFrame(rows, EVENT)
    partials = folds.capture_partials(events, chunk_rows=chunk_rows)
    found, want = {r["fingerprint"]: r for r in folds.merge_partials(partials).collect()}, sequential_fold(rows, "fold")
    for key, w in want.items():
        assert found[key]["occurrence_count"] == w["n"] and found[key]["query_time_sec"] == pytest.approx(w["q"], rel=1e-12)


def test_a_burst_within_an_hour_is_many_chunks(spark):
    rows = spark.sql("""select id, if(id % 5 = 0, 'rare' || id, 'hot') k, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id / 10) at from range(20000)
                        union all select -1, 'hot', null""")
    chunks = ordered.with_balanced_chunks(rows, keys=["k"], ts="at", target=500, out="chunk").groupBy("k", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy("chunk").collect()
    hot = [r for r in chunks if r["k"] == "hot"]
    assert len(hot) >= 30 and max(r["n"] for r in hot) <= 500 + 80 and sum(r["n"] for r in chunks) == 20_001
    assert all(a["high"] < b["low"] for a, b in zip(hot, hot[1:])) and {r["chunk"] for r in chunks if r["k"] != "hot"} == {0}
    plan = ordered.with_balanced_chunks(rows, keys=["k"], ts="at", target=500, out="chunk")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 1


TRACE = "task_id string, step bigint, tool string, args string, total_tokens bigint"


def test_repeat_guard(spark):
    calls = [("t", i, "x", a) for i, a in enumerate("abbab")] + [("u", 1, "x", "a"), ("u", 9000, "x", "a"), ("u", 20000, "x", "a"), ("u", 20001, "x", "a")] + [
        ("v", i, "x", "a") for i in range(3)]
    df = spark.createDataFrame([c + (1,) for c in calls], TRACE)
    assert {(r["task_id"], r["step"]) for r in tasks.repeat_guard(df).collect()} == {("u", 20000), ("v", 2)}


def test_budget_guard_is_strict(spark):
    df = spark.createDataFrame([("at", 1, "x", "", 60), ("at", 9999, "x", "", 40), ("over", 1, "x", "", 60), ("over", 9999, "x", "", 41), ("over", 9, "x", "", None)], TRACE)
    assert [tuple(r) for r in tasks.budget_guard(df, budget=100).collect()] == [("over", 9999, 101)]
