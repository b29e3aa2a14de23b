"""Structured Streaming jobs.

Every job works per micro-batch with the batch operators and keeps its small state, which expires, as one parquet version per batch: batch n
reads version n-1 and writes version n. A batch that is run again after a failure overwrites exactly what it wrote before.
The batch operators spread hot keys over many tasks, which a per-key stateful function could not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import constants as K
from tidewatch.functions.text import fingerprint, is_noise, micros, severity
from tidewatch.operators.cooldown import cooldown_dedup, key_text, period_micros
from tidewatch.operators.filters import flt_enabled_source, flt_http_valid
from tidewatch.operators.folds import capture_partials, compact_partials, merge_partials
from tidewatch.operators.rules import alert_text, build_context
from tidewatch.operators.tasks import join_project, join_report_cache, new_tasks
from tidewatch.sources import readers, sinks
from tidewatch.sources.tail import tail_blocks


CHUNK_ROWS = 200_000


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_slow_log(spark: SparkSession, *, folder: str, out: str, checkpoint: str, instance_id: str,
                    since: Column | None = None, start="earliest", quiet_seconds: float = 30, split_bytes: int = 64 << 20, **limits) -> StreamingQuery:
    """Events of the blocks appended to the logs below `folder`, each once; with `since`, only those after it.

    Logs are followed while they grow, are renamed or truncated (see `sources.tail`). The schema chosen by a `use` line is carried over
    micro-batches, one row per log, in `out`-schemas. Rejected blocks go to `out`-rejects.
    """
    blocks = tail_blocks(spark, folder, start=start, quiet_seconds=quiet_seconds, split_bytes=split_bytes)

    def work(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once for events, rejects and the schema in force
        known = sinks.read_version(spark, f"{out}-schemas", batch_id - 1) if batch_id else None
        events, rejects = readers.slow_log_events(batch, instance_id=instance_id, known=known, **limits)
        sinks.write_version(rejects, f"{out}-rejects", batch_id)
        if since is not None:
            events = events.filter(F.col("captured_at") > since)
        sinks.write_version(events, out, batch_id)
        chosen = readers.last_used_db(readers.slow_log_blocks(batch))
        if known is not None:
            chosen = chosen.unionByName(known.select("file_id", "used_db").join(chosen, "file_id", "left_anti"))
        sinks.write_version(chosen, f"{out}-schemas", batch_id)
        batch.unpersist()

    return _start(blocks, work, checkpoint)


def stream_http(spark: SparkSession, *, folder: str, out: str, checkpoint: str, max_len: int | None = None,
                enabled: DataFrame | None = None) -> StreamingQuery:
    """JSON reports, one per line, checked and parsed without state. Rejected ones go to `out`-rejects with their reason.

    With `enabled` (instance_id, source) only events of enabled sources are kept.
    """
    body = spark.readStream.text(folder).select(
        F.col("value").alias("body"), F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id")
    )

    def work(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = flt_http_valid(readers.src_http_events(batch), max_len=max_len)
        sinks.write_version(valid if enabled is None else flt_enabled_source(valid, enabled), out, batch_id)
        sinks.write_version(rejected, f"{out}-rejects", batch_id)

    return _start(body, work, checkpoint)


def stream_history_anchor(snapshots: DataFrame, *, out: str, seen: str, checkpoint: str, min_sec=0.5, keep="1 day", polls=16) -> StreamingQuery:
    """New rows of repeated statement-history snapshots, each (instance, event id) once.

    What was taken is kept by id, not by a moving start time: a snapshot may come in several files and batches, and a long statement
    that started before others but ended after them is still new. An id is forgotten when it is `keep` older than the newest row of its instance
    and no snapshot of the last `polls` batches held it, so the state (one version per batch below `seen`) is bounded by what
    servers still show. A row that is so old and not remembered is compared with the output of its time, so none is lost or taken twice.
    """
    spark, step = snapshots.sparkSession, period_micros(keep)
    ids = ["instance_id", "event_id"]

    def work(batch: DataFrame, batch_id: int) -> None:
        rows = readers.history_filter(batch, min_sec=min_sec).dropDuplicates(ids)
        rows = rows.withColumn("_at", F.coalesce(micros(F.col("captured_at")), F.lit(0))).persist()
        taken = rows
        known = sinks.read_version(spark, seen, batch_id - 1) if batch_id else spark.createDataFrame([], _SEEN)
        if batch_id:
            clock = known.groupBy("instance_id").agg((F.max("at") - step).alias("_old"))
            new = rows.join(known.select(*ids), ids, "left_anti").join(clock, "instance_id", "left")
            old = F.col("_at") < F.col("_old")
            span = new.where(old).agg(F.min("captured_at").alias("low"), F.max("captured_at").alias("high"), F.count(F.lit(1)).alias("n")).first()
            taken = new.drop("_old")
            if span["n"]:
                written = spark.read.parquet(out).where(
                    (F.col("version") < batch_id) & (F.col("captured_at").between(span["low"], span["high"]) | F.col("captured_at").isNull()))
                taken = taken.join(written.select(*ids), ids, "left_anti")
        sinks.write_version(readers.history_events(taken), out, batch_id)
        shown = rows.select(*ids, F.col("_at").alias("at"), F.lit(batch_id).cast("bigint").alias("batch"))
        both = known.unionByName(shown).groupBy(*ids).agg(F.max("at").alias("at"), F.max("batch").alias("batch"))
        newest = both.groupBy("instance_id").agg(F.max("at").alias("_newest"))
        kept = both.join(newest, "instance_id").where((F.col("at") >= F.col("_newest") - step) | (F.col("batch") > batch_id - polls)).drop("_newest")
        sinks.write_version(kept, seen, batch_id)
        rows.unpersist()

    return _start(snapshots, work, checkpoint)


_SEEN = "instance_id string, event_id bigint, at bigint, batch bigint"


def cooldown_batch(batch: DataFrame, batch_id: int, *, state: str, keys, ts: str, tie: str, period: str, delay="1 hour",
                   keep_events: bool = True) -> DataFrame:
    """Accepted events of one micro-batch, read back from where they were written.

    The state holds the last accepted time of a key until its period has ended `delay` before the newest accepted event; then it
    expires, as later rows of that key are free. So its size is bounded by the keys of one period and delay, not by history. Rows older than
    that whose key has no state find the last accepted time in what was accepted around them; only then is anything but the state read, and
    one source with a fast clock costs the others a look-up, no event.

    Rows within the period after their key's last accepted event are suppressed. Rows before it, and rows without a time, come too late to
    be judged on the fly: they are kept in `state`/late, as all rows are in `state`/events (unless `keep_events` is off), and
    `settle_late` judges the keys they belong to anew, so that stream and batch agree.

    A function with state per key (`transformWithState`) would take all rows of a hot key into one task; here a micro-batch is judged by
    `cooldown_dedup`, which does not.
    """
    spark, step = batch.sparkSession, period_micros(period)
    # several passes follow; a lost executor recomputes its part of the batch from the source
    keyed = batch.withColumn("_part", key_text(keys)).withColumn("_us", micros(F.col(ts))).persist()
    known = sinks.read_version(spark, f"{state}/last", batch_id - 1) if batch_id else spark.createDataFrame([], "_part string, _last bigint")
    newest = known.agg(F.max("_last")).first()[0] if batch_id else None
    forgotten = None
    if newest is not None:
        edge = newest - period_micros(delay)
        forgotten = keyed.where(F.col("_us") < edge).join(known, "_part", "left_anti").persist()
        low = forgotten.agg(F.min("_us")).first()[0]
        if low is not None:
            # Nothing before this can still hold back a row, and the column comparison reaches the scan.
            since = F.timestamp_micros(F.lit(low - step)).cast(batch.schema[ts].dataType)
            past = spark.read.parquet(f"{state}/accepted").where((F.col("version") < batch_id) & (F.col(ts) >= since))
            past = past.select(key_text(keys).alias("_part"), micros(F.col(ts)).alias("_last")).join(forgotten.select("_part"), "_part", "left_semi")
            known = known.unionByName(past.groupBy("_part").agg(F.max("_last").alias("_last")))
    if keep_events:
        sinks.write_version(keyed.drop("_part", "_us"), f"{state}/events", batch_id)
    judged = keyed.join(known, "_part", "left")
    late = F.col("_us").isNull() | F.coalesce(F.col("_us") < F.col("_last"), F.lit(False))
    sinks.write_version(judged.filter(late).drop("_part", "_us", "_last"), f"{state}/late", batch_id)
    free = judged.filter(~late & (F.col("_last").isNull() | (F.col("_us") >= F.col("_last") + F.lit(step)))).drop("_last", "_part", "_us")
    accepted = sinks.write_version(
        cooldown_dedup(free, keys=keys, ts=ts, tie=tie, period=period), f"{state}/accepted", batch_id
    )
    times = accepted.select(key_text(keys).alias("_part"), micros(F.col(ts)).alias("_last")).unionByName(known)
    last = times.groupBy("_part").agg(F.max("_last").alias("_last"))
    newest = max(filter(None, [newest, accepted.agg(F.max(micros(F.col(ts)))).first()[0]]), default=0)
    sinks.write_version(last.where(F.col("_last") + step >= newest - period_micros(delay)), f"{state}/last", batch_id)
    keyed.unpersist()
    if forgotten is not None:
        forgotten.unpersist()
    return accepted


def settle_late(spark: SparkSession, state: str, *, keys=("fingerprint",), ts="captured_at", tie="event_id", period="30 minutes") -> DataFrame:
    """All accepted events of a cool-down stream, as one batch run over everything it has read would give them.

    Keys with late rows are judged anew from all their events; the others keep what the stream accepted.
    """
    part = key_text(keys)
    late = spark.read.parquet(f"{state}/late").select(part.alias("_part")).distinct()
    events = spark.read.parquet(f"{state}/events").drop("version").withColumn("_part", part).join(late, "_part", "left_semi").drop("_part")
    kept = spark.read.parquet(f"{state}/accepted").drop("version").withColumn("_part", part).join(late, "_part", "left_anti").drop("_part")
    return kept.unionByName(cooldown_dedup(events, keys=keys, ts=ts, tie=tie, period=period))


def stream_cooldown(events: DataFrame, *, keys=("fingerprint",), ts="captured_at", tie="event_id", period="30 minutes", delay="1 hour",
                    out: str, state: str, checkpoint: str) -> StreamingQuery:
    """The cool-down over a stream in event time; see `cooldown_batch` for its state and late rows."""

    def work(batch: DataFrame, batch_id: int) -> None:
        accepted = cooldown_batch(batch, batch_id, state=state, keys=keys, ts=ts, tie=tie, period=period, delay=delay)
        sinks.write_version(accepted, out, batch_id)

    return _start(events, work, checkpoint)


def stream_alerts(events: DataFrame, *, period="24 hours", tie="event_id", out: str, state: str, checkpoint: str) -> StreamingQuery:
    """Alert lines for worst-grade events, once per fingerprint and period."""
    graded = events.withColumn("severity", severity(F.col("query_time_sec"), F.col("rows_examined")))
    worst = graded.filter(F.col("severity") == "P0").withColumn(
        "fingerprint", fingerprint(F.col("instance_id"), F.col("sql_text"))
    )

    def work(batch: DataFrame, batch_id: int) -> None:
        accepted = cooldown_batch(
            batch, batch_id, state=state, keys=["fingerprint"], ts="captured_at", tie=tie, period=period
        )
        sinks.write_version(alert_text(accepted), out, batch_id)

    return _start(worst, work, checkpoint)


def stream_upsert(events: DataFrame, *, path: str, checkpoint: str) -> StreamingQuery:
    """Fold graded, fingerprinted events batch by batch. A batch writes its own partial folds only, so its cost
    does not grow with the history; `read_captured` gives the snapshot."""

    def work(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # counted first, then folded in chunks of even size
        sinks.write_version(capture_partials(batch, batch=batch_id, chunk_rows=CHUNK_ROWS), f"{path}/partials", batch_id)
        batch.unpersist()

    return _start(events, work, checkpoint)


def _partials(spark: SparkSession, path: str, compacted: int | None) -> DataFrame:
    parts = spark.read.parquet(f"{path}/partials")
    if compacted is None:
        return parts.drop("version")
    newer = parts.filter(F.col("version") > compacted).drop("version")
    return sinks.read_version(spark, f"{path}/compacted", compacted).unionByName(newer)


def read_captured(spark: SparkSession, path: str, *, compacted: int | None = None) -> DataFrame:
    """The snapshot of everything folded so far; with `compacted`, on top of that compaction."""
    return merge_partials(_partials(spark, path, compacted))


def compact_captured(spark: SparkSession, path: str, *, version: int, compacted: int | None = None) -> None:
    """Merge the partial folds up to batch `version` into one per fingerprint; run it now and then between batches."""
    parts = _partials(spark, path, compacted).filter(F.col("_batch") <= version)
    sinks.write_version(compact_partials(parts), f"{path}/compacted", version)


def capture_events(events: DataFrame, instances: DataFrame) -> DataFrame:
    """The stateless part of the capture chain: project, noise filter, fingerprint, grade."""
    return graded_events(join_project(events, instances).filter(F.col("sql_text").isNotNull()).filter(~is_noise(F.col("sql_text"))))


def graded_events(events: DataFrame) -> DataFrame:
    """Events with their fingerprint and grade."""
    return events.withColumns({
        "fingerprint": fingerprint(F.col("instance_id"), F.col("sql_text")),
        "severity": severity(F.col("query_time_sec"), F.col("rows_examined")),
    })


Table = DataFrame | Callable[[], DataFrame]


def _now(table: Table) -> DataFrame:
    """A table as it is for this batch; a function is asked anew, so that versions written since are seen."""
    return table if isinstance(table, DataFrame) else table()


def capture_batch(graded: DataFrame, batch_id: int, *, out: str, state: str, snapshot: str, period="30 minutes", alert_period="24 hours",
                  rules=K.RULES, plan_keys: Table | None = None, reports: Table | None = None, ttl_days=7, alerts: bool = True) -> None:
    """What follows the grading of events: report cache, cool-down, fold, tasks and alerts of one micro-batch.

    With `plan_keys` and `reports` (the versions of the report cache, each with its time) an event meets the version of its own time
    (`join_report_cache`; never for the worst grade). Its report goes into the snapshot, an accepted event that has one makes no task, and a
    suppressed one raises an alert with the report. Suppressed repeats count in the snapshot. Alerts go to `out`-alerts, once
    per fingerprint and `alert_period`.
    """
    if plan_keys is not None and reports is not None:
        graded = join_report_cache(graded, _now(plan_keys), _now(reports), ttl_days=ttl_days).drop("plan_key")
    else:
        graded = graded.withColumn("cached_report", F.lit(None).cast("string"))
    graded = graded.withColumn("diagnosis_report", F.coalesce("cached_report", "diagnosis_report")).persist()
    chain = dict(keys=["fingerprint"], ts="captured_at", tie="event_id")
    accepted = cooldown_batch(graded, batch_id, state=state, period=period, **chain)
    sinks.write_version(capture_partials(graded, batch=batch_id, chunk_rows=CHUNK_ROWS), f"{snapshot}/partials", batch_id)
    if alerts:
        suppressed = graded.filter(F.col("cached_report").isNotNull()).join(accepted.select("event_id"), "event_id", "left_anti")
        told = graded.filter(F.col("severity") == "P0").unionByName(suppressed.select(graded.columns))
        told = cooldown_batch(told, batch_id, state=f"{state}-alerts", period=alert_period, keep_events=False, **chain)
        report = F.concat(F.lit(K.CACHED_REPORT), F.col("cached_report"))
        lines = alert_text(told.filter(F.col("cached_report").isNull())).unionByName(
            alert_text(told.filter(F.col("cached_report").isNotNull()), content=report))
        sinks.write_version(lines, f"{out}-alerts", batch_id)
    sinks.sink_tasks(new_tasks(build_context(accepted, rules)), path=out, version=batch_id)
    graded.unpersist()


def stream_capture(events: DataFrame, instances: DataFrame, *, out: str, state: str, snapshot: str, checkpoint: str, **chain) -> StreamingQuery:
    """The whole chain: filter, grade, and all that `capture_batch` does."""

    def work(batch: DataFrame, batch_id: int) -> None:
        capture_batch(capture_events(batch, instances), batch_id, out=out, state=state, snapshot=snapshot, **chain)

    return _start(capture_source(events), work, checkpoint)


def stream_http_capture(spark: SparkSession, *, folder: str, instances: DataFrame, out: str, state: str, snapshot: str, checkpoint: str,
                        enabled: Table | None = None, max_len: int | None = None, received_at: str = "$.received_at", **chain) -> StreamingQuery:
    """JSON reports as one job: check, enabled source, project, grade, cool-down, fold, tasks and alerts.

    Every statement that is valid, and whose instance has this source enabled if it names one, is folded; accepted ones make a task. The
    others go to `out`-rejects with their reason. A body's own time is read from `received_at`; without one it is the time of the
    micro-batch. Events without an id get one from their body and time.
    """
    text = spark.readStream.text(folder)

    def work(batch: DataFrame, batch_id: int) -> None:
        at = F.coalesce(F.get_json_object("body", received_at).try_cast("timestamp_ntz"), F.current_timestamp().cast("timestamp_ntz"))
        event_id = F.coalesce(F.get_json_object("body", "$.event_id").try_cast("bigint"), F.xxhash64("body", "at"))
        bodies = batch.select(F.col("value").alias("body")).withColumn("at", at).withColumn("event_id", event_id)
        valid, rejected = flt_http_valid(readers.src_http_events(bodies, received_at=F.col("at")), max_len=max_len)
        if enabled is not None:
            open_ = _now(enabled).select("instance_id", "source").distinct().withColumn("_on", F.lit(True))
            judged = valid.join(open_, ["instance_id", "source"], "left")
            on = F.col("_on").isNotNull() | F.col("instance_id").isNull() | (F.trim("instance_id") == "")
            rejected = rejected.unionByName(judged.filter(~on).drop("_on").withColumn("reject_reason", F.lit("source not enabled")))
            valid = judged.filter(on).drop("_on")
        sinks.write_version(rejected, f"{out}-rejects", batch_id)
        named = join_project(capture_source(valid), instances)
        capture_batch(graded_events(named), batch_id, out=out, state=state, snapshot=snapshot, **chain)

    return _start(text, work, checkpoint)


def capture_source(events: DataFrame) -> DataFrame:
    """The event columns the capture chain needs, missing ones as NULL."""
    for column in ("project_code", "diagnosis_report"):
        if column not in events.columns:
            events = events.withColumn(column, F.lit(None).cast("string"))
    return events
