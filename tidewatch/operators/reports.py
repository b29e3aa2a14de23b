"""Dashboards, counts and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.filters import flt_system_schema
from tidewatch.operators.search import match_captured, match_history, top_frequent


def agg_fingerprint(events: DataFrame, *, project=None, limit=50, digits=2) -> DataFrame:
    """Most frequent fingerprints with their times and worst grade."""
    return (
        match_captured(events, project=project).groupBy("fingerprint").agg(
            F.min("sql_text").alias("sample_sql"), F.count(F.lit(1)).alias("cnt"),
            F.avg("query_time_sec").alias("_avg"), F.max("query_time_sec").alias("_max"),
            F.min("severity").alias("top_severity"), F.max("diagnosis_report").alias("has_report"),
            F.max("instance_id").alias("instance_id"), F.max("project_code").alias("project_code"),
        )
        .orderBy(F.desc("cnt"), F.desc("_avg"), "fingerprint").limit(limit)
        .select(
            "fingerprint", "sample_sql", "cnt", F.round("_avg", digits).alias("avg_time"), F.round("_max", digits).alias("max_time"),
            "top_severity", "has_report", "instance_id", "project_code",
        )
    )


def count_by_source(captured: DataFrame, *, project=None) -> DataFrame:
    return match_captured(captured, project=project).groupBy("source").agg(F.count(F.lit(1)).alias("cnt"))


def _today(as_of: Column) -> Column:
    return F.col("captured_at") >= F.date_trunc("DAY", as_of)


def _counters(as_of: Column) -> list[Column]:
    return [
        F.count_if(_today(as_of)).alias("today_count"), F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("severity") == "P0").alias("p0_count"),
    ]


def count_today_total_p0(captured: DataFrame, *, as_of: Column, project=None) -> DataFrame:
    """One pass for three counters."""
    return match_captured(captured, project=project).agg(*_counters(as_of))


def count_diagnoses(diagnoses: DataFrame, *, project=None) -> DataFrame:
    status = F.upper("status")
    return match_history(diagnoses, project=project).agg(
        F.count(F.lit(1)).alias("diagnosis_count"),
        F.count_if(status.isin("PENDING", "RUNNING")).alias("pending_count"),
        F.count_if(status.isin("COMPLETED", "FAILED") & F.col("report").isNotNull()).alias("finished_count"),
    )


def dash_stats(captured: DataFrame, diagnoses: DataFrame, *, as_of: Column, project=None, top=5) -> DataFrame:
    """The dashboard in long form: (metric, item, value).

    The counters are summed from the counts per source, so both come from one pass over the statements.
    """

    def rows(frame, metric, item, value):
        return frame.select(F.lit(metric).alias("metric"), item.alias("item"), value.cast("bigint").alias("value"))

    def unpivot(frame, pairs):
        cells = F.array(*[
            F.struct(F.lit(m).alias("metric"), F.lit("").alias("item"), F.col(c).cast("bigint").alias("value")) for m, c in pairs
        ])
        return frame.select(F.inline(cells))

    per_source = match_captured(captured, project=project).groupBy("source").agg(*_counters(as_of))
    names = ("today_count", "total_count", "p0_count")
    counts = unpivot(
        per_source.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]), tuple(zip(("today", "total", "p0"), names))
    )
    tasks = unpivot(
        count_diagnoses(diagnoses, project=project), (("diagnoses", "diagnosis_count"), ("pending", "pending_count"))
    )
    sources = rows(per_source, "source", F.col("source"), F.col("total_count"))
    frequent = rows(
        top_frequent(captured, n=top, project=project), "top", F.col("fingerprint"), F.col("occurrence_count")
    )
    return counts.unionByName(tasks).unionByName(sources).unionByName(frequent)


def daily_trend(captured: DataFrame, *, as_of: Column, days=7, project=None) -> DataFrame:
    """Statements per day since `days` days before the day of `as_of`; days without any are absent."""
    first = F.timestamp_add("DAY", F.lit(-days), F.date_trunc("DAY", as_of))
    found = match_captured(captured, project=project).filter(F.col("captured_at") >= first)
    return found.groupBy(F.to_date("captured_at").alias("day")).agg(F.count(F.lit(1)).alias("cnt"))


def top_statements(history: DataFrame, *, limit=20, own_schemas=()) -> DataFrame:
    """Most frequent statement texts of a history snapshot outside the system schemas."""
    user = flt_system_schema(history, own_schemas=own_schemas).filter(F.col("sql_text").isNotNull())
    return (
        user.groupBy("sql_text").agg(
            F.count(F.lit(1)).alias("times"), F.avg("query_time_sec").alias("avg_time"),
            F.max("query_time_sec").alias("max_time"), F.avg("rows_examined").alias("avg_rows"),
        )
        .orderBy(F.desc("times"), "sql_text").limit(limit)
    )


def capture_stats(capture_log: DataFrame, *, as_of: Column, interval_sec=60) -> DataFrame:
    """Per instance: rows collected, last activity, its error if it failed, seconds to the next poll.

    The log holds one row per poll: instance_id, polled_at, seq, collected (NULL on failure), error.
    """
    order = F.struct("polled_at", "seq")
    last = capture_log.groupBy("instance_id").agg(
        F.coalesce(F.sum("collected"), F.lit(0)).alias("total_collected"), F.max("polled_at").alias("last_collect_at"),
        F.max_by("error", order).alias("last_error"),
    )
    elapsed = F.timestamp_diff("SECOND", F.col("last_collect_at"), as_of)
    left = F.lit(interval_sec) - elapsed % F.lit(interval_sec)
    return last.withColumn("next_poll_sec", F.greatest(left, F.lit(0)))


def connections_by_command(process_list: DataFrame) -> DataFrame:
    return process_list.groupBy("instance_id", F.coalesce("command", F.lit("Unknown")).alias("command")).agg(
        F.count(F.lit(1)).alias("connections")
    )


def buffer_hit_rate(counters: DataFrame, *, warn=95.0) -> DataFrame:
    """Share of page requests served from memory, per instance; none where nothing was requested."""

    def counter(name):
        return F.coalesce(F.max(F.when(F.col("variable_name") == name, F.col("value"))), F.lit(0)).cast("bigint")

    both = counters.groupBy("instance_id").agg(
        counter("Innodb_buffer_pool_reads").alias("disk_reads"),
        counter("Innodb_buffer_pool_read_requests").alias("requests"),
    )
    rate = (F.lit(1.0) - F.col("disk_reads") / F.col("requests")) * 100
    return (
        both.withColumn("hit_rate", F.when(F.col("requests") != 0, rate))
        .withColumn("below_target", F.col("hit_rate") < warn)
    )
