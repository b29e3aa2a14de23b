"""Fold events and changes into keyed snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordered import time_chunk, with_balanced_chunks

_CHUNK_SECONDS = 600


_STATE_BATCH = -1
_FIRST = ("sql_text", "database_name", "instance_id", "project_code", "rows_sent", "source", "captured_at",
          "query_time_sec", "lock_time_sec")
_LATEST = ("diagnosis_report", "severity")


def _order(batch: int, at: Column, tie: Column) -> Column:
    return F.struct(F.lit(batch).alias("batch"), at.alias("at"), tie.alias("tie"))


def capture_partials(events: DataFrame, *, on_duplicate="fold", tie="event_id", batch=0, chunk_rows: int | None = None) -> DataFrame:
    """Partial folds of `events`: one row per fingerprint and ten minutes, which `merge_partials` and `compact_partials` combine. With
    `chunk_rows` chunks have about that many rows instead, so that a burst within ten minutes is spread too; stored events are read twice then.

    Times are averaged pairwise in order, m <- (m + v) / 2, so event i of n weighs 2^-(n-i+1) and the first one twice
    that. The sum is associative: each chunk is summed on its own and shifted later by the number of events after
    it, so a hot fingerprint is spread over its chunks and batches can be folded apart.
    """
    chunk = time_chunk("captured_at", _CHUNK_SECONDS)
    if chunk_rows is not None:
        events, chunk = with_balanced_chunks(events, keys=["fingerprint"], ts="captured_at", target=chunk_rows, out="_chunk"), F.col("_chunk")
    rows = events.select(
        "fingerprint", *_FIRST, "rows_examined", *_LATEST,
        _order(batch, F.col("captured_at"), F.col(tie)).alias("_order"),
        chunk.alias("_chunk"),
        (F.coalesce("duplicate", F.lit(False)) if "duplicate" in events.columns else F.lit(False)).alias("_dup"),
    )
    if on_duplicate == "skip":
        rows = rows.filter(~F.col("_dup"))
    folded = ~F.col("_dup") if on_duplicate == "count" else F.lit(True)
    late_first = Window.partitionBy("fingerprint", "_chunk").orderBy(F.desc("_folded"), F.desc("_order"))
    when = F.when(F.col("_folded"), F.col("_order"))

    def total(column):
        return F.sum(F.coalesce(column, F.lit(0.0)) * F.col("_weight")).alias(f"_{column}")

    return (
        rows.withColumn("_folded", folded)
        .withColumn("_weight", F.when(F.col("_folded"), F.pow(F.lit(2.0), -F.row_number().over(late_first))))
        .groupBy(F.lit(batch).alias("_batch"), "fingerprint", "_chunk").agg(
            F.count_if("_folded").alias("_n"), F.count(F.lit(1)).alias("_count"),
            total("query_time_sec"), total("lock_time_sec"),
            F.max(F.when(F.col("_folded"), F.col("rows_examined"))).alias("_rows"),
            F.min_by(F.struct(*_FIRST), when).alias("_first"), F.min(when).alias("_first_order"),
            *[F.max_by(F.struct(c, "_order"), F.when(F.col(c).isNotNull(), when)).alias(f"_{c}") for c in _LATEST],
        )
    )


def _state_partials(state: DataFrame, events: DataFrame, tie: str) -> DataFrame:
    """A snapshot as partials that come before all events."""
    at = F.col("captured_at").cast(events.schema["captured_at"].dataType)
    order = _order(_STATE_BATCH, at, F.lit(None).cast(events.schema[tie].dataType))
    half = F.lit(0.5)
    return state.withColumn("captured_at", at).select(
        F.lit(_STATE_BATCH).alias("_batch"), "fingerprint", F.lit(0).cast("bigint").alias("_chunk"),
        F.lit(1).cast("bigint").alias("_n"), F.col("occurrence_count").alias("_count"),
        *[(F.coalesce(c, F.lit(0.0)) * half).alias(f"_{c}") for c in ("query_time_sec", "lock_time_sec")],
        F.col("rows_examined").alias("_rows"), F.struct(*_FIRST).alias("_first"), order.alias("_first_order"),
        *[F.when(F.col(c).isNotNull(), F.struct(c, order.alias("_order"))).alias(f"_{c}") for c in _LATEST],
    )


def compact_partials(partials: DataFrame) -> DataFrame:
    """One partial per fingerprint instead of one per batch and hour; it may be combined with later ones again."""
    later = (
        Window.partitionBy("fingerprint").orderBy(F.desc("_batch"), F.desc("_chunk"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = F.pow(F.lit(2.0), -F.col("_later"))
    return (
        partials.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .groupBy("fingerprint").agg(
            F.max("_batch").alias("_batch"), F.max("_chunk").alias("_chunk"), F.sum("_n").alias("_n"),
            F.sum("_count").alias("_count"),
            *[F.sum(F.col(f"_{c}") * shift).alias(f"_{c}") for c in ("query_time_sec", "lock_time_sec")],
            F.max("_rows").alias("_rows"), F.min_by("_first", "_first_order").alias("_first"),
            F.min("_first_order").alias("_first_order"),
            *[F.max_by(f"_{c}", f"_{c}._order").alias(f"_{c}") for c in _LATEST],
        )
        .select(partials.columns)
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """The snapshot: one row per fingerprint that has at least one folded event."""
    total = compact_partials(partials).filter(F.col("_n") > 0)
    first_again = F.pow(F.lit(2.0), -F.col("_n"))

    def mean(column):
        return (F.col(f"_{column}") + F.coalesce(F.col(f"_first.{column}"), F.lit(0.0)) * first_again).alias(column)

    return total.select(
        "fingerprint", "_first.sql_text", "_first.database_name", "_first.instance_id", "_first.project_code",
        mean("query_time_sec"), mean("lock_time_sec"), F.col("_rows").alias("rows_examined"), "_first.rows_sent",
        "_first.source", F.col("_count").alias("occurrence_count"),
        *[F.col(f"_{c}.{c}").alias(c) for c in _LATEST], "_first.captured_at",
    )


def agg_upsert_captured(state: DataFrame | None, events: DataFrame, *, on_duplicate="fold", tie="event_id") -> DataFrame:
    """One row per fingerprint after applying `events` to `state` in order of (captured_at, tie).

    Events may carry a flag `duplicate` (within the cool-down). `on_duplicate` says what it does: "fold" treats
    it like any event, "count" only adds to the counter, "skip" ignores it.
    """
    partials = capture_partials(events, on_duplicate=on_duplicate, tie=tie)
    if state is not None:
        partials = _state_partials(state, events, tie).unionByName(partials)
    return merge_partials(partials)


_UPDATED = ("status", "report", "error_message", "duration_ms", "tool_call_count", "updated_at")


def agg_upsert_diagnosis(state: DataFrame | None, changes: DataFrame, *, order: str = "updated_at", tie="seq") -> DataFrame:
    """One row per task: six columns from the last write, the others from the first."""
    columns = [c for c in changes.columns if c != tie]
    rows = changes.withColumn(
        "_order", F.struct(F.lit(1).alias("kind"), F.col(order).alias("at"), F.col(tie).alias("tie"))
    ).drop(tie)
    if state is not None:
        first = F.struct(
            F.lit(0).alias("kind"), F.lit(None).cast(changes.schema[order].dataType).alias("at"),
            F.lit(None).cast(changes.schema[tie].dataType).alias("tie"),
        )
        rows = state.select(*columns, first.alias("_order")).unionByName(rows)
    updated = [c for c in _UPDATED if c in columns]
    kept = [c for c in columns if c not in updated and c != "task_id"]
    return (
        rows.groupBy("task_id").agg(
            F.max_by(F.struct(*updated), "_order").alias("_last"), F.min_by(F.struct(*kept), "_order").alias("_first")
        )
        .select("task_id", *[f"_first.{c}" for c in kept], *[f"_last.{c}" for c in updated])
        .select(*columns)
    )


