"""Order-dependent work per key that does not put a whole key into one task.

A plain window over a key sends all its rows to one task, which is the bottleneck when one key holds a large
share of the data. The functions below split every key into chunks along its order (an hour of time, a block of
step numbers), work inside the chunks in parallel, and pass only one summary row per chunk along the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import micros

_PART, _CHUNK = "_part", "_chunk"


def time_chunk(ts: str, seconds: int = 3600) -> Column:
    """Chunk number of a timestamp column."""
    return F.floor(micros(F.col(ts)) / F.lit(seconds * 1_000_000))


def number_chunk(column: str, width: int = 4096) -> Column:
    """Chunk number of a numeric order column."""
    return F.floor(F.col(column) / F.lit(width))


def with_balanced_chunks(rows: DataFrame, *, keys, ts: str, target: int, out: str, seconds: int = 10) -> DataFrame:
    """Add chunk numbers that grow with time within a key, of about `target` rows each, whatever the key's rows per hour.

    Rows are counted per key and stretch of `seconds`, combined on the map side; a key with more than `target` rows is cut where its running
    count passes multiples of `target`, and the cuts, one row per stretch of such a key, are joined to the rows. Other keys are one chunk. No chunk holds more
    than `target` rows and one stretch. The rows are read twice, so they should be stored or persisted.
    """
    stretch = F.coalesce(F.floor(micros(F.col(ts)) / F.lit(seconds * 1_000_000)), F.lit(-(2**62)).cast("bigint"))
    marked = rows.withColumn("_key", F.struct(*keys)).withColumn("_stretch", stretch)
    counts = marked.groupBy("_key", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    large = counts.groupBy("_key").agg(F.sum("_n").alias("_total")).filter(F.col("_total") > target).select("_key")
    before = Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.join(large, "_key").select(
        "_key", "_stretch", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(target)).alias(out))
    return marked.join(cuts, ["_key", "_stretch"], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("bigint"))).drop("_key", "_stretch")


def _chunked(rows: DataFrame, keys, chunk: Column) -> DataFrame:
    # a struct is never NULL itself, so keys that are NULL meet in an ordinary equality join
    # rows without an order value sort first and get a chunk of their own
    return rows.withColumn(_PART, F.struct(*keys)).withColumn(_CHUNK, F.coalesce(chunk, F.lit(-(2**62)).cast("bigint")))


def running_total(rows: DataFrame, *, keys, order, chunk: Column, value: Column, out: str) -> DataFrame:
    """Add the sum of `value` over the key up to and including the row. `chunk` must grow with `order`."""
    parts = _chunked(rows, keys, chunk).withColumn("_value", value)
    inside = Window.partitionBy(_PART, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(_PART).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(_PART, _CHUNK).agg(F.sum("_value").alias("_total"))
        .select(_PART, _CHUNK, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        parts.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, [_PART, _CHUNK])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop(_PART, _CHUNK, "_value", "_local", "_offset")
    )


def position(rows: DataFrame, *, keys, order, chunk: Column, out: str) -> DataFrame:
    """Add the number of the row within its key, counted from one."""
    return running_total(rows, keys=keys, order=order, chunk=chunk, value=F.lit(1).cast("bigint"), out=out)


def carry(
    rows: DataFrame, *, keys, order, chunk: Column, value: Column, out: str,
    include_current: bool = True, backwards: bool = False,
) -> DataFrame:
    """Add the latest non-NULL `value` of the key up to the row (or the next one, with `backwards`)."""
    parts = _chunked(rows, keys, chunk).withColumn("_value", value)
    towards = [F.desc(c) if backwards else F.asc(c) for c in order]
    inside = (
        Window.partitionBy(_PART, _CHUNK).orderBy(*towards)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    chunk_order = F.desc(_CHUNK) if backwards else F.asc(_CHUNK)
    before = Window.partitionBy(_PART).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.when(F.col("_value").isNotNull(), F.struct(*order))
    edge = F.min_by("_value", rank) if backwards else F.max_by("_value", rank)
    carried = (
        parts.groupBy(_PART, _CHUNK).agg(edge.alias("_edge"))
        .select(_PART, _CHUNK, F.last("_edge", ignorenulls=True).over(before).alias("_carried"))
    )
    return (
        parts.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, [_PART, _CHUNK])
        .withColumn(out, F.coalesce("_local", "_carried"))
        .drop(_PART, _CHUNK, "_value", "_local", "_carried")
    )


def previous(rows: DataFrame, *, keys, order, chunk: Column, columns, out: str) -> DataFrame:
    """Add a struct with `columns` of the row before; NULL for the first row of a key."""
    return carry(rows, keys=keys, order=order, chunk=chunk, value=F.struct(*columns), out=out, include_current=False)


def following(rows: DataFrame, *, keys, order, chunk: Column, columns, out: str) -> DataFrame:
    """Add a struct with `columns` of the row after; NULL for the last row of a key."""
    return carry(
        rows, keys=keys, order=order, chunk=chunk, value=F.struct(*columns), out=out,
        include_current=False, backwards=True,
    )
