"""Suppress repeats of a key for a period that starts at each accepted event.

Whether an event is accepted depends on the accepted one before it, so a key is one long chain. Only distinct (key, microsecond) rows
take part; duplicates are merged on the map side, and the merged rows are written once to the shared folder.

Keys of at most `task_rows` rows are walked within tasks, many keys in each. The chain of a larger key is found by a parallel prefix. Its time is cut
into spans of one period. For a span, a sorted table says where the chain leaves it (the time it is free again) for every point it could enter at; a
chain enters within a span's first period, so only the events there and the first one after them are entry points. Going up, the tables
of two neighbouring spans are composed into that of a span twice as long, which halves the rows; going down, the real entry point of every span
follows from that of the span it is a half of. Each of these log2(spans) rounds is one look-up of "the first row at or after a time",
which works in chunks of ten seconds per key (`ordered.carry`): no task holds more of a key than that, however large the key and whatever the period.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import fingerprint, micros, severity
from tidewatch.operators.ordered import carry, position, time_chunk
from tidewatch.session import settled

TASK_ROWS = 200_000
_GRANULE = 10_000_000  # microseconds


def key_text(keys) -> Column:
    """All key columns as one text that is never NULL."""
    return F.coalesce(F.to_json(F.struct(*keys)), F.lit(""))


def period_micros(period: str) -> int:
    """`30 minutes` -> microseconds."""
    return int(pd.Timedelta(period).total_seconds() * 1_000_000)


def _walk(period: int):
    """Rows sorted by key and time -> those the chain of their key accepts. A key may go over several batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_left

        part, free = None, 0
        for pdf in batches:
            parts, times, hits = pdf["_part"].to_numpy(), pdf["_us"].tolist(), []
            cuts = (parts[1:] != parts[:-1]).nonzero()[0] + 1
            bounds = [0, *cuts.tolist(), len(times)]
            for low, high in zip(bounds, bounds[1:]):
                if low == high:
                    continue
                if part != parts[low]:
                    part, free = parts[low], times[low]
                at = bisect_left(times, free, low, high)
                while at < high:
                    hits.append(at)
                    free = times[at] + period
                    at = bisect_left(times, free, at + 1, high)
            yield pdf.iloc[hits]

    return run


def _first_from(queries: DataFrame, rows: DataFrame, at: str, columns) -> DataFrame:
    """`queries` with `_hit`: a struct of `columns` of the first of `rows` of the same key whose `_entry` is not before `at`."""
    points = rows.select(
        F.col("_part").alias("_key"), F.col("_entry").alias("_at"), F.lit(1).alias("_kind"), F.struct(*columns).alias("_row"))
    asked = queries.withColumnRenamed("_part", "_key").withColumn("_at", F.col(at)).withColumn("_kind", F.lit(0))
    found = carry(
        asked.unionByName(points, allowMissingColumns=True), keys=["_key"], order=["_at", "_kind"],
        chunk=F.floor(F.col("_at") / F.lit(_GRANULE)), value=F.col("_row"), out="_hit", include_current=False, backwards=True,
    )
    return found.where("_kind = 0").withColumnRenamed("_key", "_part").select(*queries.columns, "_hit")


def long_chains(times: DataFrame, step: int) -> DataFrame:
    """(_part, _us) of the accepted times; `times` has the distinct (_part, _us) of large keys and `_start`, the first time of the key."""
    span = F.floor((F.col("_us") - F.col("_start")) / F.lit(step))
    base = settled(times.select("_part", "_start", span.alias("_span"), F.col("_us").alias("_entry"), (F.col("_us") + step).alias("_exit")), "chain-spans")
    levels = [base]
    rounds = int(base.agg(F.max("_span")).first()[0] or 0).bit_length()
    for level in range(rounds):
        levels.append(settled(_doubled(levels[-1], step, step << level), "chain-spans"))
    starts = base.groupBy("_part").agg(F.min("_entry").alias("_free"))
    entries = settled(starts.select("_part", F.lit(0).cast("bigint").alias("_span"), "_free"), "chain-entries")
    for level in reversed(range(rounds)):
        entries = settled(_halved(entries, levels[level]), "chain-entries")
    hits = _first_from(entries, base, "_free", ["_span", "_entry"])
    return hits.where("_hit._span = _span").select("_part", F.col("_hit._entry").alias("_us"))


def _doubled(table: DataFrame, step: int, width: int) -> DataFrame:
    """Exit tables of spans of `width` -> those of spans of twice that: an exit of the left half is looked up in the right half."""
    left, right = table.where("_span % 2 = 0"), table.where("_span % 2 = 1")
    up = F.shiftright("_span", 1)
    met = _first_from(left, right, "_exit", ["_span", "_exit"])
    leaves = F.when(F.col("_hit._span") == F.col("_span") + 1, F.col("_hit._exit")).otherwise(F.col("_exit"))
    composed = met.select("_part", "_start", up.alias("_span"), "_entry", leaves.alias("_exit"))
    # Where nothing in the left half lies behind its first period, a late entry leads to the first event of the right half.
    first = right.groupBy("_part", up.alias("_span")).agg(F.min(F.struct("_entry", "_exit", "_start")).alias("_first"))
    last = left.groupBy("_part", up.alias("_span")).agg(F.max("_entry").alias("_last"))
    late = F.col("_last").isNull() | (F.col("_last") < F.col("_first._start") + F.col("_span") * F.lit(2 * width) + F.lit(step))
    beyond = first.join(last, ["_part", "_span"], "left").where(late)
    return composed.unionByName(beyond.select("_part", "_first._start", "_span", "_first._entry", "_first._exit"))


def _halved(entries: DataFrame, table: DataFrame) -> DataFrame:
    """Entry points of spans -> those of their halves that have events: the right one is entered where the left one is left."""
    children = entries.select("_part", F.shiftleft("_span", 1).alias("_span"), "_free")
    met = _first_from(children, table.where("_span % 2 = 0"), "_free", ["_span", "_exit"])
    leaves = F.when(F.col("_hit._span") == F.col("_span"), F.col("_hit._exit")).otherwise(F.col("_free"))
    both = children.unionByName(met.select("_part", (F.col("_span") + 1).alias("_span"), leaves.alias("_free")))
    return both.join(table.select("_part", "_span").distinct(), ["_part", "_span"], "left_semi")


def accepted_times(events: DataFrame, *, keys, ts: str, tie: str, period: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """(_part, _us, _tie) of the accepted events; ties of one microsecond go to the smallest `tie`."""
    step = period_micros(period)
    firsts = settled(
        events.select(key_text(keys).alias("_part"), micros(F.col(ts)).alias("_us"), F.col(tie).alias("_tie"))
        .filter(F.col("_us").isNotNull()).groupBy("_part", "_us").agg(F.min("_tie").alias("_tie")), "chain-times")
    schema = T.StructType([firsts.schema["_part"], firsts.schema["_us"], firsts.schema["_tie"]])

    def walked(rows: DataFrame) -> DataFrame:
        return rows.repartition("_part").sortWithinPartitions("_part", "_us").mapInPandas(_walk(step), schema)

    large = firsts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_start")).where(F.col("_n") > task_rows)
    if firsts.count() <= task_rows or large.isEmpty():
        return walked(firsts)
    large = settled(large.drop("_n"), "chain-keys")  # at most one key per `task_rows` rows
    chained = long_chains(firsts.join(large, "_part"), step)
    return walked(firsts.join(large, "_part", "left_anti")).unionByName(chained.join(firsts, ["_part", "_us"]).select("_part", "_us", "_tie"))


def _keyed(events: DataFrame, keys, ts: str, tie: str) -> DataFrame:
    return events.withColumns({"_part": key_text(keys), "_us": micros(F.col(ts)), "_tie": F.col(tie)})


def mark_accepted(events: DataFrame, *, keys, ts: str, tie: str, period: str, out: str = "accepted", task_rows: int = TASK_ROWS) -> DataFrame:
    """All events with a flag; rows without a time are never accepted."""
    hits = accepted_times(events, keys=keys, ts=ts, tie=tie, period=period, task_rows=task_rows).withColumn(out, F.lit(True))
    joined = _keyed(events, keys, ts, tie).join(hits, ["_part", "_us", "_tie"], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(False))).drop("_part", "_us", "_tie")


def cooldown_dedup(events: DataFrame, *, keys=("fingerprint",), ts="captured_at", tie="event_id",
                   period="30 minutes", task_rows: int = TASK_ROWS) -> DataFrame:
    """Events that are not within `period` after an accepted event of the same key."""
    hits = accepted_times(events, keys=keys, ts=ts, tie=tie, period=period, task_rows=task_rows)
    return _keyed(events, keys, ts, tie).join(hits, ["_part", "_us", "_tie"], "left_semi").drop("_part", "_us", "_tie")


def alert_dedup(events: DataFrame, *, period="24 hours", tie="event_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """Worst-grade events, once per fingerprint and period."""
    graded = events.withColumn("severity", severity(F.col("query_time_sec"), F.col("rows_examined")))
    worst = graded.filter(F.col("severity") == "P0")
    worst = worst.withColumn("fingerprint", fingerprint(F.col("instance_id"), F.col("sql_text")))
    return cooldown_dedup(worst, period=period, tie=tie, task_rows=task_rows)


def quota_flag(requests: DataFrame, *, key: str, ts: str, tie: str, limit: int = 100,
               period: str = "60 seconds", task_rows: int = TASK_ROWS) -> DataFrame:
    """Flag requests beyond `limit` in a window that opens at a client's first request; 0 turns it off.

    Requests without a time belong to no window and are not refused.
    """
    if limit <= 0:
        return requests.withColumn("refused", F.lit(False))
    untimed = requests.filter(F.col(ts).isNull()).withColumn("refused", F.lit(False))
    requests = requests.filter(F.col(ts).isNotNull())
    chunk = time_chunk(ts)
    opened = mark_accepted(requests, keys=[key], ts=ts, tie=tie, period=period, out="_opens", task_rows=task_rows)
    opened = carry(
        opened, keys=[key], order=[ts, tie], chunk=chunk, value=F.when(F.col("_opens"), F.col(ts)), out="_opened_at"
    )
    ranked = position(opened, keys=[key, "_opened_at"], order=[ts, tie], chunk=chunk, out="_rank")
    judged = ranked.withColumn("refused", F.col("_rank") > limit).drop("_opens", "_opened_at", "_rank")
    return judged.unionByName(untimed)
