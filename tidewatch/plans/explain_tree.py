"""Execution plans stored as JSON text.

Plan trees nest without a fixed depth, which column expressions cannot walk, and a VARIANT sorts the fields of an object, which loses the order of
the steps; so one Arrow-batched function turns each document into a flat array of table accesses. Everything after it is
ordinary column work.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import unnest

TABLE_ACCESS = T.ArrayType(T.StructType([
    T.StructField("step", T.IntegerType()), T.StructField("path", T.StringType()),
    T.StructField("table_name", T.StringType()), T.StructField("access_type", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("key_is_null", T.BooleanType()),
    T.StructField("rows", T.LongType()), T.StructField("filtered", T.DoubleType()), T.StructField("extra", T.StringType()),
]))
_ARROW = pa.list_(pa.struct([
    ("step", pa.int32()), ("path", pa.string()), ("table_name", pa.string()), ("access_type", pa.string()),
    ("key", pa.string()), ("key_is_null", pa.bool_()), ("rows", pa.int64()), ("filtered", pa.float64()),
    ("extra", pa.string()),
]))


def _number(value) -> float | None:
    """A finite number, also one written as text; None for everything else."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        number = float(value)
    except (ValueError, OverflowError):
        return None
    return number if math.isfinite(number) else None


def _rows(value) -> int | None:
    number = _number(value)
    return int(number) if number is not None and abs(number) < 2.0**63 else None


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def table_accesses(document: str | None) -> list[dict] | None:
    """All nodes with a table name, in document order; None for text that is not JSON. Fields of another type than they should have are
    NULL, as are numbers that are not finite or too large."""
    if document is None:
        return None
    try:
        root = json.loads(document)
    except (ValueError, RecursionError):
        return None
    found, todo = [], [("$", root)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, list):
            todo.extend((f"{path}[{i}]", child) for i, child in reversed(list(enumerate(node))))
        elif isinstance(node, dict):
            if isinstance(node.get("table_name"), str):
                found.append({
                    "step": len(found) + 1, "path": path, "table_name": node["table_name"],
                    "access_type": _text(node.get("access_type")), "key": _text(node.get("key")),
                    "key_is_null": "key" in node and node["key"] is None,
                    "rows": _rows(node.get("rows_examined_per_scan")),
                    "filtered": _number(node.get("filtered")), "extra": _text(node.get("Extra")),
                })
            todo.extend((f"{path}.{k}", v) for k, v in reversed(node.items()) if isinstance(v, (dict, list)))
    return found


@F.arrow_udf(TABLE_ACCESS)
def _accesses(documents: pa.Array) -> pa.Array:
    return pa.array([table_accesses(d) for d in documents.to_pylist()], type=_ARROW)


def with_accesses(plans: DataFrame, *, plan="plan", out="accesses") -> DataFrame:
    """Add the table accesses of a plan as an array, for row-local use."""
    return plans.withColumn(out, _accesses(F.col(plan)))


def plan_tables(plans: DataFrame, *, id_column="plan_id", plan="plan") -> DataFrame:
    """One row per table access of each plan."""
    return unnest(with_accesses(plans, plan=plan), "accesses", "_access", id_column).select(id_column, "_access.*")


def plan_key(plans: DataFrame, *, id_column="plan_id", plan="plan") -> DataFrame:
    """`type|key|Extra` of the first table of each plan; NULL for plans without a table."""
    first = F.col("accesses")[0]
    key = F.concat_ws("|", *[F.coalesce(first[c], F.lit("")) for c in ("access_type", "key", "extra")])
    return with_accesses(plans, plan=plan).select(id_column, F.when(F.size("accesses") > 0, key).alias("plan_key"))


_COMPARED = ("table_name", "access_type", "key", "rows", "filtered", "extra")


def compare_plans(before: DataFrame, after: DataFrame, *, id_column="plan_id", plan="plan") -> DataFrame:
    """Two plans side by side per step, with a flag where they differ."""

    def side(frame, name):
        return plan_tables(frame, id_column=id_column, plan=plan).select(
            id_column, "step", *[F.col(c).alias(f"{name}_{c}") for c in _COMPARED]
        )

    both = side(before, "before").join(side(after, "after"), [id_column, "step"], "full")
    same = F.lit(True)
    for c in _COMPARED:
        same = same & F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    return both.withColumn("changed", ~same)
