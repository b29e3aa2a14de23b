"""Audits over index, column, table and plan snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as X
from tidewatch.functions.structure import statement_parts
from tidewatch.session import settled

_TABLE = ["instance_id", "table_name"]


def index_definitions(index_columns: DataFrame) -> DataFrame:
    """One row per index with its columns in order; an index has a handful of columns."""
    parts = F.array_sort(F.collect_list(F.struct("seq_in_index", "column_name")))
    return index_columns.groupBy(*_TABLE, "index_name").agg(
        F.array_join(F.transform(parts, lambda p: p["column_name"]), ",").alias("cols"),
        F.count(F.lit(1)).alias("width"), F.min_by("column_name", "seq_in_index").alias("first_column"),
    )


def redundant_indexes(index_columns: DataFrame, *, min_indexes=3) -> DataFrame:
    """Single-column indexes whose column leads a longer index, in tables with at least `min_indexes` indexes."""
    indexes = index_definitions(index_columns)
    counts = indexes.groupBy(*_TABLE).agg(F.count(F.lit(1)).alias("index_count")).filter(F.col("index_count") >= min_indexes)
    single = indexes.filter(F.col("width") == 1).select(*_TABLE, "first_column", "index_name", "cols").join(counts, _TABLE)
    longer = indexes.filter(F.col("width") > 1).select(
        *_TABLE, "first_column", F.col("index_name").alias("covered_by"), F.col("cols").alias("covering_cols")
    )
    return single.join(longer, [*_TABLE, "first_column"]).drop("first_column")


def _analysed(statements: DataFrame, key: str, *parts: str) -> DataFrame:
    """Key, instance and parts of the statements that have a text. A walk over a known shape costs less than bringing equal texts together, so
    the statements stay where they are."""
    texts = statements.filter(F.col("sql_text").isNotNull())
    return texts.select(key, "instance_id", statement_parts("sql_text").alias("parts")).select(key, "instance_id", *[f"parts.{p}" for p in parts])


def index_coverage(statements: DataFrame, index_columns: DataFrame, *, key="statement_id") -> DataFrame:
    """Per statement and table: the indexed columns and the used columns that no index has.

    A column without qualifier counts for every table of its statement.
    """
    analysed = _analysed(statements, key, "refs", "used")
    per_table = X.unnest(analysed, "refs", "ref", key, "instance_id", "used").select(
        key, "instance_id", F.col("ref.table").alias("table_name"),
        F.transform(
            F.filter("used", lambda u: (u["qualifier"] == "") | (u["qualifier"] == F.col("ref.alias"))
                     | (u["qualifier"] == F.col("ref.table"))),
            lambda u: u["column"],
        ).alias("used"),
    ).filter(F.col("table_name").rlike("^[A-Za-z0-9_]+$"))
    # Written, so that its measured size decides whether it goes to every task.
    indexed = index_columns.groupBy(*_TABLE).agg(F.sort_array(F.collect_set("column_name")).alias("indexed"))
    indexed = settled(indexed.withColumn("indexed_columns", F.array_join("indexed", ",")), "indexed-columns")
    both = per_table.join(indexed, _TABLE, "left")
    missing = F.when(F.col("indexed").isNull(), F.array_distinct("used")).otherwise(F.array_except("used", "indexed"))
    return both.select(
        key, *_TABLE, F.coalesce("indexed_columns", F.lit("")).alias("indexed_columns"),
        F.array_join(F.sort_array(missing), ",").alias("missing_columns"),
    )


_TEXT_TYPE = r"(?i)^\s*(?:(?:var)?char|(?:tiny|medium|long)?text|enum|set|json)\b"
_NUMBER_TYPE = r"(?i)^\s*(?:(?:tiny|small|medium|big)?int|integer|decimal|numeric|float|double|real|bit)\b"


def type_mismatch(statements: DataFrame, columns: DataFrame, *, key="statement_id") -> DataFrame:
    """Comparisons whose constant is of another kind than the column: text with number, or number with text."""
    analysed = _analysed(statements, key, "refs", "tests")
    tests = X.unnest(analysed, "tests", "test", key, "instance_id", "refs").select(key, "instance_id", "refs", "test.*")
    tests = X.unnest(tests, "refs", "ref", key, "instance_id", "qualifier", "column", "literal")
    tests = tests.filter(
        (F.col("qualifier") == "") | (F.col("qualifier") == F.col("ref.alias")) | (F.col("qualifier") == F.col("ref.table"))
    ).select(key, "instance_id", F.col("ref.table").alias("table_name"), F.col("column").alias("column_name"), "literal")
    typed = tests.join(columns, [*_TABLE, "column_name"])
    quoted = F.col("literal").startswith("'")
    problem = (
        F.when(F.col("data_type").rlike(_TEXT_TYPE) & ~quoted, "text column compared with number")
        .when(F.col("data_type").rlike(_NUMBER_TYPE) & quoted, "number column compared with text")
    )
    return typed.select(key, *_TABLE, "column_name", "data_type", "literal", problem.alias("problem")).filter(
        F.col("problem").isNotNull()
    )


def row_estimate_audit(estimates: DataFrame, actuals: DataFrame, *, key="statement_id", ratio=10.0) -> DataFrame:
    """Estimated and actual rows side by side; `outdated` where they differ by more than `ratio` times."""
    both = estimates.select(key, "estimated_rows").join(actuals.select(key, "actual_rows"), key)
    low = F.greatest(F.least("estimated_rows", "actual_rows"), F.lit(1))
    off = F.greatest("estimated_rows", "actual_rows") / low
    return both.withColumn("deviation", off).withColumn("outdated", F.col("deviation") > ratio)


def table_statistics(tables: DataFrame, index_columns: DataFrame) -> DataFrame:
    """Row count of each table with the cardinality of each index column; tables without index keep one row."""
    return tables.join(
        index_columns.select(*_TABLE, "index_name", "seq_in_index", "column_name", "cardinality"), _TABLE, "left"
    )
