"""Jobs over statement tables and application logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions import text as X
from tidewatch.functions.structure import statement_parts
from tidewatch.operators.ordered import following, number_chunk


def fn_normalize_sql(statements: DataFrame) -> DataFrame:
    return statements.withColumn("normalized", X.normalize_sql(F.col("sql_text")))


def fn_fingerprint(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint", X.fingerprint(F.col("instance_id"), F.col("sql_text")))


def fn_fingerprint_global(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint_global", X.fingerprint_global(F.col("sql_text")))


def fn_severity(events: DataFrame) -> DataFrame:
    return events.withColumn("severity", X.severity(F.col("query_time_sec"), F.col("rows_examined")))


def fn_strip_comments(statements: DataFrame) -> DataFrame:
    return statements.withColumn("stripped", X.strip_comments(F.col("sql_text")))


def mask_statements(statements: DataFrame, *, names=K.SENSITIVE_NAMES) -> DataFrame:
    """Add the masked text, the number of masked values and a flag."""
    sql = F.col("sql_text")
    masked = X.let(X.masked_parts(sql, names), lambda parts: F.struct(X.masked_text(sql, parts, names).alias("sql"), X.masked_count(parts).alias("n")))
    rows = statements.withColumn("_masked", masked)
    return rows.withColumns({"masked_sql": F.col("_masked.sql"), "masked_count": F.col("_masked.n"), "masked": F.col("_masked.n") > 0}).drop("_masked")


def bind_parameters(log_lines: DataFrame, *, thread="thread", order="line_no", line="line") -> DataFrame:
    """Bound statements of an application log: a `Preparing:` line and the next such line of its thread, if that one
    holds `Parameters:`. `order` is a number that grows with the log."""

    def after(mark: str) -> Column:
        """What follows a mark up to the end of the line; NULL without the mark."""
        at = F.locate(mark.lower(), F.lower(line))
        rest = F.substring_index(F.substring(F.col(line), at + len(mark), F.length(line)), "\n", 1)
        return F.when(at > 0, F.trim(rest))

    marks = log_lines.select(
        thread, order, F.when(after("Preparing:") != "", after("Preparing:")).alias("template"), after("Parameters:").alias("parameters")
    ).filter(F.col("template").isNotNull() | F.col("parameters").isNotNull())
    paired = following(
        marks, keys=[thread], order=[order], chunk=number_chunk(order, 65_536), columns=["template", "parameters"],
        out="_next",
    ).filter(F.col("template").isNotNull())
    parameters = F.when(F.col("_next.template").isNull(), F.col("_next.parameters"))
    return paired.select(thread, order, X.bind_sql(F.col("template"), parameters).alias("sql_text"))


def classify_statements(statements: DataFrame) -> DataFrame:
    """Add the class of each statement, whether it may be analysed, and why not."""
    return (
        statements.withColumn("statement_class", X.statement_class(F.col("sql_text")))
        .withColumn("is_safe", F.col("statement_class") == "select")
        .withColumn("refusal", X.refusal(F.col("statement_class")))
    )


def with_parts(statements: DataFrame, *columns: str) -> DataFrame:
    """`columns` of the statements that have a text, and `parts` (see `functions.structure`). Each distinct text is analysed once.

    Texts are grouped with their copies combined on the map side; statements meet the result on their text, and a text that a large share of the
    statements has is split by adaptive execution.
    """
    # counting keeps the optimizer from merging the grouping into another one
    texts = statements.filter(F.col("sql_text").isNotNull()).groupBy("sql_text").agg(F.count(F.lit(1)).alias("_copies"))
    parts = texts.select("sql_text", statement_parts("sql_text").alias("parts"))
    return statements.select(*columns, "sql_text").join(parts, "sql_text").select(*columns, "parts")


def referenced_tables(statements: DataFrame, *, key="statement_id") -> DataFrame:
    """One row per statement and table."""
    named = with_parts(statements, key).select(key, F.array_distinct(F.col("parts.refs.table")).alias("_tables"))
    return X.unnest(named, "_tables", "table_name", key)


def audit_rows(statements: DataFrame) -> DataFrame:
    """Audit columns of analysed statements: length, masked or not, tables, duration, status."""
    tables = F.array_distinct(F.col("_parts.refs.table"))
    return statements.withColumn("_parts", statement_parts("sql_text")).select(
        "task_id", "session_id", "instance_id", F.length("sql_text").alias("sql_len"),
        (X.sensitive_count(F.col("sql_text")) > 0).alias("masked"),
        F.concat(F.lit("["), F.array_join(tables, ", "), F.lit("]")).alias("tables"),
        "duration_ms", "status",
    )


def tables_array(diagnoses: DataFrame, *, column="table_names") -> DataFrame:
    """The stored list text, `[a, b]` or JSON, as an array."""
    inner = F.regexp_replace(F.trim(F.col(column)), r'^\[|\]$|"', "")
    return diagnoses.withColumn("tables", F.filter(F.split(inner, r"\s*,\s*"), lambda t: t != ""))


def tables_text(diagnoses: DataFrame, *, column="tables") -> DataFrame:
    """The array as stored text."""
    return diagnoses.withColumn("table_names", F.concat(F.lit("["), F.array_join(column, ", "), F.lit("]")))
