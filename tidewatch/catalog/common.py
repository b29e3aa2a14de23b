"""Inputs that several queries share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.statements import fn_fingerprint, fn_severity
from tidewatch.operators.tasks import join_project


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def events_as_of() -> Column:
    """The moment the event views are looked at."""
    return moment("2024-01-31 00:00:00")


def orders_as_of() -> Column:
    """The moment the order views are looked at."""
    return moment("2001-08-02 00:00:00")


def captured(v) -> DataFrame:
    """Statement events with project, fingerprint and grade."""
    return fn_severity(fn_fingerprint(join_project(v.stmt_events, v.dim_instance)))
