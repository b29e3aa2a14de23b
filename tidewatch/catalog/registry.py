"""Registry of queries over the given tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from string import Template

from pyspark.sql import DataFrame, SparkSession

from tidewatch.catalog.views import DUCK_EACH, DUCK_VIEWS, SPARK_EACH, TABLES, VIEWS
from tidewatch.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Sets up the input files of a query ahead of it, so that they are not part of its time.
PREPARE: dict[str, Callable[[SparkSession, str], object]] = {}
_PREPARED: dict[tuple[str, str, str], str] = {}


class Inputs:
    """Tables and derived views of one data folder, as lazy DataFrames: `inputs.stmt_events`, `inputs.orders`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        files = {t: f"parquet.`{self.folder}/{t}.parquet`" for t in TABLES}
        return self.spark.sql(Template(VIEWS[name]).substitute(files | SPARK_EACH))


    def prepared(self, name: str, write: Callable[[str], object]) -> str:
        """A folder that `write(folder)` fills once per session and data folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _PREPARED:
            path = shared_folder(self.spark, name)
            write(path)
            _PREPARED[key] = path
        return _PREPARED[key]


def _dependencies(text: str, seen: dict[str, str]) -> None:
    known = {**VIEWS, **DUCK_VIEWS}
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
    for name in known:
        if name in words and name not in seen:
            sql = known[name]
            _dependencies(sql, seen)
            seen[name] = Template(sql).substitute({t: t for t in TABLES} | DUCK_EACH) if name in VIEWS else sql


def oracle_text(body: str) -> str:
    """The check query with the views it names put in front as common table expressions."""
    seen: dict[str, str] = {}
    _dependencies(body, seen)
    ctes = [f"{name} as (\n{sql}\n)" for name, sql in seen.items()]
    head, _, rest = body.strip().partition("\nselect ") if body.strip().startswith("with ") else ("", "", "")
    if head:
        return "with recursive " + ",\n".join([*ctes, head[len("with "):]]) + "\nselect " + rest
    return ("with recursive " + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()


def query(name: str, oracle: str | None = None, prepare: Callable[[Inputs], object] | None = None):
    """Register a function of `Inputs`. An oracle that starts with `with` has its final select at the start of a line; `prepare` sets up
    files the query asks `Inputs.prepared` for."""

    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        if prepare is not None:
            PREPARE[name] = lambda spark, folder: prepare(Inputs(spark, folder))
        return build

    return register
