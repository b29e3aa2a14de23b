"""Session settings the library relies on and the shared folder it may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_root: tempfile.TemporaryDirectory | None = None


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in `spark.checkpoint.dir`.

    Every executor must see it, so a machine-local folder is used only where the session names none and runs
    inside one process, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        global _local_root
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _local_root = _local_root or tempfile.TemporaryDirectory(prefix="tidewatch-")
        root = _local_root.name
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def settled(rows: DataFrame, purpose: str) -> DataFrame:
    """`rows` written to the shared folder and read back: computed once, however often they are used, and safe from lost executors."""
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
