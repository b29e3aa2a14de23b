"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`; a session without one (tests) gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewatch-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, purpose: str, tidy: bool = False) -> DataFrame:
    """`rows` written to the shared folder and read back: lineage ends, and lost executors cost nothing.

    `tidy`: what the write has shuffled goes with its end, not when the driver happens to collect its garbage.
    """
    path = scratch(rows.sparkSession, purpose)
    with shuffles_removed(rows.sparkSession) if tidy else contextlib.nullcontext():
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, executions remove their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores in front until no column of `taken` has it (Spark compares without case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; NULL for a NULL key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def mostly_among(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """The rows whose `key` (a long) is in the only column of `wanted`, and a few others; a join behind makes it exact.

    A bitmap of 2^27 places of the wanted keys (16 MB at most, whatever their number) goes to the rows, so that hardly any row that is not
    wanted is shuffled later on.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << 27))
    bitmap = wanted.select(place(F.col(wanted.columns[0])).alias("_p")).groupBy(F.shiftright("_p", 15).alias("_part")).agg(
        F.bitmap_construct_agg(F.col("_p").bitwiseAND(32767)).alias("_bits"))
    met = rows.withColumn("_p", place(key)).withColumn("_part", F.shiftright("_p", 15)).join(F.broadcast(bitmap), "_part")
    bit = F.col("_p").bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.call_function("shiftright", byte, bit.bitwiseAND(7)).bitwiseAND(1) == 1).select(*rows.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: rows (node, component), component the smallest node reachable.

    Alternates "large star" and "small star": every node links its larger (then its smaller) neighbours to the smallest
    one it knows, which halves distances each time. A node's neighbours are never gathered; only their minimum
    is aggregated, which combines on the map side, so a hub with a third of all links is no hot task. Each round
    is written to the shared folder. Self links are allowed; NULL ends are ignored.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    current = settled(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    summary = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"))
    before = current.agg(summary.alias("s")).first()["s"]
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.where("v < u")
        small = low.groupBy("u").agg(F.min("v").alias("m"))
        star = low.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        star = star.unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        current = settled(star, "links")
        after = current.agg(summary.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
