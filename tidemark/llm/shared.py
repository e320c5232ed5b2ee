"""Helpers that the training-data operators share: the cluster's shared folder, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word pattern ``[^\x20\x09-\x0D]+`` leaves it.
BLANKS = r"[ \x09-\x0D]+"

#: Bytes of rows that a Python worker is handed at once, about; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20

#: For the C library of Python workers: arrays from this many bytes on go back to the system as soon as they are freed, and so does what is free
#: beyond that many bytes at the end of the heap. By itself it raises both as it goes, and a worker that lives on keeps what any stage took.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20)}

_own_folder: list[str] = []
_scopes: list[str] = []


def _base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session without it gets a temporary folder; on a cluster that would be a folder of one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="tidemark-"))
        base = _own_folder[0]
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, inside the open ``scratch`` if there is one."""
    return f"{_scopes[-1] if _scopes else _base(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table or a folder of them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables written inside the block go to one folder, which is deleted at its end; what is to last must be written elsewhere by then."""
    path = f"{_base(spark)}/{uuid.uuid4().hex}"
    _scopes.append(path)
    try:
        yield path
    finally:
        _scopes.remove(path)
        remove(spark, path)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stash_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``stash`` of what ``make`` returns; the tables that are written on the way are deleted."""
    path = shared_folder(spark)
    with scratch(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Let ``spark`` hand Python workers at most ``BATCH_BYTES`` at once, unless a limit is set already; for callers that pass whole texts to operators.

    Spark's own limit counts rows above all, and a few thousand whole texts are many times a worker's share of memory. Workers started from now on
    also give memory back by ``WORKER_MEMORY``, unless their environment has other values.
    """
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def identity(*columns: str) -> list[Column]:
    """Two longs (_h1, _h2) that tell rows apart by all of ``columns``, nulls included: 128 bits, so unequal rows do not meet in practice."""
    parts = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "_h1"), (2, "_h2"))]


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, with underscores in front until it is no column in ``taken``, in any case."""
    low = {c.lower() for c in taken}
    while wish.lower() in low:
        wish = "_" + wish
    return wish


def words(text: Column) -> Column:
    """The array of a text's words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def smallest_reachable(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of ``links`` (a long, b long): one row (node, root) per linked node, root the smallest id it reaches.

    Large-star and small-star rounds in turn. Every round takes one minimum per node, combined before the shuffle, so a node with very
    many links costs one row per task; each round is written to the shared folder. ``links`` must not hold nulls. An empty table gives an
    empty one. Raises after ``max_rounds`` rounds, which is far above the logarithm of any chain that fits a cluster.
    """
    spark, path = links.sparkSession, ""

    def settle(df: DataFrame) -> DataFrame:
        nonlocal path
        old, path = path, shared_folder(spark)
        df.write.parquet(path)
        if old:
            remove(spark, old)
        return spark.read.schema(df.schema).parquet(path)

    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        edges = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        down = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = settle(down.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
