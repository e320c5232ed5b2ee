"""Memory tables as versioned lists of Parquet parts: a commit writes new parts and then names them."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import scalars as X
from tidemark.operators.graph import cut


def number_rows(rows: DataFrame, order: str, last_id: int) -> DataFrame:
    """Add ``id`` from ``last_id`` + 1 on in the order of the column ``order``; ranges of it are sorted and counted apart, so no task sees all rows.

    The dealt rows are written, as sorting them again could deal them otherwise.
    """
    dealt = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return numbered.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).withColumn("id", F.lit(last_id) + F.col("_before") + F.col("_k")).drop("_part", "_of", "_before", "_k")


def tombstone(records: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """``records`` with those in ``ids`` marked as deleted, without data and vector; edges stay."""
    hit = records.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    now = F.coalesce("_hit", F.lit(False))
    return hit.select(
        *(F.when(~now, F.col(c)).alias(c) if c in ("data", "embedding") else (F.col(c) | now).alias(c) if c == "tombstoned" else F.when(now, at).otherwise(F.col(c)).alias(c) if c == "tombstoned_at" else F.col(c) for c in records.columns)
    )


def delete(records: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and edges without those in ``ids`` and without all edges that touch one."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return records.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def apply_updates(table: DataFrame, updates: DataFrame) -> DataFrame:
    """``table`` with the columns of ``updates`` (id, ...) in the rows that it names; one update per id."""
    new = updates.select("id", *(F.col(c).alias(f"_{c}") for c in updates.columns if c != "id"))
    joined = table.join(new, "id", "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in updates.columns and c != "id" else F.col(c) for c in table.columns))


def relate(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, type, stability) of ``wanted`` (from_id, to_id, type) whose ends both exist, tombstones included."""
    sources = records.select(F.col("id").alias("from_id"), X.initial_stability(F.col("importance")).alias("stability"))
    return wanted.join(sources, "from_id").join(records.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", "type", "stability")


class ConcurrentCommit(RuntimeError):
    """Another writer commits on the same version."""


class Store:
    """Tables of one memory in a folder that all executors share.

    A table is a list of parts, one per commit that wrote to it. A commit writes new parts and then a one-row pointer that names the parts of each
    table, so appending rows costs those rows and not the table, and changing some rows costs the parts that hold them. Readers follow the
    newest pointer, so they see all of a commit or nothing; a lost executor or a failed write leaves the old version. A writer claims the
    version it builds on with a file that only one can create, so two commits never overwrite each other; the claim of a writer that died
    ends after ``CLAIM_S`` seconds.
    """

    TABLES = {
        "records": S.RECORDS, "edges": S.EDGES, "entities": S.ENTITIES, "entity_edges": S.ENTITY_EDGES, "links": S.LINKS, "insights": S.INSIGHTS, "pending": S.PENDING, "events": S.EVENTS,
        "budgets": S.BUDGETS,
    }
    CLAIM_S = 3_600
    #: From so many parts on a commit to a table rewrites it as one.
    MOST_PARTS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = self._at("versions")
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _pointer(self) -> tuple[int, dict[str, list[str]]]:
        if not self._fs.exists(self._folder):
            return 0, {}
        done = [int(s.getPath().getName()) for s in self._fs.listStatus(self._folder) if s.getPath().getName().isdigit() and self._fs.exists(self._at("versions", s.getPath().getName(), "_SUCCESS"))]
        if not done:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/versions/{max(done)}").first()[0]
        return max(done), json.loads(text)

    def _create(self, text: str, *names: str) -> bool:
        """Create a file with ``text``; false if it is there already."""
        try:
            out = self._fs.create(self._at(*names), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self._fs.exists(self._at(*names)):
                return False
            raise
        out.writeBytes(text)
        out.close()
        return True

    @property
    def version(self) -> int:
        return self._pointer()[0]

    def _load(self, table: str, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(self.TABLES[table]).parquet(*parts) if parts else self.spark.createDataFrame([], self.TABLES[table])

    def read(self, table: str) -> DataFrame:
        """The newest version of a table; an empty one if it was never written."""
        return self._load(table, self._pointer()[1].get(table, []))

    def commit(self, append: dict[str, DataFrame] | None = None, change: dict[str, tuple[DataFrame, tuple[str, ...], Callable[[DataFrame], DataFrame]]] | None = None, **tables: DataFrame) -> int:
        """Make new contents current together; returns the version.

        ``append`` adds rows. ``change`` (ids, columns, function) rewrites by the function those parts of a table in which a row has one of the ids in
        one of the columns. Other ``tables`` are replaced.
        """
        version, current = self._pointer()
        claim = ("versions", f"claim-{version}")
        if not self._create("", *claim):
            age = int(self.spark.sparkContext._jvm.System.currentTimeMillis()) - self._fs.getFileStatus(self._at(*claim)).getModificationTime()
            if self.version != version or age < self.CLAIM_S * 1000 or not self._fs.delete(self._at(*claim), False) or not self._create("", *claim):
                raise ConcurrentCommit(f"version {version} is being built on")
        try:
            if self.version != version:
                raise ConcurrentCommit(f"version {version} has a successor")
            version, new = version + 1, dict(current)

            def write(name: str, kind: str, df: DataFrame) -> str:
                at = f"{self.path}/data/{version}/{name}-{kind}"
                df.select(*(f.split(" ")[0] for f in self.TABLES[name].split(", "))).write.mode("overwrite").parquet(at)
                return at

            for name, df in tables.items():
                new[name] = [write(name, "all", df)]
            for name, (ids, columns, f) in (change or {}).items():
                touched = self._touched(name, current.get(name, []), ids, columns)
                if touched:
                    rest = [p for p in current[name] if p not in touched]
                    new[name] = [*rest, write(name, "changed", f(self._load(name, touched)))]
            for name, df in (append or {}).items():
                parts = new.get(name, [])
                if len(parts) >= self.MOST_PARTS:
                    new[name] = [write(name, "whole", self._load(name, parts).unionByName(df.select(*self._load(name, []).columns)))]
                else:
                    new[name] = [*parts, write(name, "added", df)]
            self.spark.createDataFrame([(json.dumps(new),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/versions/{version}")
        finally:
            self._fs.delete(self._at(*claim), False)
        return version

    def _touched(self, table: str, parts: list[str], ids: DataFrame, columns: tuple[str, ...]) -> list[str]:
        """Those of ``parts`` with a row that has one of ``ids`` (id) in one of ``columns``; only these columns are read."""
        if len(parts) < 2:
            return parts
        rows = self._load(table, parts).select(F.explode(F.array(*columns)).alias("id"), F.regexp_extract(F.input_file_name(), r"/data/\d+/[^/]+", 0).alias("part"))
        found = {r.part for r in rows.join(ids.select("id").distinct(), "id", "left_semi").select("part").distinct().collect()}
        return [p for p in parts if any(p.endswith(f) for f in found)]

    def next_id(self, table: str) -> int:
        return (self.read(table).agg(F.max("id")).first()[0] or 0) + 1

    def acquire(self, process: str, seconds: float, now: datetime) -> bool:
        """Take the lease of ``process`` until ``seconds`` after ``now``; false while another holder's lease runs. A lease that has run out is taken over."""
        ms, name = int(now.timestamp() * 1000), ("leases", process)
        if self._create(f"{ms} {int(seconds * 1000)}", *name):
            return True
        since, lasts = map(int, self.spark.read.text(f"{self.path}/leases/{process}").first()[0].split())
        if ms < since + lasts:
            return False
        self._fs.delete(self._at(*name), False)
        return self._create(f"{ms} {int(seconds * 1000)}", *name)

    def release(self, process: str) -> None:
        self._fs.delete(self._at("leases", process), False)

    def fork(self, path: str) -> Store:
        """An independent copy of the current version of every table."""
        other = Store(self.spark, path)
        other.commit(**{t: self.read(t) for t in self._pointer()[1]})
        return other
