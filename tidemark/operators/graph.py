"""Neighbours and shortest paths in the directed entity graph, one frontier join per hop."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema as S

_own: list[str] = []
_open = threading.local()


def _base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tidemark-"))
        base = _own[0]
    return base.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, inside this thread's open ``scratch`` if there is one."""
    scopes = getattr(_open, "scopes", [])
    return f"{scopes[-1] if scopes else _base(spark)}/{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes inside the block, in this thread, are deleted at its end; nothing lazy that reads them may leave it."""
    path = f"{_base(spark)}/{uuid.uuid4().hex}"
    _open.scopes = [*getattr(_open, "scopes", []), path]
    try:
        yield
    finally:
        _open.scopes = _open.scopes[:-1]
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate table to a fresh folder and read it again."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def touching(edges: DataFrame, ids: list[int]) -> DataFrame:
    """Edges from or to one of ``ids``."""
    return edges.where(F.col("from_id").isin(*ids) | F.col("to_id").isin(*ids))


def new_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Those of ``new`` whose (from_id, to_id, type) is not in ``edges`` yet, each once, the smallest id of repeats."""
    key = ["from_id", "to_id", "type"]
    once = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where("_n = 1").drop("_n")
    return once.join(edges.select(*key), key, "left_anti").select(*edges.columns)


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` and ``new_edges``."""
    return edges.unionByName(new_edges(edges, new))


def neighbors(edges: DataFrame, entities: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Rows (start_id, id, hops): entities that directed edges reach from each of ``starts`` (start_id) in at most ``depth`` hops, 1 to 5, without the start."""
    depth = max(1, min(S.NEIGHBOUR_DEPTH, depth))
    step = edges.select("from_id", "to_id").distinct()
    frontier = starts.select("start_id", F.col("start_id").alias("id"), F.lit(0).alias("hops"))
    seen = frontier
    for hop in range(1, depth + 1):
        reached = frontier.join(step, F.col("id") == F.col("from_id")).select("start_id", F.col("to_id").alias("id")).distinct()
        frontier = reached.join(seen.select("start_id", "id"), ["start_id", "id"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0").join(entities.select("id"), "id", "left_semi").select("start_id", "id", "hops")


def visits(edges: DataFrame, starts: DataFrame, max_hops: int, targets: DataFrame | None = None) -> list[DataFrame]:
    """For each hop the nodes (from_id, node, parent, visit) that a breadth-first search from each of ``starts`` (from_id) meets then for the first time.

    Weights are ignored; each node keeps the parent that is visited first, by the visit order of parents and then edge ids. A hop is one join
    and one written table; paths are not carried along. The search ends as soon as every one of ``targets`` (node) is met from some start.
    """
    at = starts.select("from_id", F.col("from_id").alias("node"), F.lit(None).cast("bigint").alias("parent"), F.lit(1).cast("bigint").alias("visit")).distinct()
    found = [cut(at)]
    step = edges.select(F.col("id").alias("edge"), F.col("from_id").alias("node"), F.col("to_id").alias("next"))
    open_ = None if targets is None else cut(targets.select("node").distinct().join(found[0], "node", "left_anti"))
    for _ in range(max_hops):
        if open_ is not None and open_.isEmpty():
            break
        seen = found[0].select("from_id", F.col("node").alias("next"))
        for earlier in found[1:]:
            seen = seen.unionByName(earlier.select("from_id", F.col("node").alias("next")))
        reached = found[-1].join(step, "node").groupBy("from_id", "next").agg(F.min(F.struct("visit", "edge", "node")).alias("best"))
        fresh = reached.join(seen, ["from_id", "next"], "left_anti")
        order = Window.partitionBy("from_id").orderBy("best.visit", "best.edge")
        new = cut(fresh.select("from_id", F.col("next").alias("node"), F.col("best.node").alias("parent"), F.row_number().over(order).cast("bigint").alias("visit")))
        if new.isEmpty():
            break
        found.append(new)
        open_ = None if open_ is None else cut(open_.join(new, "node", "left_anti"))
    return found


@dataclass
class Search:
    """Both ends of a search: for each hop the nodes first met from a start (from_id, node) or towards a target (to_id, node), and the nodes where a pair's ends met (from_id, to_id, node, i, j), i hops from the start and j from the target."""

    ahead: list[DataFrame]
    back: list[DataFrame]
    meets: DataFrame


def meet_in_the_middle(edges: DataFrame, pairs: DataFrame, max_hops: int) -> Search:
    """Breadth-first from both ends of all ``pairs`` (from_id, to_id) at once, the side with fewer nodes to leave first.

    When the ends are i and j hops deep every pair at a distance below i + j has met, so one at that distance shows in the two newest
    frontiers alone, and leaves the search. A start goes on only while one of its pairs is open, a target likewise. So a hop takes the
    frontiers of open pairs along, and never what a start reaches all around it.
    """
    open_ = cut(pairs.select("from_id", "to_id").where("from_id is not null and to_id is not null").distinct())
    step = cut(edges.select("from_id", "to_id").distinct())
    ahead = [cut(open_.select("from_id", F.col("from_id").alias("node")).distinct())]
    back = [cut(open_.select("to_id", F.col("to_id").alias("node")).distinct())]
    meets: DataFrame | None = None

    def grow(levels: list[DataFrame], key: str, arcs: DataFrame) -> None:
        """One hop along ``arcs`` (node, next) for what is still open, without nodes met before."""
        front = levels[-1].join(open_.select(key).distinct(), key, "left_semi")
        new = front.join(arcs, "node").select(key, F.col("next").alias("node")).distinct()
        for earlier in levels:
            new = new.join(earlier, [key, "node"], "left_anti")
        levels.append(cut(new))

    out = step.select(F.col("from_id").alias("node"), F.col("to_id").alias("next"))
    into = step.select(F.col("to_id").alias("node"), F.col("from_id").alias("next"))
    for depth in range(max_hops + 1):
        if depth:
            here, there = ahead[-1].count(), back[-1].count()
            if not here or not there:
                break
            grow(*((ahead, "from_id", out) if here <= there else (back, "to_id", into)))
        at = cut(open_.join(ahead[-1], "from_id").join(back[-1], ["to_id", "node"]).select("from_id", "to_id", "node", F.lit(len(ahead) - 1).alias("i"), F.lit(len(back) - 1).alias("j")))
        meets = at if meets is None else meets.unionByName(at)
        open_ = cut(open_.join(at, ["from_id", "to_id"], "left_anti"))
        if open_.isEmpty():
            break
    return Search(ahead, back, meets)


def bounded_hops(max_hops: int) -> int:
    return max(1, min(S.MOST_PATH_HOPS, max_hops))


def path_lengths(edges: DataFrame, pairs: DataFrame, max_hops: int = S.PATH_HOPS) -> DataFrame:
    """Rows (from_id, to_id, hops) for the reachable ``pairs`` (from_id, to_id), by a search from both ends; 0 for a pair of one node with itself."""
    meets = meet_in_the_middle(edges, pairs, bounded_hops(max_hops)).meets
    return meets.groupBy("from_id", "to_id").agg(F.first(F.col("i") + F.col("j")).alias("hops"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = S.PATH_HOPS) -> DataFrame:
    """Rows (from_id, to_id, hops, path array<bigint>) for the reachable ``pairs`` (from_id, to_id), by a search from both ends.

    A pair of one node with itself is a path of no hops. Of several shortest paths it is the one that a breadth-first search from the start finds:
    at each step the smallest edge id. From where the ends met, the nodes on shortest paths are followed to either end, hop by hop, and the path
    is then walked from the start along these alone.
    """
    found = meet_in_the_middle(edges, pairs, bounded_hops(max_hops))
    key = ["from_id", "to_id"]
    arcs = edges.select(F.col("id").alias("edge"), F.col("from_id").alias("node"), F.col("to_id").alias("next"))
    deepest = len(found.ahead) + len(found.back) - 2
    lies: dict[int, DataFrame] = {}  # hop from the start: nodes (from_id, to_id, node) of the pairs' shortest paths
    for k in range(len(found.ahead) - 1, -1, -1):
        on = found.meets.where(F.col("i") == k).select(*key, "node")
        if k + 1 in lies:
            before = found.ahead[k].join(arcs, "node").join(lies[k + 1].withColumnRenamed("node", "next"), ["from_id", "next"]).select(*key, "node")
            on = on.unionByName(before)
        lies[k] = cut(on.distinct())
    # Towards the target a pair's hop k is hop i + j - k from it.
    span = found.meets.groupBy(*key).agg(F.first("i").alias("i"), F.first(F.col("i") + F.col("j")).alias("hops"))
    for k in range(1, deepest + 1):
        later = lies[k - 1].join(span.where((F.col("i") < k) & (F.col("hops") >= k)), key).join(arcs, "node").select(*key, F.col("next").alias("node"), (F.col("hops") - k).alias("left"))
        towards = [level.withColumn("left", F.lit(j)) for j, level in enumerate(found.back)]
        every = towards[0]
        for more in towards[1:]:
            every = every.unionByName(more)
        after = later.join(every, ["to_id", "node", "left"]).select(*key, "node")
        lies[k] = cut((lies[k].unionByName(after) if k in lies else after).distinct())
    paths = span.select(*key, "hops", F.array("from_id").alias("path"))
    for k in range(1, deepest + 1):
        going = paths.where(F.col("hops") >= k).withColumn("node", F.element_at("path", -1)).join(arcs, "node")
        step = going.join(lies[k].withColumnRenamed("node", "next"), [*key, "next"]).groupBy(*key).agg(F.min(F.struct("edge", "next")).alias("s"))
        paths = paths.join(step, key, "left").select(*key, "hops", F.when(F.col("s").isNotNull(), F.array_append("path", F.col("s.next"))).otherwise(F.col("path")).alias("path"))
        paths = cut(paths)
    return paths


def from_nearest_seed(edges: DataFrame, seeds: DataFrame, targets: DataFrame, max_hops: int = S.PATH_HOPS) -> DataFrame:
    """Rows (to_id, origin_id, hops, path): for each of ``targets`` (to_id) the shortest path from one of ``seeds`` (from_id, seed_order), the first seed on ties.

    One search from all seeds, which ends when all targets are met; the paths are then followed back for the chosen seed of each target only.
    """
    goals = targets.select(F.col("to_id").alias("node")).distinct()
    found = visits(edges, seeds.select("from_id").distinct(), bounded_hops(max_hops), goals)
    met = None
    for hop, nodes in enumerate(found):
        at = nodes.join(goals, "node", "left_semi").join(seeds, "from_id").select("node", F.struct(F.lit(hop).alias("hops"), "seed_order", "from_id").alias("by"))
        met = at if met is None else met.unionByName(at)
    chosen = cut(met.groupBy("node").agg(F.min("by").alias("b")).select(F.col("node").alias("to_id"), F.col("b.from_id").alias("origin_id"), F.col("b.hops").alias("hops")))
    paths = chosen.withColumn("path", F.array("to_id"))
    for hop in range(len(found) - 1, 0, -1):
        up = found[hop].select(F.col("from_id").alias("_from"), F.col("node").alias("_node"), "parent")
        here = (F.col("hops") >= hop) & (F.col("origin_id") == F.col("_from")) & (F.element_at("path", 1) == F.col("_node"))
        paths = paths.join(up, here, "left").select("to_id", "origin_id", "hops", F.when(F.col("parent").isNotNull(), F.array_prepend("path", F.col("parent"))).otherwise(F.col("path")).alias("path"))
    return paths


def reliability(hops):
    """ok up to five hops and where there is no path, else degraded."""
    return F.when(F.coalesce(hops, F.lit(0)) <= S.RELIABLE_HOPS, "ok").otherwise("degraded")
