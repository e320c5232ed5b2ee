"""Clusters of episodic records, their consolidation, decay statistics and pruning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import scalars as X
from tidemark.operators.filters import live
from tidemark.operators.graph import cut, scratch_path
from tidemark.operators.vectors import cosines
from tidemark.sources.store import number_rows


def stats(records: DataFrame, as_of: Column) -> DataFrame:
    """One row: counts of live, episodic, semantic and tombstoned records, and mean stability and retention of live ones (0 if none)."""
    alive = ~F.col("tombstoned")
    kept = F.when(alive, X.retention(F.col("last_accessed_at"), F.col("stability"), as_of))
    return records.agg(
        F.count_if(alive).alias("total"), F.count_if(alive & (F.col("tier") == "episodic")).alias("episodic"), F.count_if(alive & (F.col("tier") == "semantic")).alias("semantic"),
        F.count_if(F.col("tombstoned")).alias("tombstoned"), F.coalesce(F.avg(F.when(alive, F.col("stability"))), F.lit(0.0)).alias("avg_stability"),
        F.coalesce(F.avg(kept), F.lit(0.0)).alias("avg_retention"),
    )


def consolidation_candidates(records: DataFrame, min_access: int = S.CLUSTER_ACCESS) -> DataFrame:
    return live(records).where((F.col("tier") == "episodic") & (F.col("access_count") >= min_access))


def similar_pairs(records: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b), a < b, of records whose cosine is at least ``threshold``.

    Records meet in blocks of a bounded number of rows, so a task holds two blocks and not the table; only pairs that pass leave it.
    """
    one, two = (records.select(F.col("id").alias(k), F.col("embedding").alias("v")) for k in "ab")
    return cosines(one, two, threshold, once=True).select("a", "b")


def greedy_clusters(pairs: DataFrame, most_pairs: int = 1 << 20) -> DataFrame:
    """Rows (cluster_id, id): scan ids in order; each one not taken starts a cluster, and later ones join if they pair with every member; no singletons.

    As members join in order of ids, an id's cluster is the first one of which every smaller member pairs with it, and what larger ids do
    does not change it. So ids are taken in ranges, smallest first. For each range joins count, over all tasks, which clusters of earlier
    ranges an id pairs with whole (``_whole``); one task then reads these and the pairs within the range, id by id, and holds no more than the
    range's own members. There are so many ranges that a range has about ``most_pairs`` pairs of its own: their number grows with the root of the pairs.
    """
    spark, ends = pairs.sparkSession, F.array("a", "b")
    once = cut(pairs.where("a <> b").select(F.array_min(ends).alias("a"), F.array_max(ends).alias("b")).distinct())
    total = once.count()
    ranges = max(1, math.ceil((2 * total / max(1, most_pairs)) ** 0.5))
    places = once.select(F.col("a").cast("double").alias("x")).unionByName(once.select(F.col("b").cast("double").alias("x")))
    bounds = sorted({int(x) for x in places.approxQuantile("x", [k / ranges for k in range(1, ranges)], 0.25 / ranges)}) if ranges > 1 else []
    home = lambda c: sum((F.when(F.col(c) > x, 1).otherwise(0) for x in bounds), F.lit(0))
    path = scratch_path(spark)
    once.select("a", "b", home("a").alias("low"), home("b").alias("k")).write.partitionBy("k").parquet(path)
    dealt = spark.read.schema("a long, b long, low int, k int").parquet(path)
    none = once.select(F.col("a").alias("cluster_id"), F.col("b").alias("id")).limit(0)
    found = none
    for k in range(len(bounds) + 1):
        here = dealt.where(F.col("k") == k)
        rows = here.where(F.col("low") == k).select("b", F.lit(1).alias("own"), F.col("a").alias("x"))
        if k:
            rows = rows.unionByName(_whole(here.where(F.col("low") < k), found).select("b", F.lit(0).alias("own"), F.col("cluster_id").alias("x")))
        placed = cut(rows.repartition(1).sortWithinPartitions("b", "own", "x").mapInPandas(_scan, "cluster_id long, id long"))
        found = placed if k == 0 else found.unionByName(placed)
    return found.unionByName(found.select("cluster_id", F.col("cluster_id").alias("id")).distinct())


def _whole(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (b, cluster_id): of the clusters so far, ``found`` (cluster_id, id) and single ids, those of which every member pairs with ``b`` as an ``a``."""
    of = pairs.join(found.withColumnRenamed("id", "a"), "a", "left").select("b", F.coalesce("cluster_id", "a").alias("cluster_id"))
    met = of.groupBy("b", "cluster_id").agg(F.count("*").alias("met"))
    sizes = found.groupBy("cluster_id").agg((F.count("*") + 1).alias("members"))
    return met.join(sizes, "cluster_id", "left").where(F.col("met") == F.coalesce("members", F.lit(1))).select("b", "cluster_id")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (cluster_id, id) of ids that join a cluster, from rows (b, own, x) in order: clusters x of earlier ranges that b pairs with whole, then b's smaller neighbours x in its own range."""
    taken: dict[int, int] = {}  # the cluster of an id of this range that has joined one
    grown: dict[int, int] = {}  # the members of this range that a cluster has

    def place(b: int, whole: list[int], near: list[int]) -> int | None:
        met: dict[int, int] = {}
        for a in near:
            c = taken.get(a, a)
            met[c] = met.get(c, 0) + 1
        first = next((c for c in whole if met.get(c, 0) == grown.get(c, 0)), None)
        if first is None:  # clusters of earlier ranges have smaller ids than those that start here
            started = set(near).difference(taken)
            first = min((c for c in started if met[c] == grown.get(c, 0) + 1), default=None)
        if first is not None:
            taken[b] = first
            grown[first] = grown.get(first, 0) + 1
        return first

    held: tuple[int | None, list[int], list[int]] = (None, [], [])
    for batch in batches:
        joined = []
        ids, starts = np.unique(batch["b"].to_numpy(), return_index=True)
        own, x = batch["own"].to_numpy(), batch["x"].to_numpy()
        for b, i, j in zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
            if b != held[0]:
                if held[0] is not None and (c := place(*held)) is not None:
                    joined.append((c, held[0]))
                held = (b, [], [])
            split = i + int(np.searchsorted(own[i:j], 1))
            held[1].extend(x[i:split].tolist())
            held[2].extend(x[split:j].tolist())
        yield pd.DataFrame(joined, columns=["cluster_id", "id"], dtype="int64")
    if held[0] is not None and (c := place(*held)) is not None:
        yield pd.DataFrame([(c, held[0])], columns=["cluster_id", "id"], dtype="int64")


def temporal_split(members: DataFrame, max_days: float = S.SPREAD_DAYS) -> DataFrame:
    """Rows (cluster_id, part, id): a cluster (cluster_id, id, created_at) that spans more than ``max_days`` is split once at its first largest gap."""
    in_time = Window.partitionBy("cluster_id").orderBy("created_at", "id")
    whole = Window.partitionBy("cluster_id")
    micros = F.unix_micros("created_at")
    gaps = members.withColumn("_gap", micros - F.lag(micros).over(in_time)).withColumn("_n", F.row_number().over(in_time))
    wide = (F.max(micros).over(whole) - F.min(micros).over(whole)) > F.lit(max_days * 86_400_000_000.0)
    gaps = gaps.withColumn("_wide", wide).withColumn("_cut", F.max(F.when(F.col("_gap").isNotNull(), F.struct(F.col("_gap"), (-F.col("_n")).alias("m")))).over(whole))
    return gaps.select("cluster_id", F.when(F.col("_wide") & (F.col("_n") >= -F.col("_cut.m")), 1).otherwise(0).alias("part"), "id")


def large_parts(split: DataFrame, least: int = S.PROCESS_CLUSTER_SIZE) -> DataFrame:
    sized = split.withColumn("_n", F.count("*").over(Window.partitionBy("cluster_id", "part")))
    return sized.where(F.col("_n") >= least).drop("_n")


def retried(summarise: Callable[[DataFrame], DataFrame], rows: DataFrame, times: int = S.SUMMARY_ATTEMPTS) -> tuple[DataFrame, int]:
    """(summaries, calls): what ``summarise`` (cluster_id, ... -> cluster_id, summary, ...) says of each cluster of ``rows``, asked again for those without a summary, ``times`` in all.

    Each cluster asked for is a call. A cluster that stays without an answer has no row.
    """
    open_, done, calls = rows, None, 0
    for _ in range(times):
        asked = open_.select("cluster_id").distinct().count()
        if not asked:
            break
        calls += asked
        said = cut(summarise(open_).where("summary is not null").dropDuplicates(["cluster_id"]))
        done = said if done is None else done.unionByName(said)
        open_ = open_.join(said.select("cluster_id"), "cluster_id", "left_anti")
    return (cut(summarise(rows.limit(0))) if done is None else done), calls


def gate(summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries to store, pending ones): a confidence below one half waits for approval."""
    sure = F.col("confidence") >= S.FALSE_MEMORY_CONFIDENCE
    return summaries.where(sure), summaries.where(~sure)


def pending(unsure: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """Rows for the list of pending consolidations; the id is a hash of what they would consolidate, so it stays the same from cycle to cycle."""
    sources = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("source_ids"))
    name = F.concat(F.lit("pending-"), F.sha2(F.array_join(F.col("source_ids").cast("array<string>"), ","), 256))
    return unsure.join(sources, "cluster_id").select(name.alias("pending_id"), "summary", "confidence", "source_ids", "preserved_facts", "uncertainties", now.alias("created_at"))


def consolidate(records: DataFrame, summaries: DataFrame, members: DataFrame, as_of: Column, next_id: int, deflate: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new records, new edges, source updates) of ``summaries`` (cluster_id, summary, confidence, preserved_facts, uncertainties) of ``members`` (cluster_id, id).

    A semantic record takes the largest importance of its live sources and their largest stability times 1 + confidence / 2, a consolidates
    edge goes to every member named, and the sources stay with half their stability. Clusters without a live source are left out.
    """
    sources = members.join(live(records), "id")
    facts = sources.groupBy("cluster_id").agg(F.max("importance").alias("importance"), F.max("stability").alias("top"), F.array_sort(F.collect_list("id")).alias("source_ids"))
    joined = cut(number_rows(summaries.join(facts, "cluster_id"), "cluster_id", next_id - 1))
    new = joined.select(
        "id", "cluster_id", F.col("summary").alias("data"), F.lit("semantic").alias("tier"), "importance", (F.col("top") * (1 + S.CONSOLIDATION_GAIN * F.col("confidence"))).alias("stability"),
        F.to_json(F.struct("confidence", F.col("preserved_facts").alias("preservedFacts"), "uncertainties", F.col("source_ids").alias("sourceIds"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("consolidatedAt"))).alias("metadata"),
        as_of.alias("created_at"), as_of.alias("last_accessed_at"), F.lit(0).alias("access_count"),
    )
    links = joined.select(F.col("id").alias("from_id"), "cluster_id", "importance").join(members, "cluster_id")
    edges = links.select("from_id", F.col("id").alias("to_id"), F.lit("consolidates").alias("type"), X.initial_stability(F.col("importance")).alias("stability"), as_of.alias("last_accessed_at"))
    half = sources.join(joined.select("cluster_id"), "cluster_id", "left_semi").groupBy("id").agg(F.max("stability").alias("s"), F.count("*").alias("n"))
    return new, edges, half.select("id", (F.col("s") * F.pow(F.lit(0.5), "n")).alias("stability")) if deflate else half.limit(0).select("id", F.col("s").alias("stability"))


def prune(records: DataFrame, edges: DataFrame, as_of: Column, least: float = S.PRUNE_RETENTION, tier: str | None = None) -> DataFrame:
    """Rows (id, action) of live records below the retention: tombstone those a consolidates edge points to, delete the others.

    Records go in id order and a deletion takes its edges along, so an edge from a smaller id that is itself deleted does not count. A chain
    of such edges takes as many rounds as the logarithm of its length.
    """
    weak = live(records).where(X.retention(F.col("last_accessed_at"), F.col("stability"), as_of) < least)
    weak = (weak.where(F.col("tier") == tier) if tier else weak).select("id")
    into = edges.where("type = 'consolidates'").select("from_id", "to_id").distinct().join(weak.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    # Only edges that go up in id between weak records can lose their source first.
    rising = cut(into.where("from_id < to_id").join(weak.withColumnRenamed("id", "from_id"), "from_id", "left_semi"))
    kept = cut(into.join(rising, ["from_id", "to_id"], "left_anti").select(F.col("to_id").alias("id")).distinct())
    # Every round reaches twice as far: what is kept spreads along edges, then each edge takes the place of two in a row.
    while not rising.isEmpty():
        new = rising.join(kept.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id"))
        kept = cut(kept.unionByName(new).distinct())
        above = rising.select(F.col("from_id").alias("top"), F.col("to_id").alias("from_id"))
        twice = rising.join(above, "from_id").select(F.col("top").alias("from_id"), "to_id").distinct()
        rising = cut(twice.join(kept.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select("from_id", "to_id"))
    marked = weak.join(kept.withColumn("_kept", F.lit(True)), "id", "left")
    return marked.select("id", F.when(F.coalesce("_kept", F.lit(False)), "tombstone").otherwise("delete").alias("action"))
