"""Hybrid recall: cosine and decay, spreading along record edges, fused ranks, superseded records and their companions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import scalars as X
from tidemark.operators.filters import RecallOptions, live, predicate
from tidemark.operators.graph import cut
from tidemark.operators.ranking import positions
from tidemark.operators.vectors import cosine_of, cosines, exact, matrix, meet


#: Columns of results.
RESULTS = (
    "query_id BIGINT, position INT, id BIGINT, effective_score DOUBLE, rrf_score DOUBLE, is_superseded BOOLEAN, superseding_ids ARRAY<BIGINT>, strategies ARRAY<STRING>, confidence DOUBLE, "
    "section INT, data STRING, metadata STRING, tier STRING, importance DOUBLE, stability DOUBLE, last_accessed_at TIMESTAMP, access_count INT, created_at TIMESTAMP, session_id STRING, "
    "category STRING, sim DOUBLE, ret DOUBLE"
)


class Recall:
    """The parts of a recall. ``results`` is what the caller sees; updates are written only if recall strengthens.

    ``scored``, ``lists`` and ``fused`` hold a row for each query with each candidate. ``results`` and the updates are made without them; they are
    computed where they are asked for. ``decayed`` has the rows (query_id, id, retention) of candidates that have nearly decayed, and needs no scores.
    """

    def __init__(self, results: DataFrame, record_updates: DataFrame, edge_updates: DataFrame, decayed: DataFrame, whole: Callable[[], Ranked]):
        self.results, self.record_updates, self.edge_updates, self.decayed, self._whole = results, record_updates, edge_updates, decayed, whole

    @cached_property
    def ranked(self) -> Ranked:
        return self._whole()

    @property
    def scored(self) -> DataFrame:
        return self.ranked.scored

    @property
    def lists(self) -> DataFrame:
        return self.ranked.lists

    @property
    def fused(self) -> DataFrame:
        return self.ranked.fused


@dataclass
class Ranked:
    """Scores, ranked lists and fused scores of every query with every candidate."""

    scored: DataFrame
    lists: DataFrame
    fused: DataFrame
    ranks: DataFrame


class ModelMismatch(ValueError):
    """The stored vectors are of another embedding model than the query's."""


def check_model(records: DataFrame, model_id: str) -> None:
    """Raise unless the live record with the smallest id has ``model_id``; an empty store passes."""
    first = live(records).orderBy("id").select("embedding_model_id").first()
    if first is not None and (not first[0] or first[0] != model_id):
        raise ModelMismatch(f"stored {first[0] or 'none'}, query {model_id}")


def score(records: DataFrame, queries: DataFrame, as_of: Column, *keep: str) -> DataFrame:
    """Rows (query_id, id, sim, ret, and columns to ``keep``) of each query (query_id, vector) with each record: block products of both sides.

    Ranks run over all candidates, so every pair comes out.
    """
    ret = X.retention(F.col("last_accessed_at"), F.col("stability"), as_of).alias("ret")
    asked = queries.select(F.col("query_id").cast("long").alias("a"), F.col("vector").alias("v"))
    pairs = cosines(asked, records.select(F.col("id").alias("b"), F.col("embedding").alias("v"), ret, *keep))
    return pairs.select(F.col("a").alias("query_id"), F.col("b").alias("id"), "sim", "ret", *keep)


def spread(ranked: DataFrame, edges: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """Rows (query_id, id, assoc_rank, assoc_score) of live records one outgoing edge from the first semantic hits.

    Targets rank by first visit: the hit's rank, then the edge's id. Contradicting edges reach a target but carry no score.
    """
    seeds = ranked.where(F.col("semantic_rank") <= S.SEMANTIC_SEEDS).select("query_id", F.col("id").alias("seed"), "sim", "semantic_rank")
    out = edges.where(F.col("type").isin(*S.EDGE_TYPES)).join(seeds, F.col("from_id") == F.col("seed"))
    carried = F.when(F.col("type").isin(*S.SPREADING_TYPES), F.col("sim") * X.retention(F.col("last_accessed_at"), F.col("stability"), as_of) * S.ASSOCIATIVE_SCORE)
    reached = out.groupBy("query_id", F.col("to_id").alias("id")).agg(
        F.min(F.struct("semantic_rank", F.col("id").alias("edge"))).alias("visit"), F.greatest(F.lit(0.0), F.coalesce(F.max(carried), F.lit(0.0))).alias("assoc_score")
    )
    reached = reached.join(live(records).select("id"), "id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("visit")
    return reached.select("query_id", "id", F.row_number().over(order).alias("assoc_rank"), "assoc_score")


def superseders(edges: DataFrame, as_of: Column) -> DataFrame:
    """Rows (id, superseding_ids) of records with a superseding edge whose retention is above the cut, in edge order."""
    strong = edges.where((F.col("type") == "supersedes") & (X.retention(F.col("last_accessed_at"), F.col("stability"), as_of) > S.SUPERSEDES_RETENTION))
    listed = strong.groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("edge"), "from_id"))).alias("_by"))
    return listed.select("id", F.col("_by.from_id").alias("superseding_ids"))


def companions(rows: DataFrame, shown: DataFrame, scores: Callable[[DataFrame], DataFrame], order: list) -> DataFrame:
    """Live records that supersede one of ``rows`` and are not ``shown``: (query_id, id, sim, ret, injected), each once, in the order of first mention.

    ``scores`` gives (query_id, id, sim, ret) of pairs (query_id, id) of live records.
    """
    named = rows.where(F.size("superseding_ids") > 0).select("query_id", F.struct(*order).alias("_o"), F.posexplode("superseding_ids").alias("_p", "id"))
    first = named.groupBy("query_id", "id").agg(F.min(F.struct("_o", "_p")).alias("_first"))
    new = cut(first.join(shown.select("query_id", "id"), ["query_id", "id"], "left_anti"))
    new = new.join(scores(new.select("query_id", "id")).select("query_id", "id", "sim", "ret"), ["query_id", "id"])
    return new.select("query_id", "id", "sim", "ret", F.row_number().over(Window.partitionBy("query_id").orderBy("_first")).alias("injected"))


def best_first(sims: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by falling score, a null (NaN) last, then by id."""
    return np.lexsort((ids, np.where(np.isnan(sims), np.inf, -sims)))


def survivors(pool: DataFrame, queries: DataFrame, threshold: float, spare: int) -> DataFrame:
    """Rows (query_id, id, sim, ret) that can be in a result: of each block of ``pool`` with a query those that pass ``threshold``, the first semantic ones and the best ``spare`` below it.

    Blocks are scored in the tasks and only these rows leave them, so no table of queries times records is written.
    """

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p, q, ids, ret = matrix(x["v"]), matrix(y["v"]), y["b"].to_numpy(), y["ret"].to_numpy(float)
        out = []
        for k in range(len(x)):
            sim = exact(p, np.full(len(y), k), q, np.arange(len(y)))
            score = sim * ret
            kept = score >= threshold
            order = best_first(sim, ids)
            kept[order[: S.SEMANTIC_SEEDS]] = True
            if spare:
                below = order[(score < threshold)[order] & (sim > S.TOP_UP_COSINE)[order]]
                kept[below[np.argsort(-score[below], kind="stable")[:spare]]] = True
            at = np.flatnonzero(kept)
            out.append(pd.DataFrame({"query_id": x["a"].iloc[k], "id": ids[at], "sim": np.where(np.isnan(sim[at]), None, sim[at].astype(object)), "ret": ret[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "sim": [], "ret": []})

    asked = queries.select(F.col("query_id").cast("long").alias("a"), F.col("vector").cast("array<double>").alias("v"))
    rows = pool.select(F.col("id").alias("b"), F.col("embedding").cast("array<double>").alias("v"), "ret")
    return meet(asked, rows, "query_id long, id long, sim double, ret double", cell)


def count_ranks(pool: DataFrame, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (query_id, id, semantic_rank, temporal_rank, entity_rank) of ``wanted`` (query_id, id, sim, ret), a bounded number for each query, among all of ``pool``.

    Each block counts, for its query, how many of its rows come before each wanted one; the counts are summed up. The entity rank counts
    named rows only, and is null for a row that is not.
    """

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p, q, ids, ret, named = matrix(x["v"]), matrix(y["v"]), y["b"].to_numpy(), y["ret"].to_numpy(float), y["named"].to_numpy(bool)
        out = []

        def before(scores: np.ndarray, rows: np.ndarray, at: np.ndarray, goals: np.ndarray) -> list[int]:
            order = best_first(scores, rows)
            falling, rows = np.where(np.isnan(scores), np.inf, -scores)[order], rows[order]
            first, last = np.searchsorted(falling, -goals, "left"), np.searchsorted(falling, -goals, "right")
            return [int(a + np.searchsorted(rows[a:b], i)) for a, b, i in zip(first, last, at, strict=True)]

        for k in range(len(x)):
            sim = exact(p, np.full(len(y), k), q, np.arange(len(y)))
            at, goals, far = np.array(x["ids"].iloc[k]), np.array(x["sims"].iloc[k]), np.array(x["rets"].iloc[k])
            out.append(pd.DataFrame({"query_id": x["a"].iloc[k], "id": at, "s": before(sim, ids, at, goals), "t": before(sim * ret, ids, at, goals * far), "e": before(sim[named], ids[named], at, goals), "own": np.isin(at, ids[named])}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "id", "s", "t", "e", "own")})

    lists = wanted.groupBy("query_id").agg(F.collect_list(F.struct("id", "sim", "ret")).alias("w"))
    asked = queries.select("query_id", "vector").join(lists, "query_id").select(
        F.col("query_id").cast("long").alias("a"), F.col("vector").cast("array<double>").alias("v"), F.col("w.id").alias("ids"), F.col("w.sim").alias("sims"), F.col("w.ret").alias("rets")
    )
    rows = pool.select(F.col("id").alias("b"), F.col("embedding").cast("array<double>").alias("v"), "ret", "named")
    counts = meet(asked, rows, "query_id long, id long, s long, t long, e long, own boolean", cell).groupBy("query_id", "id").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("e").alias("e"), F.max("own").alias("own"))
    rank = lambda c: (F.col(c) + 1).cast("int")
    return counts.select("query_id", "id", rank("s").alias("semantic_rank"), rank("t").alias("temporal_rank"), F.when(F.col("own"), rank("e")).alias("entity_rank"))


def recall(records: DataFrame, edges: DataFrame, queries: DataFrame, options: RecallOptions, as_of: Column) -> Recall:
    """Answer all ``queries`` (query_id, vector) together.

    Ranks over all candidates feed the fused score; the effective score, similarity times retention, decides about the threshold and the
    order. Records that edges reach from the first hits come in even if a filter excludes them, with the spread score as similarity.

    A first pass over the records keeps what can be a result (``survivors``), a second counts the ranks of what is one (``count_ranks``); without a
    limit the results may be as many as the candidates, and ranks come from the ranked lists. Either table is written once (``cut``).
    """
    o = options
    named, by_entity = F.lit(False), o.entity_name is not None or o.entity_type is not None
    if by_entity:
        named = X.has_entity(X.entities_of(F.col("metadata")), o.entity_name, o.entity_type)
    ret = X.retention(F.col("last_accessed_at"), F.col("stability"), as_of)
    marked = live(records).withColumn("in_pool", F.coalesce(predicate(o), F.lit(False))).withColumn("named", F.coalesce(named, F.lit(False))).withColumn("ret", ret)
    pool = marked.where("in_pool").select("id", "embedding", "ret", "named")
    kept = cut(survivors(pool, queries, o.threshold, o.min_results))
    first = Window.partitionBy("query_id").orderBy(F.col("sim").desc_nulls_last(), "id")
    seeds = kept.withColumn("semantic_rank", F.row_number().over(first)).where(F.col("semantic_rank") <= S.SEMANTIC_SEEDS)
    reached = cut(spread(seeds, edges, records, as_of))
    whole = cache(lambda: rank_all(marked, edges, queries, by_entity, reached, as_of))

    def pointed(pairs: DataFrame) -> DataFrame:
        """Scores of single pairs (query_id, id), of live records in the pool or not."""
        both = pairs.join(queries.select("query_id", "vector"), "query_id").join(marked.select("id", "embedding", "ret", "in_pool"), "id")
        return both.select("query_id", "id", cosine_of("vector", "embedding").alias("sim"), "ret", "in_pool")

    near = pointed(reached.join(kept.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id"))
    every = kept.withColumn("in_pool", F.lit(True)).unionByName(near).join(reached, ["query_id", "id"], "left")
    inside = F.col("in_pool")
    sim = F.when(inside, F.col("sim")).otherwise(F.col("assoc_score"))
    no_ids = F.array().cast("array<bigint>")
    fused = every.select(
        "query_id", "id", sim.alias("sim"), "ret", (sim * F.col("ret")).alias("effective_score"), "in_pool", "assoc_rank",
        F.array_compact(F.array(F.when(inside, "semantic"), F.when(inside, "temporal"), F.when(F.col("assoc_rank").isNotNull(), "associative"))).alias("strategies"),
    ).join(superseders(edges, as_of), "id", "left").withColumn("superseding_ids", F.coalesce("superseding_ids", no_ids))
    fused = cut(fused)

    # The order of semantic ranks, known without the ranks: those in the pool by similarity and id, then the others.
    semantic = lambda: [F.when(inside, F.col("sim")).desc_nulls_last(), F.when(inside, F.col("id")).asc_nulls_last(), F.col("assoc_rank").asc_nulls_last()]
    stable = [F.when(inside, 0).otherwise(1).alias("a"), F.when(inside, -F.col("sim")).alias("b"), F.when(inside, F.col("id")).otherwise(F.col("assoc_rank")).alias("c")]
    passing = fused.where(F.col("effective_score") >= o.threshold).withColumn("injected", F.lit(0))
    brought = cut(companions(passing, passing, pointed, stable))

    def as_rows(extra: DataFrame) -> DataFrame:
        return extra.select(
            "query_id", "id", "sim", "ret", (F.col("sim") * F.col("ret")).alias("effective_score"), F.lit(False).alias("in_pool"), F.lit(None).cast("int").alias("assoc_rank"),
            F.array(F.lit("companion")).alias("strategies"), no_ids.alias("superseding_ids"), "injected",
        )

    shown = passing.unionByName(as_rows(brought)).withColumn("section", F.lit(0)).withColumn("_place", F.lit(0))
    if o.min_results:
        have = queries.select("query_id").join(shown.groupBy("query_id").agg(F.count("*").alias("_have")), "query_id", "left")
        below = fused.where((F.col("effective_score") < o.threshold) & (F.col("sim") > S.TOP_UP_COSINE))
        below = below.join(have.where(F.coalesce("_have", F.lit(0)) < o.min_results), "query_id")
        by_score = Window.partitionBy("query_id").orderBy(F.desc("effective_score"), *semantic())
        more = below.withColumn("_place", F.row_number().over(by_score)).where(F.col("_place") <= o.min_results - F.coalesce("_have", F.lit(0)))
        more = cut(more.withColumn("injected", F.lit(0)).withColumn("section", F.lit(1)).drop("_have"))
        late = companions(more, shown.select("query_id", "id").unionByName(more.select("query_id", "id")), pointed, [F.col("_place")])
        late_rows = as_rows(late).withColumn("section", F.lit(2)).withColumn("_place", F.col("injected"))
        shown = shown.unionByName(more).unionByName(late_rows)

    facts = records.select("id", "data", "metadata", "tier", "importance", "stability", "last_accessed_at", "access_count", "created_at", "session_id", "category")
    keys = facts.select("id", "last_accessed_at", "stability", "importance")
    key = {"confidence": "effective_score", "recency": "last_accessed_at", "stability": "stability", "importance": "importance"}[o.sort]
    order = Window.partitionBy("query_id").orderBy("section", "_place", F.when(F.col("section") == 0, F.col(key)).desc(), *semantic(), "injected")
    placed = shown.join(keys, "id").withColumn("position", F.row_number().over(order)).drop("last_accessed_at", "stability", "importance")
    if o.limit is not None:
        placed = placed.where(F.col("position") <= o.limit)
    placed = cut(placed)
    wanted = placed.where("in_pool").select("query_id", "id", "sim", "ret")
    ranks = whole().ranks if o.limit is None else count_ranks(pool, queries, wanted)
    if not by_entity:
        ranks = ranks.withColumn("entity_rank", F.lit(None).cast("int"))
    terms = [F.coalesce(X.rrf(F.col(c)), F.lit(0.0)) for c in ("semantic_rank", "temporal_rank", "assoc_rank", "entity_rank")]
    full = placed.join(ranks.select("query_id", "id", "semantic_rank", "temporal_rank", "entity_rank").withColumn("in_pool", F.lit(True)), ["query_id", "id", "in_pool"], "left")
    full = full.withColumn("rrf_score", F.when(F.col("injected") > 0, 0.0).otherwise(terms[0] + terms[1] + terms[2] + terms[3])).join(facts, "id")
    confident = F.when((F.col("tier") == "semantic") & ~F.array_contains("strategies", "companion"), F.get_json_object("metadata", "$.confidence").cast("double"))
    results = cut(full.select(
        "query_id", "position", "id", "effective_score", "rrf_score", (F.size("superseding_ids") > 0).alias("is_superseded"), "superseding_ids", "strategies",
        confident.alias("confidence"), "section", "data", "metadata", "tier", "importance", "stability", "last_accessed_at", "access_count", "created_at", "session_id", "category",
        "sim", "ret",
    ))

    # The first of the whole order, before the limit, sets the scale of the fused scores; a limit keeps it.
    top = results.where("section = 0").groupBy("query_id").agg(F.min_by("rrf_score", "position").alias("_top"))
    again = results.where("section = 0").join(top, "query_id").withColumn("_near", F.array_contains("strategies", "associative"))
    on_graph = again.join(reached.select("query_id", "id", F.lit(True).alias("_reached")), ["query_id", "id"], "left")
    share = F.when(F.col("_top") > 0, F.col("rrf_score") / F.col("_top")).otherwise(1.0) * F.when(F.coalesce("_reached", F.lit(False)), S.ASSOCIATIVE_STRENGTHEN).otherwise(1.0)
    record_updates = on_graph.select(
        "query_id", "id", X.strengthened(F.col("stability"), F.col("ret"), share).alias("stability"), as_of.alias("last_accessed_at"), (F.col("access_count") + 1).alias("access_count")
    )
    hit = edges.where("type = 'supersedes'").join(passing.select("query_id", F.col("id").alias("to_id")), "to_id")
    kept_edges = X.retention(F.col("last_accessed_at"), F.col("stability"), as_of)
    edge_updates = hit.select("query_id", "id", F.least(F.lit(S.MAX_STABILITY), F.col("stability") * X.growth(kept_edges)).alias("stability"), as_of.alias("last_accessed_at"))
    faint = marked.where(F.col("ret") < S.DECAY_RETENTION).select("id", "ret", "in_pool")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id")).crossJoin(faint.where("in_pool"))
    beside = reached.select("query_id", "id").join(faint.where("not in_pool"), "id")
    decayed = asked.unionByName(beside).select("query_id", "id", F.col("ret").alias("retention"))
    return Recall(results, record_updates, edge_updates, decayed, whole)


def rank_all(marked: DataFrame, edges: DataFrame, queries: DataFrame, by_entity: bool, reached: DataFrame, as_of: Column) -> Ranked:
    """Every query with every candidate: scores, the ranked lists, and the fused scores, which hold what ``reached`` brought in as well."""
    everyone = cut(score(marked, queries, as_of, "in_pool", "named"))
    scored = everyone.where("in_pool").withColumn("temporal", F.col("sim") * F.col("ret"))
    ranked = cut(positions(cut(positions(scored, "query_id", "sim", "id", "semantic_rank")), "query_id", "temporal", "id", "temporal_rank"))
    listed = [
        ranked.select("query_id", "id", F.lit("semantic").alias("list"), F.col("semantic_rank").alias("rank")),
        ranked.select("query_id", "id", F.lit("temporal").alias("list"), F.col("temporal_rank").alias("rank")),
        reached.select("query_id", "id", F.lit("associative").alias("list"), F.col("assoc_rank").alias("rank")),
    ]
    ranked = ranked.withColumn("entity_rank", F.lit(None).cast("int"))
    if by_entity:
        of_named = cut(positions(scored.where("named").select("query_id", "id", "sim"), "query_id", "sim", "id", "entity_rank"))
        listed.append(of_named.select("query_id", "id", F.lit("entity").alias("list"), F.col("entity_rank").alias("rank")))
        ranked = ranked.drop("entity_rank").join(of_named.select("query_id", "id", "entity_rank"), ["query_id", "id"], "left")
    lists = listed[0]
    for more in listed[1:]:
        lists = lists.unionByName(more)
    beside = reached.select("query_id", "id").join(everyone.select("query_id", "id", F.col("ret").alias("_ret")), ["query_id", "id"])
    joined = ranked.join(reached, ["query_id", "id"], "full").join(beside, ["query_id", "id"], "left")
    terms = [F.coalesce(X.rrf(F.col(c)), F.lit(0.0)) for c in ("semantic_rank", "temporal_rank", "assoc_rank", "entity_rank")]
    inside = F.col("semantic_rank").isNotNull()
    sim, ret = F.when(inside, F.col("sim")).otherwise(F.col("assoc_score")), F.coalesce("ret", "_ret")
    fused = joined.select(
        "query_id", "id", sim.alias("sim"), ret.alias("ret"), (sim * ret).alias("effective_score"), (terms[0] + terms[1] + terms[2] + terms[3]).alias("rrf_score"),
        "semantic_rank", "temporal_rank", "assoc_rank",
        F.array_compact(F.array(F.when(inside, "semantic"), F.when(inside, "temporal"), F.when(F.col("assoc_rank").isNotNull(), "associative"))).alias("strategies"),
    )
    fused = cut(fused.join(superseders(edges, as_of), "id", "left").withColumn("superseding_ids", F.coalesce("superseding_ids", F.array().cast("array<bigint>"))))
    return Ranked(scored, lists, fused, ranked)
