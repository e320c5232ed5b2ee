"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that the rotations are fitted on and search radii are chosen from; queries that are broadcast at once.
FIT_ROWS = 4_096
QUERY_ROWS = 16_384
#: Vectors that a task indexes at once, and queries that it probes with at once.
SEGMENT_ROWS = 16_384
PROBE_ROWS = 128
SUBSTRING_BITS = 16
#: All values of a substring in the order of their bits, and how many have at most so many bits.
FLIPS = np.arange(1 << SUBSTRING_BITS, dtype=np.uint32)
FLIPS = FLIPS[np.argsort(np.bitwise_count(FLIPS), kind="stable")].astype(np.uint16)
WITHIN = np.bincount(np.bitwise_count(FLIPS), minlength=SUBSTRING_BITS + 1).cumsum()


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros((0, 0))
    if len(x):
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
    return x


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """(dim, bits): several orthogonal rotations, each turned by alternating steps so that signs lose least (iterative quantisation)."""
    dim, rng, found = sample.shape[1], np.random.default_rng(seed), []
    for _ in range(-(-bits // dim)):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds if len(sample) else 0):
            u, _, v = np.linalg.svd(np.where(sample @ r >= 0, 1.0, -1.0).T @ sample, full_matrices=False)
            r = v.T @ u.T
        found.append(r)
    return np.hstack(found)[:, :bits]


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """(n, substrings) of 16 bits each."""
    packed = np.packbits(vectors @ rotation >= 0, axis=1)
    return np.ascontiguousarray(packed).view(np.uint16)


def reaches(radius: np.ndarray, tables: int) -> np.ndarray:
    """(n, tables): how many bits of each substring to probe so that every code within ``radius`` bits is met; -1 for none.

    Pigeonhole: with radius = q * tables + k, the first k + 1 substrings may differ by q bits and the others by q - 1; a code that breaks all
    of these bounds differs in more than ``radius`` bits.
    """
    q, k = np.divmod(radius, tables)
    return np.where(np.arange(tables) <= k[:, None], q[:, None], q[:, None] - 1)


class MultiIndex:
    """A table per substring from its value to the codes that hold it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable").astype(np.int32) for s in range(codes.shape[1])]
        self.starts = [np.concatenate(([0], np.bincount(codes[:, s], minlength=1 << SUBSTRING_BITS).cumsum())).astype(np.int32) for s in range(codes.shape[1])]

    def probe(self, asked: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(queries, codes) boolean: the codes that share a near substring with a query, among them every one within its ``radius`` bits.

        Each table is looked up at all values within its reach; where these are more than its codes, the codes are compared instead.
        """
        seen = np.zeros((len(asked), len(self.codes)), bool)
        reach = reaches(radius, self.codes.shape[1])
        for s, (order, starts) in enumerate(zip(self.order, self.starts, strict=True)):
            for t in np.unique(reach[:, s]):
                who = np.flatnonzero(reach[:, s] == t)
                if t < 0:
                    continue
                if WITHIN[min(t, SUBSTRING_BITS)] >= len(self.codes):
                    seen[who] |= np.bitwise_count(asked[who, s][:, None] ^ self.codes[None, :, s]) <= t
                    continue
                values = asked[who, s][:, None] ^ FLIPS[: WITHIN[t]]
                first = starts[values]
                size = starts[values.astype(np.int64) + 1] - first
                row, column = np.nonzero(size)
                size = size[row, column]
                at = np.repeat(first[row, column] - np.cumsum(size) + size, size) + np.arange(size.sum())
                seen[np.repeat(who[row], size), order[at]] = True
        return seen


def radii(kth: np.ndarray, tables: int, chance: float) -> np.ndarray:
    """For each cosine the least radius whose probing meets a vector at that cosine with at least that ``chance``.

    Signs of two vectors at angle a differ with probability a / pi, so the bits that a substring differs by are binomial.
    """
    p = np.arccos(np.clip(kth, -1.0, 1.0)) / np.pi
    ways = np.diff(WITHIN, prepend=0)
    t = np.arange(SUBSTRING_BITS + 1)
    share = (ways * p[:, None] ** t * (1 - p[:, None]) ** (SUBSTRING_BITS - t)).cumsum(1)
    miss = np.concatenate((np.zeros((len(p), 1)), -np.log1p(-np.minimum(share, 1 - 1e-15))), 1)  # first column: no probe
    radius = np.arange(tables * SUBSTRING_BITS)
    q, k = np.divmod(radius, tables)
    met = (k + 1) * miss[:, q + 1] + (tables - k - 1) * miss[:, q]
    return np.argmax(met >= -np.log(1 - chance), axis=1)


def search_segment(ids: np.ndarray, vectors: np.ndarray, asked: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], rotation: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """Rows (q, vec_id, own, score): of one segment the ``k`` + 1 best codes met by each query (ids, vectors, codes, radii), reranked by exact cosine."""
    index, (query_ids, query_vectors, query_codes, radius) = MultiIndex(encode(vectors, rotation)), asked
    for at in range(0, len(query_ids), PROBE_ROWS):
        some, reach = query_codes[at : at + PROBE_ROWS], radius[at : at + PROBE_ROWS].copy()
        seen = index.probe(some, reach)
        while len(short := np.flatnonzero(seen.sum(1) < min(k + 1, len(ids)))):
            reach[short] = np.minimum(reach[short] + rotation.shape[1] // 16, rotation.shape[1])
            seen[short] = index.probe(some[short], reach[short])
        found: list[tuple] = []
        for q, hits in enumerate(seen, at):
            hit = np.flatnonzero(hits)
            score = (vectors[hit] * query_vectors[q]).sum(1)
            if len(hit) > 4 * k:
                near = score >= np.partition(score, len(hit) - k - 1)[len(hit) - k - 1]
                hit, score = hit[near], score[near]
            best = np.lexsort((ids[hit], -score))[: k + 1]
            hit, score = hit[best], score[best]
            found.append((np.full(len(hit), q), ids[hit], (ids[hit] == query_ids[q]) & (vectors[hit] == query_vectors[q]).all(1), score))
        q, vec, own, score = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pd.DataFrame({"q": q, "vec_id": vec, "own": own, "score": score})


def best_of(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The ``k`` + 1 best rows of each query; rows that are the query's own vector come last among equals, so one of them is left if any is."""
    both = pd.concat(found, ignore_index=True).sort_values(["q", "score", "vec_id", "own"], ascending=[True, False, True, False])
    return both[both.groupby("q").cumcount() <= k]


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5, tables: int = 64, chance: float = 0.96, seed: int = 0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of ``candidates`` to each row of ``queries`` by cosine, ties to the smaller id.

    Codes are signs after rotations learned on at most ``FIT_ROWS`` vectors, cut into ``tables`` substrings of 16 bits. Every task indexes its
    candidates by each substring, a segment of ``SEGMENT_ROWS`` at a time, retrieves by pigeonhole probing every code within the query's
    radius (and others that share a near substring), and reranks all that it met by the exact cosine in double precision. The radius is
    the query's own: the least one that meets a vector as near as its ``k``-th neighbour, whose cosine is estimated on the fit sample, with
    the given ``chance``; it grows where a segment has fewer than ``k`` such codes. So every candidate is indexed, no bucket is capped, and recall does not hang on the data. Queries are broadcast in
    blocks of about ``QUERY_ROWS``, each of which takes one pass over the candidates.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; vectors of different lengths never meet
    (one search per length). A query row never finds itself, but finds other rows of its id; repeated query rows are answered each. No query
    or no candidate gives an empty table. Other columns are ignored.
    """
    spark = candidates.sparkSession
    clean = lambda df: df.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    lengths = clean(candidates).groupBy(F.size("v").alias("dim")).count().join(clean(queries).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("asked")), "dim")
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in lengths.orderBy("dim").collect():
        mine = lambda df: clean(df).where(F.size("v") == length["dim"])  # noqa: B023, E731
        sample = unit(mine(candidates).orderBy(F.xxhash64("vec_id"), "v").select("v").limit(FIT_ROWS).toPandas()["v"].to_list())
        rotation = learn_rotations(sample, tables * SUBSTRING_BITS, seed)
        # The rank in the sample that stands for the k-th neighbour in all.
        place = max(0, round(k * len(sample) / length["count"]) - 1)
        blocks = -(-length["asked"] // QUERY_ROWS)
        for block in range(blocks):
            some = mine(queries).where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block) if blocks > 1 else mine(queries)
            found = found.unionByName(_answer(mine(candidates), some, sample, rotation, place, k, tables, chance))
    return found


def _answer(candidates: DataFrame, queries: DataFrame, sample: np.ndarray, rotation: np.ndarray, place: int, k: int, tables: int, chance: float) -> DataFrame:
    """``nearest`` for one block of queries of one length."""
    spark = candidates.sparkSession
    got = queries.groupBy("vec_id", "v").agg(F.count("*").alias("times")).orderBy("vec_id", "v").toPandas()
    vectors, radius = unit(got["v"].to_list()), np.zeros(len(got), np.int64)
    for at in range(0, len(got), 1024):
        sims = vectors[at : at + 1024] @ sample.T
        sims[sims > 1 - 1e-9] = -1  # the query itself, and copies, which any radius meets
        at_place = min(place, sims.shape[1] - 1)
        radius[at : at + 1024] = radii(-np.partition(-sims, at_place, axis=1)[:, at_place], tables, chance)
    sent = spark.sparkContext.broadcast((got["vec_id"].to_numpy(np.int64), vectors, encode(vectors, rotation), radius, rotation))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *asked, turned = sent.value
        best: pd.DataFrame | None = None
        held: list[pd.DataFrame] = []

        def segment() -> pd.DataFrame:
            part = pd.concat(held, ignore_index=True)
            held.clear()
            return best_of([*([] if best is None else [best]), *search_segment(part["vec_id"].to_numpy(np.int64), unit(part["v"].to_list()), tuple(asked), turned, k)], k)

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= SEGMENT_ROWS:
                best = segment()
        if sum(map(len, held)):
            best = segment()
        if best is not None:
            yield best

    hits = candidates.mapInPandas(each, "q long, vec_id long, own boolean, score double")
    listed = hits.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", (~F.col("own")).alias("other")))), 1, k + 1).alias("hits"))
    # One own row goes; without any the last of k + 1 rows is one too many.
    own = F.coalesce(F.nullif(F.array_position(F.transform("hits", lambda h: h["other"]), False), F.lit(0)), F.lit(k + 1))
    others = listed.select("q", F.slice(F.filter("hits", lambda h, i: i + 1 != own), 1, k).alias("hits"))
    names = spark.createDataFrame(pd.DataFrame({"q": range(len(got)), "query_id": got["vec_id"], "times": got["times"]}), "q long, query_id long, times long")
    named = others.join(F.broadcast(names), "q").select("query_id", "hits", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_time"))
    return named.select("query_id", F.posexplode("hits").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.minus")).alias("score"))
