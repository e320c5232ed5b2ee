"""SimHash near-duplicates: fingerprints, then exact Hamming links by vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import identity, smallest_reachable, stash

HASH_SEED = 42
#: Distinct fingerprints that the shared top of the tree is built from, about how many a shard then holds, and shards at most: boundaries
#: overlap, so every doubling of the shards makes the rows about a quarter more.
SAMPLE_ROWS = 65_536
SHARD_ROWS, MOST_SHARDS = 16_384, 4_096
#: Fingerprints that no ball splits are a crowd from so many expected rows on; it is not one shard then.
CROWD_ROWS = 131_072
#: Below this many fingerprints a node is compared pair by pair.
LEAF_ROWS = 1_024
BLOCK_WORDS = 1 << 13
#: Wide fingerprints: pieces of 24 bits, each with a tree of its own, and bytes by which what meets in a piece is told apart.
PIECES, PIECE_BYTES, CHECK_BYTES = 24, 3, 16
FACTORS = np.random.default_rng(HASH_SEED).integers(0, 1 << 63, (PIECES * PIECE_BYTES + CHECK_BYTES) // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Standard deviations of the bits that differ, by which candidates may be farther apart than their similarity lets expect.
SIGMAS = 2.5
#: Two values of a piece that differ in one bit at most are equal in one of its halves, of so many bits.
HALF_BITS = 4 * PIECE_BYTES
#: Rows that a task joins at once by their pieces; from so many pairs on that meet at one half, pivots are compared first.
MEET_ROWS, MANY_PAIRS = 1 << 17, 1 << 20
#: Documents whose sets of shingles a task compares with each other at once, and how many a larger crowd offers to all its blocks first: what these
#: link needs no comparison between blocks.
BLOCK_DOCS, OFFERS = 128, 16
#: Rows of five longs that are broadcast, at most.
BROADCAST_ROWS = 1 << 19


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the ``width``-word shingles of a text, A-Z lower-cased, in blocks; of the whole sequence if that is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if 0 < len(words) < width:
        yield np.array([digest(joined, HASH_SEED)], np.uint64)
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = len(words) - width + 1
    for at in range(0, total, BLOCK_WORDS):
        to = min(total, at + BLOCK_WORDS)
        pairs = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        yield np.array([digest(joined[a:b], HASH_SEED) for a, b in pairs], np.uint64)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of ``rows`` (n, words) have each bit set: (words * 64), lowest bit of the first word first. So few rows are added at a time that a byte holds their sum."""
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")
    ones = np.zeros(bits.shape[1], np.int64)
    for at in range(0, len(bits), 255):
        ones += bits[at : at + 255].sum(0, dtype=np.uint8)
    return ones


def majority(blocks: Iterator[np.ndarray], words: int) -> np.ndarray:
    """(words) of 64 bits, each set if over half of the rows of all ``blocks`` have it set."""
    ones, total = np.zeros(64 * words, np.int64), 0
    for rows in blocks:
        ones, total = ones + bit_counts(rows), total + len(rows)
    return np.packbits(2 * ones > total, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles of a text, A-Z lower-cased; 0 without words. Signed, as Spark's long."""
    return int(majority((h[:, None] for h in shingle_hashes(text, width)), 1).view(np.int64)[0])


def wide_fingerprint(hashes: Callable[[], Iterator[np.ndarray]]) -> np.ndarray:
    """SimHash of all pieces and the check bits; each shingle's hash is spread over all words by multiplication and shifts."""

    def spread(h: np.ndarray) -> np.ndarray:
        x = (h[:, None] ^ (h[:, None] >> np.uint64(31))) * FACTORS
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    return majority(map(spread, hashes()), len(FACTORS)).view(np.int64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, fp) per row of ``docs``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t) for t in b["text"]], np.int64)})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(each, "doc_id long, fp long")


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def split(points: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """A vantage point among ``points`` and the ball radius that leaves the least of them on both sides of the boundary.

    None if every ball would leave a side with more than four fifths of all.
    """
    best = None
    for k in np.linspace(0, len(at) - 1, 5).astype(int):
        ball = np.bincount(distances(points[at], points[at[k]]), minlength=65).cumsum()
        for mu in range(0, 64 - radius):
            sides = (int(ball[mu + radius]), len(at) - int(ball[mu]))
            if max(sides) <= 0.8 * len(at) and (best is None or sum(sides) + max(sides) < best[0]):
                best = (sum(sides) + max(sides), points[at[k]], mu)
    return best and best[1:]


def top_tree(sample: np.ndarray, rows: int, radius: int, shard_rows: int = SHARD_ROWS):
    """Nested (vantage, mu, near, far) down to shard numbers, so that each shard gets about its share of ``rows``; a negative number is a crowd."""
    shards = min(MOST_SHARDS, -(-rows // shard_rows))
    size, numbers = max(2, len(sample) // max(1, shards)), iter(range(1, 1 << 40))

    def grow(at: np.ndarray):
        found = split(sample, at, radius) if len(at) > size else None
        if found is None:
            crowd = len(at) > 2 * size and len(at) * rows > CROWD_ROWS * len(sample)
            return -next(numbers) if crowd else next(numbers)
        d = distances(sample[at], found[0])
        return (*found, grow(at[d <= found[1] + radius]), grow(at[d > found[1]]))

    return grow(np.arange(len(sample)))


def route(tree, points: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) of all shards: a point goes to its own side of each ball, and from just outside the ball to the inside as well.

    By the triangle inequality two points within ``radius`` of each other share a shard: if they are on different sides, the outer one is
    at most ``radius`` outside.
    """
    if not isinstance(tree, tuple):
        yield tree, at
        return
    vantage, mu, near, far = tree
    d = distances(points[at], vantage)
    yield from route(near, points, at[d <= mu + radius], radius)
    yield from route(far, points, at[d > mu], radius)


class Forest:
    """Union-find over positions, smallest position as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            np.minimum.at(root, hi, lo)
            while not np.array_equal(root, jump := root[root]):
                root[:] = jump
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]


def link(points: np.ndarray, radius: int, close: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For each of ``points`` the smallest position that it reaches by steps of at most ``radius`` bits, which ``close`` (two positions each) may deny.

    Splits by vantage points as long as that helps; what is left is compared in blocks, but a large node first loses the points that are in
    one component with a vantage point already: those need no comparison among each other.
    """
    forest, todo = Forest(len(points)), [np.arange(len(points))]

    def compare(one: np.ndarray, all_: np.ndarray) -> None:
        i, j = np.nonzero(np.bitwise_count(points[one, None] ^ points[None, all_]) <= radius)
        a, b = one[i], all_[j]
        if close is not None:
            open_ = forest.root[a] != forest.root[b]
            a, b = a[open_], b[open_]
            fits = close(a, b)
            a, b = a[fits], b[fits]
        forest.join(a, b)

    while todo:
        at = todo.pop()
        found = split(points, at, radius) if len(at) > LEAF_ROWS else None
        if found is not None:
            d = distances(points[at], found[0])
            todo += [at[d <= found[1] + radius], at[d > found[1]]]
            continue
        if len(at) > 4 * LEAF_ROWS:
            for k in np.linspace(0, len(at) - 1, 64).astype(int):
                compare(at[k : k + 1], at)
            roots, count = np.unique(forest.root[at], return_counts=True)
            rest = at[forest.root[at] != roots[count.argmax()]]
        else:
            rest = at
        for k in range(0, len(rest), 512):
            compare(rest[k : k + 512], rest[k:] if rest is at else at)
    return forest.root


def neighbour_links(crowd: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of a crowd (fp, rep), distinct fingerprints in very large numbers so near each other that no ball splits them.

    Two fingerprints one bit apart are equal without that bit; two fingerprints at most two bits apart have a neighbour at one bit in common.
    So points meet at such keys, at most 65 at each, however many there are in all.
    """
    if radius == 0:
        return crowd.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    near = "array_append(transform(sequence(0, 63), i -> struct(0 AS bit, fp ^ shiftleft(1L, i) AS key)), struct(0 AS bit, fp AS key))"
    without = "transform(sequence(0, 63), i -> struct(i AS bit, fp & ~shiftleft(1L, i) AS key))"
    keyed = crowd.select("rep", F.explode(F.expr(near if radius == 2 else without)).alias("at")).groupBy("at")
    met = keyed.agg(F.min("rep").alias("b"), F.collect_list("rep").alias("all")).where(F.size("all") > 1)
    return met.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs``: 16 hex digits, and the smallest doc_id that links reach.

    Documents whose fingerprints of three-word shingles differ in at most ``radius`` bits, 0 to 2, link. Equal fingerprints come first: one
    representative each, the smallest doc_id, combined before the shuffle, so groups of copies are one row. The representatives go to shards
    of a vantage-point tree, whose top is fitted on at most ``SAMPLE_ROWS`` of them (an index; every row is routed), and each shard links its
    own points by a tree of its own; a crowd that no ball splits is linked by ``neighbour_links`` and not in one shard. A shard gives one link
    per linked point, never all pairs. Shards overlap at boundaries, so no link is lost; all links meet in ``smallest_reachable``.

    A null or empty text has fingerprint zero and links like any other. Rows with a null doc_id get a fingerprint, take no part in links and
    have a null component_id. Repeated rows give repeated rows; an empty table gives an empty one. Other columns are ignored.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    marked = stash(fingerprints(docs, doc_id, text))
    classes = stash(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    n = classes.count()
    sample = classes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE_ROWS).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = top_tree(np.sort(sample), n, radius)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points, rep = b["fp"].to_numpy(np.int64).view(np.uint64), b["rep"].to_numpy()
            for shard, at in route(tree, points, np.arange(len(points)), radius):
                if len(at):
                    yield pd.DataFrame({"shard": shard, "fp": points[at].view(np.int64), "rep": rep[at]})

    def stars(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("rep", ignore_index=True)
        root = link(shard["fp"].to_numpy(np.int64).view(np.uint64), radius)
        linked = root != np.arange(len(root))
        return pd.DataFrame({"a": shard["rep"].to_numpy()[linked], "b": shard["rep"].to_numpy()[root[linked]]})

    dealt = stash(classes.mapInPandas(deal, "shard long, fp long, rep long"))
    links = dealt.where("shard > 0").groupBy("shard").applyInPandas(stars, "a long, b long")
    links = links.unionByName(neighbour_links(dealt.where("shard < 0").select("fp", "rep").distinct(), radius))
    roots = smallest_reachable(links)
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = marked.where("doc_id is not null").join(named, "fp").unionByName(marked.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``code``, some ``MEET_ROWS`` at a time, so that those that share a half of a piece stay together."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= MEET_ROWS:
            part = pd.concat(held, ignore_index=True)
            keys = part["code"].to_numpy() >> HALF_BITS
            open_ = int(np.searchsorted(keys, keys[-1]))
            if open_:
                yield part.iloc[:open_]
            held = [part.iloc[open_:]]
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def meetings(code: np.ndarray, check: np.ndarray, limit: int, many_pairs: int = MANY_PAIRS) -> np.ndarray:
    """For each point the smallest position that candidates reach from it; points are in the order of ``code``, groups are whole.

    A code is piece and half, the bits of that half, by which points were dealt, and the bits of the other one, by which they are looked up here.
    Candidates are at most one bit apart in the piece and at most ``limit`` bits in ``check``. Where very many pairs meet, ``link`` compares them.
    """
    forest, key, n = Forest(len(code)), code >> HALF_BITS, len(code)
    met, pairs = [], np.zeros(n, np.int64)
    for flip in (0, *(1 << k for k in range(HALF_BITS))):
        # Equal pieces meet at both halves, and count at the first.
        rows = np.flatnonzero(code & flip if flip else ~(code >> 2 * HALF_BITS) & 1)
        low = np.searchsorted(code, code[rows] ^ flip, "left")
        count = (np.searchsorted(code, code[rows] ^ flip, "right") if flip else rows) - low
        some = count > 0
        met.append((rows[some], low[some], count[some]))
        pairs[rows] += count
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], n]
    crowded = np.add.reduceat(pairs, starts) > many_pairs if n else np.zeros(0, bool)
    alone = np.repeat(~crowded, ends - starts)
    near = lambda a, b: np.bitwise_count(check[a] ^ check[b]).sum(1, dtype=np.int64) <= limit
    for rows, low, count in met:
        rows, low, count = (x[alone[rows]] for x in (rows, low, count))
        upto = np.cumsum(count)
        for at in range(0, int(upto[-1]) if len(upto) else 0, many_pairs):
            k = np.arange(at, min(at + many_pairs, int(upto[-1])))
            of = np.searchsorted(upto, k, "right")
            a, b = rows[of], low[of] + k - (upto[of] - count[of])
            fits = near(a, b)
            forest.join(a[fits], b[fits])
    for s, e in zip(starts[crowded].tolist(), ends[crowded].tolist(), strict=True):
        points = (code[s:e] & ((1 << HALF_BITS) - 1)).astype(np.uint64)
        forest.root[s:e] = s + link(points, 1, lambda a, b, s=s: near(s + a, s + b))
    return forest.root


def link_sets(sets: list[np.ndarray], label: np.ndarray, similarity: float, one: np.ndarray | None = None, rest: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest position that it reaches by equal labels and by sets of that Jaccard similarity.

    Compared are all sets with each other, or those at positions ``one`` with those at positions ``rest``, unless they are linked already.
    """
    size, forest = np.array(list(map(len, sets)), np.int64), Forest(len(sets))
    _, first, same = np.unique(label, return_index=True, return_inverse=True)
    forest.join(np.arange(len(sets)), first[same])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ids = np.split(ids, np.cumsum(size)[:-1])
    inside = np.zeros(1 + max((int(x.max()) for x in ids if len(x)), default=0), bool)
    for i in range(len(sets)) if one is None else one.tolist():
        other = np.arange(i) if one is None else rest
        other = other[(forest.root[other] != forest.root[i]) & (np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i]) - 1e-9) & (size[other] > 0)]
        if len(other):
            inside[ids[i]] = True
            both = np.add.reduceat(inside[np.concatenate([ids[j] for j in other.tolist()])], np.r_[0, np.cumsum(size[other])[:-1]], dtype=np.int64)
            inside[ids[i]] = False
            fits = both >= similarity * (size[i] + size[other] - both) - 1e-9
            forest.join(np.full(int(fits.sum()), i), other[fits])
    return forest.root


def farthest(bits: int, similarity: float) -> int:
    """Bits of a fingerprint of that many in which texts of the similarity may differ: as expected, and ``SIGMAS`` standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + SIGMAS * math.sqrt(bits * p * (1 - p)))


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (_h1, _h2, times, keep) per distinct row of ``docs``: its ``identity``, how often it is there, and whether it is the first of its group.

    Two documents link if the Jaccard similarity of their sets of ``width``-word shingles is ``similarity`` or more, which is checked on the sets
    themselves. What to check comes from wide fingerprints. At such distances a ball leaves nearly all points on both sides of its boundary, so
    no tree over whole fingerprints prunes; instead each of their pieces of 24 bits is looked up: values one bit apart are equal in one half of the
    piece, so a document is dealt twice for each piece, however many there are in all. What meets is a candidate if the check bits differ in no more
    than the similarity lets expect (``farthest``). Two documents at 0.8 meet in at least one of the pieces with a chance of 0.92, at 0.85 of 0.98.

    What candidates connect is a crowd, and only documents of crowds are read again. In a crowd all sets are compared, a block of ``BLOCK_DOCS`` by
    itself first, together with some documents that all blocks get. What is then not in the crowd's largest group is compared with all others,
    block by block. So no table of pairs is made, and yet no pair of a crowd that would link two groups stays unchecked.

    Equal sets of shingles are one point from the start, so groups of copies are one row. The first of a group has the smallest doc_id, null last,
    then the smallest identity. Null and empty texts are copies of each other. All columns tell rows apart; an empty table gives an empty one.
    """
    limit, body = farthest(CHECK_BYTES * 8, similarity), PIECES * PIECE_BYTES

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prints, sets = [], []
            for t in b["text"]:
                blocks = list(shingle_hashes(t, width))
                prints.append(wide_fingerprint(lambda blocks=blocks: iter(blocks)))
                sets.append(xxhash.xxh3_128_digest(np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks])).tobytes()))
            yield b[["id", "_h1", "_h2"]].assign(fp=prints, grams=sets)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), *identity(*docs.columns), F.col(text).alias("text"))
    marked = stash(rows.mapInPandas(mark, "id long, _h1 long, _h2 long, fp array<long>, grams binary"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_h1", "_h2")
    classes = stash(marked.groupBy("grams").agg(F.min(order).alias("first"), F.min("fp").alias("fp")).withColumn("class", F.monotonically_increasing_id()))
    times = stash(marked.groupBy("_h1", "_h2").agg(F.count("*").alias("times")))

    def as_bytes(fps: pd.Series) -> np.ndarray:
        return np.array(fps.to_list(), np.int64).reshape(-1, len(FACTORS)).view(np.uint8)

    def piece(fps: np.ndarray, k: int) -> np.ndarray:
        part = fps[:, k * PIECE_BYTES : (k + 1) * PIECE_BYTES].astype(np.int64)
        return part[:, 0] | part[:, 1] << 8 | part[:, 2] << 16

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps, low = as_bytes(b["fp"]), (1 << HALF_BITS) - 1
            tail = np.ascontiguousarray(fps[:, body:]).view(np.int64)
            for k in range(PIECES):
                value = piece(fps, k)
                for half, turned in enumerate((value, (value & low) << HALF_BITS | value >> HALF_BITS)):
                    yield pd.DataFrame({"code": ((2 * k + half << 2 * HALF_BITS) + turned).astype(np.int32), "c1": tail[:, 0], "c2": tail[:, 1], "class": b["class"]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches):
            check = np.ascontiguousarray(b[["c1", "c2"]].to_numpy(np.int64)).view(np.uint64)
            root, name = meetings(b["code"].to_numpy(np.int64), check, limit), b["class"].to_numpy()
            least = name.copy()  # pieces that find the same group then give the same links
            np.minimum.at(least, root, name)
            least = least[root]
            yield pd.DataFrame({"a": name[name != least], "b": least[name != least]})

    dealt = classes.select("fp", "class").mapInPandas(deal, "code int, c1 long, c2 long, class long")
    dealt = dealt.repartition(F.shiftright("code", HALF_BITS)).sortWithinPartitions("code")
    links = linked_sets(rows, classes, smallest_reachable(dealt.mapInPandas(meet, "a long, b long")), not times.where("times > 1").isEmpty(), width, similarity)
    roots = smallest_reachable(links)
    grouped = classes.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    firsts = grouped.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f._h1").alias("_h1"), F.col("f._h2").alias("_h2"), F.lit(True).alias("keep"))
    return times.join(firsts, ["_h1", "_h2"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def linked_sets(rows: DataFrame, classes: DataFrame, crowds: DataFrame, repeated: bool, width: int, similarity: float) -> DataFrame:
    """Links (a, b) of ``classes`` that join all sets of shingles of that Jaccard similarity in a crowd (node, root); only texts in crowds are read again.

    ``repeated`` says that rows may be there more than once.
    """
    crowds = stash(crowds)
    sizes = crowds.groupBy("root").agg(F.count("*").alias("n"))
    members = classes.join(crowds.join(sizes, "root"), F.col("class") == F.col("node"))
    members = stash(members.select("class", F.col("root").alias("crowd"), "n", F.col("first._h1").alias("_h1"), F.col("first._h2").alias("_h2")))
    total = members.count()
    if total <= BROADCAST_ROWS:  # or all texts would be shuffled to find these
        members = F.broadcast(members)
    texts = rows.select("_h1", "_h2", "text").join(members, ["_h1", "_h2"]).select("class", "crowd", "n", "text")
    if repeated:
        texts = texts.dropDuplicates(["class"])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["class", "crowd", "n"]].assign(grams=[shingle_set(t, width).view(np.int64) for t in b["text"]])

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, crowd in tile.groupby("crowd"):
            crowd = crowd.sort_values("class", ignore_index=True)
            name, sides = crowd["class"].to_numpy(), [np.flatnonzero(crowd["side"] == k) for k in (1, 2)]
            label = crowd["label"].to_numpy()
            root = link_sets(crowd["grams"].to_list(), label, similarity, *(sides if len(sides[0]) else ()))
            head = np.unique(label, return_index=True)[1]  # what has its label is linked to it already
            linked = head[name[head] != name[root[head]]]
            found.append(pd.DataFrame({"a": name[linked], "b": name[root[linked]]}))
        return pd.concat(found)

    sets = stash(texts.mapInPandas(grams, "class long, crowd long, n long, grams array<long>"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_DOCS)
    own = lambda n: F.pmod(F.xxhash64("class"), blocks(n))
    all_ = lambda n: F.sequence(F.lit(0).cast("long"), blocks(n) - 1)
    large = F.col("n") > BLOCK_DOCS
    # Small crowds share tiles; of a large one, some documents are in all its tiles.
    place = F.when(large, F.col("crowd")).otherwise(F.pmod(F.xxhash64("crowd"), F.lit(-(-total // BLOCK_DOCS) or 1)))
    at = F.when(large & (F.pmod(F.xxhash64(F.lit(1), "class"), F.col("n")) < OFFERS), all_("n")).otherwise(F.array(F.when(large, own("n")).otherwise(F.lit(-1))))
    tiles = sets.select(place.alias("place"), F.explode(at).alias("at"), "crowd", "class", F.col("class").alias("label"), F.lit(0).alias("side"), "grams")
    links = stash(tiles.groupBy("place", "at").applyInPandas(compare, "a long, b long"))
    some = stash(sets.where(large).select("class", "crowd", "n"))
    if some.isEmpty():
        return links
    roots = smallest_reachable(links)
    some = stash(some.join(roots, F.col("class") == F.col("node"), "left").select("class", "crowd", "n", F.coalesce("root", "class").alias("label")))
    groups = some.groupBy("crowd", "label").agg(F.count("*").alias("k")).groupBy("crowd").agg(F.max_by("label", F.struct("k", "label")).alias("most"), (F.sum("k") - F.max("k")).alias("left"))
    open_ = some.join(groups.where("left > 0"), "crowd").join(sets.select("class", "grams"), "class")
    rest = open_.select("crowd", F.explode(all_("left")).alias("p"), own("n").alias("q"), "class", "label", F.lit(2).alias("side"), "grams")
    one = open_.where("label <> most").select("crowd", own("left").alias("p"), F.explode(all_("n")).alias("q"), "class", "label", F.lit(1).alias("side"), "grams")
    return links.unionByName(stash(rest.unionByName(one).groupBy("crowd", "p", "q").applyInPandas(compare, "a long, b long")))
