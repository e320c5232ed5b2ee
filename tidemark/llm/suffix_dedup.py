"""Suffix-array dedup: a depth-limited radix sort of suffixes finds every repeated window of bytes.

Sorting all suffixes would shuffle many times the input. Instead only suffixes at anchors are sorted: the positions whose hashed gram is least
in some window of the threshold length. The choice depends on the window's bytes alone, so two equal windows have an anchor at the same
place, and whatever repeats is found next to anchors. Most-significant-digit passes then split the anchors: by their gram, by their whole
context (all bytes that share a window with the gram), and last, for contexts that differ, by the bytes of each window, eight at a time. A
group of one drops out at once. The first two digits are hashes of 64 bits each, of gram and context, so contexts are held equal by 128 bits;
the windows of a gram with very many contexts go by two hashes of 64 bits instead of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, stash, stash_alone

THRESHOLD, GRAM = 100, 32
CHUNK = 1 << 16
FLUSH_ROWS = 1 << 17
#: Rows that a task hands to Spark at once.
OUT_ROWS = 1 << 15
#: From so many different contexts of a gram in one task on, each window of them goes its own way.
HOT_CONTEXTS = 64
REFINE_ROWS = 1 << 15
#: A place is a long: the position, and 7 bits of context behind the gram.
EXTENT_BITS = 7
COVER, ANCHOR, HOT, MARK, PARTIAL, WINDOW = range(6)
M64 = (1 << 64) - 1


@lru_cache(maxsize=4)
def scheme(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and the powers of an odd base and of its inverse, for a polynomial hash modulo 2 ** 64."""
    table = np.random.default_rng(seed).integers(0, M64, 256, dtype=np.uint64, endpoint=True)
    base = 0x9E3779B97F4A7C15 + 2 * seed

    def powers(b: int) -> np.ndarray:
        factors = np.full(CHUNK + 8 * THRESHOLD, b & M64, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    return table, powers(base), powers(pow(base, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def sums(data: np.ndarray, seed: int) -> np.ndarray:
    table, powers, _ = scheme(seed)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * powers[: len(data)], dtype=np.uint64)))


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x, size = best(x[:-size], x[size:]), 2 * size
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, gram hashes, context hashes, context lengths behind the gram) of a text's anchors, a stretch at a time."""
    n, reach, before = len(data), THRESHOLD - GRAM, np.zeros(0, np.int64)
    for s in range(0, n - THRESHOLD + 1, CHUNK):
        e = min(n - THRESHOLD + 1, s + CHUNK)
        lo, hi = max(0, s - reach), min(n, e - 1 + THRESHOLD + reach)
        part = np.frombuffer(data, np.uint8, hi - lo, lo)
        p1, p2, inverse1, inverse2 = sums(part, 1), sums(part, 2), scheme(1)[2], scheme(2)[2]
        at = np.arange(s - lo, e + reach - lo)
        g = mix((p1[at + GRAM] - p1[at]) * inverse1[at])
        least = sliding(g, reach + 1, np.minimum)
        edge = np.zeros(reach, np.uint64)
        pos = np.flatnonzero(sliding(np.concatenate((edge, least, edge)), reach + 1, np.maximum) == g)
        g, pos = g[pos], pos + s
        old = np.isin(pos, before)
        g, before, pos = g[~old], pos[pos >= e], pos[~old]
        left, right = np.minimum(pos, reach), np.minimum(n - pos - GRAM, reach)
        a, b = pos - left - lo, pos + GRAM + right - lo
        c = mix((p2[b] - p2[a]) * inverse2[a] + (left * 256 + right).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        yield pos, g.view(np.int64), c.view(np.int64), right


def first_and_rest(doc: np.ndarray, place: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first row of each ``key`` by (doc, place), and of the later rows that are at another place."""
    order = np.lexsort((place, doc, *key[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = ~new & ((doc[order] != doc[head]) | (place[order] != place[head]))
    return order[new], order[later]


def merged(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of stretches (doc, start, length): disjoint ones, not touching, in order."""
    if not len(doc):
        return doc, start, length
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], start[order] + length[order]
    by_end = np.lexsort((end, doc))
    rank = np.empty(len(doc), np.int64)
    rank[by_end] = np.arange(len(doc))
    far = end[by_end[np.maximum.accumulate(rank)]]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(doc) - 1]))
    return doc[new], start[new], far[last] - start[new]


def whole_context(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of an anchor's context."""
    where = place >> EXTENT_BITS
    left = np.minimum(where, THRESHOLD - GRAM)
    return where - left, left + GRAM + (place & ((1 << EXTENT_BITS) - 1))


def rows(kind: int, g: np.ndarray, c: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(doc), kind, np.int32), "g": g, "c": c, "doc": doc, "place": place})


def covers(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> pd.DataFrame:
    doc, start, length = merged(doc, start, length)
    return rows(COVER, mix(doc.view(np.uint64)).view(np.int64), length, doc, start)


def sliced(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in found:
        for at in range(0, len(df), OUT_ROWS):
            yield df.iloc[at : at + OUT_ROWS]


def gathered(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The same rows in batches of about ``least``."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors of all texts of a task. Of equal contexts in a stretch of ``FLUSH_ROWS`` only the first goes on, the others are covered at once."""
    held: list[tuple] = []

    def flush() -> Iterator[pd.DataFrame]:
        g, c, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        first, later = first_and_rest(doc, place, g, c)
        yield covers(doc[later], *whole_context(place[later]))
        g, c, doc, place = g[first], c[first], doc[first], place[first]
        _, inverse, many = np.unique(g, return_inverse=True, return_counts=True)
        hot = many[inverse] > HOT_CONTEXTS
        yield rows(ANCHOR, g[~hot], c[~hot], doc[~hot], place[~hot])
        if hot.any():
            # Dealt by the context; one row per gram tells the others.
            yield rows(HOT, c[hot], g[hot], doc[hot], place[hot])
            marks = np.unique(g[hot])
            yield rows(MARK, marks, marks, marks, marks)

    n = 0
    for b in batches:
        for doc, data in zip(b["doc"], b["text"], strict=True):
            for pos, g, c, right in anchors(data):
                held.append((g, c, np.full(len(pos), doc, np.int64), (pos << EXTENT_BITS) + right))
                n += len(pos)
                if n >= FLUSH_ROWS:
                    yield from sliced(flush())
                    n = 0
    if held:
        yield from sliced(flush())


def match_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second pass, over rows sorted by gram, kind (marks first), context, doc and place: of equal contexts all but the first are covered.

    Grams with one context only drop out, the others stay partial. Rows are worked off as they come: of a gram that goes on, only the first
    row of each context is held, and once it has more than ``OUT_ROWS`` contexts they go on as they are.
    """
    columns = ("kind", "g", "c", "doc", "place")
    held = [np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in columns[1:])]
    marked: set[int] = set()  # marked grams among those held

    def settle(kind, g, c, doc, place, many: bool) -> Iterator[pd.DataFrame]:
        for k in (ANCHOR, HOT):
            mine = kind == k
            a, b, d, p = g[mine], c[mine], doc[mine], place[mine]
            if k == HOT:
                yield rows(HOT, b, a, d, p)
            elif len(a):
                _, inverse, count = np.unique(a, return_inverse=True, return_counts=True)
                hot = np.isin(a, np.fromiter(marked, np.int64, len(marked)))
                partial = ~hot & ((count[inverse] > 1) | many)
                yield rows(HOT, a[hot], b[hot], d[hot], p[hot])
                yield rows(PARTIAL, a[partial], b[partial], d[partial], p[partial])

    spilled: int | None = None  # a gram whose contexts have gone on already
    for batch in gathered(batches, FLUSH_ROWS):
        kind, g, c, doc, place = (np.concatenate((h, batch[k].to_numpy())) for h, k in zip(held, columns, strict=True))
        cover = kind == COVER
        yield rows(COVER, g[cover], c[cover], doc[cover], place[cover])
        marked |= set(g[kind == MARK].tolist())
        open_ = g[-1] if len(g) else None
        for k in (ANCHOR, HOT):
            mine = np.flatnonzero(kind == k)
            first, later = first_and_rest(doc[mine], place[mine], g[mine], c[mine])
            yield covers(doc[mine[later]], *whole_context(place[mine[later]]))
            gone = np.ones(len(mine), bool)
            gone[first] = False
            kind[mine[gone]] = COVER
        left = (kind == ANCHOR) | (kind == HOT)
        kind, g, c, doc, place = (x[left] for x in (kind, g, c, doc, place))
        last = g == open_
        if spilled is not None:
            mine = g == spilled
            yield from settle(*(x[mine & ~last] for x in (kind, g, c, doc, place)), many=True)
            kind, g, c, doc, place, last = (x[~mine | last] for x in (kind, g, c, doc, place, last))
        done = ~last
        yield from settle(*(x[done] for x in (kind, g, c, doc, place)), many=False)
        held = [x[last] for x in (kind, g, c, doc, place)]
        if len(held[0]) > OUT_ROWS:
            # The last context may go on in the next batch, so its first row stays.
            end = held[2] == batch["c"].iloc[-1]
            yield from settle(*(x[~end] for x in held), many=True)
            held, spilled = [x[end] for x in held], open_
        elif open_ != spilled:
            spilled = None
        marked &= {open_}
    if len(held[0]):
        yield from settle(*held, many=spilled is not None)


def cut_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts of partial anchors, padded to one width, from the texts; for hot grams every window's two hashes instead.

    Of equal windows in a batch only the first goes on, so a window in very many documents is a row or few per batch; the others are covered.
    """
    unpack, reach = zstandard.ZstdDecompressor(), THRESHOLD - GRAM
    held, contexts, windows = [], [], []

    def flush() -> Iterator[pd.DataFrame]:
        if held:
            g, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            yield pd.DataFrame({"kind": np.int32(PARTIAL), "g": g, "w": np.int64(0), "doc": doc, "place": place, "context": contexts})
        if windows:
            g, w, doc, place = (np.concatenate(x) for x in zip(*windows, strict=True))
            first, later = first_and_rest(doc, place, g, w)
            yield pd.DataFrame({"kind": np.int32(WINDOW), "g": g[first], "w": w[first], "doc": doc[first], "place": place[first], "context": b""})
            doc, start, length = merged(doc[later], place[later] >> EXTENT_BITS, np.full(len(later), THRESHOLD, np.int64))
            yield pd.DataFrame({"kind": np.int32(COVER), "g": mix(doc.view(np.uint64)).view(np.int64), "w": length, "doc": doc, "place": start, "context": b""})
        held.clear()
        contexts.clear()
        windows.clear()

    n = 0
    for b in batches:
        for doc, packed, g, place, kind in zip(b["doc"], b["packed"], b["g"], b["place"], b["kind"], strict=True):
            data, pos, hot = unpack.decompress(packed), place >> EXTENT_BITS, kind == HOT
            padded = bytes(reach) + data + bytes(reach)
            contexts += [padded[p : p + GRAM + 2 * reach] for p in pos[~hot].tolist()]
            held.append((g[~hot], np.full(int((~hot).sum()), doc, np.int64), place[~hot]))
            n += len(pos)
            if hot.any():
                starts = np.unique(np.concatenate([np.arange(max(0, x - reach), min(len(data) - THRESHOLD, x) + 1) for x in pos[hot].tolist()]))
                for at in range(0, len(starts), CHUNK // 2):
                    some = starts[at : at + CHUNK // 2]
                    bytes_of = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), THRESHOLD)[some]
                    hashes = [mix(np.add.reduce(scheme(s)[0][bytes_of] * scheme(s)[1][:THRESHOLD], axis=1, dtype=np.uint64)).view(np.int64) for s in (3, 4)]
                    windows.append((*hashes, np.full(len(some), doc, np.int64), some << EXTENT_BITS))
                    n += len(some)
                    if n >= OUT_ROWS:
                        yield from flush()
                        n = 0
            if n >= OUT_ROWS:
                yield from flush()
                n = 0
    yield from flush()


def repeated_windows(group: np.ndarray, doc: np.ndarray, place: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Third pass, over whole groups of a gram: (rows, first offsets, last offsets) of the windows that also start earlier.

    First the bytes of the gram itself split the groups. For each offset of the window before the gram, digits of eight bytes split the groups, most significant first; a row alone in its group
    drops out. Rows of a group that is left hold the same window, and all but the first are covered.
    """
    reach = THRESHOLD - GRAM
    left = np.minimum(place >> EXTENT_BITS, reach)
    right = place & ((1 << EXTENT_BITS) - 1)
    grams = np.ascontiguousarray(context[:, reach : reach + GRAM]).view(np.int64)
    order = np.lexsort((*grams.T, group))
    new = np.concatenate(([True], (group[order[1:]] != group[order[:-1]]) | (grams[order[1:]] != grams[order[:-1]]).any(1)))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    low, high = np.full(len(group), reach + 1), np.full(len(group), -1)
    for offset in range(reach + 1):
        at = np.flatnonzero((left >= offset) & (right >= reach - offset))
        ids = group[at]
        for digit in range(0, THRESHOLD, 8):
            if len(at) < 2:
                break
            column = reach - offset + min(digit, THRESHOLD - 8)
            if column >= reach and column + 8 <= reach + GRAM:
                continue  # within the gram all are equal
            value = np.ascontiguousarray(context[at, column : column + 8]).view(np.int64)[:, 0]
            order = np.lexsort((value, ids))
            new = np.concatenate(([True], (ids[order[1:]] != ids[order[:-1]]) | (value[order[1:]] != value[order[:-1]])))
            alone = new & np.concatenate((new[1:], [True]))
            ids, at = np.cumsum(new)[~alone], at[order[~alone]]
        if len(at) > 1:
            _, later = first_and_rest(doc[at], place[at], ids)
            low[at[later]] = np.minimum(low[at[later]], offset)
            high[at[later]] = np.maximum(high[at[later]], offset)
    hit = np.flatnonzero(high >= 0)
    return hit, low[hit], high[hit]


def match_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Third pass over rows sorted by gram: stretches (doc, start, length) that the windows cover."""

    def solve(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        whole = part[part["kind"] == COVER]
        found = [(whole["doc"].to_numpy(), whole["place"].to_numpy(), whole["w"].to_numpy())]
        some = part[part["kind"] == PARTIAL]
        if len(some):
            doc, place = some["doc"].to_numpy(), some["place"].to_numpy()
            context = np.frombuffer(b"".join(some["context"]), np.uint8).reshape(len(some), -1)
            hit, low, high = repeated_windows(np.unique(some["g"].to_numpy(), return_inverse=True)[1], doc, place, context)
            found.append((doc[hit], (place[hit] >> EXTENT_BITS) - high, high - low + THRESHOLD))
        some = part[part["kind"] == WINDOW]
        if len(some):
            doc, place = some["doc"].to_numpy(), some["place"].to_numpy()
            _, later = first_and_rest(doc, place, some["g"].to_numpy(), some["w"].to_numpy())
            found.append((doc[later], place[later] >> EXTENT_BITS, np.full(len(later), THRESHOLD, np.int64)))
        doc, start, length = merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pd.DataFrame({"doc": doc, "start": start, "length": length})

    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= REFINE_ROWS:
            part = pd.concat(held, ignore_index=True)
            open_ = int(np.searchsorted(part["g"].to_numpy(), part["g"].iloc[-1]))
            if open_:
                yield from solve(part.iloc[:open_])
            held = [part.iloc[open_:]]
    if sum(map(len, held)):
        yield from solve(pd.concat(held, ignore_index=True))


def pack(text: pd.Series) -> pd.Series:
    """Texts as compressed bytes, so that shuffling them takes less disk."""
    press = zstandard.ZstdCompressor(level=3)
    return text.map(press.compress)


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TEXT = "n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, span_starts array<long>, span_ends array<long>"


def unite(starts: np.ndarray | None, lengths: np.ndarray | None) -> list[list[int]]:
    """[start, end] of the maximal runs of the stretches, in order."""
    runs: list[list[int]] = []
    if starts is not None:
        for s, n in sorted(zip(starts.tolist(), lengths.tolist(), strict=True)):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], s + n)
            else:
                runs.append([s, s + n])
    return runs


def removed(packed: bytes, starts: np.ndarray | None, lengths: np.ndarray | None) -> tuple[int, list[list[int]], bytes]:
    """(length of the text, removed runs, bytes that stay)."""
    data, runs = zstandard.ZstdDecompressor().decompress(packed), unite(starts, lengths)
    ends = [0, *(e for _, e in runs)]
    return len(data), runs, b"".join([data[a:s] for a, (s, _) in zip(ends, runs, strict=False)] + [data[ends[-1] :]])


def cut_digest(packed: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    rows = [(n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) for n, runs, kept in map(removed, packed, starts, lengths)]
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def cut_text(packed: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    rows = [
        (n, n - len(kept), len(runs), kept, kept.decode("utf-8", "ignore"), [s for s, _ in runs], [e for _, e in runs])
        for n, runs, kept in map(removed, packed, starts, lengths)
    ]
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_text", "span_starts", "span_ends"])


def keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` with a long that tells documents apart and orders them, and the text's bytes; and the names of these two columns.

    Where no id is null or repeated, the key is the id itself. Otherwise distinct pairs of id and text are numbered in the order of id (null
    last), then of the text's SHA-256: ranges of them are sorted and counted apart, and the numbers are joined to the rows.
    """
    key, data, digest, spare = (free_name(docs.columns, n) for n in ("_doc", "_bytes", "_sha", "_spare"))
    whole = docs.withColumn(data, F.coalesce(F.col(text), F.lit("")).cast("binary"))
    odd = docs.groupBy(doc_id).count().where((F.col("count") > 1) | F.col(doc_id).isNull())
    if odd.isEmpty():
        return whole.withColumn(key, F.col(doc_id).cast("long")), key, data
    whole = whole.withColumn(digest, F.sha2(data, 256))
    id_, sha, part, n = F.col(doc_id).cast("long"), "s", "p", "n"
    pairs = whole.select(id_.alias("i"), F.col(digest).alias(sha)).distinct()
    dealt = stash(pairs.repartitionByRange(F.col("i").asc_nulls_last(), sha).withColumn(part, F.spark_partition_id()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(part).agg(F.count("*").alias(n)).select(F.col(part).alias("o"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(part).orderBy(F.col("i").asc_nulls_last(), sha))
    numbers = dealt.withColumn(n, within).join(F.broadcast(offsets), F.col(part) == F.col("o")).select("i", sha, (F.col("before") + F.col(n)).alias(key))
    numbers = stash(numbers.select(F.col("i").alias(spare), F.col(sha).alias(f"{digest}2"), key))
    joined = whole.join(numbers, F.col(doc_id).cast("long").eqNullSafe(F.col(spare)) & (F.col(digest) == F.col(f"{digest}2")))
    return joined.drop(digest, f"{digest}2", spare), key, data


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Rows (doc, starts, lengths) of the stretches to remove, per document of ``texts`` (doc long, text binary) that has any; they may overlap and touch."""
    texts = texts.where(F.octet_length("text") >= THRESHOLD)
    schema = "kind int, g long, c long, doc long, place long"
    anchored = texts.mapInPandas(find_anchors, schema).repartition("g").sortWithinPartitions("g", F.desc("kind"), "c", "doc", "place")
    found = stash(anchored.mapInPandas(lambda batches: sliced(match_contexts(batches)), schema))
    wanted = found.where(F.col("kind") != COVER).groupBy(F.col("doc").alias("_doc"))
    wanted = wanted.agg(F.collect_list(F.struct("g", "place", "kind")).alias("w")).select("_doc", F.col("w.g").alias("g"), F.col("w.place").alias("place"), F.col("w.kind").alias("kind"))
    packed = texts.select("doc", F.pandas_udf(pack, "binary")("text").alias("packed"))
    asked = packed.join(wanted, F.col("doc") == F.col("_doc")).select("doc", "packed", "g", "place", "kind")
    contexts = asked.mapInPandas(cut_contexts, "kind int, g long, w long, doc long, place long, context binary")
    last = contexts.repartition("g").sortWithinPartitions("g").mapInPandas(match_windows, "doc long, start long, length long")
    whole = found.where(F.col("kind") == COVER).select("doc", F.col("place").alias("start"), F.col("c").alias("length"))
    spans = whole.unionByName(last).groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    return spans.select("doc", F.col("spans.start").alias("starts"), F.col("spans.length").alias("lengths"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Remove each byte that a ``THRESHOLD``-byte string covers which also starts earlier: in a smaller doc_id, or further left in the same one.

    Every row of ``docs`` without its text, but with n_bytes, n_removed, n_spans, kept (bytes), kept_text, span_starts and span_ends, or with
    ``digest`` kept_sha256 in place of the last four; columns of these names, in any case, are replaced, others stay. All strings are judged on the input,
    so which copy stays does not depend on what else goes. Texts are compared as UTF-8 bytes and never across documents; kept_text leaves
    out what is left of a letter that was cut in two.

    A null or empty text has no bytes. Rows that repeat id and text are one document and get the same result; different texts with one id
    come in the order of their SHA-256. Null ids come last. An empty table gives an empty one.
    """
    ready, key, data = keyed(docs, doc_id, text)
    spans = stash_alone(docs.sparkSession, lambda: repeated_spans(ready.select(F.col(key).alias("doc"), F.col(data).alias("text"))))
    cut, gives = (cut_digest, DIGEST) if digest else (cut_text, TEXT)
    fields = [f.split()[0] for f in gives.split(", ")]
    rest = [c for c in docs.columns if c != text and c.lower() not in fields]
    names = [free_name(ready.columns, n) for n in ("_of", "_starts", "_lengths", "_packed", "_cut")]
    packed = ready.select(*rest, key, F.pandas_udf(pack, "binary")(data).alias(names[3]))
    both = packed.join(spans.toDF(*names[:3]), F.col(key) == F.col(names[0]), "left")
    # Called non-deterministic so that a filter on its result does not run it a second time, in workers of its own.
    cutter = F.pandas_udf(cut, gives).asNondeterministic()
    done = both.select(*rest, cutter(names[3], names[1], names[2]).alias(names[4]))
    return done.select(*rest, *(F.col(f"{names[4]}.{f}").alias(f) for f in fields))
