"""Toxicity: the nearest labelled examples by exact TF-IDF cosine over all terms, found in a block-max inverted index, vote."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import PER_CLASS, held_out, known_labels, labelled_sample

BLOCK = 64
#: A term in more than one of so many examples is bounded by block before it is summed; the others are summed at once.
COMMON = 8
#: Texts whose words are looked up together, and queries whose common terms are summed together.
TEXTS, GROUP = 256, 64
POSTING = np.dtype([("who", np.uint32), ("weight", np.float32)])
#: Weight of the prior share of toxic documents among the votes, whose weights are their cosines.
DOUBT = 0.1
#: ASCII letters in lower case, digits and bytes from 128 on as they are, all else as white space.
PLAIN = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters + string.digits else b if b > 127 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits, A-Z lower-cased, and other alphabets' letters as they are."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


@dataclass
class BlockMaxIndex:
    """Weights of labelled examples by term, and for common terms the largest weight in each block of ``BLOCK`` examples."""

    terms: dict[bytes, int] | np.ndarray  # numbers of the terms, or their hashes in ascending order
    idf: np.ndarray
    postings: np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]  # terms x examples, or (ends of each term, examples, weights); the weights of an example have length one or are all zero
    ids: np.ndarray
    labels: np.ndarray
    k: int
    prior: float | None = None  # score of a text without any term

    def __post_init__(self):
        if isinstance(self.terms, dict):
            own = hashes(list(self.terms))
            self.order = np.array(list(self.terms.values()), np.int64)[np.argsort(own)]
            self.terms = np.sort(own)
        else:
            self.order = np.arange(len(self.terms))
        if isinstance(self.postings, np.ndarray):
            term, who = np.nonzero(self.postings)
            self.postings = np.bincount(term, minlength=len(self.terms)).cumsum(), who, self.postings[term, who]
        n = len(self.ids)
        if self.prior is None:
            self.prior = (self.labels.sum() + 1) / (n + 2)
        ends, who, weights = self.postings
        self.starts, self.ends = np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64)
        common = np.flatnonzero(self.ends - self.starts > n / COMMON)
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.blocks = -(-n // BLOCK)
        dense = np.zeros((len(common), self.blocks * BLOCK))
        for row, t in enumerate(common):
            at = slice(self.starts[t], self.ends[t])
            dense[row, who[at]] = weights[at].astype(np.float32, copy=False)
        dense = dense.reshape(len(common), self.blocks, BLOCK)
        self.most = dense.max(2, initial=0.0)
        self.dense = np.ascontiguousarray(dense.transpose(1, 0, 2))
        # Example and weight of a posting lie side by side, so that a list is copied at one go.
        packed = np.empty(len(who), POSTING)
        packed["who"], packed["weight"] = who, weights
        self.packed, self.postings = packed.view(np.int64), None

    def vectors(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """For each text its rows (term, count) of the index's terms, in their order; every distinct word of all texts is looked up once."""
        counts = [Counter(tokens(t)) for t in texts]
        words = list(set().union(*counts)) if len(self.terms) else []
        if not words:
            return [np.zeros((0, 2), np.int64) for _ in counts]
        own = hashes(words)
        asked = np.argsort(own)  # neighbours in the sorted terms are looked up one after the other
        at = np.empty(len(words), np.int64)
        at[asked] = np.minimum(np.searchsorted(self.terms, own[asked]), len(self.terms) - 1)
        place = dict(zip(words, np.where(self.terms[at] == own, self.order[at], -1).tolist(), strict=True))
        found = []
        for c in counts:
            pairs = np.empty((len(c), 2), np.int64)
            pairs[:, 0], pairs[:, 1] = np.fromiter(map(place.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))
            pairs = pairs[pairs[:, 0] >= 0]
            found.append(pairs[np.argsort(pairs[:, 0])])
        return found

    def vector(self, text: str | None) -> np.ndarray:
        """Rows (term, count) of the index's terms in a text."""
        return self.vectors([text])[0]

    def nearest(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``nearest_all`` of one query."""
        return next(self.nearest_all([query]))

    def nearest_all(self, queries: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ``k`` examples of largest cosine above zero, ties to the smaller number, and the cosines.

        Rarer terms are summed over their postings. Common terms bound what they add in each block. As they take nothing away, the k-th largest
        sum of blocks so far is a lower bound of the k-th best cosine: what common terms add is only computed for blocks that some
        query of a group can need, as one product for the group, which always has the same shape.
        """
        for at in range(0, len(queries), GROUP):
            some = queries[at : at + GROUP]
            sums, common = np.zeros((len(some), self.blocks, BLOCK)), np.zeros((GROUP, len(self.most)))
            need = np.zeros(self.blocks, bool)
            for own, total, query in zip(common, sums, some, strict=False):
                t, n = query[:, 0], query[:, 1]
                q = (1 + np.log(n)) * self.idf[t]
                q = q / np.sqrt((q * q).sum())
                rare = self.row[t] < 0
                starts, ends = self.starts[t[rare]], self.ends[t[rare]]
                if len(starts):
                    met = np.concatenate([self.packed[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]).view(POSTING)
                    total[:] = np.bincount(met["who"], met["weight"] * np.repeat(q[rare], ends - starts), total.size).reshape(total.shape)
                rows, q = self.row[t[~rare]], q[~rare]
                own[rows] = q
                most = total.max(1)
                need |= most + q @ self.most[rows] > max(0.0, self.least(most) - 2e-12)
            for b in np.flatnonzero(need):
                sums[:, b] += (common @ self.dense[b])[: len(some)]
            for total in sums:
                numbers = np.flatnonzero(total > max(0.0, self.least(total.max(1)) - 2e-12))
                cosines = total.ravel()[numbers]
                best = np.lexsort((numbers, -np.round(cosines, 12)))[: self.k]
                yield numbers[best], cosines[best]

    def least(self, most: np.ndarray) -> float:
        """The k-th largest of the blocks' largest sums: so many examples have no less; 0 for fewer blocks."""
        return float(np.partition(most, -self.k)[-self.k]) if len(most) >= self.k else 0.0

    def judge_all(self, texts: list[str | None]) -> Iterator[tuple[float, list[int], list[float]]]:
        """For each text its score, and the ids and cosines of the examples it rests on.

        Votes are weighted by cosine; the prior has the weight of a tenth of a vote, however many terms a text has.
        """
        for at in range(0, len(texts), TEXTS):
            queries = self.vectors(texts[at : at + TEXTS])
            found = self.nearest_all([q for q in queries if len(q)])
            for query in queries:
                if not len(query):
                    yield float(self.prior), [], []
                    continue
                numbers, cosines = next(found)
                score = ((cosines * self.labels[numbers]).sum() + DOUBT * self.prior) / (cosines.sum() + DOUBT)
                yield float(min(1.0, max(0.0, score))), self.ids[numbers].tolist(), cosines.tolist()


def fit(sample: DataFrame, k: int = 15, prior: float | None = None) -> BlockMaxIndex:
    """Index of all terms of ``sample`` (doc_id, label, text), which has a bounded number of rows; the weights of an example have length one.

    A weight is (1 + log count) * idf * sqrt(1 + chi-square), the latter that of the term with the label over the sample: no term is left out, and
    those that say nothing about the label keep their plain TF-IDF weight. Terms are known by 64-bit hashes.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [Counter(tokens(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "size": [len(c) for c in counts], "term": [hashes(list(c)).tobytes() for c in counts], "n": [np.fromiter(c.values(), np.uint32, len(c)).tobytes() for c in counts]})

    # The driver's memory is small: packed columns, narrow types, and nothing kept for longer than it is used.
    got = sample.mapInPandas(each, "doc_id long, label int, size int, term binary, n binary").toPandas().sort_values("doc_id", ignore_index=True)
    ids, labels, size = got["doc_id"].to_numpy(np.int64), got["label"].to_numpy(np.float64), len(got)
    who = np.repeat(np.arange(size, dtype=np.min_scalar_type(max(size, 1))), got["size"].to_numpy(np.int64))
    found, n = np.frombuffer(b"".join(got.pop("term")), np.uint64), np.frombuffer(b"".join(got.pop("n")), np.uint32)
    terms = np.unique(found)
    term = np.searchsorted(terms, found).astype(np.int32)
    del got, found
    n1, both = labels.sum(), np.bincount(term, minlength=len(terms)).astype(np.float64)
    n0, a = size - n1, np.bincount(term[labels[who] == 1], minlength=len(terms))
    b, spread = both - a, both * (size - both) * n1 * n0
    chi = np.divide(size * (a * (n0 - b) - b * (n1 - a)) ** 2, spread, out=np.zeros(len(terms)), where=spread > 0)
    idf = (np.log((1 + size) / (1 + both)) + 1) * np.sqrt(1 + chi)
    weights = np.log(n)
    weights += 1
    weights *= idf[term]
    weights /= np.sqrt(np.bincount(who, weights * weights, size))[who]
    order = np.argsort(term, kind="stable")
    return BlockMaxIndex(terms, idf, (both.cumsum(), who[order], weights.astype(np.float32)[order]), ids, labels, k, prior)


def index(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int, k: int) -> BlockMaxIndex:
    """Index of the labelled sample; its prior is the share of toxic ones among all labels that are not held out, as the sample evens out the classes."""
    toxic, n = known_labels(labels, label, modulus, remainder).agg(F.count_if(F.col("label") == 1), F.count("*")).first()
    return fit(labelled_sample(docs, labels, label, modulus, remainder, per_class), k, (toxic + 1) / (n + 2))


def reject(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, per_class: int = PER_CLASS, k: int = 15) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that ``classify`` predicts 0 for, all columns as they are, in one pass without a shuffle."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(index(docs, labels, label, modulus, remainder, per_class, k))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), TEXTS):
                part = b.slice(at, TEXTS)
                yield part.filter(pa.array([j[0] < 0.5 for j in sent.value.judge_all(part.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, per_class: int = PER_CLASS, k: int = 15, evidence: bool = True
) -> DataFrame:
    """One row (doc_id, held_out, score, predicted, and with ``evidence`` also neighbours, cosines) per row of ``docs`` (doc_id, text).

    The index holds all terms of at most ``2 * per_class`` examples and is broadcast; every whole text is scored in one pass without a
    shuffle. A text without any term of the index, such as a null or empty one, gets the share of toxic ones among the labels. A null doc_id is not held out; without labels every score is a half. Repeated rows are scored each; an empty table gives an
    empty one. Scores use the text alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index(docs, labels, label, modulus, remainder, per_class, k))
    schema = "doc_id long, held_out boolean, score double, predicted int" + ", neighbours array<long>, cosines array<double>" * evidence

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            judged = list(sent.value.judge_all(b["text"].tolist()))
            score = np.array([j[0] for j in judged], np.float64)
            out = pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})
            if evidence:
                out["neighbours"], out["cosines"] = [j[1] for j in judged], [j[2] for j in judged]
            yield out

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "text")
    return ready.mapInPandas(each, schema)
