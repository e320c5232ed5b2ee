"""Quality classifier: labelled neighbours in a latent-semantic space vote, weighted by cosine.

A text's terms are its words, hashed to ``WORDS`` numbers and weighted by TF-IDF, and how it is written: the triples of runs of byte classes
(letters, digits, marks, ...) and four measures of repetition and length. Words tell what is said, the others see gibberish and boilerplate in any
vocabulary. The space is that of the first singular vectors of the labelled documents' terms.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import PER_CLASS, held_out, labelled_sample

CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".,;:", "!?", "#*$%&|<>", "'\"()[]{}-_/@=+~^`\\")
N_CLASSES = len(CLASSES) + 2
CLASS_OF = np.full(256, len(CLASSES), np.int16)
for _k, _letters in enumerate(CLASSES):
    CLASS_OF[np.frombuffer(_letters.encode(), np.uint8)] = _k
CLASS_OF[128:] = len(CLASSES) + 1
SHAPES, EXTRAS, WORDS = N_CLASSES**3, 4, 4_096
N_TERMS = SHAPES + EXTRAS + WORDS
#: Length of the word part of a text's vector; that of its shapes is 1.
WORD_SHARE = 0.6
CHUNK = 1 << 22
ROWS = 256


def shape(data: bytes) -> np.ndarray:
    """Roots of the shares of run triples, then how repetitive a text is (words, lines, bytes) and how short."""
    counts, tail = np.zeros(SHAPES), np.zeros(0, np.int16)
    for at in range(0, len(data), CHUNK):
        c = CLASS_OF[np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at)]
        c = np.concatenate((tail, c))
        runs = c[np.concatenate(([True], c[1:] != c[:-1]))].astype(np.int64)
        if len(runs) > 2:
            counts += np.bincount((runs[:-2] * N_CLASSES + runs[1:-1]) * N_CLASSES + runs[2:], minlength=SHAPES)
        tail = runs[-2:].astype(np.int16)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    repeated = sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words) - 1)
    same_lines = 1 - len(set(lines)) / max(1, len(lines))
    squeezed = min(1.0, len(zlib.compress(data, 1)) / max(1, len(data)))
    return np.concatenate((np.sqrt(counts / max(1.0, counts.sum())), [repeated**0.5, same_lines, squeezed, 1 / (1 + len(words)) ** 0.5]))


def word_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of the hashed words of a text, A-Z lower-cased."""
    counts = Counter(data.lower().split())
    numbers = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)) % np.uint64(WORDS)
    found, inverse = np.unique(numbers.astype(np.int64), return_inverse=True)
    return found, np.bincount(inverse, np.fromiter(counts.values(), np.float64, len(counts)), len(found))


def terms(text: str | None, idf: np.ndarray) -> np.ndarray:
    """Weights of all terms of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return joined(shape(data), *word_counts(data), idf)


def joined(shapes: np.ndarray, numbers: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(N_TERMS)
    x[: len(shapes)] = shapes
    w = (1 + np.log(counts)) * idf[numbers]
    x[len(shapes) + numbers] = WORD_SHARE * w / max(1e-12, np.sqrt((w * w).sum()))
    return x


@dataclass
class Neighbours:
    """Labelled documents as unit vectors of a latent space; ``project`` takes term weights there."""

    idf: np.ndarray
    basis: np.ndarray
    mean: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int
    sharpness: float

    def project(self, weights: np.ndarray) -> np.ndarray:
        x = (weights - self.mean) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Share of label 1 among the ``k`` nearest of all labelled documents by exact cosine, each weighted by a power of its similarity."""
        if not len(self.vectors):
            return np.full(len(weights), 0.5)
        found = np.empty(len(weights))
        k = min(self.k, len(self.vectors))
        for at in range(0, len(weights), ROWS):
            sims = self.project(weights[at : at + ROWS]) @ self.vectors.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            power = np.maximum(np.take_along_axis(sims, near, 1), 1e-6) ** self.sharpness
            found[at : at + ROWS] = (power * self.labels[near]).sum(1) / power.sum(1)
        return np.clip(found, 0.0, 1.0)


def fit(sample: DataFrame, dims: int = 64, k: int = 15, sharpness: float = 4.0) -> Neighbours:
    """Latent-semantic basis and the vectors of all documents of ``sample`` (doc_id, label, text), which has a bounded size.

    The first singular vectors come from a random projection sharpened by four power steps; terms are spelled out for a few documents at a
    time, so the driver never holds the whole matrix.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"]]
            words = [word_counts(d) for d in data]
            packed = lambda rows, kind: [r.astype(kind).tobytes() for r in rows]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "label": b["label"], "x": packed(map(shape, data), np.float32), "w": packed((w for w, _ in words), np.uint16),
                "n": packed((n for _, n in words), np.float32),
            })

    got = sample.mapInPandas(each, "doc_id long, label int, x binary, w binary, n binary").toPandas().sort_values("doc_id", ignore_index=True)
    size = len(got)
    numbers = [np.frombuffer(w, np.uint16).astype(np.int64) for w in got.pop("w")]
    idf = np.log((1 + size) / (1 + np.bincount(np.concatenate([np.zeros(0, np.int64), *numbers]), minlength=WORDS))) + 1

    def blocks() -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, size, ROWS):
            some = range(at, min(size, at + ROWS))
            yield slice(at, at + ROWS), np.array([joined(np.frombuffer(got["x"][i], np.float32), numbers[i], np.frombuffer(got["n"][i], np.float32), idf) for i in some])

    mean = sum((x.sum(0) for _, x in blocks()), np.zeros(N_TERMS)) / max(1, size)
    basis = np.random.default_rng(0).standard_normal((N_TERMS, dims + 16))
    for _ in range(4 if size else 0):
        basis = np.linalg.qr(sum((x - mean).T @ ((x - mean) @ basis) for _, x in blocks()))[0]
    low = np.zeros((size, basis.shape[1]))
    for at, x in blocks():
        low[at] = (x - mean) @ basis
    turn = np.linalg.svd(low, full_matrices=False)[2].T[:, :dims] if size else np.eye(basis.shape[1], dims)
    model = Neighbours(idf, basis @ turn, mean, np.zeros((0, turn.shape[1])), got["label"].to_numpy(np.float64), k, sharpness)
    if size:
        model.vectors = np.concatenate([model.project(x) for _, x in blocks()])
    return model


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, per_class: int = PER_CLASS, dims: int = 64, k: int = 15
) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text).

    The labelled vectors, at most ``2 * per_class`` of ``dims`` numbers, are broadcast; every document of the corpus is compared with all of
    them in blocks, in one pass without a shuffle. Scores use the text alone. A null text counts as empty and is scored like any other; a
    null doc_id is not held out; without labels every score is 0.5. Repeated rows are scored each; an empty table gives an empty one.
    """
    model = fit(labelled_sample(docs, labels, label, modulus, remainder, per_class), dims, k)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.iloc[at : at + ROWS]
                score = sent.value.scores(np.array([terms(t, sent.value.idf) for t in part["text"]]))
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "text")
    return ready.mapInPandas(each, "doc_id long, held_out boolean, score double, predicted int")
