"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a vector of weighted term counts: hashed character trigrams, and
terms for its shape (share of symbols, digits and capitals, repetition of words
and lines, lengths), each in steps. The space is the truncated singular value
decomposition of such vectors of labelled documents. The labelled vectors are
broadcast; for every document its cosines to all of them are computed in
blocks, and the labels of the nearest vote by similarity, each weighted by how many
documents of its class stand for it.

Learned from at most about ``DOCS_PER_LABEL`` documents of each label, picked by
hash of the id, so the broadcast holds at most about 2 * DOCS_PER_LABEL * DIMENSIONS
floats.

Defined cases: null and empty texts have the shape of an empty text and are scored
by it; null labels are not learned from, of conflicting ones the largest counts;
without labels every score is 0.5; repeated rows get the same score; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, held_out, pieces, read_table
from .ngrams import trigram_counts
from .toxicity import labelled

BITS, DIMENSIONS = 10, 48
DOCS_PER_LABEL = 2500
NEIGHBOURS, SHARPNESS = 25, 12
THRESHOLD = 0.3
STEPS = 8
SHAPE_WEIGHT = 1.5


def shape(text: str) -> list[float]:
    """Measures in 0..1."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = text.split("\n")
    letters = sum(map(str.isalpha, text))
    symbols = sum(text.count(c) for c in "#$%&*@^~=<>|{}[]\\_+")
    top = counts.most_common(1)[0][1] if counts else 0
    return [
        min(1.0, letters / chars), min(1.0, 4 * symbols / n), min(1.0, 20 * symbols / chars), len(counts) / n, top / n,
        len(set(lines)) / max(1, len(lines)), min(1.0, chars / n / 16), min(1.0, math.log1p(n) / 10), min(1.0, 2 * (text.count(".") + text.count(",")) / n),
        min(1.0, len(lines) / n), min(1.0, 5 * sum(text.count(d) for d in "0123456789") / chars),
    ]


N_SHAPE = 11
N_TERMS = (1 << BITS) + N_SHAPE * STEPS


def term_counts(text: str | None) -> np.ndarray:
    """Damped trigram counts scaled to length 1, then the shape in steps of a thermometer."""
    text = text or ""
    grams = np.log1p(trigram_counts(text, BITS, letters_only=False)).astype(np.float32)
    size = float(np.sqrt((grams**2).sum()))
    steps = np.clip(np.array(shape(text))[:, None] * STEPS - np.arange(STEPS)[None, :], 0, 1).astype(np.float32)
    return np.concatenate([grams / size if size else grams, SHAPE_WEIGHT * steps.ravel() / math.sqrt(N_SHAPE * STEPS)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)


class Space:
    """Term weights, the map to the latent space, and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, standing_for: np.ndarray):
        df = (x[:, : 1 << BITS] > 0).sum(axis=0)
        self.weight = np.ones(N_TERMS, dtype=np.float32)
        self.weight[: 1 << BITS] = np.log((1 + len(x)) / (1 + df))
        self.mean = np.zeros(N_TERMS, dtype=np.float32)
        weighted = x * self.weight
        if len(x):
            self.mean = weighted.mean(axis=0)
        centred = weighted - self.mean
        # the right singular vectors are the eigenvectors of the terms' products
        _, vectors = np.linalg.eigh((centred.T @ centred).astype(np.float64))
        self.map = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
        self.vectors = _unit(centred @ self.map).astype(np.float32)
        self.label, self.standing_for = y.astype(np.float32), standing_for.astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.label):
            return np.full(len(x), 0.5)
        cos = _unit((x * self.weight - self.mean) @ self.map) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(x), 1))
        vote = np.clip(np.take_along_axis(cos, near, axis=1), 1e-3, None) ** SHARPNESS * self.standing_for[near]
        prior = float((self.label * self.standing_for).sum() / self.standing_for.sum())
        tiny = 1e-6 * self.standing_for.mean()
        return np.clip(((vote * self.label[near]).sum(axis=1) + tiny * prior) / (vote.sum(axis=1) + tiny), 0, 1).astype(np.float64)


def _terms_of(texts: list[str | None]) -> np.ndarray:
    return np.stack([term_counts(t) for t in texts]) if texts else np.zeros((0, N_TERMS), dtype=np.float32)


def learn(sample: DataFrame) -> Space:
    """``sample``: a bounded number of rows with doc_id, text, label (0 or 1) and of (the number of labels of that value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = _terms_of(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], batch["of"], pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["doc_id", "label", "of", "x"])

    got = sample.select("doc_id", "text", "label", "of").mapInArrow(run, "doc_id long, label int, of long, x binary").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable") if got.num_rows else np.empty(0, dtype=int)
    y = got["label"].to_numpy()[order] if got.num_rows else np.empty(0)
    x = np.zeros((len(order), N_TERMS), dtype=np.float32)
    for i, k in enumerate(order):
        x[i] = np.frombuffer(got["x"][int(k)].as_py(), dtype=np.float16)
    own = Counter(y.tolist())
    return Space(x, y, got["of"].to_numpy()[order] / np.array([own[v] for v in y.tolist()]) if len(order) else np.empty(0))


def score(docs: DataFrame, space: Space, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without its text, with score and predicted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            s = np.concatenate([shared.value.score(_terms_of(texts[k : k + 500])) for k in range(0, len(texts), 500)] or [np.empty(0)])
            rest = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != text]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*[n for n in batch.schema.names if n != text], "score", "predicted"])

    kept = docs.drop("score", "predicted")
    return kept.mapInArrow(run, ", ".join(x for x in (fields(kept, text), "score double, predicted int") if x))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    space = learn(labelled(docs, read_table(spark, sf_dir, "labels"), "quality", 5, 0, DOCS_PER_LABEL, by_label=True))
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 0)), space).select("doc_id", "held_out", "score", "predicted")
