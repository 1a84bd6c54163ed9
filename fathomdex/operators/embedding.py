"""Vectors of texts, by a provider that each Python worker loads once."""

import hashlib
import importlib.util
import os
import re
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_JS_SPACE = re.compile("[ \t\n\x0b\x0c\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


class Provider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class _Buckets(dict):
    """The numbers of words, each hashed once while there is room."""

    MOST = 1 << 17

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = n = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
        return n


_buckets = _Buckets()


class HashProvider:
    """Counts of words by hash bucket, scaled to length 1: lexical, needs no model. A stand-in where no model is at hand."""

    dimension = 384

    def embed(self, texts: list[str]) -> np.ndarray:
        buckets = np.zeros(len(texts) * self.dimension)
        for row, text in enumerate(texts):
            own = [_buckets[w] for w in _JS_SPACE.split(text or "") if w]
            if own:
                buckets[row * self.dimension : (row + 1) * self.dimension] = np.bincount(np.array(own) % self.dimension, minlength=self.dimension)
        out = buckets.reshape(len(texts), self.dimension)
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(size > 0, size, 1)


class OnnxProvider:
    """A sentence-embedding model from a local folder: mean of the token vectors, scaled to length 1."""

    def __init__(self, folder: str, dimension: int = 384, batch: int = 16, tokens: int = 512):
        self.folder, self.dimension, self.batch, self.tokens = folder, dimension, batch, tokens

    @property
    def available(self) -> bool:
        return all(importlib.util.find_spec(m) for m in ("onnxruntime", "tokenizers")) and os.path.exists(f"{self.folder}/model.onnx")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_loaded"}

    def _load(self):
        if not hasattr(self, "_loaded"):
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1  # each Spark task has one core
            tokenizer = Tokenizer.from_file(f"{self.folder}/tokenizer.json")
            tokenizer.enable_truncation(self.tokens)
            tokenizer.enable_padding()
            self._loaded = onnxruntime.InferenceSession(f"{self.folder}/model.onnx", options), tokenizer
        return self._loaded

    def embed(self, texts: list[str]) -> np.ndarray:
        session, tokenizer = self._load()
        wanted = {i.name for i in session.get_inputs()}
        out = []
        for k in range(0, len(texts), self.batch):
            codes = tokenizer.encode_batch([t or "" for t in texts[k : k + self.batch]])
            mask = np.array([c.attention_mask for c in codes], dtype=np.int64)
            feed = {"input_ids": np.array([c.ids for c in codes], dtype=np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            hidden = session.run(None, {n: v for n, v in feed.items() if n in wanted})[0]
            mean = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
            out.append(mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12))
        return np.concatenate(out) if out else np.zeros((0, self.dimension))


#: Texts that are Python objects at a time.
TEXTS = 128


def _vectors(texts: pa.Array, provider: Provider, kind: type) -> pa.Array:
    """The list array of the texts' vectors, written in place: beside it, only what ``TEXTS`` texts need is held."""
    flat = np.empty((len(texts), provider.dimension), dtype=kind)
    for k in range(0, len(texts), TEXTS):
        flat[k : k + TEXTS] = provider.embed(texts.slice(k, TEXTS).to_pylist())
    ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * provider.dimension)
    return pa.ListArray.from_arrays(ends, pa.array(flat.reshape(-1)))


def passage(text: Column) -> Column:
    return F.concat(F.lit("passage: "), text)


def query_text(query: str) -> str:
    return f"query: {query}"


def embedded(df: DataFrame, text: Column, provider: Provider, into: str = "vector", double: bool = False) -> DataFrame:
    """``df`` with the vectors of ``text``, in Arrow batches.

    Spark takes the function as not deterministic, else it computes vectors twice where
    a filter (an explode makes one) is put below them.
    """
    kind, number = ("array<double>", np.float64) if double else ("array<float>", np.float32)

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return _vectors(texts, provider, number)

    return df.withColumn(into, run.asNondeterministic()(text))
