"""Language identification by mixtures of languages.

A document's n-grams are taken as drawn from a mixture of the languages' n-gram
distributions. Expectation-maximisation estimates the proportions; the set of
languages is the one of the nested sets (the most probable language, the two most
probable, ...) with the best likelihood less a penalty for each further language.
The prediction is the language with the largest proportion in that set, and the
score its proportion.

The distributions are learned from at most about ``DOCS_PER_LANGUAGE`` documents
of each language (all, where there are fewer), picked by hash of the id.

Defined cases: a null text, or one without a letter (numerals such as a half aren't
letters), is ``und`` with score 0; with
nothing to learn from, every text is ``und``; null labels are not learned from;
repeated rows get the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fields, held_out, pieces, read_table
from .ngrams import trigram_counts

BITS = 12
DOCS_PER_LANGUAGE = 4000
STEPS, BLOCK = 20, 64
#: What a further language must gain in log-likelihood, for each unit of the log of the number of n-grams (these overlap, hence more than 1/2).
PENALTY = 3.0
UNDEFINED = "und"
#: Languages that may be learned; their table of doubles, 2 ** BITS for each, is broadcast.
LANGUAGES = 2000


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in pieces(batches):
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            counts = trigram_counts(text, BITS)
            sums[lang] = sums[lang] + counts if lang in sums else counts
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bin", "n"])


def learn(train: DataFrame, per_language: int = DOCS_PER_LANGUAGE, most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a row of n-gram probabilities for each. ``train``: doc_id, text, lang.

    More than ``most`` different values of lang are an error, as the table of the model grows with them.
    """
    rows = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    if len(rows.select("lang").distinct().limit(most + 1).collect()) > most:
        raise ValueError(f"more than {most} languages to learn")
    sample = bounded_sample(rows, per_language, "lang").select("text", "lang")
    counted = sample.mapInArrow(_count_by_language, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted["lang"].to_pylist()))
    table = np.full((len(langs), 1 << BITS), 0.5)
    at = {lang: i for i, lang in enumerate(langs)}
    np.add.at(table, (np.array([at[x] for x in counted["lang"].to_pylist()], dtype=int), counted["bin"].to_numpy()), counted["n"].to_numpy())
    return langs, table / table.sum(axis=1, keepdims=True)


def mixture(counts: np.ndarray, table: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """For rows of counts: proportions of the languages, and the log-likelihood under them."""
    n = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    share = np.full((len(counts), len(table)), 1 / len(table))
    for _ in range(steps if len(table) > 1 else 0):
        share = share * ((counts / (share @ table)) @ table.T) / n
    return share, (counts * np.log(share @ table)).sum(axis=1)


def identify(counts: np.ndarray, table: np.ndarray, penalty: float = PENALTY) -> list[list[tuple[int, float]]]:
    """For each row of counts, the chosen languages with their proportions, the largest first."""
    share, _ = mixture(counts, table)
    out = []
    for row, c in zip(share, counts):
        order = [k for k in np.argsort(-row, kind="stable") if row[k] >= 0.02] or [int(row.argmax())]
        if row[order[0]] >= 0.98:
            order = order[:1]
        some = np.flatnonzero(c)
        few, best = c[some][None, :], None
        for size in range(1, len(order) + 1):
            own, log = mixture(few, table[np.ix_(order[:size], some)])
            value = log[0] - penalty * (size - 1) * np.log(max(2, c.sum()))
            if best is not None and value <= best[0]:
                break
            best = (value, own[0])
        out.append(sorted(((order[k], float(p)) for k, p in enumerate(best[1])), key=lambda x: -x[1]))
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` without its text, with lang_pred, score and languages (a map of the set to its proportions)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model[0], model[1].astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found: list[list[tuple[int, float]]] = [[] for _ in texts]
            real = [i for i, t in enumerate(texts) if langs and t is not None and any(map(str.isalpha, t))]
            for k in range(0, len(real), BLOCK):
                block = real[k : k + BLOCK]
                counts = np.stack([trigram_counts(texts[i], BITS) for i in block]).astype(np.float64)
                for i, x in zip(block, identify(counts, table)):
                    found[i] = x
            rest = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != text]
            yield pa.RecordBatch.from_arrays(
                [
                    *rest,
                    pa.array([langs[x[0][0]] if x else UNDEFINED for x in found], pa.string()),
                    pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64()),
                    pa.array([[(langs[j], p) for j, p in x] for x in found], pa.map_(pa.string(), pa.float64())),
                ],
                names=[*[n for n in batch.schema.names if n != text], "lang_pred", "score", "languages"],
            )

    kept = docs.drop("lang_pred", "score", "languages")
    return kept.mapInArrow(run, ", ".join(x for x in (fields(kept, text), "lang_pred string, score double, languages map<string, double>") if x))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    return predict(docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
