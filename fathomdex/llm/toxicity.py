"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed and of an induced lexicon, nearness of their words
to second-person words, capitals, punctuation and obfuscation rates, and a few
measures of length. The induced lexicon holds words and beginnings of words that occur in
toxic training documents far more often than in others.

Learned from at most about ``TRAIN_DOCS`` labelled documents, picked by hash of the
id (all, where there are fewer). The calibration is fitted to margins that each document
gets from a lexicon and trees that haven't seen it.

Defined cases: null and empty texts have all features 0 and get the score of
that; null labels are not learned from, of conflicting ones the largest counts;
without labels of both kinds every score is the prior; repeated rows get the same
score; an empty table gives an empty result; columns named score or predicted are
replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import bounded_sample, fields, held_out, pieces, read_table, staged

TRAIN_DOCS = 12_000
THRESHOLD = 0.7
FOLDS = 4
LEXICON_SIZE, STEM_LENGTHS, LEAST_ODDS = 800, (4, 5, 6, 8), 1.8

#: Words of abuse and of address; short lists written for this operator.
ABUSE = frozenset("idiot idiots stupid moron morons loser losers clown pathetic worthless disgusting scum trash garbage dumb ugly hate kill crap damn fool liar filth vermin idiota imbécil estúpido basura asco idiote imbécile stupide ordure crétin idioten dumm blöd dreck abschaum".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen tú ti usted ustedes vosotros vuestro".split())

_TOKEN = re.compile(r"[^\s]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = "\"'`.,;:!?()[]{}<>*#&%$@-_/\\|~+=«»“”‘’…"
_ELONGATED = re.compile(r"(\w)\1{3,}")
_REPEATED = re.compile(r"[!?.*#$%&]{2,}")
_INNER = re.compile(r"[^\W\d_][\d@$!*]+[^\W\d_]")


def tokens(text: str) -> list[str]:
    """Lower-cased words without punctuation around them."""
    return [w for w in (t.strip(_EDGE) for t in text.lower().split()) if w]


def stems(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word[:n] for n in STEM_LENGTHS if len(word) > n] + [word] * (len(word) >= STEM_LENGTHS[0])


def roots_of(lexicon: dict[str, float]) -> frozenset[str]:
    """The shortest beginnings of the lexicon's stems, to pass over most words by one look."""
    return frozenset(s[: STEM_LENGTHS[0]] for s in lexicon)


# Per code point what it can be, to run a pattern only on texts that may hold a match.
_UPPER, _MARK, _INSIDE, _ALPHA = 1, 2, 4, 8


def _kinds() -> np.ndarray:
    table = np.full(0x10000, _ALPHA, dtype=np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if not 0xD800 <= c < 0xE000:
            digit = ch.isdecimal()
            table[c] = _UPPER * ch.isupper() | _MARK * (ch in "!?.*#$%&") | _INSIDE * (digit or ch in "@$!*") | _ALPHA * (ch.isalnum() and not digit)
    return table


_KINDS = _kinds()


class Words(dict):
    """What a lexicon says of words: (weight, hidden), or None. Filled as words are looked up, and emptied when it is large."""

    MOST = 200_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.roots = lexicon, roots_of(lexicon)

    def __missing__(self, w: str) -> tuple[float, bool] | None:
        plain = w
        if not w.isalpha() and _INNER.search(w):
            plain = w.translate(_LEET).replace("*", "")
        best = max((self.lexicon.get(s, 0.0) for s in stems(plain)), default=0.0) if plain[: STEM_LENGTHS[0]] in self.roots else 0.0
        if len(self) >= self.MOST:
            self.clear()
        self[w] = found = (best, plain is not w, plain in ABUSE) if best or plain in ABUSE else None
        return found


def features(text: str | None, known: Words) -> list[float]:
    if not text:
        return [0.0] * N_FEATURES
    words = tokens(text)
    n = max(1, len(words))
    distinct = set(words)
    bad = {w: found for w in distinct if (found := known[w]) is not None}
    hits, fixed, total, strongest, near = 0, 0, 0.0, 0.0, 0
    hidden = sum(found[1] for found in bad.values())
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    if bad:
        at = [i for i, w in enumerate(words) if w in bad]
        of = [bad[words[i]] for i in at]
        hits = len(at)
        fixed = sum(x[2] for x in of)
        total = sum(x[0] for x in of)
        strongest = max(x[0] for x in of)
        if you:
            y = np.array(you)
            pos = np.searchsorted(y, at)
            gap = np.minimum(np.abs(y[np.minimum(pos, len(y) - 1)] - at), np.abs(y[np.maximum(pos - 1, 0)] - at))
            near = int((gap <= 5).sum())
    chars = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _KINDS[np.minimum(codes, 0xFFFF)]
    upper = int(np.count_nonzero(kind & _UPPER))
    shout = sum(w.isupper() and len(w) > 1 for w in text.split()) if upper else 0
    same = codes[1:] == codes[:-1]
    long = len(_ELONGATED.findall(text)) if (same[2:] & same[1:-1] & same[:-2]).any() else 0
    repeated = len(_REPEATED.findall(text)) if (kind[1:] & kind[:-1] & _MARK).any() else 0
    inside, alpha = (kind & _INSIDE) > 0, (kind & _ALPHA) > 0
    inner = len(_INNER.findall(text)) if (inside[1:] & alpha[:-1]).any() and (inside[:-1] & alpha[1:]).any() else 0
    marks = text.count("!"), text.count("?"), text.count(",") + text.count(".") + text.count(";") + text.count(":")
    return [
        fixed / n, math.log1p(fixed), hits / n, math.log1p(hits), total / n, math.log1p(total), strongest, len(bad) / max(1, len(distinct)),
        near / max(1, hits), near / n, len(you) / n,
        upper / chars, shout / n,
        marks[0] / n, marks[1] / n, marks[2] / n, repeated / n,
        hidden / n, inner / n, long / n,
        math.log1p(n), chars / n, len(distinct) / n,
    ]


N_FEATURES = 23


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a stem, by fold and label (twice the fold and the label)."""
    seen: list[Counter] = [Counter() for _ in range(2 * FOLDS)]
    for batch in pieces(batches):
        for text, label, fold in zip(*(batch[c].to_pylist() for c in ("text", "label", "fold"))):
            own = seen[2 * fold + label]
            own.update({s for w in set(tokens(text or "")) for s in stems(w)})
            own[""] += 1
    for of, counts in enumerate(seen):
        names = list(counts)
        for k in range(0, len(names), 10_000):
            part = names[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([of] * len(part), pa.int32()), pa.array([counts[s] for s in part], pa.int64())], names=["stem", "of", "n"])


def induce_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Stems with a high log odds ratio: for each fold those of the other folds, then those of all. ``sample``: text, label, fold.

    At most LEXICON_SIZE rows of each reach the driver.
    """
    rows = sample.select("text", "label", "fold").mapInArrow(_stem_counts, "stem string, of int, n long")
    by = [F.sum(F.when(F.col("of") == k, F.col("n")).otherwise(0)).alias(f"_{k}") for k in range(2 * FOLDS)]
    counts = rows.groupBy("stem").agg(*by)
    toxic = sum((F.col(f"_{2 * k + 1}") for k in range(FOLDS)), F.lit(0))
    counts = staged(counts.where((toxic >= 3) | (F.col("stem") == "")), "stems")
    totals = counts.where("stem = ''").first()
    out = []
    for left_out in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != left_out]
        n1, n0 = (sum(totals[f"_{2 * k + label}"] for k in folds) if totals else 0 for label in (1, 0))
        if not n1:
            out.append({})
            continue
        a, b = (sum((F.col(f"_{2 * k + label}") for k in folds), F.lit(0)) for label in (1, 0))
        odds = F.log((a + 0.5) / n1) - F.log((b + 0.5) / max(1, n0))
        kept = counts.where((F.col("stem") != "") & (a >= max(3, n1 // 100)) & (odds > LEAST_ODDS))
        top = kept.select("stem", odds.alias("odds"), a.alias("a")).orderBy(F.desc(F.col("odds") * F.sqrt("a")), "stem").limit(LEXICON_SIZE)
        out.append({r["stem"]: float(r["odds"]) for r in top.collect()})
    return out


def _features_of(texts: list[str | None], known: Words) -> np.ndarray:
    return np.array([features(t, known) for t in texts], dtype=np.float64).reshape(len(texts), N_FEATURES)


def learn(sample: DataFrame) -> tuple[dict[str, float], Boosted]:
    """Lexicon and calibrated trees. ``sample``: a bounded number of rows with doc_id, text and label (0 or 1)."""
    spark = sample.sparkSession
    sample = sample.select("doc_id", "text", "label", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    lexicons = induce_lexicons(sample)
    shared = spark.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Words(x) for x in shared.value]
        for batch in pieces(batches):
            texts, folds = batch["text"].to_pylist(), batch["fold"].to_pylist()
            whole = _features_of(texts, known[-1])
            unseen = np.array([features(t, known[f]) for t, f in zip(texts, folds)], dtype=np.float64)
            x = pa.array([v.tobytes() for v in np.concatenate([whole, unseen], axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], batch["fold"], x], names=["doc_id", "label", "fold", "x"])

    rows = sample.mapInArrow(run, "doc_id long, label int, fold int, x binary").toArrow()
    both = np.frombuffer(b"".join(rows["x"].to_pylist()), dtype=np.float64).reshape(-1, 2 * N_FEATURES)
    y, fold = rows["label"].to_numpy().astype(float), rows["fold"].to_numpy()
    order = np.lexsort((*both.T, rows["doc_id"].to_numpy()))  # sums of floats don't depend on the order of tasks
    x, unseen, y, fold = both[order, :N_FEATURES], both[order, N_FEATURES:], y[order], fold[order]
    margins = np.zeros(len(y))
    for k in range(FOLDS):
        # the rows that the trees learn from have features of their own folds' lexicons, as the left-out ones do
        margins[fold == k] = Boosted().fit(unseen[fold != k], y[fold != k]).margin(unseen[fold == k])
    return lexicons[-1], Boosted().fit(x, y).calibrate(margins, y)


def score(docs: DataFrame, model: tuple[dict[str, float], Boosted], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trees = Words(shared.value[0]), shared.value[1]
        for batch in pieces(batches):
            s = trees.score(_features_of(batch.column(batch.schema.get_field_index(text)).to_pylist(), known))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    kept = docs.drop("score", "predicted")
    return kept.mapInArrow(run, f"{fields(kept)}, score double, predicted int")


def labelled(docs: DataFrame, labels: DataFrame, which: str, folds: int, fold: int, most: int = TRAIN_DOCS, by_label: bool = False) -> DataFrame:
    """Documents to learn from, with their label and ``of``, the number of labels (of that value) that the sample is from.

    The sample, of about ``most`` rows (of each value), is taken from the labels, whose
    bounded number of ids is then broadcast, so that no text is shuffled.
    """
    one = labels.where(F.col(which).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(which).cast("int").alias("label"))
    one = staged(one.where(~held_out(F.col("doc_id"), folds, fold)), "labels")
    sample = bounded_sample(one, most, *["label"] * by_label).withColumnRenamed("_n", "of")
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(labelled(docs, read_table(spark, sf_dir, "labels"), "toxic", 3, 1))
    scored = score(docs.withColumn("held_out", held_out(F.col("doc_id"), 3, 1)), model)
    return scored.select("doc_id", "held_out", "score", "predicted")
