"""Exact cosine search.

Every partition (or cell of items and queries, where these are many) keeps its best rows for each query, found by matrix products over
Arrow batches; only those few rows leave the Python workers. The texts of the
hits are joined afterwards, so the scan reads vectors and keys alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import in_folder

#: Scores are compared after rounding to so many decimals, so that ties are ties on any machine.
RANK_DECIMALS = 9


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return np.where(size > 0, x / np.where(size > 0, size, 1), 0.0)


#: Queries whose scores are held together, by default and at most.
SCORED = 64


def _best_of(batches: Iterable[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int, keys: Sequence[str], vector: str, exclude_self: str | None, together: int) -> pa.Table | None:
    """(*keys, query_id, score): the k best rows of the batches for each of the unit vectors ``q``."""
    best: pa.Table | None = None
    floor = np.full(len(ids), -2.0)  # each query's k-th score so far: lower ones can't come in
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch[vector]))
        if not batch.num_rows:
            continue
        column = batch[vector]
        x = _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
        rest = pa.Table.from_batches([batch.select(keys)])
        found = [best] if best is not None else []
        for a in range(0, len(ids), together):
            score = np.round(q[a : a + together] @ x.T, RANK_DECIMALS)
            if exclude_self:
                score[ids[a : a + together, None] == batch[exclude_self].to_numpy()[None, :]] = -np.inf
            kth = np.partition(score, -k, axis=1)[:, -k] if k < score.shape[1] else np.full(len(score), -2.0)
            i, j = np.nonzero(score >= np.maximum(kth, floor[a : a + together])[:, None])
            part = rest.take(pa.array(j))
            found.append(part.append_column("query_id", pa.array(ids[a + i])).append_column("score", pa.array(score[i, j])))
        best = _best(pa.concat_tables(found), keys, k).combine_chunks()
        own, first, count = np.unique(best["query_id"].to_numpy(), return_index=True, return_counts=True)
        full = dict(zip(own[count == k].tolist(), best["score"].to_numpy()[(first + k - 1)[count == k]].tolist()))
        floor = np.array([full.get(n, -2.0) for n in ids.tolist()])
    return best


def _ranks(hits: DataFrame, k: int, order: list) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def _schema(items: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(items.dtypes)
    return ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "query_id long, score double"])


def top_k(items: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, keys: Sequence[str], vector: str = "vector", exclude_self: str | None = None, together: int = SCORED) -> DataFrame:
    """(query_id, *keys, score, rank): the k best items of each query, ties by keys.

    ``queries`` come from the caller, so their number is the caller's; ``together`` of
    them are scored at a time. ``exclude_self``: the key that may not equal the query's id.
    """
    spark, schema = items.sparkSession, _schema(items, keys)
    if not queries:
        return spark.createDataFrame([], f"{schema}, rank int")
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = _unit(np.array([v for _, v in queries], dtype=np.float64).reshape(len(queries), -1))
    shared = spark.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _best_of(batches, *shared.value, k, keys, vector, exclude_self, together)
        if best is not None:
            yield from best.to_batches()

    hits = items.select(*keys, vector).mapInArrow(run, schema)
    order = [F.desc("score"), *keys]
    if len(queries) == 1:
        ranked = hits.orderBy(*order).limit(k)
        return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return _ranks(hits, k, order)


#: Queries that are sent to the workers together, and items that are held against more than that.
BLOCK, CELL = 20_000, 20_000


def top_k_of(items: DataFrame, queries: DataFrame, k: int, keys: Sequence[str], vector: str = "vector", exclude_self: str | None = None, block: int = SCORED) -> DataFrame:
    """``top_k`` for a table of queries (id, vector) of any length, scored ``block`` at a time.

    Up to ``BLOCK`` queries are sent to the workers, and the items are scanned once. More
    stay in Spark: items and queries are dealt into cells of about ``CELL`` by ``BLOCK``
    rows, each of which fits a worker, so the driver holds ``BLOCK`` queries at most.
    """
    number, value = queries.columns
    asked, together = queries.count(), min(block, SCORED)
    if asked <= BLOCK:
        return top_k(items, [(int(q), v) for q, v in queries.collect()], k, keys, vector, exclude_self, together)
    across, down = items.count() // CELL + 1, asked // BLOCK + 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = items.select(*keys, vector, F.pmod(F.xxhash64(*keys), F.lit(across).cast("long")).alias("_across"), numbers(down).alias("_down"))
    right = queries.select(F.col(number).cast("long").alias("_id"), F.col(value).alias("_value"), F.pmod(F.xxhash64(number), F.lit(down).cast("long")).alias("_down"))
    right = right.withColumn("_across", numbers(across))

    def cell(own: pa.Table, asking: pa.Table) -> pa.Table:
        best = None
        if own.num_rows and asking.num_rows:
            q = _unit(asking["_value"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(asking.num_rows, -1))
            best = _best_of(own.to_batches(10_000), asking["_id"].to_numpy(), q, k, keys, vector, exclude_self, together)
        if best is None:
            best = own.select(keys).slice(0, 0).append_column("query_id", pa.array([], pa.int64())).append_column("score", pa.array([], pa.float64()))
        return best

    by = ("_across", "_down")
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(cell, _schema(items, keys))
    return _ranks(hits, k, [F.desc("score"), *keys])


def _best(table: pa.Table, keys: Sequence[str], k: int) -> pa.Table:
    table = table.sort_by([("query_id", "ascending"), ("score", "descending"), *[(c, "ascending") for c in keys]])
    q = table["query_id"].to_numpy()
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, dtype=int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return table.filter(pa.array(place < k))


HIT = ("doc_id", "chunk_id", "texto", "fichero", "raiz", "ruta_relativa", "pagina", "fecha_modificacion")


def search(index: DataFrame, vector: Sequence[float], n: int = 5, folder: str | None = None, mode: str = "exact") -> DataFrame:
    """The n best chunks, as hits.

    ``exact`` filters by folder before ranking. ``overfetch`` ranks first, takes
    min(5 n, 200) and filters those, so it may return fewer than n although more match.
    """
    return search_many(index, [(0, vector)], n, folder, mode).drop("query_id").orderBy(F.desc("score"), "doc_id", "chunk_id")


def search_many(index: DataFrame, queries: Sequence[tuple[int, Sequence[float]]] | DataFrame, n: int = 5, folder: str | None = None, mode: str = "exact") -> DataFrame:
    """Hits of several queries: a list, or a table (id, vector)."""
    pool = index.where(in_folder(F.col("ruta_relativa"), folder)) if folder and mode == "exact" else index
    k = min(5 * n, 200) if folder and mode == "overfetch" else n
    many = isinstance(queries, DataFrame)
    hits = (top_k_of if many else top_k)(pool, queries, k, ("doc_id", "chunk_id"))
    # k rows a query: few for a list, which is the caller's
    rows = pool.select(*HIT).join(hits if many else F.broadcast(hits), ["doc_id", "chunk_id"])
    if folder and mode == "overfetch":
        rows = rows.where(in_folder(F.col("ruta_relativa"), folder))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= n)
    return rows.select("query_id", *HIT, F.round("score", 4).alias("score"))
