"""Embedding near-duplicates by search in a robust-pruned flat graph.

Vectors are clustered in two levels: by centroids that are fitted to a bounded sample, and
within each cell by centroids fitted to a sample of the cell, as many as make shards of
about ``SHARD`` vectors; their number has no bound. Every vector goes to the nearest few
cells and in each to the nearest few shards. A shard that is still large is cut into parts, and each
two parts meet in a shard of their own. In each shard a flat graph is
built: each vector's candidates are pruned robustly (a candidate that is much
closer to a kept neighbour than to the vector goes), and edges are also held
backwards. The adjacency lists that a vector has in its shards are united. Every
vector is then searched for in its shards: greedily from the shard's medoid, and once
the search is in range, the range is expanded from every vector in it until no new
one turns up. What is found is verified by the cosine in double precision. Two
vectors that share several shards are counted in the first of them.

Recall is audited against brute force for a set of queries, picked by hash whatever
was found, each compared with all vectors in blocks; the set grows until enough of
it has true links, or to a bound. Where the share of the links found, or its mean
over the queries with links, is below ``RECALL``, the search is done again with more cells, shards and
a wider beam, ``WIDER`` times at most; then a warning says what was reached.

Equal vectors are one node that stands for all its copies, whatever their ids.

Defined cases: vectors that are null, zero, hold nulls or non-finite components,
or have another length than most, link with nothing and are their own component; so
are rows with a null id; repeated rows are copies; rows that share an id and not the vector
have links and components of their own; an empty table gives an empty
result; other columns of the input aren't returned.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import read_table, staged, unstage
from .graph import least_of, roots_of, small
from .simhash import forest

log = logging.getLogger("fathomdex")

THRESHOLD, RECALL = 0.95, 0.98
#: Vectors that a shard should hold before overlap; members of a shard that isn't cut.
SHARD, LARGE = 500, 8000
#: Vectors that cells are fitted to; per shard those that it is fitted to; shards of a cell at most (a larger cell's are cut).
SAMPLE, PER_SHARD, SHARDS = 20_000, 64, 4096
#: Cells of a vector and shards in each at first; how often there may be one more of both.
CELLS, OVERLAP, WIDER = 2, 2, 3
DEGREE, CANDIDATES, BEAM, ALPHA = 24, 48, 32, 1.2
#: Queries audited at first; of them so many should have true links; values that all queries hold at most.
AUDITED, AUDITED_LINKED, AUDITED_VALUES = 200, 100, 1_000_000
#: Rows that a task places or searches on average.
ROWS = 4000


def usable(vectors: DataFrame, vec: str, embedding: str) -> DataFrame:
    """(id, k1, k2, v) of each row; v is null where it can't link. Floats stay floats until they are computed with."""
    single = isinstance(vectors.schema[embedding].dataType.elementType, FloatType)
    v = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec).cast("long").alias("id"), v.alias("v"))
    inf = F.lit(float("inf"))
    good = F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(good, F.col("v")))
    lengths = rows.where("v IS NOT NULL").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.withColumn("v", F.when(F.size("v") == (lengths["n"] if lengths else 0), F.col("v")))
    hashed = lambda seed: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v"))
    return rows.select("id", hashed("a").alias("k1"), hashed("b").alias("k2"), "v")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k unit centroids of unit vectors, by a few rounds from random ones of them."""
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(6 if k > 1 else 1):
        near = np.concatenate([(x[a : a + 2000] @ c.T).argmax(axis=1) for a in range(0, len(x), 2000)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = (np.abs(sums).max(axis=1) > 1e-9) & (np.bincount(near, minlength=k) > 0)
        c[full] = _unit(sums[full])
    return c


def _unit_of_id() -> Column:
    return F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def cell_centroids(nodes: DataFrame, n: int) -> np.ndarray:
    """Centroids of the cells: about the root of the number of shards, fitted to about SAMPLE nodes."""
    got = nodes.where(_unit_of_id() < min(1.0, SAMPLE / max(1, n))).select("id", "v").toArrow()
    if not got.num_rows:
        return np.zeros((1, 1))
    return k_means(_unit(_matrix(got["v"]))[np.argsort(got["id"].to_numpy())], min(SAMPLE // 8, math.isqrt(max(0, n - 1) // SHARD) + 1))


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(-(_unit(x) @ c.T), axis=1, kind="stable")[:, : min(k, len(c))].astype(np.int32)


def _cells_of(shared, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(_nearest(_matrix(batch["v"]), shared.value, cells)), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


def _fit_cell(rows: pa.Table) -> pa.Table:
    x = _unit(_matrix(rows["v"]))[np.argsort(rows["id"].to_numpy())]
    c = k_means(x, min(SHARDS, -(-rows["all"][0].as_py() // SHARD)))
    return pa.table({"cell": pa.array([rows["cell"][0].as_py()] * len(c), pa.int32()), "v": pa.array(list(c), pa.list_(pa.float64()))})


def _shards_in(overlap: int):
    """Rows come sorted by cell, salt and kind: a cell's centroids, then its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            cell, salt, kind = (batch[c].to_numpy() for c in ("cell", "salt", "kind"))
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if not kind[a]:
                    if at != (cell[a], salt[a]):
                        at, held = (cell[a], salt[a]), []
                    held.append(_matrix(some["v"]))
                    continue
                centres = np.concatenate(held)
                near = _nearest(_matrix(some["v"]), centres, overlap)
                rows = pa.array(np.repeat(np.arange(b - a), near.shape[1]))
                leaf = near.ravel().astype(np.int64) + (np.int64(cell[a]) << np.int64(16))
                yield pa.RecordBatch.from_arrays([some["id"].take(rows), some["n"].take(rows), some["v"].take(rows), pa.array(leaf)], names=["id", "n", "v", "leaf"])

    return run


def _tasks(df: DataFrame, rows: int) -> int:
    """Partitions by rows, as little data may mean much computing."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // ROWS)


def placed(nodes: DataFrame, n: int, centres: np.ndarray, wider: int) -> DataFrame:
    """A staged table (id, n, v, shard): each node in each of its shards."""
    spark = nodes.sparkSession
    kind = nodes.schema["v"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(centres)
    near = staged(nodes.mapInArrow(_cells_of(shared, CELLS + wider), f"id long, n long, v {kind}, cells array<int>"), "cells")
    counts = near.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("all"))
    first = near.select(F.element_at("cells", 1).alias("cell"), "id", "v")
    own = staged(first.groupBy("cell").agg(F.count("*").alias("all")), "counts")
    sample = first.join(F.broadcast(own), "cell").where(_unit_of_id() < F.least(F.lit(PER_SHARD / SHARD), F.lit(float(PER_SHARD * SHARDS)) / F.col("all")) + 32 / F.col("all"))
    fitted = staged(sample.groupBy("cell").applyInArrow(_fit_cell, "cell int, v array<double>"), "centroids")
    salts = staged(counts.select("cell", F.ceil(F.col("all") / (50 * ROWS)).cast("int").alias("salts")), "salts")  # a row per cell
    salts = F.broadcast(salts)
    spread = near.withColumn("cell", F.explode("cells")).join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "id"), "salts").cast("int"))
    # a cell that is nobody's nearest has no centroids of its own and isn't needed
    spread = spread.join(F.broadcast(own.select("cell")), "cell", "left_semi").select("cell", "salt", F.lit(1).alias("kind"), "id", "n", F.col("v").cast("array<double>").alias("v"))
    heads = fitted.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("cell", "salt", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), "v")
    rows = spread.union(heads).repartition(_tasks(nodes, 2 * n), "cell", "salt").sortWithinPartitions("cell", "salt", "kind", "id")
    leaves = staged(rows.mapInArrow(_shards_in(OVERLAP + wider), "id long, n long, v array<double>, leaf long").withColumn("v", F.col("v").cast(kind)), "leaves")
    large = staged(leaves.groupBy("leaf").count().where(F.col("count") > LARGE).select("leaf", F.ceil(F.col("count") / (LARGE / 2)).cast("int").alias("parts")), "large")
    if large.isEmpty():
        return leaves.withColumnRenamed("leaf", "shard")
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.coalesce("parts", F.lit(1))).cast("int")
    cut = leaves.join(small(large), "leaf", "left").withColumn("mine", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    # two parts meet in one shard, which holds both whole; a part needs no shard of its own
    cut = cut.where("parts IS NULL OR mine <> other")
    shard = F.when(F.col("parts").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", F.least("mine", "other"), F.greatest("mine", "other")))
    out = staged(cut.select("id", "n", "v", shard.alias("shard")), "cut")
    unstage(leaves)
    return out


def build_graph(x: np.ndarray) -> np.ndarray:
    """A pruned neighbour list for each of the unit vectors, with edges in both directions where there is room."""
    n = len(x)
    width = min(n, CANDIDATES)
    near = np.empty((n, width), dtype=np.int64)
    for a in range(0, n, 256):
        cos = x[a : a + 256] @ x.T
        part = np.argpartition(-cos, width - 1, axis=1)[:, :width]
        near[a : a + 256] = np.take_along_axis(part, np.argsort(-np.take_along_axis(cos, part, axis=1), axis=1, kind="stable"), axis=1)
    # a few far ones keep the graph navigable from the medoid
    far = np.random.default_rng(n).integers(0, n, (n, 8))
    return np.concatenate([robust_prune(x, near[a : a + 512], far[a : a + 512], a) for a in range(0, n, 512)]) if n else np.empty((0, DEGREE), dtype=np.int64)


def robust_prune(x: np.ndarray, near: np.ndarray, far: np.ndarray, first: int) -> np.ndarray:
    """Neighbours (-1: none) of the vectors from ``first`` on. A kept neighbour hides the candidates that are ALPHA times closer to it."""
    n, width = len(near), near.shape[1] + far.shape[1]
    candidates = np.concatenate([near, far], axis=1)
    rows = np.arange(first, first + n)
    vectors = x[candidates]
    own = 2 - 2 * np.einsum("id,ijd->ij", x[rows], vectors)
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = candidates != rows[:, None]
    out = np.full((n, DEGREE), -1, dtype=np.int64)
    filled = np.zeros(n, dtype=np.int64)
    for j in range(width):  # the candidates come nearest first, the far ones last
        at = np.flatnonzero(alive[:, j] & (filled < DEGREE))
        out[at, filled[at]] = candidates[at, j]
        filled[at] += 1
        alive[at] &= ALPHA * between[at, j] > own[at]
    return out


def both_ways(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All edges with their reverses, as (from, to), sorted and distinct."""
    i = np.repeat(np.arange(len(graph)), graph.shape[1])
    j = graph.ravel()
    i, j = i[j >= 0], j[j >= 0]
    pair = np.unique(np.concatenate([i * len(graph) + j, j * len(graph) + i]))
    return pair // max(1, len(graph)), pair % max(1, len(graph))


class Lists(NamedTuple):
    """Neighbours one list after another: those of i begin at ``first[i]``."""

    first: np.ndarray
    to: np.ndarray

    @classmethod
    def of(cls, n: int, fro: np.ndarray, to: np.ndarray) -> "Lists":
        return cls(np.append(0, np.cumsum(np.bincount(fro, minlength=n))), to)

    def of_all(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, neighbour) of all neighbours of the nodes."""
        width = self.first[nodes + 1] - self.first[nodes]
        return np.repeat(np.arange(len(nodes)), width), self.to[np.arange(width.sum()) + np.repeat(self.first[nodes] - np.cumsum(width) + width, width)]


def greedy(x: np.ndarray, lists: Lists, queries: np.ndarray, medoid: int, beam: int) -> np.ndarray:
    """The ``beam`` nearest vectors met (-1: none) by going from the medoid to ever nearer ones, for many queries at once."""
    m, q = len(queries), x[queries]
    beam = min(beam, len(x))
    ids = np.full((m, beam), -1, dtype=np.int64)
    cos = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), dtype=bool)
    ids[:, 0], cos[:, 0], done[:, 0] = medoid, q @ x[medoid], False
    met = np.zeros((m, len(x)), dtype=bool)
    met[:, medoid] = True
    active = np.arange(m)
    while True:
        going = ~done[active].all(axis=1)
        active = active[going]
        if not len(active):
            return np.where(cos > -np.inf, ids, -1)
        pick = done[active].argmin(axis=1)  # beams are sorted: the first that is open is the nearest
        done[active, pick] = True
        row, near = lists.of_all(ids[active, pick])
        fresh = ~met[active[row], near]
        row, near = row[fresh], near[fresh]
        met[active[row], near] = True
        c = np.einsum("kd,kd->k", x[near], q[active[row]])
        enters = c > cos[active[row], -1]
        row, near, c = row[enters], near[enters], c[enters]
        if not len(row):
            continue
        count = np.bincount(row, minlength=len(active))
        some = np.flatnonzero(count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = np.searchsorted(some, row)
        new_ids, new_cos = np.full((len(some), count.max()), -1, dtype=np.int64), np.full((len(some), count.max()), -np.inf)
        new_ids[at, place], new_cos[at, place] = near, c
        own = active[some]
        all_cos = np.concatenate([cos[own], new_cos], axis=1)
        top = np.argsort(-all_cos, axis=1, kind="stable")[:, :beam]
        cos[own] = np.take_along_axis(all_cos, top, axis=1)
        ids[own] = np.take_along_axis(np.concatenate([ids[own], new_ids], axis=1), top, axis=1)
        done[own] = np.take_along_axis(np.concatenate([done[own], new_ids < 0], axis=1), top, axis=1)


def in_range(x: np.ndarray, lists: Lists, queries: np.ndarray, starts: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, cosines to the queries) of those met by expanding the range from ``starts``: whatever is in range of a query leads on.

    The queries of a block share what is met, so each is held against it by one product.
    """
    seen = np.zeros(len(x), dtype=bool)
    seen[starts] = True
    front = starts
    while len(front):
        cos = x[front] @ x[queries].T
        yield front, cos
        near = lists.of_all(front[(cos >= threshold).any(axis=1)])[1]
        front = np.unique(near[~seen[near]])
        seen[front] = True


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard; rows come sorted by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch["shard"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1]["shard"][0].as_py() != shard[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _adjacency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _by_shard(batches):
        ids, shard = t["id"].to_numpy(), t["shard"][0].as_py()
        i, j = both_ways(build_graph(_unit(_matrix(t["v"]))))
        starts = np.searchsorted(i, np.arange(len(ids) + 1))
        for a in range(0, len(ids), 2000):
            some = range(a, min(len(ids), a + 2000))
            near = pa.array([ids[j[starts[k] : starts[k + 1]]] for k in some], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 2000]), pa.array([shard] * len(some), pa.int64()), near], names=["id", "shard", "near"])


def _memberships(shards: pa.ChunkedArray, shard: int) -> np.ndarray:
    """By member a 1 for each earlier shard that it shares with others of this one."""
    lists = shards.combine_chunks()
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    which = lists.flatten().to_numpy(zero_copy_only=False)
    of, which = of[which < shard], which[which < shard]
    names, place, count = np.unique(which, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count > 1)
    column = np.full(len(names), -1)
    column[several] = np.arange(len(several))
    keep = column[place] >= 0
    out = np.zeros((len(lists), len(several)), dtype=np.float32)
    out[of[keep], column[place[keep]]] = 1
    return out


def _searching(beam: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_shard(batches):
            order = np.argsort(t["id"].to_numpy(), kind="stable")
            t = t.take(pa.array(order))
            ids, copies, shard = t["id"].to_numpy(), t["n"].to_numpy(), t["shard"][0].as_py()
            x = _unit(_matrix(t["v"]))
            found = t["near"].combine_chunks()
            to = found.flatten().to_numpy(zero_copy_only=False)
            fro = np.repeat(np.arange(len(ids)), found.value_lengths().to_numpy(zero_copy_only=False))
            place = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
            here = ids[place] == to  # neighbours from other shards that are members of this one too
            fro, place = fro[here], place[here]
            near_of = Lists.of(len(ids), fro, place)
            earlier = _memberships(t["shards"], shard)
            medoid = int((x @ x.mean(axis=0)).argmax())
            links, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
            # neighbours are searched for together
            ranked = np.argsort(-(x @ x[medoid]), kind="stable")
            for a in range(0, len(ids), 256):
                queries = ranked[a : a + 256]
                near = greedy(x, near_of, queries, medoid, beam)
                for met, cos in in_range(x, near_of, queries, np.unique(np.append(near[near >= 0], queries)), threshold):
                    hit = cos >= threshold
                    # of those that share an earlier shard, that shard takes care
                    hit &= (earlier[met] @ earlier[queries].T == 0) & (met[:, None] != queries[None, :])
                    links[queries] += copies[met] @ hit
                    i, j = np.nonzero(hit)
                    label = forest(label, met[i], queries[j])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[label])], names=["id", "links", "root"])

    return run


def _search(nodes: DataFrame, n: int, centres: np.ndarray, wider: int, threshold: float) -> DataFrame:
    """A staged table of (id, links, root) per vector and shard."""
    spread = placed(nodes, n, centres, wider)
    tasks = _tasks(nodes, (CELLS + wider) * (OVERLAP + wider) * n)
    lists = spread.select("shard", "id", "v").repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_adjacency, "id long, shard long, near array<long>")
    union = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_list("shard").alias("shards"))
    whole = spread.join(union, "id").repartition(tasks, "shard").sortWithinPartitions("shard")
    found = staged(whole.mapInArrow(_searching(BEAM << wider, threshold), "id long, links long, root long"), "found")
    return found


def audit(nodes: DataFrame, found: DataFrame, threshold: float, queries: int = AUDITED) -> tuple[float, float]:
    """Recall of the links of some nodes, as brute force over all nodes has them: over all links, and as a mean over the nodes that have any."""
    spark = nodes.sparkSession
    while True:
        some = nodes.select("id", "v").orderBy(F.xxhash64(F.lit("audit"), "id"), "id").limit(queries).toArrow()
        if not some.num_rows:
            return 1.0, 1.0
        shared = spark.sparkContext.broadcast((some["id"].to_numpy(), _unit(_matrix(some["v"]))))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            total = np.zeros(len(ids), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    x, those, n = _unit(_matrix(batch["v"])), batch["id"].to_numpy(), batch["n"].to_numpy()
                    for a in range(0, len(ids), 1000):
                        i, j = np.nonzero(q[a : a + 1000] @ x.T >= threshold)
                        other = ids[a + i] != those[j]
                        np.add.at(total, a + i[other], n[j[other]])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], names=["id", "links"])

        truth = dict(tuple(r) for r in nodes.mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links")).collect())
        shared.unpersist()
        most = max(AUDITED, AUDITED_VALUES // max(1, len(some["v"][0])))
        if len(truth) >= AUDITED_LINKED or some.num_rows < queries or queries >= most:
            break
        queries = min(most, queries * 4)
    if not truth:
        return 1.0, 1.0
    asked = spark.createDataFrame(pa.table({"id": pa.array(list(truth), pa.int64())}))
    got = dict(tuple(r) for r in found.join(F.broadcast(asked), "id", "left_semi").groupBy("id").agg(F.sum("links")).collect())
    hit = np.array([min(got.get(i, 0), n) for i, n in truth.items()])
    all_links = np.array(list(truth.values()))
    return float(hit.sum() / all_links.sum()), float((hit / all_links).mean())


def near_duplicates(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """For each row: its id, n_links, component_id and kept."""
    rows = staged(usable(vectors, vec, embedding), "vectors")
    grouped = rows.where("v IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    known = staged(grouped, "nodes")
    n = known.count()
    # a node goes by one hash of its vector; if ever two share it, by the other
    name = next((k for k in ("k1", "k2") if known.select(k).distinct().count() == n), None)
    if name is None:
        known, name = staged(known.withColumn("name", F.monotonically_increasing_id()), "named"), "name"
    nodes = known.select(F.col(name).alias("id"), "n", "v")
    centres = cell_centroids(nodes, n)
    for wider in range(WIDER + 1):
        found = _search(nodes, n, centres, wider, threshold)
        recall = audit(nodes, found, threshold)
        if min(recall) >= RECALL:
            break
    else:
        log.warning("recall of links %.3f, mean over vectors %.3f", *recall)
    roots = roots_of(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    least = least_of(known.select(F.col(name).alias("node"), "least"), roots)
    per = known.select("k1", "k2", "n", F.col(name).alias("id")).join(links, "id").join(least.withColumnRenamed("_node", "id"), "id")
    per = per.select("k1", "k2", (F.col("links") + F.col("n") - 1).alias("links"), "_least")
    out = rows.select("id", "k1", "k2").join(per, ["k1", "k2"], "left")
    root = F.coalesce("_least", "id")
    return out.select(F.col("id").cast(vectors.schema[vec].dataType).alias(vec), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.cast("long").alias("component_id"), F.coalesce(root == F.col("id"), F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
