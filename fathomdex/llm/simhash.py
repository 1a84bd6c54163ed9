"""SimHash near-duplicates by a hierarchical index in Gray order.

Two fingerprints within r bits agree on at least k of r + k blocks of bits. Each
distinct fingerprint therefore goes to one bucket per choice of k blocks, and any two
that must be linked meet in a bucket; the pair belongs to the first of those. The
blocks are the key of the shuffle only, and the same at every size. In each
bucket, fingerprints are sorted by Gray rank and indexed: consecutive ones share
bits, which are factored into nodes as masked patterns, upper nodes holding what
their children share. A search for all fingerprints at once goes down the levels and
adds the differences to each node's own bits; a node whose sum exceeds r is pruned
with its whole group, and so is a node all of whose members are joined with the one
that is searched for already. A bucket returns no more links than it has members: a
spanning forest. Buckets of more than ``BUCKET`` members are cut into parts, and each
two parts meet in a group of their own.

Equal fingerprints are one node from the start, so copies cost nothing here.

Defined cases: null and empty texts have fingerprint zero, which is linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows are
copies; rows with a null id take part and have the smallest id of their component;
an empty table gives an empty result; of the input's columns ``fingerprints`` passes
all on but the text and one named ``_fp``, and ``drop_near_copies`` all whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, packed, pieces, read_table, staged, unstage
from .graph import least_of, roots_of, small

SEED = 42
#: Blocks that agree in a bucket; members of a bucket that isn't cut.
BLOCKS, BUCKET = 2, 50_000
#: Members of a node; places that the search of one block of fingerprints can reach at most (a single one may reach its whole bucket).
FANOUT, REACH = 16, 4_000_000


def _digests(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of whole words, A-Z lower-cased."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip([0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist())], dtype=np.uint64)


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _remixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash (a finaliser of multiplications and shifts)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, words: int) -> int:
    return _majority(_digests(text or "", words))


def fingerprints(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``_fp`` (the fingerprint as a signed long)."""
    docs = docs.drop("_fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            one = [fingerprint(t, words) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            cols = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != text]
            cols.append(pa.array(np.array(one, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(cols, names=[*[n for n in batch.schema.names if n != text], "_fp"])

    return docs.mapInArrow(run, ", ".join(x for x in (fields(docs, text), "_fp long") if x))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the order of the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of nodes over groups of fingerprints, each group in Gray order; a node keeps only the bits that its parent doesn't.

    ``starts`` are the first places of the groups in ``codes``. A node never spans two groups; the top level has one for each.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.starts, self.sizes = starts, np.diff(np.append(starts, len(codes)))
        ones, zeros = codes, codes  # AND and OR of the members
        mask, ends = np.full(len(codes), ~np.uint64(0)), np.arange(1, len(codes) + 1)
        self.patterns, self.own, self.ends, self.children = [codes], [], [ends], []
        count, offset = self.sizes, starts
        while True:
            up = -(-count // FANOUT)
            local = np.arange(up.sum()) - np.repeat(np.cumsum(up) - up, up)
            cuts = np.repeat(offset, up) + local * FANOUT
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(zeros, cuts)
            children = np.append(cuts, len(mask))
            above = ~(ones ^ zeros)
            self.own.append(mask & ~np.repeat(above, np.diff(children)))
            self.patterns.append(ones & above)
            self.children.append(children)
            self.ends.append(self.ends[-1][children[1:] - 1])
            mask, count, offset = above, up, np.cumsum(up) - up
            if count.max() == 1:
                break
        self.own.append(mask)

    def _joined(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level, the label that all members of a node have, or -1."""
        out = [label]
        for children in self.children:
            low, high = np.minimum.reduceat(out[-1], children[:-1]), np.maximum.reduceat(out[-1], children[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def _search(self, r: int, codes: np.ndarray, groups: np.ndarray, after: np.ndarray, label: np.ndarray, joined: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        level = len(self.patterns) - 1
        i, node, acc = np.arange(len(codes)), groups, np.zeros(len(codes), dtype=np.uint8)
        while True:
            acc = acc + np.bitwise_count((codes[i] ^ self.patterns[level][node]) & self.own[level][node])
            keep = (acc <= r) & (self.ends[level][node] > after[i] + 1) & (joined[level][node] != label[i])
            i, node, acc = i[keep], node[keep], acc[keep]
            if not level:
                return i, node
            level -= 1
            first = self.children[level][node]
            width = self.children[level][node + 1] - first
            i, acc = np.repeat(i, width), np.repeat(acc, width)
            node = np.arange(len(i)) + np.repeat(first - np.cumsum(width) + width, width)

    def join(self, r: int, codes: np.ndarray, member: np.ndarray, query: np.ndarray, groups: np.ndarray, after: np.ndarray, near=None) -> np.ndarray:
        """The labels of all rows once each query is linked with all places of its group within r bits that lie after ``after``.

        ``codes`` are those of all rows, ``member`` the rows that stand at the places, ``query`` rows too. ``near``
        keeps some of the pairs of rows.
        """
        label = np.arange(len(codes))
        joined = self._joined(label[member])
        cost, at = np.cumsum(self.sizes[groups]), 0
        while at < len(query):
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + REACH, side="right")))
            rows = query[at:to]
            i, place = self._search(r, codes[rows], groups[at:to], after[at:to], label[rows], joined)
            u, v = rows[i], member[place]
            if len(u) and near is not None:
                keep = near(u, v)
                u, v = u[keep], v[keep]
            if len(u):
                label = forest(label, u, v)
                if to < len(query):
                    joined = self._joined(label[member])
            at = to
        return label


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels (each the least place of those joined) after the links (i, j)."""
    label = label.copy()
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


class Blocks:
    """The r + k blocks of bits, and one bucket for each choice of k of them."""

    def __init__(self, r: int, k: int = BLOCKS):
        cuts = np.linspace(0, 64, r + k + 1).round().astype(int)
        self.spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        self.choices = list(combinations(range(r + k), k))
        self.masks = np.array([((1 << (b - a)) - 1) << a for a, b in self.spans], dtype=np.uint64)
        self.k = k

    def keys(self, fp: Column) -> Column:
        """An array of bucket numbers: the choice, then the bits of its blocks."""
        part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in self.spans]
        out = []
        for number, choice in enumerate(self.choices):
            key = F.lit(number).cast("long")
            for block in choice:
                a, b = self.spans[block]
                key = F.shiftleft(key, b - a).bitwiseOR(part[block])
            out.append(F.struct(F.lit(number).alias("choice"), key.alias("key")))
        return F.array(*out)

    def owned(self, choice: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether these choices are the first under which the fingerprints share a bucket."""
        same = ((x ^ y)[:, None] & self.masks[None, :]) == 0
        rank = same.cumsum(axis=1)
        chosen = np.zeros((len(self.choices), len(self.spans)), dtype=bool)
        for number, blocks in enumerate(self.choices):
            chosen[number, list(blocks)] = True
        return ((same & (rank <= self.k)) == chosen[choice]).all(axis=1)


#: Rows that are indexed together, at the next end of a bucket.
TOGETHER = 1 << 16
_GROUP = ("choice", "key", "a", "b")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """The places at which a row differs from the one before, the first included."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _linking(blocks: Blocks | None, r: int, both: int | None = None):
    """Finds the links in buckets, whose rows come sorted by _GROUP. Without blocks, a pair may be found in several."""

    def links(choice, key, a, b, part, node, fp, fp2=None) -> tuple[np.ndarray, np.ndarray]:
        starts = _changes(choice, key, a, b)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        several = np.bincount(group)[group] > 1
        if not several.any():
            return node[:0], node[:0]
        choice, a, b, part, node, fp, group = (x[several] for x in (choice, a, b, part, node, fp, group))
        fp2 = fp2[several] if fp2 is not None else None
        order = np.lexsort((gray_rank(fp), group))
        member = order[part[order] == b[order]]
        starts = _changes(group[member])
        known = group[member][starts]  # a group of two parts may lack one of them
        query = order[(part[order] == a[order]) & np.isin(group[order], known)]
        place = np.full(len(fp), -1)
        place[member] = np.arange(len(member))

        def near(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            keep = np.ones(len(u), dtype=bool)
            if both is not None:
                keep &= np.bitwise_count(fp[u] ^ fp[v]) + np.bitwise_count(fp2[u] ^ fp2[v]) <= both
            if blocks is not None:
                keep &= blocks.owned(choice[u], fp[u], fp[v])
            return keep

        index = GrayIndex(fp[member], starts)
        after = np.where(a[query] == b[query], place[query], -1)
        label = index.join(r, fp, member, query, np.searchsorted(known, group[query]), after, near)
        u = np.flatnonzero(label != np.arange(len(label)))
        return node[u], node[label[u]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            u, v = links(*(np.concatenate(x) for x in zip(*held)))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = tuple(batch[c].to_numpy() for c in (*_GROUP, "part", "node"))
            arrays += tuple(batch[c].to_numpy().view(np.uint64) for c in ("_fp", "_fp2") if c in batch.schema.names)
            if size >= TOGETHER:
                cut = _changes(*arrays[:4])
                if any(x[0] != y[-1] for x, y in zip(arrays[:4], held[-1])):
                    cut = np.append(cut, 0)  # the batch begins with a new group
                else:
                    cut = cut[cut > 0]
                if len(cut):
                    to = int(cut.min())
                    if to:
                        held.append(tuple(x[:to] for x in arrays))
                    yield from close()
                    held, size, arrays = [], 0, tuple(x[to:] for x in arrays)
            held.append(arrays)
            size += len(arrays[0])
        if held:
            yield from close()

    return run


#: Counters by which large buckets are told: a bucket's counter counts it and others.
COUNTERS = 1 << 16


def dealt(spread: DataFrame, most: int = 0) -> DataFrame:
    """``spread`` (choice, key, node, ...) with part, a and b, laid out for ``_linking``.

    Buckets of more than ``most`` rows are cut into parts by node; a row goes to all
    groups of its part and another. Only buckets under a large counter are counted exactly.
    """
    most = most or BUCKET
    counter = F.pmod(F.xxhash64("choice", "key"), F.lit(COUNTERS)).cast("int")
    full = staged(spread.groupBy(counter.alias("_counter")).count().where(F.col("count") > most).select("_counter"), "counters")
    if full.isEmpty():
        out = spread.select("*", *[F.lit(0).alias(c) for c in ("part", "a", "b")])
    else:
        inside = spread.withColumn("_counter", counter).join(F.broadcast(full), "_counter", "left_semi")
        large = staged(inside.groupBy("choice", "key").count().where(F.col("count") > most).select("choice", "key", F.ceil(F.col("count") / most).cast("int").alias("_parts")), "large")
        parts = F.coalesce("_parts", F.lit(1))
        cut = spread.join(small(large), ["choice", "key"], "left").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), parts).cast("int"))
        cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        out = cut.select(*spread.columns, "part", F.least("part", "_other").alias("a"), F.greatest("part", "_other").alias("b"))
    return out.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def link(nodes: DataFrame, r: int) -> DataFrame:
    """Links (u, v) that join all nodes within r bits of each other.

    ``nodes``: a staged table of distinct (node, _fp). Fingerprints are only ever
    gathered by bucket.
    """
    blocks = Blocks(r)
    spread = nodes.withColumn("_at", F.explode(blocks.keys(F.col("_fp")))).select("_at.choice", "_at.key", "node", "_fp")
    return dealt(spread).mapInArrow(_linking(blocks, r), "u long, v long")


def grouped(marked: DataFrame, r: int) -> DataFrame:
    """(_node, _least) of fingerprints within r bits. ``marked``: a staged table of doc_id, _fp, _node."""
    nodes = staged(marked.groupBy(F.col("_node").alias("node"), "_fp").agg(F.min("doc_id").alias("least")), "nodes")
    return least_of(nodes.drop("_fp"), roots_of(link(nodes.drop("least"), r)))


#: Near-copies share NEAR[0] of NEAR[1] of the different shingles that either has.
NEAR = (4, 5)
#: Candidates agree on all ROWS minima of one of BANDS bands: at a similarity of 0.8 all bands fail in 2e-5 of pairs.
ROWS, BANDS = 6, 36
#: They also differ in no more bits than this, of 64 and of 128. At 0.8 pairs differ in 15% to 19% of bits: the bounds are 4.5 deviations off or more.
WIDE, WIDE_BOTH = 26, 48
#: Shingles that a group of candidates holds on average when it is verified in one piece.
PART = 200_000

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_WEIGHTS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band of minima; sets of fewer shingles than NEAR needs to tell two sets apart have none."""
    if len(shingles) < NEAR[0]:
        return np.empty(0, dtype=np.int64)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(h), 1024):
        np.minimum(least, (_FACTORS[:, None] * h[None, k : k + 1024]).min(axis=1), out=least)
    mixed = (_remixed(least.astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1)) * _WEIGHTS).sum(axis=1, dtype=np.uint64)
    return _remixed(mixed + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text, ``_text`` to doc_id, ``_text``, ``_node`` (a hash of the set of shingles), ``_n`` of them, 128 bits and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 100):
            sets = [np.unique(_digests(t or "", words)) for t in batch["text"].to_pylist()]
            node = [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets]
            one, two = [_majority(x) for x in sets], [_majority(_remixed(x)) for x in sets]
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (node, one, two)]
            n = pa.array([len(x) for x in sets], type=pa.int64())
            keys = pa.array([_band_keys(x) for x in sets], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_text"], longs[0], n, *longs[1:], keys], names=["doc_id", "_text", "_node", "_n", "_fp", "_fp2", "_keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "_text").mapInArrow(run, f"doc_id {kind}, _text long, _node long, _n long, _fp long, _fp2 long, _keys array<long>")


def near_sets(sets: list[np.ndarray], label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all sets with a Jaccard similarity of NEAR or more, each of them such a pair.

    A set is only held against larger ones that it isn't joined with yet; ``label`` says what is joined before.
    """
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    ends = np.cumsum(sizes)
    number = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    mark = np.zeros(int(number.max()) + 1, dtype=bool)
    label = np.arange(len(sets)) if label is None else label[order].copy()
    u, v = [], []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, np.searchsorted(sizes * NEAR[0], sizes[i] * NEAR[1], side="right"))
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        mine = number[ends[i] - sizes[i] : ends[i]]
        mark[mine] = True
        starts = np.cumsum(sizes[j]) - sizes[j]
        places = np.arange(int(sizes[j].sum())) + np.repeat(ends[j] - sizes[j] - starts, sizes[j])
        shared = np.add.reduceat(mark[number[places]], starts, dtype=np.int64)
        mark[mine] = False
        j = j[(NEAR[0] + NEAR[1]) * shared >= NEAR[0] * (sizes[i] + sizes[j])]
        if len(j):
            u += [i] * len(j)
            v += j.tolist()
            label[np.isin(label, label[j])] = label[i]
    return order[np.array(u, dtype=int)], order[np.array(v, dtype=int)]


def _verifying(words: int):
    """Links in groups of texts, whose rows come sorted by family, a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, labels, sets = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                i, j = near_sets(sets, np.array(labels))
                x = np.array(nodes, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(x[j])], names=["u", "v"])

        for batch in pieces(batches, 100):
            for key, node, label, text in zip(zip(*(batch[c].to_pylist() for c in ("family", "a", "b"))), *(batch[c].to_pylist() for c in ("node", "label", "text"))):
                if key != at:
                    yield from close()
                    at, nodes, labels, sets = key, [], [], []
                nodes.append(node)
                labels.append(label)
                sets.append(np.unique(_digests(text, words)))
        yield from close()

    return run


def verified(rows: DataFrame, words: int) -> DataFrame:
    """Links between near-copies of one family. ``rows``: a staged table of node, family, _n (shingles) and text.

    A family of up to ``PART`` shingles is one group. A larger one is cut into parts
    that are verified in themselves at first; then one text of each set of joined ones is held
    against those of the other parts; at last the texts that still aren't joined with the most of
    their family are held against all of it. So a large group of near-copies costs
    about as much as it has members, and no pair is passed over.
    """

    def check(df: DataFrame) -> DataFrame:
        return df.repartition("family", "a", "b").sortWithinPartitions("family", "a", "b").mapInArrow(_verifying(words), "u long, v long")

    def cut(df: DataFrame, name: str) -> DataFrame:
        """Adds how many parts the rows of each family make, and the row's own."""
        parts = staged(df.groupBy("family").agg(F.ceil(F.sum("_n") / PART).cast("int").alias(f"{name}s")), "parts")
        return df.join(small(parts), "family").withColumn(name, F.pmod(F.xxhash64(F.lit(name), "node"), F.col(f"{name}s")).cast("int"))

    def labelled(df: DataFrame, links: DataFrame) -> DataFrame:
        return df.join(roots_of(links), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")

    rows = cut(rows, "_part")
    alone = F.col("node").alias("label")
    links = staged(check(rows.select("family", F.col("_part").alias("a"), F.lit(0).alias("b"), "node", alone, "text")), "links")
    large = rows.where("_parts > 1")
    if large.isEmpty():
        return links
    first = labelled(large, links).where("label = node").drop("_part", "_parts", "label")
    again = cut(first, "_part")
    pairs = again.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    links = staged(links.union(check(pairs.select("family", F.least("_part", "_other").alias("a"), F.greatest("_part", "_other").alias("b"), "node", alone, "text"))), "links")
    # the rest against the whole of their families
    now = labelled(large, links)
    most = staged(now.groupBy("family", "label").agg(F.sum("_n").alias("size")).groupBy("family").agg(F.max_by("label", F.struct("size", "label")).alias("_most"), F.count("*").alias("_labels")).where("_labels > 1"), "most")
    if most.isEmpty():
        return links
    now = now.join(small(most), "family")
    rest = cut(now.where("label <> _most").drop("_part", "_parts"), "_rest")
    many = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    rest = rest.join(small(staged(now.select("family", "_parts").distinct(), "families")), "family").withColumn("b", many)
    rests = staged(rest.select("family", "_rests").distinct(), "rests")
    whole = now.join(small(rests), "family").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("_rests") - 1))).withColumn("b", F.col("_part"))
    both = rest.withColumn("a", F.col("_rest")).select("family", "a", "b", "node", "label", "text").union(whole.select("family", "a", "b", "node", "label", "text"))
    return links.union(check(both))


def near_groups(marked: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(_node, _least): the smallest (doc_id, _text) of each group of near-copies. ``marked``: a staged table of ``shingle_sets`` of ``docs``.

    Nodes that share a band and are within the wide bounds of bits are joined into
    families of candidates, kept as spanning forests. The texts of families are read
    again, and only pairs that are near by their sets of shingles become links.
    """
    firsts = [F.first(c).alias(c) for c in ("_n", "_fp", "_fp2", "_keys")]
    nodes = staged(marked.groupBy(F.col("_node").alias("node")).agg(F.min(F.struct("doc_id", "_text")).alias("least"), *firsts), "nodes")
    spread = nodes.select(F.lit(0).alias("choice"), F.explode("_keys").alias("key"), "node", "_fp", "_fp2")
    family = roots_of(dealt(spread).mapInArrow(_linking(None, WIDE, WIDE_BOTH), "u long, v long"))
    chosen = small(staged(nodes.join(family.withColumnRenamed("root", "family"), "node").select("least.doc_id", "least._text", "node", "family", "_n"), "chosen"))
    texts = staged(docs.select("doc_id", "_text", "text").join(chosen, ["doc_id", "_text"]).select("node", "family", "_n", "text").dropDuplicates(["node"]), "texts")
    groups = least_of(nodes.select("node", "least"), roots_of(verified(texts, words)))
    unstage(nodes, texts)
    return groups


def drop_near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near-copies: the one with the smallest id.

    Two texts are near-copies when the Jaccard similarity of their sets of shingles
    of ``words`` words is 0.8 or more; a text of fewer words is one shingle. Texts
    without a word are no copies of anything. Rows with a null id are kept; of rows
    that share an id and a text one stays. A row is known by its id and its text's hash.
    """
    row = ["doc_id", "_text"]
    keyed = docs.select(packed(docs), "doc_id", F.xxhash64("text").alias("_text"))
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("_text"))
    marked = staged(shingle_sets(worded, words), "marked")
    out = marked.select(*row, "_node").join(near_groups(marked, worded, words), "_node").where(F.struct(*row) != F.col("_least")).select(*row).distinct()
    out = staged(out, "copies")
    unstage(marked)
    kept = keyed.join(small(out), row, "left_anti")
    again = staged(keyed.where(F.col("doc_id").isNotNull()).groupBy(*row).count().where("count > 1").select(*row), "again")
    if not again.isEmpty():
        kept = kept.join(again, row, "left_anti").select(*keyed.columns).unionByName(kept.join(again, row, "left_semi").select(*keyed.columns).dropDuplicates(row))
    return kept.select("_row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 4)
    marked = staged(marked.withColumn("_node", F.col("_fp")), "marked")
    out = marked.join(grouped(marked, 4), "_node")
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_least").alias("component_id"))
