"""Benchmark decontamination by the q-gram lemma.

A stretch of ``window`` characters of an item and a stretch of a document within e
edits of it share at least window + 1 - q - q * e q-grams, all on neighbouring
diagonals (document position less item position). A document is searched in three steps:

1. Its q-grams that occur in the benchmark are counted per item in stretches of a window's
   length and e more; only stretches that reach the bound go on.
2. There q-grams are counted in overlapping bands of diagonals, in tiles of bounded size: items
   are held in segments of at most ``SEGMENT`` characters that overlap by a window.
3. Windows that reach the bound in a band are verified by banded alignment.

The first place that holds a window stands for a document and an item. Items shorter than the
window are one window, with edits in proportion; those of fewer than ``SHORT`` characters
are too short for the lemma and must occur exactly, between characters that are no letters or digits.

Texts are compared by code points with letters lower-cased and each run of white space
as one space; positions in the result are those of the text itself.

The benchmark is split into parts of at most ``PART_CHARS`` characters on average (a part has
some 16 bytes for each in memory), each of which is broadcast and held against all documents;
documents are never shuffled. Memory doesn't grow with how often q-grams repeat: lists of
q-grams in common are made for at most ``PAIRS`` of them at a time, and equal tiles are
searched once.

Defined cases: null and empty texts match nothing, and neither do items without a
character other than white space; repeated rows each get their own result; empty tables
give empty results; columns named as those of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, pieces, read_table

Q, WINDOW, EDIT_SHARE, SHORT = 12, 80, 0.05, 32
PART_CHARS = 8_000_000
#: Characters of documents that are hashed at once; of an item in a segment; pairs of equal q-grams listed at once.
CHUNK, SEGMENT, PAIRS = 1 << 18, 2000, 1 << 20
_FILTER_BITS = 22
#: Results of tiles and alignments that are remembered at most.
REMEMBERED = 1 << 14

_SPACES = [c for c in range(0x3001) if chr(c).isspace()]


def _folding() -> np.ndarray:
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1 and ord(low) < 0x10000:
            table[c] = ord(low)
    table[_SPACES] = 32
    return table


_FOLD = _folding()


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points, and the place of each in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < 0x10000, _FOLD[np.minimum(codes, 0xFFFF)], codes) if len(codes) and codes.max() > 0xFFFF else _FOLD[codes]
    space = codes == 32
    space[1:] &= space[:-1]  # a space after a space
    space[:1] = False
    place = np.flatnonzero(~space)
    return codes[place], place


def q_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each q-gram, from hashes of its halves (Q is 8 + 4)."""
    if len(codes) < Q:
        return np.empty(0, dtype=np.uint64)
    k = np.uint64(0x9E3779B97F4A7C15)
    h = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for width in (1, 2):
            h = h[:-width] * k + h[width:]
            k = k * k
        four = h
        h = h[:-4] * k + h[4:]
        h = h[:-4] * k + four[8:]
        return h * np.uint64(0xD6E8FEB86659FD93)


def edits(window: int) -> int:
    return int(window * EDIT_SHARE)


def band_edits(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Edits of ``a`` against the best stretch of ``b``, and where that begins and ends; None above ``most``."""
    n = len(b)
    # a row of the alignment at a time: costs, and where the stretch began
    cost, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for ch in a:
        diagonal = cost[:-1] + (b != ch)
        above = cost + 1
        new, from_ = above.copy(), start.copy()
        better = diagonal <= new[1:]
        new[1:][better], from_[1:][better] = diagonal[better], start[:-1][better]
        lowest = np.minimum.accumulate(new - steps) + steps  # gaps to the left
        if (lowest < new).any():
            at = np.maximum.accumulate(np.where(lowest == new, steps, 0))
            from_ = from_[at]
        cost, start = lowest, from_
        if cost.min() > most:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= most else None


def bound(m: int) -> int:
    """Shared q-grams of a window of m characters and what it matches, at least."""
    return m + 1 - Q - Q * edits(m)


def _text_of(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class _Memo(dict):
    """Remembers results, and forgets them all when they are too many."""

    def get_or(self, key, make):
        if key not in self:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = make()
        return self[key]


class Benchmark:
    """The items of one part, with an index of their q-grams."""

    def __init__(self, items: Sequence[tuple[int, str]]):
        self.ids, self.codes, self.short = [], [], {}
        for i, t in items:
            codes = folded((t or "").strip())[0]
            if len(codes) >= SHORT:
                step = SEGMENT - WINDOW + 1
                parts = [codes[a : a + SEGMENT] for a in range(0, max(1, len(codes) - WINDOW + 1), step)]
                self.ids += [i] * len(parts)
                self.codes += parts
            elif len(codes):
                self.short.setdefault(_text_of(codes), []).append(i)
        hashes = [q_hashes(c) for c in self.codes]
        h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        part = np.repeat(np.arange(len(hashes), dtype=np.uint32), [len(x) for x in hashes])
        order = np.lexsort((part, h))
        h, part = h[order], part[order]
        one = np.ones(len(h), dtype=bool)  # a q-gram counts once for each segment here
        one[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        self.hash, self.part = h[one], part[one]
        self.least = np.array([bound(min(len(c), WINDOW)) for c in self.codes])
        self.reach = np.array([min(len(c), WINDOW) + edits(min(len(c), WINDOW)) - Q for c in self.codes])
        self.some = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.some[h >> np.uint64(64 - _FILTER_BITS)] = True
        self._ready()

    def _ready(self) -> None:
        """What isn't sent with the index: an automaton of the short items, and memories."""
        self.own, self.tiles, self.aligned, self.finder = _Memo(), _Memo(), _Memo(), None
        if self.short:
            self.finder = ahocorasick.Automaton()
            for text, ids in self.short.items():
                self.finder.add_word(text, (len(text), ids))
            self.finder.make_automaton()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("own", "tiles", "aligned", "finder")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def find(self, texts: Sequence[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(place in texts, item, start, end, edits, shared q-grams) of each item that a text holds a window of."""
        held, size = [], 0
        for i, t in enumerate(texts):
            if t:
                held.append((i, *folded(t)))
                size += len(held[-1][1]) + WINDOW
            if held and (size >= CHUNK or i == len(texts) - 1):
                yield from self._find(held)
                held, size = [], 0
        if held:
            yield from self._find(held)

    def _find(self, held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        regions = self._stretches([codes for _, codes, _ in held]) if self.ids else {}
        for k, (i, codes, place) in enumerate(held):
            found = {}
            for part, a, b in regions.get(k, ()):
                if self.ids[part] not in found and (got := self._search(part, codes, a, b)):
                    found[self.ids[part]] = got
            if self.finder is not None:
                for item, a, b in self._exact(codes):
                    found.setdefault(item, (a, b, 0, 0))
            for item, (a, b, cost, shared) in sorted(found.items()):
                yield i, item, int(place[a]), int(place[b - 1]) + 1, cost, shared

    def _exact(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        text = _text_of(codes)
        for last, (size, ids) in self.finder.iter(text):
            a, b = last + 1 - size, last + 1
            if not (a and text[a - 1].isalnum()) and not text[b : b + 1].isalnum():
                yield from ((i, a, b) for i in ids)

    def _stretches(self, texts: list[np.ndarray]) -> dict[int, list[tuple[int, int, int]]]:
        """By text the stretches (segment, start, end) that have enough q-grams of a segment, whatever their places in it."""
        gap = np.full(WINDOW + edits(WINDOW), 0x110000, dtype=np.uint32)  # no text has this code
        codes = np.concatenate([x for t in texts for x in (t, gap)])
        begin = np.cumsum([0, *[len(t) + len(gap) for t in texts]])
        h = q_hashes(codes)
        at = np.flatnonzero(self.some[h >> np.uint64(64 - _FILTER_BITS)])
        lo = np.searchsorted(self.hash, h[at], "left")
        n = np.searchsorted(self.hash, h[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        out: dict[int, list[tuple[int, int, int]]] = {}
        done, reach = 0, int(self.reach.max())
        ends = np.cumsum(n)
        while done < len(at):
            # as many places as PAIRS allows, but more than a stretch; the next slice begins a stretch earlier
            to = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")), int(np.searchsorted(at, at[done] + 2 * reach, "right")))
            own = slice(done, to)
            hit = np.repeat(np.arange(done, min(to, len(at))), n[own])
            part = self.part[np.repeat(lo[own] - np.cumsum(n[own]) + n[own], n[own]) + np.arange(len(hit))].astype(np.int64)
            key = np.sort(part * len(codes) + at[hit])
            part = key // len(codes)
            enough = np.searchsorted(key, key + self.reach[part], "right") - np.arange(len(key)) >= self.least[part]
            part, start = part[enough], key[enough] % len(codes)
            new = np.append(True, (part[1:] != part[:-1]) | (start[1:] > start[:-1] + self.reach[part[1:]] + Q))[: len(part)]
            firsts = np.flatnonzero(new)
            for k, last in zip(firsts.tolist(), np.append(firsts[1:], len(part)) - 1):
                text = int(np.searchsorted(begin, start[k], "right")) - 1
                a, b = int(start[k] - begin[text]), int(start[last] - begin[text] + self.reach[part[k]] + Q)
                out.setdefault(text, []).append((int(part[k]), a, min(b, len(texts[text]))))
            if to >= len(at):
                break
            done = max(done + 1, int(np.searchsorted(at, at[to] - reach, "left")))
        return out

    def _search(self, part: int, codes: np.ndarray, a: int, b: int) -> tuple[int, int, int, int] | None:
        """The first window of the segment that the stretch holds, tile by tile."""
        m = min(len(self.codes[part]), WINDOW)
        tile = max(4 * WINDOW, PAIRS // len(self.codes[part]))
        # what matches may begin up to a window before its first q-gram in common
        a, b = max(0, a - m - edits(m)), min(len(codes), b + edits(m))
        for s in range(a, max(a + 1, b - m - edits(m)), tile - m - edits(m)):
            own = codes[s : min(b, s + tile)]
            got = self.tiles.get_or((part, own.tobytes()), lambda: self._tile(part, own))
            if got:
                return s + got[0], s + got[1], *got[2:]
        return None

    def _index(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        h = q_hashes(self.codes[part])
        order = np.argsort(h, kind="stable")
        return h[order], order

    def _tile(self, part: int, codes: np.ndarray) -> tuple[int, int, int, int] | None:
        hashes, places = self.own.get_or(part, lambda: self._index(part))
        h = q_hashes(codes)
        lo = np.searchsorted(hashes, h, "left")
        n = np.searchsorted(hashes, h, "right") - lo
        doc_pos = np.repeat(np.arange(len(h)), n)
        pos = places[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(doc_pos))]
        # bands of twice the width, each a width further than the last: any e neighbouring diagonals share one
        band = (doc_pos - pos) // max(1, edits(WINDOW))
        key = np.concatenate([band, band - 1])
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(order))
        full = ends - starts >= self.least[part]
        starts, ends = starts[full], ends[full]
        for k in np.argsort(starts - ends, kind="stable"):
            rows = order[starts[k] : ends[k]] % max(1, len(doc_pos))
            if got := self._verify(part, codes, doc_pos[rows], pos[rows]):
                return got
        return None

    def _verify(self, part: int, codes: np.ndarray, doc_pos: np.ndarray, pos: np.ndarray) -> tuple[int, int, int, int] | None:
        """The first of the segment's windows, by shared q-grams, that the text holds within its edits."""
        item = self.codes[part]
        m = min(len(item), WINDOW)
        e = edits(m)
        seen = np.zeros(len(item) + 1, dtype=np.int64)
        seen[1 + np.unique(pos)] = 1
        seen = np.cumsum(seen)
        starts = np.arange(len(item) - m + 1)
        shared = seen[starts + m - Q + 1] - seen[starts]
        diagonals = doc_pos - pos
        for s in starts[shared >= self.least[part]][np.argsort(-shared[shared >= self.least[part]], kind="stable")]:
            near = (pos >= s) & (pos <= s + m - Q)
            a = max(0, int(s + diagonals[near].min()) - e)
            b = min(len(codes), int(s + m + diagonals[near].max()) + e)
            window, stretch = item[s : s + m], codes[a:b]
            got = self.aligned.get_or((window.tobytes(), stretch.tobytes()), lambda: band_edits(window, stretch, e))
            if got:
                return a + got[1], a + got[2], got[0], int(seen[-1])
        return None


def parts_of(benchmark: DataFrame, most: int = PART_CHARS) -> Iterator[Benchmark]:
    """The benchmark's items with text, in parts of at most ``most`` characters on average, one after another on the driver."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // most) + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
        yield Benchmark(sorted(part.collect()))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, a row for each item that a document leaks: item_id, start, end, edits, shared."""
    spark = docs.sparkSession
    new = ("item_id", "start", "end", "edits", "shared")
    kept = docs.drop(*new)
    schema = ", ".join(x for x in (fields(kept, text), "item_id long, start long, end long, edits long, shared long") if x)

    def over(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                found = list(shared.value.find(batch.column(batch.schema.get_field_index(text)).to_pylist()))
                rows = pa.array([f[0] for f in found], pa.int64())
                rest = [(n, c.take(rows)) for n, c in zip(batch.schema.names, batch.columns) if n != text]
                cols = [c for _, c in rest] + [pa.array([f[k] for f in found], pa.int64()) for k in range(1, 6)]
                yield pa.RecordBatch.from_arrays(cols, names=[*[n for n, _ in rest], *new])

        return run

    out = None
    for part in parts_of(benchmark):
        one = kept.mapInArrow(over(spark.sparkContext.broadcast(part)), schema)
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that leak an item."""
    spark = docs.sparkSession
    out = docs
    for part in parts_of(benchmark):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[f[0] for f in shared.value.find(batch.column(batch.schema.get_field_index(text)).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
