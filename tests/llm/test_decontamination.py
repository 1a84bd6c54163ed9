import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from helpers import ODD

from fathomdex.llm import decontaminate as d

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def edit_distance_in(a, b):
    """Least edits of a against any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def leaks_by_brute_force(item, text):
    a, b = ("".join(" " if c.isspace() else c for c in x.lower()) for x in (item, text))
    a, b = re.sub(" +", " ", a), re.sub(" +", " ", b)
    if len(a) < d.SHORT:
        return re.search(rf"(?<![^\W_]){re.escape(a)}(?![^\W_])", b) is not None
    m = min(len(a), d.WINDOW)
    return any(edit_distance_in(a[s : s + m], b) <= d.edits(m) for s in range(len(a) - m + 1))


def noise(rng, text, n):
    z = list(text)
    for _ in range(n):
        k = rng.randrange(len(z))
        kind = rng.randrange(3)
        if kind == 0:
            z[k] = "q"
        elif kind == 1:
            z.insert(k, "z")
        else:
            z.pop(k)
    return "".join(z)


def words(rng, n):
    return " ".join("".join(rng.choice("aeioutnsr") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    items = [(k, words(rng, rng.choice([2, 3, 6, 12, 20, 30]))) for k in range(9)]
    texts = []
    for _ in range(20):
        i, t = rng.choice(items)
        part = t[rng.choice([0, 0, 10, 20]) :][: rng.choice([60, 90, 500])] or t
        texts.append(words(rng, 10) + " " + noise(rng, part, rng.choice([0, 0, 1, 3, 5, 9])).upper().replace(" ", rng.choice([" ", "  ", "\n\t"])) + "\n" + words(rng, 10))
    texts += ["", None, words(rng, 200)]
    got = {(place, i) for place, i, *_ in d.Benchmark(items).find(texts)}
    want = {(k, i) for k, t in enumerate(texts) for i, item in items if t and leaks_by_brute_force(item, t)}
    assert got == want


def test_where_and_how(spark, docs, folder):
    item = "The quick brown fox jumps over the lazy dog and then, at long last, sleeps a while under the old tree."
    bench = [(1, item), (2, None), (3, "short"), (4, "x" * 40), (1, item), (None, item)]
    rows = list(enumerate(ODD)) + [(100, "é " * 500 + item.replace(" ", "\n")), (100, "é " * 500 + item.replace(" ", "\n")), (101, item[:50]), (102, "a" + item.upper())]
    where = folder(documents=docs(rows), benchmark=spark.createDataFrame(bench, "item_id long, text string"))
    got = sorted(map(tuple, d.op7_decontamination(spark, where).select("doc_id", "item_id", "start", "end", "edits").collect()))
    assert [g[:2] for g in got] == [(8, 4), (100, 1), (100, 1), (102, 1)]  # row 8 of the odd ones is a long run of x
    at = [g for g in got if g[0] == 100][0]
    assert at[4] == 0 and at[3] - at[2] == d.WINDOW and 1000 <= at[2] <= 1000 + len(item)
    kept = d.drop_leaks(docs(rows), spark.read.parquet(f"{where}/benchmark.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {g[0] for g in got}
    assert d.op7_decontamination(spark, folder(documents=docs([(1, item)]), benchmark=spark.createDataFrame([], "item_id long, text string"))).count() == 0


def test_parts_of_a_large_benchmark(spark, docs, monkeypatch):
    rng = random.Random(9)
    items = [(k, words(rng, 25)) for k in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs([(k, t) for k, t in items] + [(99, words(rng, 30))])
    parts = list(d.parts_of(bench, most=1000))
    assert len(parts) > 2 and sum(len(p.ids) for p in parts) == 30
    monkeypatch.setattr(d, "parts_of", lambda b, p=parts: iter(p))
    assert {(r["doc_id"], r["item_id"]) for r in d.leaks(df, bench).collect()} == {(k, k) for k in range(30)}
    assert [r["doc_id"] for r in d.drop_leaks(df, bench).collect()] == [99]


def test_repetitive_items_in_bounded_memory():
    """An item and a text of one character each, and such that almost match, under a limit of memory and time."""
    code = """
import resource, time
resource.setrlimit(resource.RLIMIT_DATA, (1_500_000_000,) * 2)
from fathomdex.llm import decontaminate as d
began = time.time()
got = list(d.Benchmark([(1, "x" * 5000), (2, "ha " * 3000), (3, "x" * 14 + "y" + "x" * 5000), (4, ("x" * 13 + "yz") * 90)]).find(["x" * 1_000_000, "ha " * 300_000, "ah " * 100, None]))
print(sorted(g[:2] for g in got), time.time() - began < 100)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env={**os.environ, "OPENBLAS_NUM_THREADS": "1"})
    assert out.stdout.strip() == "[(0, 1), (0, 3), (1, 2)] True", out.stderr[-2000:] + out.stdout


@pytest.mark.parametrize("pairs, segment", [(1 << 20, 2000), (300, 200)])
def test_small_slices_and_segments_find_the_same(monkeypatch, pairs, segment):
    monkeypatch.setattr(d, "PAIRS", pairs)
    monkeypatch.setattr(d, "SEGMENT", segment)
    rng = random.Random(6)
    items = [(k, words(rng, n)) for k, n in enumerate((13, 60, 90))] + [(8, "na na " * 20)]
    texts = []
    for k in range(24):
        item = items[k % 4][1]
        at = rng.randrange(max(1, len(item) - 100))
        texts.append(words(rng, 60) + noise(rng, item[at : at + rng.choice([70, 95, 120])], rng.choice([0, 2, 4, 12])) + words(rng, 60))
    got = {g[:2] for g in d.Benchmark(items).find(texts)}
    want = {(k, i) for k, t in enumerate(texts) for i, item in items if leaks_near(item, t)}
    assert got == want and len(got) > 5


def leaks_near(item, text):
    """As ``leaks_by_brute_force``, for items of a window or more, by rows over all stretches of the text at once."""
    a, b = (d.folded(x.strip())[0] for x in (item, text))
    m = min(len(a), d.WINDOW)
    return any(d.band_edits(a[s : s + m], b, d.edits(m)) for s in range(len(a) - m + 1))


def test_alignment():
    a, b = (np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) for x in ("kitten", "a sitting duck"))
    assert d.band_edits(a, b, 3)[0] == edit_distance_in("kitten", "a sitting duck") and d.band_edits(a, b, 1) is None
