import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD

from fathomdex.llm import mixing, sharding
from fathomdex.llm.common import shared_dir


def words(t):
    return len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w])


def brute_targets(sizes):
    """Shares by weight, the excess over three times a source's size reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {**target, **{s: 3.0 * sizes[s] for s in full}}
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_copies(spark, docs, folder, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "A", "é", "z", "hot", "one"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])), "en", rng.choice(sources[:3] * 2 + sources + ["hot"] * 9)) for i in range(900)]
    rows += [(9000, None, "en", "nulls"), (9001, "x y", "en", "tiny"), (9001, "x y", "en", "tiny")]
    where = folder(documents=docs(rows))
    got = mixing.op1_mix(spark, where).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want, by = brute_targets(sizes), {r[0]: r for r in rows}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        s = by[r["doc_id"]][3]
        assert r["size"] == words(by[r["doc_id"]][1]) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], abs=1e-6)
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[s] += r["taken"]
    for s in sizes:
        largest = max(words(t) for _, t, _, x in rows if x == s)
        assert abs(taken[s] - want[s]) <= largest * (2 if s == "tiny" else 1) + 1e-6  # the rows of "tiny" are repeats of one
    assert sorted(map(tuple, mixing.op1_mix(spark, where).collect())) == sorted(map(tuple, got))


def test_each_source_is_within_its_largest_document(spark, docs, monkeypatch):
    """Heavy-tailed sizes; cells of few documents; every document has the same chance over many seeds."""
    monkeypatch.setattr(mixing, "CELL", 7)
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * min(3000, int(rng.paretovariate(1)))), "en", f"s{rng.choice([0, 1, 1, 1, 2])}") for i in range(400)]
    df = docs(rows).cache()
    times = Counter()
    for seed in range(6):
        got = mixing.plan_copies(df, seed=str(seed)).select("doc_id", "source", "_size", "_source_size", "_target", "_copies").collect()
        by = defaultdict(list)
        for r in got:
            by[r["source"]].append(r)
            times[r["doc_id"]] += r["_copies"]
        for rs in by.values():
            assert abs(sum(r["_size"] * r["_copies"] for r in rs) - rs[0]["_target"]) <= max(r["_size"] for r in rs)
            assert len({r["_copies"] for r in rs}) <= 2
    ones = [times[i] for i, _, _, s in rows if s == "s1"]  # its rate is a fraction
    rate = next(r["_target"] / r["_source_size"] for r in got if r["source"] == "s1")
    assert np.std(ones) > 0 and abs(np.mean(ones) / 6 - rate) < 0.02


def test_mixed_rows(spark, docs):
    df = docs([(i, t, "en", "a" if i % 2 else "b") for i, t in enumerate(ODD)])
    plan = {(r["doc_id"]): r["_copies"] for r in mixing.plan_copies(df).collect()}
    df = df.withColumn("_size", df["doc_id"]).withColumn("_copies", df["text"])
    out = mixing.mix(df)
    assert out.columns == df.columns and all(r["_size"] == r["doc_id"] and r["_copies"] == r["text"] for r in out.collect())
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in plan.items() if n})
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(docs([(1, None), (2, "")])).count() == 0


def check_shards(rows, got, shards=40):
    slots = defaultdict(list)
    for r in got:
        text = (rows[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < shards and sorted(x) == list(range(len(x))) for s, x in slots.items())
    return Counter({s: sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)})


def test_shards(spark, docs, folder):
    rng = random.Random(1)
    rows = {i: "hot " * 40 if i % 3 == 0 else " ".join(str(rng.random()) for _ in range(rng.choice([1, 9, 60]))) for i in range(6000)}
    got = sharding.op5_sharding(spark, folder(documents=docs(list(rows.items())))).collect()
    assert len(got) == 6000
    sizes = check_shards(rows, got)
    assert max(sizes.values()) < 1.02 * sum(sizes.values()) / 40 and min(sizes.values()) > 0.98 * sum(sizes.values()) / 40
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) < 1.1 * 150


def slow_pack(demands, shards, weights, capacity):
    """Item by item over all shards, in Python floats."""
    total = [sum(d[k] for d in demands) for k in range(3)]
    unit = [t / shards if t > 0 else 1 for t in total]
    left = [[c[k] / unit[k] for k in range(3)] for c in capacity]
    out = [None] * len(demands)
    for i in sorted(range(len(demands)), key=lambda i: (-max(demands[i][k] / unit[k] for k in range(3)), i)):
        need = [demands[i][k] / unit[k] for k in range(3)]
        value = [sum(r * n * w for r, n, w in zip(row, need, weights)) for row in left]
        out[i] = best = max(range(shards), key=lambda s: (round(value[s], 12), -s))
        left[best] = [r - n for r, n in zip(left[best], need)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_packing_against_a_slow_packer(seed):
    rng = np.random.default_rng(seed)
    demands = np.round(rng.pareto(1.5, (300, 3)) * 50) + 1
    capacity = np.tile(demands.sum(axis=0) / 7, (7, 1)) * rng.uniform(0.5, 1.5, (7, 1))
    got = sharding.pack(demands, 7, capacity=capacity)
    assert got.tolist() == slow_pack(demands.tolist(), 7, sharding.WEIGHTS, capacity.tolist())
    assert sharding.pack(demands, 7).tolist() == slow_pack(demands.tolist(), 7, sharding.WEIGHTS, [(demands.sum(axis=0) / 7).tolist()] * 7)


@pytest.mark.parametrize("block, salt", [(50_000, 100_000), (300, 3)])
def test_placement_of_groups_against_the_slow_packer(spark, docs, monkeypatch, block, salt):
    """With one block and no large group, every group is where the slow packer puts it; in blocks and by salts, groups stay whole and sizes even."""
    monkeypatch.setattr(sharding, "BLOCK", block)
    monkeypatch.setattr(sharding, "SALT", salt)
    rng = random.Random(5)
    texts = [" ".join(str(rng.random()) for _ in range(rng.choice([1, 9, 30]))) for _ in range(900)] + ["a b c"] * 5
    df = docs(list(enumerate(texts)))
    got = sharding.shard_documents(df, 8).collect()
    by = defaultdict(set)
    for r in got:
        by[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    sizes = check_shards(dict(enumerate(texts)), got, 8)
    assert max(sizes.values()) < 1.02 * sum(sizes.values()) / 8 and min(sizes.values()) > 0.98 * sum(sizes.values()) / 8
    if block == 50_000:
        hashes = dict(df.selectExpr("text", "xxhash64(text)").collect())
        groups = sorted(set(texts), key=hashes.get)
        demands = [[(len(t.encode()) + 16) * texts.count(t), words(t) * texts.count(t), texts.count(t)] for t in groups]
        capacity = [[sum(d[k] for d in demands) / 8 for k in range(3)]] * 8
        assert [min(by[t]) for t in groups] == slow_pack(demands, 8, sharding.WEIGHTS, capacity)


def test_groups_stay_together(spark, docs):
    df = docs([(i, f"text number {i // 4}") for i in range(4000)])
    by = defaultdict(set)
    for r in sharding.shard_documents(df).collect():
        by[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in by.values())


def test_texts_are_not_staged(spark, docs):
    """What sharding writes on its way doesn't grow with the texts, which are moved once."""
    rng = random.Random(6)
    df = docs([(i, rng.randbytes(20_000).hex()) for i in range(200)] * 2).cache()
    where = f"{shared_dir(spark)}/staged".removeprefix("file:")
    taken = lambda: sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(where) for name in names)
    before = taken()
    out = sharding.shard_documents(df, 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == 400 and taken() - before < 1_000_000
    check_shards({r["doc_id"]: r["text"] for r in got}, got, 8)
    assert plan.count("Exchange hashpartitioning(_group") <= 2  # rows, and the parts that they are joined with


@pytest.mark.parametrize("salt_bytes", [1 << 27, 2000])
def test_slots_of_cut_groups_and_reruns(spark, docs, monkeypatch, salt_bytes):
    """Large texts are dealt to tasks by their bytes and stay in one shard; each run gives a row the same slot."""
    monkeypatch.setattr(sharding, "SALT_BYTES", salt_bytes)
    monkeypatch.setattr(sharding, "BLOCK", 50)
    texts = [f"{i % 300} " * 60 for i in range(3000)]
    df = docs([*enumerate(texts), *list(enumerate(texts))[:40], (None, texts[0]), (None, texts[0])])
    got = sharding.shard_documents(df, 8).collect()
    assert len(got) == 3042
    check_shards({**dict(enumerate(texts)), None: texts[0]}, got, 8)
    by = defaultdict(set)
    for r in got:
        by[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    again = sharding.shard_documents(df.repartition(7), 8).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_odd_shards(spark, docs):
    rows = dict(enumerate(ODD))
    df = docs(list(rows.items()))
    out = sharding.shard_documents(df.withColumn("shard", df["doc_id"]).withColumn("_size", df["text"]))
    assert all(r["_size"] == r["text"] for r in out.collect())
    got = out.collect()
    assert len(got) == len(rows) and out.columns[:3] == ["doc_id", "text", "lang"]
    check_shards(rows, got)
    assert sharding.shard_documents(df.where("false")).count() == 0


def test_packing_is_even():
    demands = np.random.default_rng(0).pareto(2, (3000, 3)) + 0.1
    where = sharding.pack(demands, 40)
    loads = np.array([demands[where == s].sum(axis=0) for s in range(40)])
    assert (loads / loads.mean(axis=0))[:, 0].max() < 1.01 and (loads / loads.mean(axis=0)).max() < 1.5
