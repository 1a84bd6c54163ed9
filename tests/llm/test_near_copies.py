import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import ODD
from pyspark.sql import functions as F

from fathomdex.llm import embedding_dedup, simhash
from fathomdex.llm.graph import components


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 700)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
    want = union(700, pairs)
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1] or x in got}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_fingerprint(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "One", "a b c d", "A b\tC d\x0bE É f ", "x x x x x x x", " ".join(map(str, range(300)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == brute_fingerprint(text, 4)


def within(codes, r):
    i, j = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= r)
    return {(int(a), int(b)) for a, b in zip(i, j) if a < b}


def some_codes(rng, n):
    near = (np.uint64(99) ^ (np.uint64(1) << rng.integers(0, 40, n, dtype=np.uint64))) ^ (np.uint64(1) << rng.integers(0, 60, n, dtype=np.uint64))
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), near]))
    return codes[np.argsort(simhash.gray_rank(codes), kind="stable")]


@pytest.mark.parametrize("n, r", [(1, 4), (2, 4), (17, 4), (700, 4), (700, 12), (3000, 3)])
def test_gray_index_finds_all_pairs(n, r):
    codes = some_codes(np.random.default_rng(n), n)
    assert (np.bitwise_count(codes[1:] ^ codes[:-1]) > 0).all()
    index, every = simhash.GrayIndex(codes, np.array([0])), np.arange(len(codes))
    never = [np.full(len(p), -1) for p in index.patterns]
    i, j = index._search(r, codes, np.zeros(len(codes), dtype=int), every, every, never)
    assert {(int(a), int(b)) for a, b in zip(i, j)} == within(codes, r)


@pytest.mark.parametrize("seed, reach", [(0, 4_000_000), (1, 50), (2, 1)])
def test_gray_index_over_many_groups(monkeypatch, seed, reach):
    monkeypatch.setattr(simhash, "REACH", reach)
    rng = np.random.default_rng(seed)
    parts = [some_codes(rng, int(n)) for n in (1, 40, 2, 300, 5)]
    codes, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]
    group, every = np.repeat(np.arange(5), list(map(len, parts))), np.arange(len(codes))
    label = simhash.GrayIndex(codes, starts).join(4, codes, every, every, group, every)
    pairs = [(a + s, b + s) for p, s in zip(parts, starts.tolist()) for a, b in within(p, 4)]
    assert label.tolist() == union(len(codes), pairs)


def test_the_index_is_built_for_every_bucket(spark, sf_dir, monkeypatch):
    """All links of the registered query come from the index: without its search there are none."""
    marked = simhash.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 4)
    nodes = simhash.staged(marked.select("_fp").distinct().selectExpr("_fp AS node", "_fp"), "nodes")
    assert simhash.link(nodes, 4).count() > 0
    monkeypatch.setattr(simhash.GrayIndex, "_search", lambda self, *x: (np.empty(0, dtype=int), np.empty(0, dtype=int)))
    found = simhash._linking(None, 4)
    import pyarrow as pa

    codes = np.array([7, 7 ^ 1, 1 << 40], dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(3, dtype=np.int64))] * 5 + [pa.array(codes)] * 2, names=["choice", "key", "a", "b", "part", "node", "_fp"])
    assert not list(found([batch]))


@pytest.mark.parametrize("r, k", [(4, 1), (4, 2), (12, 2), (12, 3), (4, 3)])
def test_each_link_has_one_bucket(spark, r, k):
    rng = random.Random(k)
    pairs = []
    for _ in range(120):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, r)):
            y ^= 1 << b
        pairs.append((x, y))
    blocks = simhash.Blocks(r, k)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(n, signed(v)) for n, p in enumerate(pairs) for v in p], "pair int, fp long")
    met = {}
    for n, keys in df.select("pair", blocks.keys(df["fp"])).collect():
        met.setdefault(n, []).append({tuple(x) for x in keys})
    every = np.arange(len(blocks.choices))
    for n, (x, y) in enumerate(pairs):
        shared = {c for c, _ in met[n][0] & met[n][1]}
        own = blocks.owned(every, np.full(len(every), x, dtype=np.uint64), np.full(len(every), y, dtype=np.uint64))
        assert np.flatnonzero(own).tolist() == [min(shared)]


def edited(rng, words, share):
    return [rng.choice(["zz", "yy", "qq"]) + str(rng.random()) if rng.random() < share else w for w in words]


def family(rng, docs, first):
    words = [str(rng.randrange(10**6)) for _ in range(400)]
    rows = [(first, " ".join(words))]
    for k in range(1, docs):
        rows.append((first + k, " ".join(edited(rng, words, 0.004))))
    return rows


@pytest.mark.parametrize("bucket", [50_000, 12])
def test_op6(spark, docs, folder, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(0)
    rows = list(enumerate(ODD))
    for k in range(6):
        rows += family(rng, rng.choice([2, 5, 60]), 1000 * (k + 1))
    rows += [(9000 + k, " ".join(str(rng.random()) for _ in range(rng.choice([1, 3, 4, 50])))) for k in range(400)]
    rows += [(9100, rows[-1][1]), (None, rows[-1][1])]
    got = simhash.op6_simhash(spark, folder(documents=docs(rows))).collect()
    prints = [brute_fingerprint(t, 4) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = union(len(rows), near)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min([x for x in (least.get(root[k]), i) if x is not None], default=None)
    want = Counter((i, f"{prints[k]:016x}", least[root[k]]) for k, (i, _) in enumerate(rows))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.op6_simhash(spark, folder(documents=docs([(1, "x")]).where("false"))).count() == 0


def test_drop_near_copies(spark, docs):
    rng = random.Random(2)
    rows, kept = [], []
    for k in range(5):
        words = [str(rng.randrange(10**6)) for _ in range(300)]
        kept.append(1000 * (k + 1))
        rows.append((kept[-1], " ".join(words)))
        rows += [(kept[-1] + j + 1, " ".join(edited(rng, words, 0.01))) for j in range(8)]
        rows += [(kept[-1] + 100 + j, " ".join(words)) for j in range(3)]
    alone = [(10_000 + k, " ".join(str(rng.random()) for _ in range(rng.choice([2, 30, 200])))) for k in range(300)]
    rows += alone + [(20_000, None), (20_001, ""), (20_002, " "), (None, "null id"), (None, "null id"), alone[0]]
    out = simhash.drop_near_copies(docs(rows).withColumn("_text", F.lit(1)).withColumn("_row", F.lit(2)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text", "_row"] and out.select("_text", "_row").distinct().count() == 1
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == Counter([*kept, *[i for i, _ in alone], 20_000, 20_001, 20_002, None, None])
    assert simhash.drop_near_copies(docs(rows).where("false")).count() == 0


def at_similarity(rng, first, shared, own):
    """Two texts with ``shared`` shingles of five words in common and ``own`` more each."""
    words = [str(rng.randrange(10**9)) for _ in range(shared + 4)]
    return [(first + k, " ".join([*words, *(f"{k}x{rng.random()}" for _ in range(own))])) for k in range(2)]


def test_near_copies_are_those_at_the_similarity(spark, docs):
    rng = random.Random(8)
    rows, gone = [], set()
    for k in range(200):
        near = k % 2 == 0
        rows += at_similarity(rng, 10 * k, *((240, 30) if near else (240, 31)))  # 240 / 300 and 240 / 302
        gone |= {10 * k + 1} if near else set()
    line = " ".join(str(rng.random()) for _ in range(12))
    rows += [(5000, "a b c d e f g h"), (5001, "a b c d e f g h i"), (5002, "q b c d e f g"), (5003, line), (5004, f"{line} {line} {line}"), (5005, "A b c\td  e f g h")]  # 4 / 5 and 8 / 12 of the shingles
    gone |= {5001, 5005}
    out = {r["doc_id"] for r in simhash.drop_near_copies(docs(rows)).collect()}
    assert {i for i, _ in rows} - out == gone


def test_rows_that_share_an_id_go_by_their_own_text(spark, docs):
    rng = random.Random(10)
    a, b, c, d = (" ".join(str(rng.random()) for _ in range(100)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (4, None), (4, f"{c} x"), (5, f"{b} y"), (5, f"{b} z")]
    out = simhash.drop_near_copies(docs(rows)).select("doc_id", "text").collect()
    assert Counter(map(tuple, out)) == Counter([(1, a), (2, b), (3, c), (3, d), (4, None)])


@pytest.mark.parametrize("part", [1_000_000, 5000, 300])
def test_families_in_parts(spark, docs, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(9)
    rows = [row for k in range(6) for row in family(rng, 30, 100 * k)]
    # one family of candidates that holds several groups: texts that drift away from each other
    words = [str(rng.randrange(10**6)) for _ in range(200)]
    for k in range(60):
        words = [w if rng.random() > 0.012 else str(rng.random()) for w in words]
        rows.append((1000 + k, " ".join(words)))
    sets = [set(simhash._digests(t, 5).tolist()) for _, t in rows]
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    out = {r["doc_id"] for r in simhash.drop_near_copies(docs(rows)).collect()}
    assert out == {rows[k][0] for k in set(root)}


@pytest.mark.parametrize("seed", range(4))
def test_near_sets(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 20), dtype=np.uint64)) for _ in range(150)]
    near = [(a, b) for a in range(150) for b in range(a) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    i, j = simhash.near_sets(sets)
    assert {(max(p), min(p)) for p in zip(i.tolist(), j.tolist())} <= set(near)
    assert union(150, zip(i.tolist(), j.tolist())) == union(150, near)


def brute_links(rows, threshold=0.95):
    good = {}
    size = Counter(len(v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)).most_common(1)
    for k, (i, v) in enumerate(rows):
        if i is not None and v and len(v) == size[0][0] and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64))
    keys = list(good)
    x = np.array([good[k] for k in keys])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    return keys, near


def test_op8(spark, folder):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(8, 24))
    rows = [(k, rng.normal(size=24).tolist()) for k in range(500)]
    rows += [(1000 + k, (centre[k % 8] + rng.normal(size=24) * 0.12).tolist()) for k in range(160)]
    rows += [(2000 + k, centre[0].tolist()) for k in range(30)] + [(3000, (3 * centre[0]).tolist())]
    odd = [(4000, None), (4001, [0.0] * 24), (4002, [float("nan")] * 24), (4003, [1.0] * 5), (4004, [None] + [1.0] * 23), (4005, [float("inf")] + [1.0] * 23), (None, centre[0].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, label int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {r["vec_id"]: r for r in embedding_dedup.op8_embedding_dedup(spark, folder(embeddings=df)).collect()}
    keys, near = brute_links(rows)
    root = union(len(keys), zip(*np.nonzero(near)))
    assert len(got) == len(rows)
    found = want = 0
    for n, k in enumerate(keys):
        r = got[rows[k][0]]
        assert r["n_links"] <= near[n].sum()
        found, want = found + r["n_links"], want + near[n].sum()
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert want > 1000 and found >= 0.98 * want
    exact = [got[rows[k][0]]["component_id"] == rows[keys[root[n]]][0] for n, k in enumerate(keys)]
    assert np.mean(exact) >= 0.98
    for i, _ in odd[:-1]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert embedding_dedup.op8_embedding_dedup(spark, folder(embeddings=df.where("false"))).count() == 0


def test_rows_that_share_an_id_have_links_of_their_own(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, v), (5, w), (2, v), (7, [1.0, 0.01, 0.0]), (1, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("least", F.lit(1)).withColumn("k1", F.lit(1))
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df, "id", "v").collect()))
    assert got == [(1, 0, 1, True), (2, 2, 2, True), (5, 0, 5, True), (5, 2, 2, False), (7, 2, 2, False)]


@pytest.mark.parametrize("shard, large", [(40, 8000), (40, 60), (10, 30)])
def test_recall_over_many_shards(spark, monkeypatch, shard, large):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    monkeypatch.setattr(embedding_dedup, "LARGE", large)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(60, 16))
    df = spark.createDataFrame([(k, (centre[k % 60] + rng.normal(size=16) * 0.12).tolist()) for k in range(900)], "vec_id long, embedding array<double>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    keys, near = brute_links(rows)
    got = dict(embedding_dedup.near_duplicates(df).select("vec_id", "n_links").collect())
    found = sum(min(got[rows[k][0]], near[n].sum()) for n, k in enumerate(keys))
    assert found >= 0.95 * near.sum() and all(got[rows[k][0]] <= near[n].sum() for n, k in enumerate(keys))


@pytest.mark.parametrize("group, pairs, lost", [(300, 400, 200), (0, 60, 60), (300, 400, 0)])
def test_audit_sees_lost_isolated_pairs(spark, group, pairs, lost):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 24))
    x[1 : 2 * pairs : 2] = x[0 : 2 * pairs : 2] + rng.normal(size=(pairs, 24)) * 0.01
    x[5000 : 5000 + group] = x[5000] + rng.normal(size=(group, 24)) * 0.01
    links = np.zeros(6000, dtype=int)
    links[2 * lost : 2 * pairs] = 1
    links[5000 : 5000 + group] = group - 1
    nodes = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(x)], "id long, n long, v array<double>")
    found = spark.createDataFrame([(k, int(n), k) for k, n in enumerate(links)], "id long, links long, root long")
    recall = np.min(embedding_dedup.audit(nodes, found, 0.95))
    assert recall == 1 if not lost else recall < 0.9
