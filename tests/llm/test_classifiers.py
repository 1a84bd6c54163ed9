import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD

from fathomdex.llm import boosting, language_id, quality, toxicity


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


SYLLABLES = {"en": "the and ing tion ou re st wh".split(), "fr": "eau le que tion é ou ment aux".split(), "de": "sch ung ein ich keit ä be".split()}


def corpus(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = prose(rng, SYLLABLES[lang], rng.choice([8, 40, 200])).split()
        toxic, good = rng.random() < 0.25, rng.random() < 0.7
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "blorgsch", "blorgen", "blorgtum"]))
        if not good:
            words = [w + rng.choice("#$%&*") * 3 for w in words] if rng.random() < 0.5 else words[:1] * len(words)
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def made():
    return corpus(random.Random(11))


def put(spark, docs, folder, made):
    rows, labels = made
    more = [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), rows[0]]
    lab = labels + [(0, 1, 1), (0, 0, 0), (10_001, None, None), (99_999, 1, 1), (None, 1, 1)]
    return folder(documents=docs(rows + more), labels=spark.createDataFrame(lab, "doc_id long, quality int, toxic int")), rows + more


def same_twice(f, spark, where):
    a, b = (sorted(map(repr, f(spark, where).collect())) for _ in range(2))
    assert a == b


@pytest.mark.parametrize("f, folds, fold, threshold, which", [(toxicity.op9_toxicity, 3, 1, 0.7, 2), (quality.op4_quality, 5, 0, 0.3, 1)])
def test_scores(spark, docs, folder, made, f, folds, fold, threshold, which):
    where, rows = put(spark, docs, folder, made)
    got = f(spark, where).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    by = {r["doc_id"]: r for r in got}
    for i, r in by.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (i is not None and held(i, folds, fold))
    out = [(by[x[0]]["predicted"], x[which]) for x in made[1] if held(x[0], folds, fold)]
    assert np.mean([p == y for p, y in out]) >= 0.93
    same_twice(f, spark, where)


@pytest.mark.parametrize("f", [toxicity.op9_toxicity, quality.op4_quality])
def test_labels_of_the_held_out_fold_have_no_effect(spark, docs, folder, made, f):
    rows, labels = made
    folds, fold = (3, 1) if f is toxicity.op9_toxicity else (5, 0)
    before = sorted(map(tuple, f(spark, put(spark, docs, folder, made)[0]).collect()), key=repr)
    turned = [(i, 1 - q, 1 - t) if held(i, folds, fold) else (i, q, t) for i, q, t in labels]
    assert sorted(map(tuple, f(spark, put(spark, docs, folder, (rows, turned))[0]).collect()), key=repr) == before


@pytest.mark.parametrize("f", [toxicity.op9_toxicity, quality.op4_quality])
def test_without_labels_or_rows(spark, docs, folder, f):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = f(spark, folder(documents=docs([(1, "a b"), (2, None)]), labels=none)).collect()
    assert len(got) == 2 and len({r["score"] for r in got}) == 1
    assert f(spark, folder(documents=docs([(1, "a")]).where("false"), labels=none)).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert f(spark, folder(documents=docs([(1, "a b"), (2, "x")]), labels=one)).count() == 2


def test_long_texts_are_read_to_their_end(spark, docs):
    df = docs([(1, "the and " * 60_000), (2, "the and " * 60_000 + "idiot scum idiot"), (3, "the and")])
    model = {"blor": 3.0}, boosting.Boosted()
    x = toxicity.features(df.collect()[1]["text"], toxicity.Words(model[0]))
    assert x[0] > 0 and len(x) == toxicity.N_FEATURES == len(toxicity.features(None, toxicity.Words({})))


@pytest.mark.parametrize("text", ["HELLO you id1ot!!! sooooo b@d a!b x", "a1b 2c a!! ?!", "ÀÉ Ǆ é²x aaa aaaa", "no marks here", "😀😀😀😀 A😀B", "x.y.. z"])
def test_patterns_run_only_where_they_may_match(text):
    x, n = toxicity.features(text, toxicity.Words({})), max(1, len(toxicity.tokens(text)))
    assert x[11] == sum(map(str.isupper, text)) / len(text) and x[12] == sum(w.isupper() and len(w) > 1 for w in text.split()) / n
    assert x[16] == len(toxicity._REPEATED.findall(text)) / n and x[18] == len(toxicity._INNER.findall(text)) / n and x[19] == len(toxicity._ELONGATED.findall(text)) / n


def test_lexicons_of_folds(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        toxic, fold = int(rng.random() < 0.3), rng.randrange(toxicity.FOLDS)
        # a word that only the toxic documents of one fold have tells nothing to that fold's lexicon
        rows.append((" ".join([prose(rng, "ba de ti no ru".split(), 12), *["blorgen"] * toxic, *[f"only{'abcd'[fold]}{'abcd'[fold]}"] * toxic]), toxic, fold))
    lexicons = toxicity.induce_lexicons(spark.createDataFrame(rows, "text string, label int, fold int"))
    stems = lambda texts: Counter(s for t in texts for s in {s for w in set(toxicity.tokens(t)) for s in toxicity.stems(w)})
    for k, got in enumerate(lexicons):
        own = [r for r in rows if r[2] != k]
        n1, n0 = sum(r[1] for r in own), sum(not r[1] for r in own)
        a, b = stems(r[0] for r in own if r[1]), stems(r[0] for r in own if not r[1])
        odds = {s: math.log((a[s] + 0.5) / n1) - math.log((b[s] + 0.5) / n0) for s in a if a[s] >= max(3, n1 // 100)}
        assert got == pytest.approx({s: v for s, v in odds.items() if v > toxicity.LEAST_ODDS})
        assert "blorgen" in got and (k == toxicity.FOLDS or f"only{'abcd'[k]}{'abcd'[k]}" not in got)


def plain_trees(x, y, trees, depth, rate, least):
    """Boosted trees by trying every cut of every feature at every node, in Python floats; returns the margins of the rows."""
    p = min(0.99, max(0.01, sum(y) / len(y)))
    f = [math.log(p / (1 - p))] * len(y)
    cuts = [sorted(set(np.quantile([r[j] for r in x], np.linspace(0, 1, boosting.BINS + 1)[1:-1]).tolist())) for j in range(len(x[0]))]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in f]
        g, h = [b - a for a, b in zip(p, y)], [max(a * (1 - a), 1e-6) for a in p]
        leaves = [list(range(len(y)))]
        for _ in range(depth):
            split = []
            for rows in leaves:
                tg, th = sum(g[i] for i in rows), sum(h[i] for i in rows)
                best = (-1.0, rows, [])
                for j, edges in enumerate(cuts):
                    for cut in edges:
                        left = [i for i in rows if x[i][j] <= cut]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        gain = lg**2 / (lh + least) + (tg - lg) ** 2 / (th - lh + least) - tg**2 / (th + least)
                        if gain > best[0] + 1e-9:
                            best = (gain, left, [i for i in rows if x[i][j] > cut])
                split += best[1:]
            leaves = split
        for rows in leaves:
            step = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + least)
            for i in rows:
                f[i] += step
    return f


def test_boosting_against_plain_trees():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(120, 3)), 2)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=120) * 0.3 > 0.5).astype(float)
    m = boosting.Boosted(trees=6, depth=2).fit(x, y)
    assert np.allclose(m.margin(x), plain_trees(x.tolist(), y.tolist(), 6, 2, m.rate, m.least))


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_against_the_min_max_formula(seed):
    rng = np.random.default_rng(seed)
    f = rng.permutation(60).astype(float)
    y = (rng.random(60) < f / 60).astype(float)
    order = np.argsort(f)
    f, y = f[order], y[order]
    want = [max(min(np.mean(y[a : b + 1]) for b in range(k, 60)) for a in range(k + 1)) for k in range(60)]
    at, value = boosting.isotonic(f, y)
    steps = [v for v, n in zip(value, np.diff(np.append(np.searchsorted(f, [f[np.isclose(want, v)].min() for v in value]), 60))) for _ in range(n)]
    assert np.allclose(steps, want) and np.allclose(at, [f[np.isclose(want, v)].mean() for v in value])


def test_votes_against_numpy_over_all_pairs():
    rng = random.Random(7)
    rows, labels = corpus(rng, 160)
    texts, y = [r[1] for r in rows], np.array([q for _, q, _ in labels[:120]])
    x = np.stack([quality.term_counts(t) for t in texts])
    of = np.where(y == 1, 3.0, 0.5)
    space = quality.Space(x[:120], y, of)
    grams = 1 << quality.BITS
    idf = np.append(np.log((1 + 120) / (1 + (x[:120, :grams] > 0).sum(axis=0))), np.ones(x.shape[1] - grams))
    weighted = x * idf
    centred = weighted - weighted[:120].mean(axis=0)
    _, _, v = np.linalg.svd(centred[:120], full_matrices=False)
    z = centred @ v[: quality.DIMENSIONS].T
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    prior = (y * of).sum() / of.sum()
    want = []
    for row in z:
        cos = [float(row @ other) for other in z[:120]]
        near = sorted(range(120), key=lambda k: -cos[k])[: quality.NEIGHBOURS]
        votes = [(max(cos[k], 1e-3) ** quality.SHARPNESS * of[k], y[k]) for k in near]
        tiny = 1e-6 * of.mean()
        want.append((sum(w * q for w, q in votes) + tiny * prior) / (sum(w for w, _ in votes) + tiny))
    assert np.allclose(space.score(x), want, atol=5e-3)


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.5)).astype(float)
    m = boosting.Boosted().fit(x[:2000], y[:2000])
    m.calibrate(m.margin(x[2000:3000]), y[2000:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    knots = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert knots[1].tolist() == [0, 0.5, 1] and knots[0].tolist() == [1, 2.5, 4]


def plain_mixture(counts, table, steps):
    """Expectation-maximisation over single n-grams, in Python floats."""
    share = [1 / len(table)] * len(table)
    for _ in range(steps):
        total = [0.0] * len(table)
        for b, n in enumerate(counts):
            if n:
                p = [s * row[b] for s, row in zip(share, table)]
                for k, x in enumerate(p):
                    total[k] += n * x / sum(p)
        share = [x / sum(total) for x in total]
    return share, sum(n * math.log(sum(s * row[b] for s, row in zip(share, table))) for b, n in enumerate(counts) if n)


def test_mixture_against_a_plain_loop():
    rng = np.random.default_rng(3)
    table = rng.random((4, 40)) ** 3 + 1e-3
    table /= table.sum(axis=1, keepdims=True)
    counts = np.stack([rng.multinomial(n, share @ table) for n, share in [(50, np.array([1, 0, 0, 0])), (400, np.array([0.6, 0.4, 0, 0])), (300, np.array([0.3, 0.3, 0.4, 0]))]]).astype(float)
    share, log = language_id.mixture(counts, table)
    for k in range(3):
        want, value = plain_mixture(counts[k], table.tolist(), language_id.STEPS)
        assert np.allclose(share[k], want) and np.isclose(log[k], value)
        # the chosen set is the best of the nested ones by the penalised likelihood
        sets = [sorted(range(4), key=lambda j: -want[j])[:n] for n in range(1, 5)]
        values = [plain_mixture(counts[k], table[s].tolist(), language_id.STEPS)[1] - language_id.PENALTY * (len(s) - 1) * math.log(counts[k].sum()) for s in sets]
        best = next((n for n in range(3) if values[n + 1] <= values[n]), 3)
        assert {j for j, _ in language_id.identify(counts[k : k + 1], table)[0]} == set(sets[best])


def test_languages(spark, docs, folder, made):
    rng = random.Random(12)
    rows = made[0] + [(50_000, prose(rng, SYLLABLES["en"], 300) + " " + prose(rng, SYLLABLES["de"], 100)), (50_001, "12 !? 3", "en"), (50_002, "x", None), (50_003, "½ ² Ⅷ ٣", "fr"), (50_004, "½ é", "fr")]
    rows += [(60_000 + k, t, None) for k, t in enumerate(ODD)]
    where = folder(documents=docs(rows))
    got = {r["doc_id"]: r for r in language_id.op10_language_id(spark, where).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        und = t is None or not any(c.isalpha() for c in t)
        assert (got[i]["lang_pred"] == "und") == und and 0 <= got[i]["score"] <= 1 and got[i]["held_out"] == held(i, 3, 1)
        assert und or got[i]["lang_pred"] in SYLLABLES
    clean = [(got[i]["lang_pred"], lang) for i, t, lang in made[0] if held(i, 3, 1) and len(t) > 60 and not set("#$%&*") & set(t) and len(set(t.split())) > 5]
    assert len(clean) > 50 and np.mean([a == b for a, b in clean]) >= 0.98
    assert got[50_000]["lang_pred"] == "en" and got[50_000]["score"] < 0.9
    same_twice(language_id.op10_language_id, spark, where)
    model = language_id.learn(docs(made[0]))
    mixed = {r["doc_id"]: r["languages"] for r in language_id.predict(docs(rows).select("doc_id", "text", "lang"), model).collect()}
    assert set(mixed[50_000]) == {"en", "de"}
    with pytest.raises(ValueError):
        language_id.learn(docs(made[0]), most=2)
    assert language_id.op10_language_id(spark, folder(documents=docs([(1, "a", None), (2, None)]))).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.op10_language_id(spark, folder(documents=docs([(1, "a")]).where("false"))).count() == 0
