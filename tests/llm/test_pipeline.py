import ast
import os
import random
import shutil
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import corpus_pipeline

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def syll(rng, n):
    return " ".join("".join(rng.choice("ba de ti no ru la se mo".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_stages(spark, docs, folder):
    """Cases are planted; what must go goes, everything else stays."""
    rng = random.Random(21)
    rows, labels, toxic = [], [], set()
    for i in range(500):
        words = syll(rng, rng.choice([20, 60, 150])).split()
        if i % 5 == 0:
            toxic.add(i)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(words), "en", f"s{i % 4}"))
        labels.append((i, 1, int(i in toxic)))
    item = syll(rng, 40)
    leaks = {1000, 1001}
    rows += [(k, f"{syll(rng, 30)} {item} {syll(rng, 30)}", "en", "s1") for k in sorted(leaks)]
    text = syll(rng, 300)
    rows += [(2000, text, "en", "s2"), (2001, text, "en", None), (2002, " ".join([*text.split()[:7], "zzz", *text.split()[8:]]), "en", "s2")]
    rows += [(3000, None, "en", "s0"), (3001, "", "en", "s0")]
    where = folder(documents=docs(rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([(5, item)], "item_id long, text string"))
    seen = []
    now = spark.read.parquet(f"{where}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, where)
        assert out.columns[: len(now.columns)] == now.columns if k == 4 else out.columns == now.columns
        out.write.parquet(f"{where}/stage{k}")
        now = spark.read.parquet(f"{where}/stage{k}")
        seen.append(Counter(r["doc_id"] for r in now.collect()))
    ids = {r[0] for r in rows}
    clean = ids - toxic - leaks - {2001, 2002}
    assert len(set(seen[0]) & toxic) <= 3 and set(seen[0]) >= clean
    assert set(seen[0]) - set(seen[1]) == {2001, 2002}
    assert set(seen[1]) - set(seen[2]) == leaks & set(seen[1]) == leaks
    assert max(seen[3].values()) <= 3 and set(seen[3]) <= set(seen[2])
    assert seen[4] == seen[3]
    slots = defaultdict(list)
    for r in now.collect():
        slots[r["shard"]].append(r["slot"])
        assert r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    whole = corpus_pipeline.run(spark, where)
    assert Counter(r["doc_id"] for r in whole.collect()) == seen[4]


def test_stages_bear_empty_documents(spark, docs, folder):
    where = folder(documents=docs([(1, "x")]).where("false"), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, where).count() == 0


def test_the_rest_stands_alone(tmp_path):
    """Without these folders the entry still imports and has the engine's queries, the rest's tests pass, and nothing else imports them."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert out.stdout.split() == ["44", "44"], out.stderr
    few = [sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "--deselect", "tests/test_engine.py"]
    out = subprocess.run(few, cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert out.returncode == 0, out.stdout[-3000:]
    for folder, _, names in os.walk(tmp_path / "r" / "fathomdex"):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    for node in ast.walk(ast.parse(f.read())):
                        assert not (isinstance(node, ast.ImportFrom) and "llm" in (node.module or ""))
