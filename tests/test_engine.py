"""The engine over folders made here: full, incremental and streaming runs."""

import json
import os
import time

import pytest

from fathomdex.cli import main, parser
from fathomdex.config import Settings
from fathomdex.logs import to_file
from fathomdex.operators.approximate import approximate_top_k
from fathomdex.operators import search
from fathomdex.operators.search import top_k, top_k_of
from fathomdex.plans.engine import Engine, NotFound
from fathomdex.plans.tools import Tools
from fathomdex.sources import store as store_module
from fathomdex.sources.store import Store
from fathomdex.state import State
from fathomdex.streaming.watch import watch


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    os.utime(path, (time.time() - 60, time.time() - 60))
    return path


def ids(engine):
    return {r["ruta_relativa"]: r["doc_id"] for r in engine.documents().collect()}


def chunks(engine):
    return sorted((r["ruta_relativa"], r["chunk_id"], r["texto"]) for r in engine.store.read("index").collect())


@pytest.fixture
def engine(spark, tmp_path):
    a, b = str(tmp_path / "a" / "docs"), str(tmp_path / "b" / "docs")
    put(a, "one.txt", "the red house")
    put(a, "sub/two.TXT", "a blue boat " * 200)
    put(a, "_three.html", "<p>green</p> tree")
    put(a, ".hidden.txt", "x")
    put(a, "skip.exe", "x")
    put(a, "scan.png", b"1")
    put(a, "bad.docx", b"broken")
    put(a, "empty.txt", " ")
    os.symlink(os.path.join(a, "one.txt"), os.path.join(a, "link.txt"))
    put(b, "four.csv", "name,n\nx,1\n")
    return Engine(spark, Settings(folders=(a, b, os.path.join(a, "sub")), data_dir=str(tmp_path / "data")))


def test_engine(engine):
    a, b = (r.path for r in engine.settings.roots[:2])
    got = engine.index()
    assert {k: got[k] for k in ("indexados", "sin_cambios", "sin_ocr", "omitidos", "errores", "fragmentos_nuevos")} == {
        "indexados": 4, "sin_cambios": 0, "sin_ocr": 1, "omitidos": 1, "errores": 1, "fragmentos_nuevos": 5,
    }
    assert set(ids(engine)) == {"docs/one.txt", "sub/two.TXT", "docs/_three.html", "docs/scan.png", "docs/empty.txt", "docs-2/four.csv"}
    again = engine.index()
    assert again["indexados"] == 0 and again["sin_cambios"] == 6 and again["errores"] == 1

    hits = engine.search("red house").collect()
    assert hits[0]["ruta_relativa"] == "docs/one.txt" and hits[0]["score"] == round((2 / 6**0.5), 4) and len(hits) == 5
    assert {h["ruta_relativa"] for h in engine.search("x", 5, "docs-2").collect()} == {"docs-2/four.csv"}
    assert [h["query_id"] for h in engine.search_many(["red", "tree"], 1).orderBy("query_id").collect()] == [0, 1]
    for bad in (" ", None):
        with pytest.raises(ValueError):
            engine.search(bad)
    with pytest.raises(ValueError):
        engine.search("x", 51)

    two = ids(engine)["sub/two.TXT"]
    whole = engine.document(two)
    assert whole["total_fragmentos"] == 2 and whole["siguiente_fragmento"] is None and whole["fichero"] == "two.TXT"
    assert engine.document(two, 1, 1)["texto"] == engine.chunk(two, 1)["texto"]
    assert engine.document(ids(engine)["docs/scan.png"])["sin_ocr"] is True
    with pytest.raises(NotFound):
        engine.document("nothing")
    with pytest.raises(NotFound):
        engine.chunk(two, 9)
    status = engine.status()
    assert status["documentos_indexados"] == 5 and status["fragmentos_totales"] == 5 and status["ficheros_sin_ocr"] == ["docs/scan.png"]
    assert status["estado"] == "activo" and status["tamanyo_indice_mb"] > 0

    put(a, "one.txt", "the red houses")
    os.unlink(os.path.join(b, "four.csv"))
    kept = engine.index()
    assert kept["indexados"] == 1 and "docs-2/four.csv" in ids(engine)
    pruned = engine.index(prune=True)
    assert pruned["indexados"] == 0 and "docs-2/four.csv" not in ids(engine)
    before = chunks(engine)
    engine.store.compact()
    engine.store.vacuum()  # everything is too young
    assert len(engine.store._manifests()) > 1
    engine.store.vacuum(hours=0)
    assert chunks(engine) == before and len(engine.store._manifests()) == 1
    assert engine.index(force=True)["indexados"] == 3 and chunks(engine) == before


def test_tools(engine):
    tools = Tools(engine)
    run = lambda name, **args: tools.call(name, args)
    made = run("indexar_carpeta")["structuredContent"]
    assert set(made) == {"carpetas", "indexados", "sinCambios", "sinOcr", "omitidos", "errores", "fragmentosNuevos"}
    found = run("buscar_documentos", query=" red house ", n_resultados=1)["structuredContent"]
    assert found["query"] == "red house" and found["n_resultados"] == 1
    hit = found["fragmentos"][0]
    assert set(hit) == {"doc_id", "chunk_id", "texto", "fichero", "raiz", "ruta_relativa", "pagina", "fecha_modificacion", "score"} and hit["fecha_modificacion"].endswith("Z")
    assert run("obtener_fragmento", doc_id=hit["doc_id"], chunk_id=0)["structuredContent"]["texto"] == "the red house"
    whole = run("obtener_documento", doc_id=hit["doc_id"])["structuredContent"]
    assert whole["texto"] == "the red house" and whole["siguiente_fragmento"] is None
    listed = run("listar_documentos_indexados", carpeta_filtro="docs-2")["structuredContent"]
    assert listed["total"] == 1 and listed["documentos"][0]["ruta_relativa"] == "docs-2/four.csv"
    assert run("estado_servidor")["structuredContent"]["documentos_indexados"] == 5
    for bad in (run("nothing"), run("buscar_documentos"), run("obtener_fragmento", doc_id="x"), run("obtener_fragmento", doc_id="x", chunk_id=1), run("obtener_documento"), run("obtener_documento", doc_id="x")):
        assert bad["isError"] and "error" in bad["structuredContent"]


def test_failure_keeps_what_was_indexed(engine):
    a = engine.settings.roots[0].path
    put(a, "page.csv", "k,v\nq,1\n")
    engine.index()
    path = put(a, "page.csv", "k,v\nq,22\n")
    os.chmod(path, 0)
    os.unlink(path)
    os.mkdir(path)  # a folder of that name: nothing to read
    assert engine.index()["errores"] == 1
    assert any(p == "docs/page.csv" for p, _, _ in chunks(engine))


def test_stream_equals_a_full_run(engine, spark, tmp_path):
    a = engine.settings.roots[0].path
    engine.index()
    watch(engine, settle=0, once=True).awaitTermination()  # takes the first listing
    put(a, "new.txt", "brand new")
    put(a, "one.txt", "the red houses changed")
    os.unlink(os.path.join(a, "_three.html"))
    watch(engine, settle=0, once=True).awaitTermination()
    watch(engine, settle=0, once=True).awaitTermination()  # a restart applies nothing twice
    fresh = Engine(spark, Settings(folders=engine.settings.folders, data_dir=str(tmp_path / "fresh")))
    fresh.index()
    assert chunks(engine) == chunks(fresh)
    assert set(ids(engine)) == set(ids(fresh))


def test_a_failing_batch_is_passed_over(engine, monkeypatch):
    a = engine.settings.roots[0].path
    watch(engine, settle=0, once=True).awaitTermination()
    put(a, "first.txt", "the first")
    with monkeypatch.context() as m:
        m.setattr(engine, "apply_changes", lambda events: 1 / 0)
        watch(engine, settle=0, once=True).awaitTermination()
    assert engine.status()["estado"] == "error" and "division" in engine.status()["ultimo_error"]
    put(a, "second.txt", "the second")
    stream = watch(engine, settle=0, once=True)
    stream.awaitTermination()
    assert stream.exception() is None and set(ids(engine)) == {"docs/second.txt"} and engine.status()["estado"] == "activo"
    engine.index()
    assert "docs/first.txt" in ids(engine)


def test_a_file_being_written_waits(engine):
    a = engine.settings.roots[0].path
    stream = watch(engine, interval="200 milliseconds", settle=3)
    time.sleep(4)
    with open(os.path.join(a, "slow.txt"), "w") as f:
        f.write("still being written")
    began = time.time()
    while "docs/slow.txt" not in ids(engine) and time.time() - began < 60:
        time.sleep(0.3)
    assert time.time() - began >= 3 and "docs/slow.txt" in ids(engine)
    engine.stop()
    assert not stream.isActive and engine.stream is None


def test_progress_is_seen_by_others(engine, spark):
    seen = []
    kept = State.set
    other = Engine(spark, engine.settings)
    other_pid = os.getpid() + 1

    def note(self, name, error=None, progress=None):
        kept(self, name, error, progress)
        told = json.load(open(self.path))
        with open(self.path, "w") as f:
            json.dump({**told, "pid": other_pid}, f)
        seen.append(other.state.seen())

    State.set = note
    try:
        engine.index()
    finally:
        State.set = kept
    told = [x["progreso"] for x in seen if "progreso" in x]
    assert told and all(p["total"] == 7 for p in told) and seen[-1] == {"estado": "activo"}


def test_store_merges_like_sizes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MERGE_AT", 3)
    store = Store(spark, str(tmp_path / "s"), {"t": ("k long, v string", "k")})
    want = {}
    for n in range(8):
        rows = [(k, f"{n}") for k in range(n, n + 3)]
        store.commit(upserts={"t": spark.createDataFrame(rows, "k long, v string")}, deletes={"t": spark.createDataFrame([(n - 1,)], "k long")} if n % 3 == 1 else None)
        want.update(rows)
        if n % 3 == 1:
            want.pop(n - 1)
        store.merge()
        assert dict(store.read("t").collect()) == want
    state = store.manifest()["tables"]["t"]
    assert len(state["segments"]) < 6 and len(state["deleted"]) < 6
    with pytest.raises(RuntimeError):
        store._publish(store.manifest())
    store.compact()
    assert dict(store.read("t").collect()) == want


def test_cli(spark, tmp_path, capsys):
    put(str(tmp_path / "c"), "x.txt", "hello there")
    assert main(["index"]) == 2
    where = ["--folder", str(tmp_path / "c"), "--data-dir", str(tmp_path / "d")]
    assert main(["index", *where]) == 0
    assert main(["search", "hello", *where]) == 0
    assert '"texto": "hello there"' in capsys.readouterr().out
    assert main(["read", "none", *where]) == 1
    assert main(["search", *where]) == 1
    assert main(["call", "buscar_documentos", '{"query": "hello"}', *where]) == 0
    assert main(["call", "nothing", *where]) == 1
    assert parser().parse_args(["list", "--in", "x"]).within == "x"


def test_start_and_logs(spark, tmp_path):
    put(str(tmp_path / "c"), "x.txt", "hello there")
    engine = Engine(spark, Settings(folders=(str(tmp_path / "c"),), data_dir=str(tmp_path / "d")))
    assert engine.start(watching=False) is None and engine.status()["documentos_indexados"] == 1
    lines = [json.loads(x) for x in open(tmp_path / "d" / "logs" / "fathomdex.log")]
    assert lines[-1]["msg"] == "indexed" and lines[-1]["indexados"] == 1
    log = to_file(str(tmp_path / "small"), 300)
    for _ in range(20):
        log.info("x" * 100)
    assert sorted(os.listdir(tmp_path / "small")) == ["fathomdex.log", "fathomdex.log.1", "fathomdex.log.2"]


def test_approximate_search(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = items.where("vec_id = 0").first()["embedding"]
    exact = [r["vec_id"] for r in top_k(items, [(0, query)], 5, ("vec_id",), "embedding").orderBy("rank").collect()]
    got = [r["vec_id"] for r in approximate_top_k(items, query, 5, ("vec_id",), "embedding").collect()]
    assert got[0] == 0 and len(set(got) & set(exact)) >= 3


def test_tables_of_queries_of_any_length(spark, monkeypatch):
    """No queries, blocks that few of them meet, and more queries than the workers get together give what single blocks give."""
    rng = __import__("random").Random(5)
    rows = [(n, [rng.choice((-1.0, 0.0, 1.0)) for _ in range(4)]) for n in range(60)]
    items = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    asked = items.where("vec_id % 5 = 0").select("vec_id", "vector")
    assert top_k_of(items, asked.where("vec_id < 0"), 3, ("vec_id",)).collect() == []
    for own in (None, "vec_id"):
        got = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
        want = got(top_k(items, [(r["vec_id"], r["vector"]) for r in asked.collect()], 3, ("vec_id",), exclude_self=own))
        assert len(want) == 36
        assert got(top_k_of(items, asked, 3, ("vec_id",), exclude_self=own, block=1)) == want
        with monkeypatch.context() as m:
            m.setattr(search, "BLOCK", 2)
            m.setattr(search, "CELL", 9)
            assert got(top_k_of(items, asked, 3, ("vec_id",), exclude_self=own, block=1)) == want


def test_rows_for_files_are_dealt_by_their_number(spark, monkeypatch):
    """A shuffle that goes by bytes would join the small rows of many files to one task."""
    from pyspark.sql import functions as F

    from fathomdex.plans import queries

    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 50).alias("k"))
    monkeypatch.setattr(queries, "A_TASK", 100)
    grouped = queries._tables_by(rows, "k", F.col("id"))
    assert len({r["p"] for r in grouped.select(F.spark_partition_id().alias("p")).collect()}) > 4
    assert sorted((r["k"], [x["c0"] for x in r["rows"]]) for r in grouped.collect()) == [(k, list(range(k, 1000, 50))) for k in range(50)]


def test_vectors_of_a_batch_are_held_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from fathomdex.operators import embedding

    texts = [None, "", " \u00a0", *(f"w{k % 9} w{k % 7} x" for k in range(2000))]
    provider = embedding.HashProvider()
    want = provider.embed(texts)
    tracemalloc.start()
    try:
        got = embedding._vectors(pa.array(texts), provider, np.float64)
        assert tracemalloc.get_traced_memory()[1] < 1.5 * want.nbytes
    finally:
        tracemalloc.stop()
    assert got.type == pa.list_(pa.float64()) and len(got) == len(texts)
    assert (np.array(got.to_pylist()) == want).all()
    assert embedding._vectors(pa.array([], pa.string()), provider, np.float32).to_pylist() == []


def test_vectors_are_computed_once(spark, sf_dir):
    from fathomdex.plans.queries import q14_hash_vector

    plan = q14_hash_vector(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
