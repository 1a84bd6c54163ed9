"""The engine: indexing, searching and reading, over one data folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import VERSION
from ..config import Root, Settings, build_roots
from ..functions import paths, text
from ..logs import to_file
from ..operators import changes, chunking, embedding, reading, search
from ..schemas import EXTRACTED, INDEX, REGISTRY
from ..sources import listing
from ..sources.extract import Options, extract
from ..sources.store import Store
from ..state import Reporting, State

_PAGE = pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))


#: Files that a task extracts at most, on average.
FILES_PER_TASK = 200


class NotFound(LookupError):
    pass


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, provider: embedding.Provider | None = None):
        self.spark, self.settings = spark, settings or Settings.from_env()
        self.provider = provider or embedding.HashProvider()
        self.store = Store(spark, self.settings.index_dir, {"index": (INDEX, "doc_id"), "registry": (REGISTRY, "path")})
        self.size, self.overlap = chunking.sizes(self.settings.chunk_tokens, self.settings.overlap_tokens)
        self.state, self.stream = State(self.settings.data_dir), None
        listing.register(spark)

    def warm_up(self) -> None:
        """Loads the provider's model, so that the first search doesn't wait for it."""
        self.provider.embed(["warm up"])

    def start(self, watching: bool = True):
        """Warms up, brings the index up to date, and watches the folders; returns the running stream, if any.

        Without folders there is nothing to index. Errors are kept in the status.
        """
        from ..streaming.watch import watch

        log = to_file(f"{self.settings.data_dir}/logs")
        self.state.set("iniciando")
        try:
            self.warm_up()
            if self.settings.roots:
                log.info("indexed", extra={"extra": self.index()})
        except Exception as e:
            self.state.set("error", str(e))
            log.exception("start failed")
        else:
            self.state.set("activo")
        return watch(self) if watching and self.settings.roots else None

    def stop(self) -> None:
        """Ends the stream after the batch that it is at, if there is one."""
        if self.stream is not None:
            self.stream.stop()
            self.stream = None

    # Indexing

    def files(self, folders: Sequence[str] | None = None) -> DataFrame:
        """The files of the folders, each once even where folders are nested."""
        asked = list(folders) if folders else [r.path for r in self.settings.roots]
        rows = self.spark.read.format("fathomdex_files").option("folders", json.dumps(asked)).option("exclude", self.settings.data_dir).load()
        return rows.dropDuplicates(["path"])

    def _extracting(self):
        s = self.settings
        options = Options(s.max_pages, 0, s.ocr, s.ocr_lang, s.ocr_dpi, s.ocr_max_pages, s.archive_members, s.archive_bytes)
        done = self.done

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch["path"].to_pylist():  # one file at a time: a few large ones must not meet in memory
                    raw, error, pages, number, unread = None, None, [], None, False
                    family = paths.FAMILY_OF.get("." + path.rsplit(".", 1)[-1].lower())
                    try:
                        with open(path, "rb") as f:
                            content = f.read()
                        if family in ("text", "html"):
                            raw = content.decode("utf-8", "replace")
                        else:
                            found = extract(path, content, options)
                            pages, number, unread = found.pages, found.num_pages, found.sin_ocr
                    except FileNotFoundError:
                        error = "no_existe"
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                    done.add(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([family]), pa.array([raw], pa.string()), pa.array([[{"page": p.page, "text": p.text} for p in pages]], _PAGE),
                         pa.array([number], pa.int32()), pa.array([unread]), pa.array([error], pa.string())],
                        names=["path", "family", "raw", "pages", "num_pages", "sin_ocr", "error"],
                    )

        return run

    def extracted(self, files: DataFrame) -> DataFrame:
        """(path, pages, num_pages, sin_ocr, error). Texts and HTML are only read in Python; the rest of their way is in the plan."""
        kind = "path string, family string, raw string, pages array<struct<page: int, text: string>>, num_pages int, sin_ocr boolean, error string"
        rows = files.select("path").mapInArrow(self._extracting(), kind)
        pages = F.when(F.col("raw").isNull(), F.col("pages")).when(F.col("family") == "html", text.pages_from_text(text.html_to_text(F.col("raw"))))
        pages = pages.otherwise(text.pages_from_text(text.plain_text(F.col("raw"))))
        return rows.select("path", pages.cast("array<struct<page: int, text: string>>").alias("pages"), "num_pages", "sin_ocr", "error")

    def index(self, folders: Sequence[str] | None = None, force: bool = False, prune: bool = False) -> dict:
        """Indexes new and modified files (all, if forced) in one commit, and returns the run's summary.

        A file that fails keeps what was indexed of it before. ``prune`` removes
        documents of the folders whose files are gone.
        """
        roots = build_roots(folders) if folders else list(self.settings.roots)
        if not roots:
            raise ValueError("no folders: set them or name one")
        self.state.set("indexando")
        work = self._work()
        try:
            changes.compare(self.files(folders), self.store.read("registry")).write.parquet(work)  # folders are listed once
            found = self.spark.read.parquet(work)
            inside = F.lit(False)
            for root in roots:
                inside = inside | paths.under(F.col("path"), root.path)
            gone = found.where((F.col("change") == "gone") & inside).select("path")
            files = found.where("change <> 'gone'")
            summary = self._apply(files if force else files.where("change <> 'same'"), gone if prune else None)
            summary["sin_cambios"] = 0 if force else files.where("change = 'same'").count()
        except Exception as e:
            self.state.set("error", str(e))
            raise
        finally:
            self._drop(work)
        self.store.merge()
        self.state.set("activo")
        return {"carpetas": [r.path for r in roots], **summary}

    def _work(self) -> str:
        return f"{self.settings.index_dir}/work/{uuid.uuid4().hex}"

    def _drop(self, work: str) -> None:
        self.store._fs.delete(self.store._at(work.removeprefix(self.store.folder + "/")), True)

    def _apply(self, files: DataFrame, gone: DataFrame | None = None) -> dict:
        """Extracts, chunks and embeds the files and commits them, together with what is gone."""
        roots = list(self.settings.roots)
        work = self._work()
        try:
            files.select("path", "size", "mtime_ns").write.parquet(f"{work}/files")
            listed = self.spark.read.parquet(f"{work}/files")
            total = listed.count()
            tasks = max(4 * self.spark.sparkContext.defaultParallelism, total // FILES_PER_TASK)
            self.done = self.spark.sparkContext.accumulator(0)
            with Reporting(self.state, total, lambda: self.done.value):
                self.extracted(listed.repartition(tasks)).write.parquet(f"{work}/extracted")
            done = self.spark.read.schema(EXTRACTED).parquet(f"{work}/extracted").join(listed, "path")
            good = done.where("error IS NULL")
            base = good.select(
                "path", paths.doc_id(F.col("path")).alias("doc_id"), paths.root_of(F.col("path"), roots).alias("raiz"), paths.logical_path(F.col("path"), roots).alias("ruta_relativa"),
                "size", "mtime_ns", F.current_timestamp().alias("indexed_at"), "num_pages", "sin_ocr", "pages",
            )
            chunks = chunking.explode_chunks(base.where("NOT sin_ocr"), size=self.size, overlap=self.overlap)
            chunks = embedding.embedded(chunks, embedding.passage(F.col("texto")) if not isinstance(self.provider, embedding.HashProvider) else F.col("texto"), self.provider)
            draft = self.store.draft()
            new = draft.put("index", chunks.select(
                "doc_id", "chunk_id", "vector", "texto", paths.base_name(F.col("path")).alias("fichero"), "ruta_relativa", "raiz", F.col("page").alias("pagina"),
                F.timestamp_micros((F.col("mtime_ns") / 1000).cast("long")).alias("fecha_modificacion"),
            ))
            counts = new.groupBy("doc_id").agg(F.count("*").cast("int").alias("num_chunks"))
            entries = base.drop("pages").join(counts, "doc_id", "left").withColumn("num_chunks", F.coalesce("num_chunks", F.lit(0)))
            entries = draft.put("registry", entries)
            draft.remove("index", entries.select("doc_id"))  # a document may have lost all its chunks
            if gone is not None:
                gone.write.parquet(f"{work}/gone")
                gone = self.spark.read.schema("path string").parquet(f"{work}/gone")
                draft.remove("registry", gone)
                draft.remove("index", gone.select(paths.doc_id(F.col("path"))))
            draft.publish()
            state = F.when(F.col("error") == "no_existe", "omitido").when(F.col("error").isNotNull(), "error").when(F.col("sin_ocr"), "sin_ocr")
            outcome = done.select("path", "error", "sin_ocr").join(entries.select("path", "num_chunks"), "path", "left")
            state = state.when(F.col("num_chunks") == 0, "vacio").otherwise("indexado")
            return reading.run_summary(outcome.select(state.alias("estado"), F.col("num_chunks").alias("fragmentos"))).first().asDict()
        finally:
            self._drop(work)

    def apply_changes(self, events: DataFrame) -> dict:
        """Applies a batch of file changes; of several for one path the last counts."""
        last = changes.coalesced(events)
        sizes = events.where("kind = 'index'").groupBy("path").agg(F.max_by(F.struct("size", "mtime_ns"), F.struct("ts", "seq")).alias("s"))
        files = last.where("kind = 'index'").join(sizes, "path").select("path", "s.size", "s.mtime_ns")
        return self._apply(files, last.where("kind = 'remove'").select("path"))

    # Reading

    def _index(self) -> DataFrame:
        return self.store.read("index")

    def search(self, query: str, n: int | None = None, folder: str | None = None, mode: str = "exact") -> DataFrame:
        if not query or not query.strip():
            raise ValueError("a query is needed")
        n = n or self.settings.default_results
        if not 1 <= n <= self.settings.max_results:
            raise ValueError(f"1 to {self.settings.max_results} results")
        return search.search(self._index(), self._vector(query.strip()), n, folder, mode)

    def search_many(self, queries: Sequence[str], n: int | None = None, folder: str | None = None) -> DataFrame:
        asked = [(k, self._vector(q)) for k, q in enumerate(queries)]
        return search.search_many(self._index(), asked, n or self.settings.default_results, folder)

    def _vector(self, query: str) -> list[float]:
        asked = query if isinstance(self.provider, embedding.HashProvider) else embedding.query_text(query)
        return self.provider.embed([asked])[0].tolist()

    def chunk(self, doc_id: str, chunk_id: int) -> dict:
        rows = self._index().where((F.col("doc_id") == doc_id) & (F.col("chunk_id") == chunk_id)).limit(1)
        found = rows.select("doc_id", "chunk_id", "texto", "fichero", "ruta_relativa", "pagina", "fecha_modificacion").first()
        if found is None:
            raise NotFound(f"no chunk {chunk_id} of {doc_id}")
        return found.asDict()

    def document(self, doc_id: str, first: int | None = None, most: int | None = None) -> dict:
        entry = self.store.read("registry").where(F.col("doc_id") == doc_id).first()
        chunks = self._index().where(F.col("doc_id") == doc_id)
        rows = reading.assembled(chunks.select("doc_id", "chunk_id", F.col("pagina").alias("page"), "texto"), first, most).first()
        if rows is None:
            if entry is not None and entry["sin_ocr"]:
                return {"doc_id": doc_id, "ruta_relativa": entry["ruta_relativa"], "sin_ocr": True, "total_fragmentos": 0, "texto": "", "aviso": "no readable text yet"}
            raise NotFound(f"no document {doc_id}")
        one = chunks.select("fichero", "ruta_relativa").first()
        return {
            **rows.asDict(), "fichero": one["fichero"], "ruta_relativa": entry["ruta_relativa"] if entry else one["ruta_relativa"],
            "total_paginas": entry["num_pages"] if entry else None, "sin_ocr": bool(entry and entry["sin_ocr"]),
        }

    def documents(self, folder: str | None = None) -> DataFrame:
        return reading.listing(self.store.read("registry"), folder)

    def status(self) -> dict:
        row = reading.totals(self.store.read("registry"), F.col("ruta_relativa")).first()
        out = {
            **self.state.seen(), "version": VERSION, "carpetas_vigiladas": [{"nombre": r.name, "ruta": r.path} for r in self.settings.roots],
            "documentos_indexados": row["documentos"], "fragmentos_totales": row["fragmentos"], "ficheros_sin_ocr": list(row["sin_ocr"]), "tamanyo_indice_mb": self.store.size_mb(),
        }
        return out


__all__ = ["Engine", "NotFound", "Root"]
