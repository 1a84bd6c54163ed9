"""The registered queries: the engine's operators over the test tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Root
from ..functions import paths, text
from ..operators import archive, changes, chunking, embedding, reading, search
from ..sources.extract import Options
from ..sources.store import Store
from . import files

Query = Callable[[SparkSession, str], DataFrame]
SIZE, OVERLAP = chunking.sizes()
#: Roots for the urls of ``pages``, whose paths begin with a language.
ROOTS = (Root("corpus-en", "/corpus/en"), Root("corpus-fr", "/corpus/fr"))
#: Limits of the archive query, low enough to be met by the test tables.
MEMBERS, BYTES = 20, 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path_of_url() -> F.Column:
    return F.regexp_extract("url", r"^\w+://[^/?#]*([^?#]*)", 1)


def q01_ext_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", paths.extension(_path_of_url()).alias("ext"))
    return rows.select("page_id", "ext", paths.family(F.col("ext")).alias("family"), paths.family(F.col("ext")).isNotNull().alias("supported"))


def q02_doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.doc_id(F.col("url")).alias("doc_id"))


def q03_root_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/corpus"), F.regexp_replace(_path_of_url(), "/+$", ""))
    return table(spark, sf_dir, "pages").select("page_id", paths.root_of(path, ROOTS).alias("raiz"), paths.logical_path(path, ROOTS).alias("ruta_relativa"))


def q04_root_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names that repeat get -2, -3, ... in the order of their folders."""
    base = F.concat(F.lit("region"), F.col("n_regionkey").cast("string"))
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(k == 1, base).otherwise(F.concat(base, F.lit("-"), k.cast("string"))).alias("name"))


def q05_trim_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\u00a0\n\t"), F.col("text"), F.lit("\u3000 \ufeff"))
    page = F.explode(text.pages_from_text(padded)).alias("p")
    return table(spark, sf_dir, "documents").select("doc_id", page).select("doc_id", F.col("p.page").alias("page"), F.col("p.text").alias("texto"))


def q06_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("texto"))


def q07_office_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.office_xml_to_text(F.col("html")).alias("texto"))


#: Rows of a table for a task that makes files of them; with fewer rows, the least for which a core is put to work.
A_TASK, A_CORE = 60_000, 1000


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key for the files that are made of them, into tasks by their number.

    Files take their time in Python by rows and keys; a shuffle that goes by bytes may join all to a few tasks.
    """
    count, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(count // A_TASK, min(cores, count // A_CORE)) + 1, key)


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export per conversation; those with odd ids lack the times."""
    head = F.concat(F.lit("[12/03/24, 9:41:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("] "), F.col("role"), F.lit(": "))
    line = F.concat(F.when(F.col("conv_id") % 2 == 0, head).otherwise(F.lit("")), F.col("text"))
    lines = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    chats = _dealt(table(spark, sf_dir, "conversations"), "conv_id").groupBy("conv_id").agg(lines.alias("l"))
    return chats.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def q08_chat_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = text.chat_heads(F.col("text"))
    return _chats(spark, sf_dir).select("conv_id", heads["checked"].cast("int").alias("checked"), heads["matched"].cast("int").alias("matched"), text.is_chat(F.col("text")).alias("is_chat"))


def q09_chat_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("conv_id", text.join_chat(F.col("text")).alias("texto"))


def _cells(*names: str) -> F.Column:
    return F.array(*[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def q10_csv_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    header = F.array(*[F.lit(n) for n in names])
    rows = table(spark, sf_dir, "supplier").withColumn("cells", F.transform(_cells(*names), lambda c: F.when(c == "0", "").otherwise(c)))
    return rows.select("s_suppkey", text.is_header(header).alias("labelled"), text.labelled_row(header, F.col("cells")).alias("line"))


def q11_csv_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.is_header(cells).alias("labelled"), text.joined_row(cells).alias("line"))


def _document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.pages_from_text(F.col("text")).alias("pages"))
    return chunking.explode_chunks(docs, size=SIZE, overlap=OVERLAP)


def _conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents with a page per turn."""
    page = F.struct((F.col("turn") + 1).cast("int").alias("page"), "text")
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    return chunking.explode_chunks(docs, size=SIZE, overlap=OVERLAP)


def q12_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_chunks(spark, sf_dir).select("doc_id", "chunk_id", "texto")


def q13_chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversation_chunks(spark, sf_dir).select("conv_id", "chunk_id", "page", "texto")


def q14_hash_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = embedding.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), embedding.HashProvider(), double=True)
    rows = docs.select("doc_id", F.posexplode("vector").alias("bucket", "weight")).where("weight > 0")
    return rows.select("doc_id", F.col("bucket").cast("int").alias("bucket"), F.round("weight", 4).alias("weight"))


def _asked(items: DataFrame) -> DataFrame:
    """The query set of searches: every vector whose id is divisible by 100."""
    return items.where("vec_id % 100 = 0").select("vec_id", "embedding")


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"), F.round("score", 4).alias("score"))


def q15_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    return _ranked(search.top_k_of(items, _asked(items), 10, ("vec_id",), "embedding"))


def _as_index(items: DataFrame) -> DataFrame:
    """Vectors as chunks of an index, in a folder per label."""
    rows = items.withColumn("doc_id", F.lpad(F.col("vec_id").cast("string"), 12, "0")).withColumn("raiz", F.concat(F.lit("label"), F.col("label").cast("string")))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("texto", "string"), ("fichero", "string"), ("pagina", "int"), ("fecha_modificacion", "timestamp"))]
    return rows.select("doc_id", F.lit(0).alias("chunk_id"), F.col("embedding").alias("vector"), "raiz", F.concat_ws("/", "raiz", "doc_id").alias("ruta_relativa"), *nothing)


def _in_folder(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    hits = search.search_many(_as_index(items), _asked(items), 10, "label3", mode)
    return hits.select("query_id", F.col("doc_id").cast("long").alias("vec_id"), "score")


def q16_topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_folder(spark, sf_dir, "exact")


def q17_topk_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_folder(spark, sf_dir, "overfetch")


def q18_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    return _ranked(search.top_k_of(items, _asked(items), 5, ("vec_id",), "embedding", block=7))


def q19_self_exclude_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    return _ranked(search.top_k_of(items, _asked(items), 5, ("vec_id",), "embedding", exclude_self="vec_id"))


def q20_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best chunks of the documents for benchmark items."""
    provider = embedding.HashProvider()
    asked = table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select("item_id", "text")
    asked = embedding.embedded(asked, F.col("text"), provider, double=True).select("item_id", "vector")
    chunks = embedding.embedded(_document_chunks(spark, sf_dir).select("doc_id", "chunk_id", "texto"), F.col("texto"), provider, double=True)
    hits = search.top_k_of(chunks, asked, 20, ("doc_id", "chunk_id"))
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.round("score", 4).alias("score"))


def q21_get_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second chunk of every document that has one."""
    rows = _document_chunks(spark, sf_dir).where("chunk_id = 1")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return rows.select("doc_id", "chunk_id", "texto", name.alias("fichero"), F.concat(F.lit("docs/"), name).alias("ruta_relativa"), F.col("page").alias("pagina"))


def q22_read_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.assembled(_conversation_chunks(spark, sf_dir), by="conv_id")


def q23_read_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.assembled(_document_chunks(spark, sf_dir), first=1, most=2)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as registered files, in a folder per source; toxic ones stand for files that couldn't be read."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    words = F.size(text.words(F.col("text")))
    chunks = F.when(words == 0, 0).when(words <= SIZE, 1).otherwise(1 + F.ceil((words - SIZE) / F.lit(SIZE - OVERLAP))).cast("int")
    docs = table(spark, sf_dir, "documents").withColumn("chunks", chunks).select("doc_id", "source", "chunks").join(labels, "doc_id", "left")
    unread = F.coalesce(F.col("toxic") == 1, F.lit(False))
    name = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(
        "doc_id", F.lit(None).cast("string").alias("raiz"), name.alias("ruta_relativa"), F.when(unread, 0).otherwise(F.col("chunks")).alias("num_chunks"),
        F.lit(None).cast("int").alias("num_pages"), unread.alias("sin_ocr"), F.lit(None).cast("timestamp").alias("indexed_at"),
    )


def q24_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with the place that each document has in it."""
    listed = reading.listing(_registry(spark, sf_dir), "\\src1/").withColumn("_id", F.monotonically_increasing_id())
    # the listing is sorted: ids hold the partition and the row in it, so a row per partition tells where each begins
    listed = listed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = listed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = (F.col("_first") + F.col("_row") + 1).cast("int").alias("place")
    return listed.join(F.broadcast(begins), "_part").select(place, "doc_id", "ruta_relativa", "fragmentos", "paginas", "sin_ocr")


def q25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading.totals(_registry(spark, sf_dir), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return rows.select("documentos", "fragmentos", F.array_join("sin_ocr", ",").alias("sin_ocr"))


def _staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, against a registry that misses some and has others with another size or time."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("path")
    files = docs.select(path, F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime_ns"))
    size = F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    mtime = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    known = docs.where("doc_id % 11 <> 0").select(path, size.alias("size"), mtime.alias("mtime_ns"))
    gone = docs.where("doc_id % 13 = 0").select(F.concat(F.lit("/gone/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime_ns"))
    return changes.compare(files, known.unionByName(gone))


def q26_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staleness(spark, sf_dir).select("path", "change")


def q27_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("change") == "same", "sin_cambios").when(F.col("change") == "gone", "omitido").otherwise("indexado")
    return reading.run_summary(_staleness(spark, sf_dir).select(state.alias("estado"), F.when(state == "indexado", 1).alias("fragmentos")))


def q28_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of documents after three commits: all, the toxic ones deleted, those of low quality replaced."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    store = Store(spark, f"{named or tempfile.mkdtemp()}/stores/{uuid.uuid4().hex}", {"docs": ("doc_id long, text string", "doc_id")})
    store.gone_at_exit()
    labels, index = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "text")
    store.commit(upserts={"docs": index})
    store.commit(deletes={"docs": labels.where("toxic = 1").select("doc_id")})
    low = index.join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    store.commit(upserts={"docs": low.withColumn("text", F.concat(F.lit("v2 "), "text"))})
    return store.read("docs").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("index")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))


def q29_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.coalesced(_events(spark, sf_dir)).select(F.col("path").alias("user_id"), "kind", F.col("events").cast("long").alias("events"))


def q30_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.debounced(_events(spark, sf_dir), "30 minutes")
    return rows.select(F.col("path").alias("user_id"), F.unix_micros(F.col("since").cast("timestamp")).alias("since_us"), "kind", F.col("events").cast("long").alias("events"))


def q31_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files with a page per turn; the shortest ones count as scanned."""
    clean = F.length(text.trim(F.regexp_replace("text", "[ \t]+", " ")))
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"), F.sum(clean).cast("long").alias("chars"))
    return per.select("conv_id", "pages", "chars", archive.is_scanned(F.col("chars"), F.col("pages")).alias("sin_ocr"))


def q32_archive_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "documents").select(F.col("source").alias("archive"), "doc_id", F.col("n_chars").alias("size"))
    return archive.guarded(members, "archive", "doc_id", MEMBERS, BYTES)


VERSIONS = (("1.2.2", "1.2.1"), ("1.2", "1.2.0"), ("1.10.0", "1.9.9"), ("2", "10"), ("1.2.x", "1.2.0"), ("1.2.1", "1.2"), ("x.y", "0.0.1"), ("0.0.2", "0.0.10"))


def q33_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(VERSIONS), "remote string, local string")
    return rows.select("remote", "local", text.version_newer(F.col("remote"), F.col("local")).alias("newer"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return _dealt(table(spark, sf_dir, "conversations"), "conv_id").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda x: x["text"]).alias("texts"))


def q34_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return files.extracted(rows, "doc_id", lambda r: (f"{r['doc_id']}.TXT", r["text"].encode()))


def q35_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extracted(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", lambda r: ("page.htm", r["html"].encode()))


def q36_extract_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extracted(_turns(spark, sf_dir), "conv_id", lambda r: ("x.docx", files.docx(r["texts"])))


def q37_extract_pptx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extracted(_turns(spark, sf_dir), "conv_id", lambda r: ("x.pptx", files.pptx(r["texts"])))


def _tables_by(rows: DataFrame, key: str, *columns: F.Column) -> DataFrame:
    """The rows of each key's file, in order of their first cell."""
    rows = _dealt(rows.select(F.col(key).cast("long").alias(key), *[c.alias(f"c{k}") for k, c in enumerate(columns)]), key)
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[f"c{k}" for k in range(len(columns))]))).alias("rows"))


def q38_extract_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["s_suppkey", "s_name", "s_acctbal"]
    rows = _tables_by(table(spark, sf_dir, "supplier"), "s_nationkey", F.col("s_suppkey"), F.col("s_name"), F.col("s_acctbal").cast("string"))
    return files.extracted(rows, "s_nationkey", lambda r: ("x.csv", files.delimited([names, *[list(x.values()) for x in r["rows"]]])))


def q39_extract_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book per customer: orders with their price to two digits and their day."""
    day = F.unix_date(F.col("o_orderdate").cast("date")) + 25569
    rows = _tables_by(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey"), F.col("o_totalprice"), day)
    return files.extracted(rows, "o_custkey", lambda r: ("x.xlsx", files.xlsx(f"c{r['o_custkey']}", [list(x.values()) for x in r["rows"]], ["General", "0.00", "yyyy-mm-dd"])))


def q40_extract_fods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tables_by(table(spark, sf_dir, "nation"), "n_regionkey", F.col("n_nationkey"), F.col("n_name"))
    return files.extracted(rows, "n_regionkey", lambda r: ("x.fods", files.fods(f"r{r['n_regionkey']}", [[str(v) for v in x.values()] for x in r["rows"]])))


def q41_extract_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn as the body, the others attached."""
    make = lambda r: ("x.eml", files.eml(f"conv {r['conv_id']}", r["texts"][0], {f"t{k}.txt": t for k, t in enumerate(r["texts"][1:], 1)}))
    return files.extracted(_turns(spark, sf_dir), "conv_id", make)


def q42_extract_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for every 40 ids, of which the limits let some members through."""
    docs = table(spark, sf_dir, "documents").withColumn("archive", F.floor(F.col("doc_id") / 40))
    rows = _tables_by(docs, "archive", F.col("doc_id"), F.col("text"))
    make = lambda r: ("x.zip", files.zipped({f"{x['c0']}.txt": x["c1"] for x in r["rows"]}))
    return files.extracted(rows, "archive", make, Options(archive_members=MEMBERS, archive_bytes=BYTES)).withColumn("texto", F.md5(F.col("texto").cast("binary")))


def q43_extract_rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return files.extracted(rows, "doc_id", lambda r: ("x.rtf", files.rtf(r["text"])))


def q44_extract_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extracted(_chats(spark, sf_dir), "conv_id", lambda r: ("chat.txt", r["text"].encode()))


QUERIES: dict[str, Query] = {name: f for name, f in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()}
