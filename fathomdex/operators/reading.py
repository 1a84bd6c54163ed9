"""Documents read back from chunks, lists and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import in_folder
from ..functions.text import trim

MOST_CHUNKS = 60


def page_span(first: int | None, most: int | None) -> tuple[int, int]:
    """(position of the first chunk, how many): from 0, 1 to 60 chunks, 60 for none or 0."""
    return max(0, int(first or 0)), max(1, min(int(most or MOST_CHUNKS), MOST_CHUNKS))


def assembled(chunks: DataFrame, first: int | None = None, most: int | None = None, by: str = "doc_id") -> DataFrame:
    """Per document: total_fragmentos, desde_fragmento, hasta_fragmento, siguiente_fragmento and texto.

    A page's number is written before its first chunk in the selection where it
    differs from the last number before; chunks without a number don't reset it.
    Chunk ids are dense, so a position is an id. A selection holds at most 60 chunks.
    """
    since, count = page_span(first, most)
    totals = chunks.groupBy(by).agg(F.count("*").cast("int").alias("total_fragmentos"))
    some = chunks.where((F.col("chunk_id") >= since) & (F.col("chunk_id") < since + count))
    order = Window.partitionBy(by).orderBy("chunk_id")
    before = F.last("page", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("page").isNotNull() & ~F.col("page").eqNullSafe(before)
    mark = F.when(new, F.concat(F.lit("\n\n[pág. "), F.col("page").cast("string"), F.lit("]\n"))).otherwise(F.lit(""))
    piece = F.concat(mark, F.coalesce("texto", F.lit("")), F.lit("\n"))
    rows = some.withColumn("_piece", piece).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("chunk_id", "_piece"))).alias("_p"))
    text = trim(F.array_join(F.transform("_p", lambda x: x["_piece"]), ""))
    until = F.least(F.lit(since + count), F.col("total_fragmentos"))
    out = totals.join(rows.select(by, text.alias("texto")), by, "left")
    return out.select(
        by, "total_fragmentos", F.lit(since).alias("desde_fragmento"), until.alias("hasta_fragmento"),
        F.when(until < F.col("total_fragmentos"), until).alias("siguiente_fragmento"), F.coalesce("texto", F.lit("")).alias("texto"),
    )


def listing(registry: DataFrame, folder: str | None = None) -> DataFrame:
    """Indexed documents in the order of their logical paths, as people sort them."""
    rows = registry.where(in_folder(F.col("ruta_relativa"), folder))
    return rows.select(
        "doc_id", "raiz", "ruta_relativa", F.coalesce("num_chunks", F.lit(0)).alias("fragmentos"), F.col("num_pages").alias("paginas"),
        F.coalesce("sin_ocr", F.lit(False)).alias("sin_ocr"), F.col("indexed_at").alias("fecha_indexado"),
    ).orderBy(F.collate("ruta_relativa", "UNICODE"), "doc_id")


def totals(registry: DataFrame, path: Column | str = "path") -> DataFrame:
    """One row: documents that could be read, their chunks, and the paths of those that couldn't."""
    unread = F.coalesce(F.col("sin_ocr"), F.lit(False))
    return registry.agg(
        F.count_if(~unread).alias("documentos"), F.coalesce(F.sum("num_chunks"), F.lit(0)).cast("long").alias("fragmentos"),
        F.sort_array(F.collect_list(F.when(unread, path))).alias("sin_ocr"),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row of counts by state; ``outcomes``: estado and fragmentos."""
    count = lambda *states: F.count_if(F.col("estado").isin(*states))
    return outcomes.agg(
        count("indexado").alias("indexados"), count("sin_cambios").alias("sin_cambios"), count("sin_ocr").alias("sin_ocr"),
        count("omitido", "vacio").alias("omitidos"), count("error").alias("errores"),
        F.coalesce(F.sum(F.when(F.col("estado") == "indexado", F.col("fragmentos"))), F.lit(0)).cast("long").alias("fragmentos_nuevos"),
    )
