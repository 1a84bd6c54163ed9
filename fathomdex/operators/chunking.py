"""Chunks: overlapping windows of words within pages, numbered through the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, words


def words_for(tokens: int) -> int:
    """Words that about so many tokens make."""
    return max(1, int(tokens / 1.4))


def sizes(chunk_tokens: int = 512, overlap_tokens: int = 64) -> tuple[int, int]:
    """(words of a chunk, words that it shares with the one before)."""
    size = words_for(chunk_tokens)
    return size, min(words_for(overlap_tokens), size - 1)


def windows(text: Column, size: int, overlap: int) -> Column:
    """The windows of a page as an array of texts; the last one is the first that reaches the end."""
    step = max(1, size - overlap)

    def cut(own: Column) -> Column:
        count = F.when(F.size(own) == 0, 0).when(F.size(own) <= size, 1).otherwise(1 + F.ceil((F.size(own) - size) / F.lit(step))).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice(own, k * step + 1, F.lit(size)), " "))

    return let(words(text), cut)


def chunk_pages(pages: Column, size: int, overlap: int) -> Column:
    """An array of (page, texto) over all pages of a document, in order."""
    each = F.transform(pages, lambda p: F.transform(windows(p["text"], size, overlap), lambda w: F.struct(p["page"].alias("page"), w.alias("texto"))))
    return F.flatten(each)


def explode_chunks(docs: DataFrame, pages: str = "pages", size: int = 365, overlap: int = 45) -> DataFrame:
    """A row per chunk: the columns of ``docs`` but its pages, chunk_id, page and texto.

    The pages of a document are one array, so numbering needs no shuffle.
    """
    kept = [c for c in docs.columns if c != pages]
    out = docs.select(*kept, F.posexplode(chunk_pages(F.col(pages), size, overlap)).alias("chunk_id", "_chunk"))
    return out.select(*kept, "chunk_id", F.col("_chunk.page").alias("page"), F.col("_chunk.texto").alias("texto"))
