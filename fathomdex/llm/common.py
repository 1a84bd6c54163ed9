"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, named by ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a folder of its own; a cluster has no
    safe default, so there it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    sc.setCheckpointDir(tempfile.mkdtemp(dir="/tmp/checkpoints"))
    return sc.getCheckpointDir()


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet into the shared folder and read again.

    This cuts the lineage at files that outlive any executor. The table goes when
    the application ends, or earlier by ``unstage``.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    fs, path = _path(spark, where)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._staged_at = where
    return out


def unstage(*dfs: DataFrame) -> None:
    """Deletes tables that ``staged`` wrote and that nothing needs any more."""
    for df in dfs:
        fs, path = _path(df.sparkSession, df._staged_at)
        fs.delete(path, True)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows; Spark bounds a batch by its bytes, this what Python makes of it at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fields(df: DataFrame, *without: str) -> str:
    """The columns as the schema of a function's result begins with them."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def packed(df: DataFrame) -> Column:
    """The whole row as ``_row``, so that no name of its columns can clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def word_count(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id written in decimal; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document belongs to the fold that is never learned from. A null id has no label, so false."""
    return F.coalesce(id_crc(doc_id) % folds == fold, F.lit(False))


#: Groups whose counts may be broadcast.
BROADCAST_GROUPS = 100_000


def bounded_sample(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """About ``most`` rows, the same ones in each run, picked by hash of their ``doc_id``.

    With ``by``, about ``most`` rows of each value of those columns. The counts are
    taken over all rows and come along as ``_n``; a group of no more than ``most`` rows is kept whole.
    """
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    if by:
        counts = staged(counts, "counts")
        joined = rows.join(F.broadcast(counts) if counts.count() <= BROADCAST_GROUPS else counts, list(by))
    else:
        joined = rows.crossJoin(F.broadcast(counts))  # one row
    return joined.where(unit < F.lit(float(most)) / F.col("_n"))
